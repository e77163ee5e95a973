"""Text helpers, ``Column -> Column``, all inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions.vocabulary import BIDI, STOPWORDS

#: A word character in the sense of Unicode letters, digits and the underscore, in Java's and RE2's syntax alike.
W = r"\p{L}\p{N}_"


def _letters(form: str, drop_marks: bool) -> dict[str, str]:
    """Every character of the basic plane that Unicode's ``form`` turns into one other character."""
    table = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        to = unicodedata.normalize(form, c)
        if drop_marks:
            to = "".join(x for x in to if not unicodedata.combining(x))
        if len(to) == 1 and to != c:
            table[c] = to
    return table


_FOLDED = {**_letters("NFKD", True), "ı": "i", "İ": "i"}
#: ``translate`` arguments: marked letters to plain ones; combining marks, which stand last and have no counterpart, go.
_MARKED, _PLAIN = "".join(_FOLDED) + "".join(map(chr, range(0x300, 0x370))), "".join(_FOLDED.values())
#: Compatibility forms (full-width letters, hard blanks) to the usual ones.
_FORMS = _letters("NFKC", False)


def lower_tr(text: Column) -> Column:
    """Lower case in which a capital dotless I becomes ı and a capital dotted İ becomes i."""
    return F.lower(F.replace(F.replace(text, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))


def without_bidi(text: Column) -> Column:
    return F.translate(text, BIDI, "")


def plain_name(text: Column) -> Column:
    """A name without marks on letters, in lower case, single spaced."""
    return F.lower(F.trim(F.regexp_replace(F.translate(without_bidi(text), _MARKED, _PLAIN), r"\s+", " ")))


def plain_name_value(text: str) -> str:
    """:func:`plain_name` of a literal."""
    table = str.maketrans(_MARKED[: len(_PLAIN)], _PLAIN, _MARKED[len(_PLAIN) :] + BIDI)
    return " ".join(text.translate(table).split()).lower()


def usual_forms(text: Column) -> Column:
    """Compatibility characters as the usual ones, so that look-alikes are equal."""
    return F.translate(text, "".join(_FORMS), "".join(_FORMS.values()))


def tidy_lines(text: Column) -> Column:
    """Exotic blanks to plain ones, runs of blanks to one, each line and the whole trimmed."""
    plain = F.regexp_replace(F.translate(text, "\u00a0\u202f\u2007", "   "), r"[ \t]+", " ")
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once for a row, as the one element of an array; written out it would be worked out again at each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether one of ``words`` occurs; one codegen'd disjunction that stops at the first hit."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def first_of(text: Column, groups: Iterable[tuple[str, Iterable[str]]], otherwise: Column | None = None) -> Column:
    """The name of the first group of which a word occurs."""
    groups = [(name, tuple(words)) for name, words in groups]
    hits = lambda t: [F.when(has_any(t, words), F.lit(name)) for name, words in groups]
    return bound(text, lambda t: F.coalesce(*hits(t), F.lit(None).cast("string") if otherwise is None else otherwise))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_tr(text), F.lit(f"[{W}]+"), F.lit(0))


def stems(text: Column, stopwords: Iterable[str] = STOPWORDS, length: int = 5) -> Column:
    """Content words cut to their first ``length`` characters, with repeats, in order."""
    kept = F.filter(words(text), lambda w: (F.char_length(w) > 2) & ~w.isin(*stopwords))
    return F.transform(kept, lambda w: F.substring(w, 1, length))


def replaced(text: Column, pattern: str, put: Callable[[Column], Column], hint: Column | None = None) -> Column:
    """Every match of ``pattern`` replaced by ``put(match)``: the pieces between and the matches, zipped.

    ``hint`` is a cheap test that holds for every text with a match; other texts are left alone.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    done = F.array_join(F.zip_with(between, F.transform(found, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return done if hint is None else F.when(hint, done).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
