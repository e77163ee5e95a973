"""Pieces of DuckDB SQL from which the queries' counterparts are put together."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from chatlake.functions import masking
from chatlake.functions import vocabulary as v
from chatlake.functions.text import W


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool | int | float):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: Sequence[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def low(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def any_of(x: str, words: Iterable[str], ends: bool = False) -> str:
    return "(" + " OR ".join(f"{'suffix' if ends else 'contains'}({x}, {literal(w)})" for w in words) + ")"


def case_of(x: str, groups: Iterable[tuple[str, Iterable[str]]], equal: bool = False) -> str:
    test = lambda words: f"{x} IN ({', '.join(map(literal, words))})" if equal else any_of(x, words)
    return "CASE " + " ".join(f"WHEN {test(words)} THEN {literal(name)}" for name, words in groups) + " END"


def stems_sql(x: str) -> str:
    words = f"regexp_extract_all({low(x)}, '[{W}]+')"
    return f"list_transform(list_filter({words}, lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(literal, v.STOPWORDS))})), lambda w: substr(w, 1, 5))"


def replaced_sql(x: str, pattern: str, put: str) -> str:
    """Every match ``m`` of ``pattern`` (a SQL literal) replaced by the expression ``put``."""
    found = f"list_concat(list_transform(regexp_extract_all({x}, {pattern}), lambda m: {put}), [''])"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {pattern}), {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def _below(host: str, domains: Iterable[str]) -> str:
    return any_of(f"('.' || {host})", ["." + d for d in domains], ends=True)


def masked_chain(x: str, steps: Sequence[str], base: str | None = None) -> str:
    """The masking steps one inside the other, after the roster rows if ``base`` says so."""
    out = x
    if base == "rosters":
        row = f"regexp_matches(x, {literal(masking.ROSTER_ROW)})"
        lines = f"string_split({out}, chr(10))"
        before = f"regexp_matches({lines}[i - 1], {literal(masking.ROSTER_ROW)})"
        marked = f"list_transform({lines}, lambda x, i: CASE WHEN NOT {row} THEN x WHEN i > 1 AND {before} THEN NULL ELSE {literal(v.ROSTER_MARK)} END)"
        out = f"array_to_string(list_filter({marked}, lambda x: x IS NOT NULL), chr(10))"
    for step in steps:
        if step == "contacts":
            out = f"regexp_replace({out}, {literal(masking.CONTACT)}, {literal(v.ROSTER_MARK)}, 'g')"
        elif step == "emails":
            domain = "lower(split_part(m, '@', -1))"
            put = (
                f"CASE WHEN {domain} IN ({', '.join(map(literal, v.DOCUMENTATION_DOMAINS))}) THEN m WHEN {_below(domain, v.OFFICIAL_DOMAINS)} THEN {literal(v.OFFICIAL_EMAIL_MARK)} "
                f"ELSE {literal(v.EMAIL_MARK)} END"
            )
            out = replaced_sql(out, literal(masking.EMAIL), put)
        elif step == "urls":
            host = "regexp_replace(lower(split_part(split_part(regexp_replace(m, '(?i)^https?://', ''), '/', 1), '?', 1)), '^www\\.', '')"
            public = f"(NOT {_below(host, v.PRIVATE_HOSTS)} AND {_below(host, (*v.PUBLIC_HOSTS, *v.DOCUMENTATION_DOMAINS))})"
            out = replaced_sql(out, literal(masking.URL), f"CASE WHEN {public} THEN m ELSE {literal(v.URL_MARK)} END")
        elif step == "phones":
            digits = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
            is_phone = f"({digits} BETWEEN 10 AND 15 AND NOT regexp_matches(m, {literal(masking.DATE)}) AND (regexp_matches(m, '[\\s\\x{{a0}}.\\-]') OR starts_with(m, '+')))"
            out = replaced_sql(out, literal(masking.PHONE), f"CASE WHEN {is_phone} THEN {literal(v.PHONE_MARK)} || regexp_extract(m, '[.\\-\\s\\x{{a0}}]+$') ELSE m END")
        elif step == "handles":
            pattern = literal(rf"(?:^|[^{W}./])@[A-Za-z0-9_.]{{3,32}}")
            name = "lower(regexp_extract(m, '@(.*)', 1))"
            kept = ", ".join(map(literal, v.KEPT_MENTIONS))
            out = replaced_sql(out, pattern, f"CASE WHEN {name} IN ({kept}) THEN m ELSE CASE WHEN starts_with(m, '@') THEN '' ELSE m[1] END || {literal(v.HANDLE_MARK)} END")
    return out
