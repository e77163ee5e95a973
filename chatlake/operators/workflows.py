"""Rule-based workflows: states of clauses, the submission checklist, correction requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import vocabulary as v
from chatlake.functions.text import W, first_of, has_any, lower_tr, strip

CLAUSE_END = rf"[,.;\n]|(?<![{W}])(?i:ama|fakat|ancak)(?![{W}])"
_NEGATED_WORDS = ("yok", "değil", "eksik", "henüz", "olmadı", "hazırlanmadı")
NEGATION = rf"(?<![{W}])(?:[{W}]+m[aeı]d[ıi]m|{'|'.join(_NEGATED_WORDS)})(?![{W}])"


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, CLAUSE_END, -1), lambda c: lower_tr(strip(c))), lambda c: c != "")


def state_of(text: Column, words: Sequence[str]) -> Column:
    """True: mentioned; false: some mention is negated; null: not mentioned."""
    about = F.filter(clauses(text), lambda c: has_any(c, words))
    return F.when(F.size(about) == 0, F.lit(None).cast("boolean")).otherwise(~F.exists(about, lambda c: c.rlike(NEGATION)))


def checklist(df: DataFrame, text: str = "text", items=v.CHECKLIST_ITEMS) -> DataFrame:
    """Adds ``ready, missing, unknown, next_steps (array<string>), complete``."""
    out = df
    for key, _, words, _, _ in items:
        out = out.withColumn(f"__{key}", state_of(F.col(text), words))
    state = lambda key: F.col(f"__{key}")
    listed = lambda parts: F.array_compact(F.array(*parts))
    ready = listed([F.when(state(k), F.lit(label)) for k, label, *_ in items])
    missing = listed(
        [F.when(~state(k), F.lit(label)).when(state(k).isNull() & F.lit(must), F.lit(label + v.NOT_MENTIONED)) for k, label, _, must, _ in items]
    )
    unknown = listed([F.when(state(k).isNull() & F.lit(not must), F.lit(label)) for k, label, _, must, _ in items])
    complete = F.lit(True)
    for k, _, _, must, _ in items:
        if must:
            complete = complete & F.coalesce(state(k), F.lit(False))
    steps = listed(
        [F.when((~state(k)) | (state(k).isNull() & F.lit(must)), F.lit(step)) for k, _, _, must, step in items]
        + [F.when(complete, F.lit(v.STEP_COMPLETE)).otherwise(F.lit(v.STEP_INCOMPLETE))]
    )
    out = out.withColumns({"ready": ready, "missing": missing, "unknown": unknown, "next_steps": steps, "complete": complete})
    return out.drop(*[f"__{k}" for k, *_ in items])


def checklist_text() -> Column:
    """The checklist's columns as one text."""
    bullets = lambda c, none: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))
    unknown = F.when(F.size("unknown") > 0, F.concat(F.lit(v.CHECKLIST_TEXT["unknown"]), bullets(F.col("unknown"), ""))).otherwise(F.lit(""))
    steps = F.array_join(F.transform("next_steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat(
        F.lit(v.CHECKLIST_TEXT["ready"]), bullets(F.col("ready"), v.CHECKLIST_TEXT["none_ready"]), F.lit(v.CHECKLIST_TEXT["missing"]),
        bullets(F.col("missing"), v.CHECKLIST_TEXT["none_missing"]), unknown, F.lit(v.CHECKLIST_TEXT["steps"]), steps,
    )


def rule_card(title: str, lines: Sequence[str]) -> str:
    return "\n".join([title, *(f"- {x}" for x in lines)])


SUBMISSION_CARD, CHANNEL_CARD = rule_card(v.SUBMISSION_TITLE, v.SUBMISSION_RULES), rule_card(v.CHANNEL_TITLE, v.CHANNEL_RULES)

# ------------------------------------------------------------------ correction requests
_UP, _LOW = "A-ZÇĞİÖŞÜ", "a-zçğıöşü"
_NAME = rf"([{_UP}][{W}'’]+(?:\s+[{_UP}][{W}'’]+){{1,2}})"
NAME_LABELLED = rf"(?<![{W}])[Aa]d\s*[- ]?\s*[Ss]oyad\s*:\s*{_NAME}"
NAME_SAID = rf"(?<![{W}])(?:[Aa]d[ıi]m|[Aa]d[ıi]\s*[Ss]oyad[ıi]m|[İIi]smim|[Bb]en)\s*[:,]?\s+{_NAME}"
NAME_ALONE = rf"(?:^|\n)\s*([{_UP}][{_LOW}'’]+(?:\s+[{_UP}][{_LOW}'’]+){{1,2}})\s*(?:$|\n)"
ADDRESS = rf"[{W}.+-]+@[{W}-]+\.[{W}.-]+"


def name_of(text: Column) -> Column:
    found = lambda p: F.nullif(strip(F.regexp_extract(text, p, 1)), F.lit(""))
    alone = found(NAME_ALONE)
    alone = F.when(~F.substring_index(F.regexp_replace(lower_tr(alone), r"\s+", " "), " ", 1).isin(*v.NOT_NAMES), alone)
    return F.coalesce(found(NAME_LABELLED), found(NAME_SAID), alone)


def correction(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``intent, detected (map), missing_info, recommendation, confidence, suggested_email``; nothing is ever applied."""
    low, t = lower_tr(F.col(text)), F.col(text)
    out = df.withColumns({
        "__project": first_of(low, v.PROJECTS), "__language": first_of(low, v.LANGUAGES), "__status": first_of(low, v.STATUSES), "__name": name_of(t),
        "__email": F.when(t.rlike(ADDRESS), F.lit(v.EMAIL_GIVEN)),
    })
    has = lambda c: F.col(f"__{c}").isNotNull()
    intent = (
        F.when(has_any(low, v.LIST_WORDS), "list_correction").when(has("project"), "project_change").when(has("language"), "language_change").when(has("status"), "participation_status")
        .when(has_any(low, v.NAME_WORDS), "name_correction").otherwise("unknown")
    )
    out = out.withColumn("intent", intent)
    vague = F.col("intent").isin("list_correction", "unknown") & ~(has("project") | has("language") | has("status"))
    missing = F.array_compact(F.array(F.when(~has("name"), F.lit("full_name")), F.when(~has("email"), F.lit("email")), F.when(vague, F.lit("requested_change"))))
    fields = (("project", "project"), ("language", "language"), ("status", "status"), ("full_name", "name"), ("email", "email"))
    pairs = F.create_map(*[x for k, c in fields for x in (F.lit(k), F.col(f"__{c}"))])
    out = out.withColumn("missing_info", missing).withColumn("detected", F.map_filter(pairs, lambda k, x: x.isNotNull()))
    n = F.size("missing_info")
    advice = F.when(n > 0, F.concat(F.lit(v.ADVICE_MISSING[0]), F.array_join("missing_info", ", "), F.lit(v.ADVICE_MISSING[1]))).otherwise(F.lit(v.ADVICE_CLEAR))
    name, address = F.coalesce("__name", F.lit(v.EMAIL_NAME)), F.when(has("email"), v.EMAIL_ADDRESSES[0]).otherwise(v.EMAIL_ADDRESSES[1])
    line = lambda title, c: F.when(has(c), F.concat(F.lit(f"\n{title}: "), F.col(f"__{c}"))).otherwise(F.lit(""))
    email = F.concat(
        F.lit(v.EMAIL_DRAFT[0]), name, F.lit(v.EMAIL_DRAFT[1]), address, F.lit("."),
        *[line(title, c) for title, c in v.EMAIL_LINES], F.lit(v.EMAIL_DRAFT[2]), name,
    )
    out = out.withColumns({"recommendation": advice, "confidence": F.when(n > 1, "low").when(n == 1, "medium").otherwise("high"), "suggested_email": email})
    return out.drop("__project", "__language", "__status", "__name", "__email")
