"""Triage of incoming messages: what they want, and who may answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import vocabulary as v
from chatlake.functions.text import W, bound, first_of, has_any, lower_tr
from chatlake.operators import topics
from chatlake.operators.answering import ask
from chatlake.operators.index import Index

_MARKS = [v.EMAIL_MARK, v.PHONE_MARK, v.URL_MARK, v.HANDLE_MARK, v.OFFICIAL_EMAIL_MARK, v.ROSTER_MARK]
PERSONAL = "|".join(
    [*(m.replace("[", r"\[").replace("]", r"\]") for m in _MARKS), rf"[{W}.+-]+@[{W}-]+\.[{W}.-]+",
     r"(?:\+90|0)\s*[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{2}[\s-]?[0-9]{2}", rf"(?:^|[^{W}])[0-9]{{11}}(?:[^{W}]|$)"]
)


def intent_of(text: Column) -> Column:
    """Narrow questions first, broad vocabulary last. The lower case, the hint and the topic are each worked out once for a row."""

    def by_topic(topic: Column) -> Column:
        return (
            F.when(topic == "correction", "correction_request").when(topic == "technical", "technical_help").when(topic == "roster", "roster_continue")
            .when(topic == "submission", "submission_requirement").otherwise("unknown")
        )

    def by_hint(low: Column, hint: Column) -> Column:
        return (
            F.when(hint == v.CORRECTION, "correction_request").when(has_any(low, v.CERTIFICATE_WORDS), "certificate").when(hint == v.TECHNICAL, "technical_help")
            .when(hint == v.CHECKLIST, "submission_requirement").otherwise(bound(topics.query_topic(text, F.lit(v.QA), low=low), by_topic))
        )

    def of(low: Column) -> Column:
        return (
            F.when(F.trim(text) == "", "unknown").when(topics.is_channel_query(text, low), "submission_channel").when(topics.is_requirement_query(text, low), "submission_requirement")
            .otherwise(bound(topics.suggested_mode(text, low=low), lambda hint: by_hint(low, hint)))
        )

    return bound(lower_tr(text), of)


def mode_of(intent: Column) -> Column:
    return bound(intent, lambda x: F.coalesce(*[F.when(x == i, F.lit(m)) for i, m in v.INTENT_MODES.items()]))


def sensitive_topic(text: Column) -> Column:
    return first_of(lower_tr(text), ((label, (word,)) for word, label in v.SENSITIVE))


def carries_personal_data(text: Column) -> Column:
    return text.rlike(PERSONAL)


def is_rule_backed(structured: Column) -> Column:
    return F.coalesce(F.get_json_object(structured, "$.tur").isin("teslim_kurallari", "teslim_kanali"), F.lit(False))


def decision(text: Column, intent: Column, evidence: Column, rule_backed: Column) -> Column:
    """``struct(decision, reason)``; the first rule that holds."""
    topic, human = sensitive_topic(text), "needs_human_approval"
    out = lambda d, reason: F.struct(F.lit(d).alias("decision"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    hot = F.concat(F.lit(v.REASONS["sensitive"][0]), topic, F.lit(v.REASONS["sensitive"][1]))
    return (
        F.when(evidence == "none", out("do_not_answer", v.REDIRECT)).when(intent == "correction_request", out(human, v.REASONS["correction"])).when(topic.isNotNull(), out(human, hot))
        .when(carries_personal_data(text), out(human, v.REASONS["personal"])).when((evidence == "low") & rule_backed, out(human, v.REASONS["card"]))
        .when(evidence == "low", out("do_not_answer", v.REASONS["weak"] + v.REDIRECT)).otherwise(out("draft_reply", v.REASONS["draft"]))
    )


def triage(messages: DataFrame, index: Index, key: str = "message_id") -> DataFrame:
    """``messages(key, text, ...)`` with intent, mode, evidence, decision, reason and draft; a human always decides, nothing is sent."""
    rows = messages.withColumn("intent", intent_of(F.col("text")))
    answers = ask(rows.select(F.col(key).alias("query_id"), "text", mode_of(F.col("intent")).alias("mode")), index).drop("question")
    rows = rows.join(answers.withColumnRenamed("query_id", key), key)
    rows = rows.withColumn("__d", decision(F.col("text"), F.col("intent"), F.col("evidence"), is_rule_backed(F.col("structured"))))
    rows = rows.withColumn("reply_decision", F.col("__d.decision")).withColumn("reason", F.col("__d.reason")).drop("__d")
    draft = F.when(F.col("reply_decision") == "do_not_answer", F.lit("")).otherwise(F.col("answer"))
    return rows.withColumn("draft", draft).withColumn("requires_human", F.lit(True)).withColumn("auto_send", F.lit(False))
