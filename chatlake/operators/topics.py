"""Topics of texts and questions, modes, lanes: predicates over word lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import vocabulary as v
from chatlake.functions.text import bound, first_of, has_any, lower_tr

Groups = Mapping[str, Sequence[str]]


def chunk_topic(text: Column, source: Column, groups: Groups = v.CHUNK_TOPICS, by_source: Groups = v.SOURCE_TOPICS, otherwise: str = "general") -> Column:
    """The first group with a word in the text, else in the source's name."""
    return F.coalesce(first_of(lower_tr(text), groups.items()), first_of(lower_tr(F.coalesce(source, F.lit(""))), by_source.items()), F.lit(otherwise))


def is_programme_topic(text: Column, programme: Sequence[str] = v.PROGRAMME, groups: Groups = v.QUERY_TOPICS) -> Column:
    words = [*programme, *(w for ws in groups.values() for w in ws)]
    return bound(lower_tr(text), lambda low: has_any(low, words))


def query_topic(query: Column, mode: Column, groups: Groups = v.QUERY_TOPICS, low: Column | None = None) -> Column:
    """A mode other than question answering decides; else the words do."""
    return (
        F.when(mode == v.TECHNICAL, "technical").when(mode == v.CHECKLIST, "submission").when(mode == v.CORRECTION, "correction")
        .otherwise(first_of(lower_tr(query) if low is None else low, groups.items(), F.lit("general")))
    )


# These take the text's lower case where a caller has it, so that it is made once for a row.


def is_requirement_query(text: Column, low: Column | None = None) -> Column:
    def asks(low: Column) -> Column:
        hands_in = F.contains(low, F.lit("teslim")) & has_any(low, v.REQUIREMENT_WORDS)
        return ~has_any(low, v.STATUS_WORDS) & (hands_in | (has_any(low, v.CODE_WORDS) & has_any(low, v.CONTENTS_WORDS)))

    return bound(lower_tr(text), asks) if low is None else asks(low)


def is_channel_query(text: Column, low: Column | None = None) -> Column:
    asks = lambda low: F.contains(low, F.lit("whatsapp")) & has_any(low, v.CHANNEL_WORDS)
    return bound(lower_tr(text), asks) if low is None else asks(low)


def suggested_mode(text: Column, groups: Groups = v.MODE_WORDS, low: Column | None = None) -> Column:
    return first_of(lower_tr(text) if low is None else low, groups.items(), F.lit(v.QA))


def resolved_mode(text: Column, requested: Column) -> Column:
    return F.when(requested != v.QA, requested).when(is_requirement_query(text) | is_channel_query(text), v.CHECKLIST).otherwise(suggested_mode(text))


def lanes(spark, allowed: Mapping[str, Sequence[str]] = v.ALLOWED) -> DataFrame:
    """``topic, category``: which categories may answer a topic."""
    return spark.createDataFrame([(t, c) for t, cs in allowed.items() for c in cs], "topic string, category string")


def is_participant_question(role: Column, text: Column) -> Column:
    bare = F.trim(text)
    return (role == "participant") & (bare.endswith("?") | (F.contains(bare, F.lit("?")) & ~F.contains(F.lower(bare), F.lit("eğitmen:"))))


def in_lane(results: DataFrame, allowed: DataFrame, query: str = "query_id") -> DataFrame:
    """``results(query, topic, category, role, text, ...)`` of allowed categories; participants' questions go unless nothing else is left."""
    kept = results.join(F.broadcast(allowed), ["topic", "category"], "left_semi")
    official = F.max((~is_participant_question(F.col("role"), F.col("text"))).cast("int")).over(Window.partitionBy(query))
    kept = kept.withColumn("__any", official)
    return kept.where((F.col("__any") == 0) | ~is_participant_question(F.col("role"), F.col("text"))).drop("__any").select(*results.columns)
