"""Hybrid retrieval of a batch of questions: gate, two candidate lists, fusion, weights, filters, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chatlake.functions import vocabulary as v
from chatlake.functions.text import stems
from chatlake.operators.embedding import HASHING, cosine_topk, embedded
from chatlake.operators.index import Index, bm25, bm25_topk, gate
from chatlake.sources.shared import materialized

# Scores below which nothing counts as evidence, and the gate's share, by embedding backend; the authority's weights by mode.
CALIBRATION = {"hashing": (0.10, 0.5), "sentence-transformers": (0.30, 0.5), "foundry-local": (0.30, 0.5)}
FALLBACK = (0.20, 0.5)
MODE_WEIGHTS = {v.QA: (0.35, 0.55), v.CHECKLIST: (0.35, 0.6), v.CORRECTION: (0.35, 0.6), v.TECHNICAL: (0.15, 0.2)}


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 6
    pool: int = 30
    dense_weight: float = 0.65
    lexical_weight: float = 0.35
    boost: float = 0.25
    penalty: float = 0.5
    recency_weight: float = 0.10
    half_life_days: float = 45.0
    diversity: float = 0.72
    duplicate: float = 0.85
    max_df_ratio: float = FALLBACK[1]
    min_score: float = FALLBACK[0]

    @classmethod
    def calibrated_for(cls, backend: str, **more) -> RetrievalConfig:
        least, share = CALIBRATION.get(backend, FALLBACK)
        return replace(cls(min_score=least, max_df_ratio=share), **more)


def saturated(x: Column, midpoint: float = 8.0) -> Column:
    return F.when(x > 0, x / (x + midpoint)).otherwise(0.0)


def recency(start: Column, latest: Column, half_life_days: float) -> Column:
    days = F.greatest((F.unix_micros(latest.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0))
    return F.coalesce(F.pow(F.lit(0.5), days / half_life_days), F.lit(0.0))


def authority(role: Column, ratio: Column, boost: Column, penalty: Column) -> Column:
    return F.when(role == "document", 1.0).otherwise((1 + boost * ratio) * (1 - penalty * (1 - ratio)))


def fused(dense: DataFrame, lexical: DataFrame, query: str, key: str, pool: int, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query, key, dense, bm25`` of both candidate lists; a candidate of one list still gets its other score if it has one.

    ``lookup(pairs)`` gives the lexical scores of the dense candidates without all others; by default they are looked up in ``lexical`` itself.
    """
    best = Window.partitionBy(query).orderBy(F.desc(F.round("bm25", 9)), key)
    top = lexical.where("bm25 > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pool).select(query, key, "bm25")
    pairs = dense.select(query, key)
    other = (lookup(pairs) if lookup else lexical.join(pairs.distinct(), [query, key], "left_semi")).select(query, key, F.col("bm25").alias("other"))
    both = dense.select(query, key, F.col("score").alias("dense")).join(other, [query, key], "left").join(top, [query, key], "full_outer")
    return both.select(query, key, F.greatest(F.coalesce("dense", F.lit(0.0)), F.lit(0.0)).alias("dense"), F.coalesce("bm25", "other", F.lit(0.0)).alias("bm25"))


def few(candidates: DataFrame, name: str = "pool", most: int = 1_000_000) -> DataFrame:
    """``candidates``, at most twice a pool for each question, written once; up to ``most`` rows go to the tables they are joined with, so that no text is shuffled."""
    rows = materialized(candidates, name)
    return F.broadcast(rows) if rows.count() <= most else rows


def scored(candidates: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Adds ``lexical, relevance, score, authority_boost, recency_boost`` to rows with ``dense, bm25, role, instructor_ratio, start_time, latest, boost, penalty``."""
    rows = candidates.withColumn("lexical", saturated(F.col("bm25"))).withColumn("relevance", config.dense_weight * F.col("dense") + config.lexical_weight * F.col("lexical"))
    rows = rows.withColumn("__a", authority(F.col("role"), F.col("instructor_ratio"), F.col("boost"), F.col("penalty")))
    rows = rows.withColumn("__r", 1 + config.recency_weight * recency(F.col("start_time"), F.col("latest"), config.half_life_days))
    return (
        rows.withColumn("score", F.col("relevance") * F.col("__a") * F.col("__r"))
        .withColumn("authority_boost", F.col("relevance") * F.col("__r") * (F.col("__a") - 1))
        .withColumn("recency_boost", F.col("relevance") * F.col("__a") * (F.col("__r") - 1)).drop("__a", "__r")
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def diversified(pool: DataFrame, limit: int, query: str = "query_id", key: str = "chunk_id", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``query, key, place``: greedy maximal marginal relevance over ``pool(query, key, score, text)``, near copies of a chosen one never chosen.

    The pools are sorted by question and stream by: a task holds the stems of one question's pool at a time, at most twice the length of a candidate list.
    A row without a score is never chosen.
    """
    lam, dup = config.diversity, config.duplicate
    rows = pool.where(F.col("score").isNotNull()).select(query, key, (-F.round("score", 12)).alias("n"), F.array_distinct(stems(F.col("text"))).alias("stems"))

    def near(a: set | None, b: set | None) -> float | None:
        if a == set() or b == set():
            return 0.0
        if a is None or b is None:  # nothing is known of a missing text
            return None
        both = len(a & b)
        return both / (len(a) + len(b) - both)

    def chosen(group: pa.Table) -> pa.Table:
        keys, n = group.column(1).to_pylist(), group.column(2).to_pylist()
        sets = [None if s is None else set(s) for s in group.column(3).to_pylist()]
        rest = sorted(range(len(keys)), key=lambda i: (n[i], keys[i] is not None, keys[i]))
        taken, nearest = [], [None] * len(keys)
        while rest and len(taken) < max(limit, 1):
            best = rest[0] if not taken else max((i for i in rest if nearest[i] is not None and nearest[i] < dup), key=lambda i: -lam * n[i] - (1 - lam) * nearest[i], default=None)
            if best is None:
                break
            taken.append(best)
            rest.remove(best)
            for i in rest:
                x = near(sets[i], sets[best])
                nearest[i] = max((y for y in (nearest[i], x) if y is not None), default=None)
        own = group.select([0, 1]).take(pa.array(taken, pa.int32()))
        return own.append_column("place", pa.array(range(1, len(taken) + 1), pa.int32()))

    return rows.groupBy(query).applyInArrow(chosen, StructType([rows.schema[query], rows.schema[key], StructField("place", IntegerType(), False)]))


def retrieve(
    queries: DataFrame, index: Index, config: RetrievalConfig | None = None, top_k: int | None = None, authority_only: bool = False, sources: Iterable[str] | None = None,
) -> DataFrame:
    """``query_id, place, score, dense, lexical, authority_boost, recency_boost`` and the chunk's columns, for ``queries(query_id, text, mode)``."""
    config = config or RetrievalConfig.calibrated_for(index.backend.name)
    limit = top_k or config.top_k
    weights = queries.sparkSession.createDataFrame([(m, *w) for m, w in MODE_WEIGHTS.items()], "mode string, boost double, penalty double")
    lex = index.texts
    asked = queries.where(F.trim("text") != "")
    passed = asked.join(gate(asked, lex, config.max_df_ratio).where("passes"), "query_id", "left_semi")
    dense = cosine_topk(embedded(passed, "query_id", "text", index.backend), index.vectors, config.pool)
    # At most ``pool`` rows for each question, read twice.
    dense = few(dense, "dense")
    both = few(fused(dense, bm25_topk(passed, lex, config.pool), "query_id", "chunk_id", config.pool, lambda pairs: bm25(passed, lex, pairs=pairs)))
    latest = index.chunks.agg(F.max("start_time").alias("latest"))
    modes = passed.select("query_id", "mode").join(F.broadcast(weights), "mode", "left").fillna({"boost": config.boost, "penalty": config.penalty}).drop("mode")
    rows = scored(both.join(index.chunks, "chunk_id").join(F.broadcast(latest)).join(modes, "query_id"), config)
    if authority_only:
        rows = rows.where("role = 'instructor'")
    if sources is not None:
        rows = rows.where(F.col("source").isin(*sources))
    # At most twice ``pool`` rows for each question, read for the choice among them and for their columns.
    rows = materialized(rows.where(F.col("score") >= config.min_score).drop("boost", "penalty", "latest", "bm25", "relevance"), "candidates")
    return rows.join(diversified(rows.select("query_id", "chunk_id", "score", "text"), limit, config=config), ["query_id", "chunk_id"])


def explanation(df: DataFrame) -> Column:
    two = lambda c: F.format_string("%.2f", F.col(c))
    who = F.when(F.col("authority_boost") > 0, F.concat(F.lit("eğitmen+"), two("authority_boost"))).when(F.col("authority_boost") < 0, F.concat(F.lit("katılımcı"), two("authority_boost")))
    new = F.when(F.col("recency_boost") != 0, F.concat(F.lit("güncellik+"), two("recency_boost")))
    return F.concat_ws(", ", F.concat(F.lit("anlamsal="), two("dense")), F.concat(F.lit("kelime="), two("lexical")), who, new)


__all__ = ["HASHING", "RetrievalConfig", "retrieve", "diversified", "fused", "scored", "jaccard"]
