"""Language identification: nearest of several clustered centroids per language, by cosine, with distance-based rejection.

A text is its lower-cased letters with one blank between runs; its 1-, 2- and 3-grams of code points are hashed to ``dims``
places, weighted by (1 + ln count) * idf, and scaled to length one. Each language has up to ``clusters`` centroids from spherical
k-means with farthest-first starts. The language of the nearest centroid is predicted; a text farther from it than
``reject_quantile`` of that cluster's own members were, less a margin, is marked as rejected.

Document frequencies count all training rows. Only the centroids are fitted on a bounded sample: per language, the ``sample_docs`` training
rows with the least hash of their id, whole texts. Training rows are those with a language, a text with a letter, a doc_id,
and a fold (crc32 of the id's text modulo ``folds``) other than 0. Language, source and id are never inputs of a prediction. The model, which
every task gets, holds at most ``clusters`` vectors of 2**``dims_bits`` floats for each language, so it grows with the languages alone.

Defined results: null texts and texts without a letter give ``und`` with score 0, not rejected; without any training row all texts do;
a null doc_id is never trained on and not held out; repeated rows give equal rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import broadcast_if_small
from chatlake.llm.sampling import hash_cut

_K = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    dims_bits: int = 12
    clusters: int = 3
    rounds: int = 8
    sample_docs: int = 1500
    folds: int = 5
    reject_quantile: float = 0.01
    reject_margin: float = 0.05
    broadcast_rows: int = 500_000  # longer tables of languages or sampled ids are joined by a shuffle


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None, bits: int) -> np.ndarray | None:
    """Counts of hashed n-grams; None if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[points] if len(points) else np.zeros(0, dtype=bool)
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of the places after a run stands for the blank
    a = np.where(letter, points, 0)[kept].astype(np.uint64)
    a = np.concatenate([np.zeros(1, dtype=np.uint64), a, np.zeros(1, dtype=np.uint64)])
    two = a[:-1] << np.uint64(21) | a[1:]
    grams = [a[a > 0] + np.uint64(1 << 63), two + np.uint64(1 << 62), two[:-1] << np.uint64(21) | a[2:]]
    at = (np.concatenate(grams) * _K) >> np.uint64(64 - bits)
    return np.bincount(at.astype(np.int64), minlength=1 << bits)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(counts), dtype=np.float32)
    on = np.flatnonzero(counts)
    v[on] = (1 + np.log(counts[on])) * idf[on]
    length = np.sqrt(np.dot(v, v))
    return v / length if length else v


def kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means over unit rows ``x``: centroids, and each row's cosine with its own."""
    mean = x.mean(0)
    starts = [int(np.argmax(x @ mean))]
    while len(starts) < min(k, len(x)):
        near = (x @ x[starts].T).max(1)
        starts.append(int(np.argmin(near)))
    centres = x[starts].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                m = x[own == c].sum(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    sims = x @ centres.T
    return centres, np.stack([np.argmax(sims, axis=1), sims.max(1)], axis=1)


@dataclass
class Centroids:
    langs: list[str]
    centres: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None], bits: int) -> tuple[list[str], list[float], list[bool]]:
        rows = [gram_counts(t, bits) for t in texts]
        on = [i for i, r in enumerate(rows) if r is not None]
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if on and self.langs:
            sims = np.stack([vector(rows[i], self.idf) for i in on]) @ self.centres.T
            best = np.argmax(sims, axis=1)
            for n, i in enumerate(on):
                b = best[n]
                s = float(min(1.0, max(0.0, sims[n, b])))
                lang[i], score[i], rejected[i] = self.langs[b], s, bool(s < self.least[b])
        return lang, score, rejected


def fold(doc_id, config: LanguageConfig):
    return F.crc32(doc_id.cast("string")) % config.folds


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> Centroids | None:
    bits, dims = config.dims_bits, 1 << config.dims_bits
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), config) != 0) & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                counts = gram_counts(t.as_py(), bits)
                if counts is not None:
                    total += counts > 0
                    n += 1
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(total[on], n))], names=["at", "n"])

    # One partial count for each place and task, then a table of at most ``dims + 1`` rows.
    df = {r["at"]: r["n"] for r in train.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    if not n:
        return None
    idf = np.full(dims, np.log(1 + n), dtype=np.float32)
    for at, k in df.items():
        idf[at] = np.log((1 + n) / (1 + k)) + 0.05
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = broadcast_if_small(train.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("of_lang")), "languages", config.broadcast_rows)
    # A cut on the hash leaves about twice the sample of each language, however many tasks there are. Ids are counted, not rows, as an id of
    # very many rows would else leave its language without a sample; the count's sketch is the same for any partitioning.
    ids = train.select("doc_id", "lang").join(sizes, "lang").where(hash_cut(F.col("doc_id"), config.sample_docs, F.col("of_lang"))).select("doc_id", "lang")
    chosen = ids.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.sample_docs)

    @F.arrow_udf("binary")
    def vectors(texts: pa.Array) -> pa.Array:
        rows = (gram_counts(t.as_py(), bits) for t in texts)
        return pa.array([None if r is None else vector(r, idf).astype(np.float16).tobytes() for r in rows], type=pa.binary())

    # At most ``sample_docs`` ids for each language.
    chosen = broadcast_if_small(chosen.select("doc_id", "lang"), "sample", config.broadcast_rows)
    sample = train.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    sample = sample.select("lang", "doc_id", vectors.asNondeterministic()("text").alias("v")).where("v is not null")
    # Rows that share a sampled id are cut before they are gathered, however many there are.
    first = Window.partitionBy("lang").orderBy("doc_id", "v")
    sample = sample.withColumn("n", F.row_number().over(first)).where(F.col("n") <= config.sample_docs).drop("n")

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "v"]).iloc[: config.sample_docs]
        x = np.stack([np.frombuffer(v, dtype=np.float16) for v in rows["v"]]).astype(np.float32)
        centres, own = kmeans(x, config.clusters, config.rounds)
        out = []
        for c in range(len(centres)):
            sims = own[own[:, 0] == c, 1]
            least = float(np.quantile(sims, config.reject_quantile)) - config.reject_margin if len(sims) else 0.0
            out.append({"lang": rows["lang"].iloc[0], "centre": centres[c].astype(np.float32).tobytes(), "least": least})
        return pd.DataFrame(out)

    got = sample.groupBy("lang").applyInPandas(clustered, "lang string, centre binary, least double").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["centre"])))
    if not got:
        return None
    return Centroids([r["lang"] for r in got], np.stack([np.frombuffer(r["centre"], dtype=np.float32) for r in got]), np.array([r["least"] for r in got]), idf)


def languages(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, a row for each document."""
    model = fit(docs, config) or Centroids([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    sent, bits = docs.sparkSession.sparkContext.broadcast(model), config.dims_bits
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        parts = [sent.value.predict(texts.slice(k, 256).to_pylist(), bits) for k in range(0, len(texts), 256)]
        cols = [pa.array([x for p in parts for x in p[i]], type=kind[i].type) for i in range(3)]
        return pa.StructArray.from_arrays(cols, fields=list(kind))

    held = F.coalesce(fold(F.col("doc_id"), config) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, predict.asNondeterministic()("text").alias("p")).select("doc_id", "held_out", "p.*")
