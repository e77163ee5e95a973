"""Hashed text vectors, pluggable model backends, and exact cosine search."""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from chatlake.functions.text import words
from chatlake.sources.shared import materialized


#: Words of one tile of texts; a longer text is a tile of its own.
WORDS = 50_000


#: A worker's words and their features' digests; made anew when there are so many.
_KNOWN: dict[str, np.ndarray] = {}
MOST_KNOWN = 200_000


def _features(t: str) -> list[str]:
    """A word, of weight 1, and its 4- and 5-grams, of weight 1/2."""
    return ["w:" + t, *("c:" + t[i : i + n] for n in (4, 5) for i in range(len(t) - n + 1))]


def _digests(features: list[str]) -> np.ndarray:
    """The first 64 bits of each feature's MD5, by which it is known: place from the upper half, sign from the ninth hexadecimal digit."""
    return np.frombuffer(b"".join([hashlib.md5(f.encode()).digest() for f in features]), ">u8")[::2].astype(np.uint64)


def _digests_of(names: list[str]) -> list[np.ndarray]:
    """The digests of each word's features."""
    if len(_KNOWN) > MOST_KNOWN:
        _KNOWN.clear()
    if new := [t for t in names if t not in _KNOWN]:
        lists = [_features(t) for t in new]
        _KNOWN.update(zip(new, np.split(_digests([f for fs in lists for f in fs]), np.cumsum([*map(len, lists)])[:-1]), strict=True))
    return [_KNOWN[t] for t in names]


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` elements of its lists in ``column``; a part ends with the row that exceeds it."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy()
    tile = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    for at, end in itertools.pairwise([*np.flatnonzero(np.diff(tile, prepend=-1)), len(tile)]):
        yield batch.slice(at, end - at)


def _places(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For tiles of ``(key, words)``: the keys, and of all places other than zero the text's number, the place and the value."""
    for batch in batches:
        for part in parts(batch, 1, WORDS):
            sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy()
            coded = part.column(1).flatten().dictionary_encode()
            code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            row = np.repeat(np.arange(len(part)), sizes)
            of = _digests_of(names)
            start = np.cumsum([0, *map(len, of)])
            times = start[code + 1] - start[code]
            place = np.arange(times.sum()) + np.repeat(start[code] - np.cumsum(times) + times, times)
            both = np.flatnonzero(row[1:] == row[:-1])  # pairs of neighbours
            pairs, of_pair = np.unique(code[both].astype(np.int64) * max(1, len(names)) + code[both + 1], return_inverse=True)
            pair = _digests([f"b:{names[i]}_{names[j]}" for i, j in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(names)))), strict=True)])
            found, number = np.unique(np.concatenate([*of, pair]), return_inverse=True)
            bucket, sign = (found >> np.uint64(32)).astype(np.int64) % dims, np.where((found >> np.uint64(28)) & np.uint64(1), 1.0, -1.0)
            w = np.full(start[-1], 0.5)
            w[start[:-1]] = 1.0
            cell, same = np.unique(np.concatenate([np.repeat(row, times) * len(found) + number[place], row[both] * len(found) + number[start[-1] + of_pair]]), return_inverse=True)
            weight = np.bincount(same, np.concatenate([w[place], np.full(len(both), 0.75)]), len(cell))
            text, feature = np.divmod(cell, max(1, len(found)))
            cell, same = np.unique(text * dims + bucket[feature], return_inverse=True)
            x = np.bincount(same, sign[feature] * (1 + np.log(weight + 1)), len(cell))
            text, bucket = np.divmod(cell, dims)
            norm = np.sqrt(np.bincount(text, x * x, len(part)))[text]
            yield part.column(0), text, bucket, np.divide(x, norm, out=np.zeros(len(x)), where=norm > 0)


def hashed(docs: DataFrame, key: str, text: str = "text", dims: int = 512) -> DataFrame:
    """``key, bucket, value``: the vector of each text, of length one, as its places other than zero. ``key`` names a text.

    Features are words, their 4- and 5-grams, and pairs of neighbours. Place and sign come from the feature's MD5, so any engine gives the same vector.
    A task makes its own texts' vectors, tile by tile: nothing is shuffled, and a feature is hashed once for a tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, bucket, value in _places(batches, dims):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(value)], names=[key, "bucket", "value"])

    own = docs.select(key, words(F.col(text)).alias("w"))
    return own.mapInArrow(run, StructType([own.schema[key], StructField("bucket", IntegerType()), StructField("value", DoubleType())]))


def dense(docs: DataFrame, key: str, text: str = "text", dims: int = 512) -> DataFrame:
    """``key, vector array<float>``: :func:`hashed` with all places, for texts that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, bucket, value in _places(batches, dims):
            own, place = np.unique(row, return_inverse=True)
            out = np.zeros((len(own), dims), dtype=np.float32)
            out[place, bucket] = value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dims, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), lists], names=[key, "vector"])

    own = docs.select(key, words(F.col(text)).alias("w"))
    return own.mapInArrow(run, StructType([own.schema[key], StructField("vector", ArrayType(FloatType()))]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def _tops(q: np.ndarray, s: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, score, key) the places of every query's first ``k`` by falling score, then key."""
    order = np.lexsort((x, -s, q))
    q = q[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def tops(tiles: Iterable[tuple[np.ndarray, Iterable[tuple[int, np.ndarray]]]], queries: int, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query number, score, key) for each query of tiles: keys, and their scores for blocks of queries from a first number on.

    Scores are compared as rounded to ``digits`` digits and given as they are; minus infinity is never among the best.
    """
    q, s, x = np.zeros(0, dtype=np.int64), np.zeros(0), None
    least = np.full(queries, -np.inf)  # the k-th best score so far
    for names, blocks in tiles:
        x = names[:0] if x is None else x
        for row, exact in blocks:
            scores = np.round(exact, digits)
            n = scores.shape[1]
            cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
            i, j = np.nonzero((scores >= np.maximum(cut, least[row : row + len(scores)])[:, None]) & (scores > -np.inf))
            new = _tops(i, scores[i, j], names[j], k)
            i, j = i[new], j[new]
            q, s, x = np.concatenate([q, i + row]), np.concatenate([s, exact[i, j]]), np.concatenate([x, names[j]])
        keep = _tops(q, np.round(s, digits), x, k)
        q, s, x = q[keep], s[keep], x[keep]
        full = np.flatnonzero(np.bincount(q, minlength=queries) >= k)
        least[full] = np.round(s[np.searchsorted(q, full, side="right") - 1], digits)
    return q, s, np.zeros(0) if x is None else x


def _nearest(batches: Iterator[pa.RecordBatch], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A task's ``k`` best (query number, score, key) for each row of ``m``: products in tiles, scores rounded before they are compared."""

    def tiles():
        for batch in batches:
            for at in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(at, TILE[1])
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield part.column(0).to_numpy(zero_copy_only=False), ((row, np.round(m[row : row + TILE[0]] @ v.T, DIGITS)) for row in range(0, len(m), TILE[0]))

    return tops(tiles(), len(m), k, DIGITS)


#: Queries and vectors of one product: 32 MB of scores.
TILE = (1024, 4096)
#: Scores that agree to so many digits are ties.
DIGITS = 9


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", most_queries: int = 8192) -> DataFrame:
    """``query, key, score, rank``: the ``k`` nearest rows of ``vectors(key, vector)`` for each of a stated set of ``queries(query, vector)``.

    The query set comes to the driver and goes to the workers in blocks of at most ``most_queries`` rows, a pass over the vectors for each. A task
    keeps its own best ``k`` for each query, so a shuffle carries tasks x queries x k rows, not the products. Scores are rounded to ``DIGITS`` digits,
    ties go by key, in every task as in the end.
    """
    spark = queries.sparkSession
    q_type, k_type = queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    shape = f"{query} {q_type}, {key} {k_type}, score double"
    kinds = [to_arrow_type(queries.schema[query].dataType), to_arrow_type(vectors.schema[key].dataType), pa.float64()]
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)

    def best_of(block: list) -> DataFrame:
        m = np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast(([r[0] for r in block], m))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            q, s, x = _nearest(batches, m, k)
            cols = [[ids[i] for i in q], x.tolist(), s]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=[query, key, "score"])

        found = vectors.select(key, "vector").where(F.col("vector").isNotNull()).mapInArrow(best, shape)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    rows, out = queries.select(query, "vector").where(F.col("vector").isNotNull()).toLocalIterator(), None
    while block := list(itertools.islice(rows, most_queries)):
        found = best_of(block)
        if len(block) == most_queries:  # others may follow: no more than one block is held at a time
            found = materialized(found, "nearest")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], shape + ", rank int") if out is None else out


@dataclass(frozen=True)
class Backend:
    """A way to embed texts: ``embed`` maps a list of texts to rows of floats inside a task."""

    name: str
    dims: int
    description: str
    embed: Callable[[list[str]], Iterable] | None = None
    available: Callable[[], bool] = lambda: True


HASHING = Backend("hashing", 512, "hashed words and n-grams (512)")
REGISTRY: dict[str, Backend] = {"hashing": HASHING}
ORDER = ("remote", "sentence-model", "hashing")


def register(backend: Backend) -> None:
    REGISTRY[backend.name] = backend


def resolve(name: str | None = None) -> Backend:
    """An explicit name must exist; otherwise the first available one of the fallback order, hashing alone when offline."""
    name = name or os.environ.get("CHATLAKE_EMBEDDING") or "auto"
    if name != "auto":
        if name not in REGISTRY:
            raise ValueError(f"unknown embedding backend {name}")
        return REGISTRY[name]
    if os.environ.get("CHATLAKE_OFFLINE") == "1":
        return HASHING
    return next(REGISTRY[n] for n in ORDER if n in REGISTRY and REGISTRY[n].available())


def embedded(docs: DataFrame, key: str, text: str = "text", backend: Backend = HASHING, batch: int = 32) -> DataFrame:
    """``key, vector``, of length one. A model runs as an Arrow function in batches, loaded once for each worker."""
    if backend.embed is None:
        return dense(docs, key, text, backend.dims)
    call = backend.embed

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [r for i in range(0, len(part), batch) for r in call(part.iloc[i : i + batch].fillna("").tolist())]
            m = np.asarray(rows, dtype=np.float32).reshape(len(part), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list(m / np.where(norm == 0, 1, norm)))

    return docs.select(key, run(text).alias("vector"))
