"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is the set of its five-word shingles (an item of fewer words is one shingle, the whole sequence). It
contaminates a document that holds at least ``threshold`` of that set, anywhere in the document.

Items are partitioned by the size of their set. An item of a partition with sizes up to ``u`` is sketched by its
``floor((1 - threshold) * u) + 1`` least shingle hashes. A document that reaches the threshold misses too few shingles to
miss the whole sketch, so probing a document's shingle hashes for sketch values finds every
contaminated document however long it is; symmetric signatures would lose short items inside long documents. Candidates
are then verified on the shingles' words.

The index of a benchmark of at most ``block_hashes`` words is broadcast, and documents are searched in one pass without a shuffle. A larger
benchmark stays distributed: the documents' shingle hashes, distinct in each document, are joined with the items' sketches, and the candidates with both texts.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.

Defined results: null or empty texts and items without words match nothing; repeated documents each get their matches; repeated items
each count; an item with a null item_id is ignored; an empty table on either side gives no pair; other columns are ignored, or pass
through the filter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chatlake.llm.common import free_name, written

KEPT = {*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)}
TABLE = bytes(b if b in KEPT else 32 for b in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item_id: bigint, n_shingles: int, n_found: int>>"


@dataclass(frozen=True)
class DecontaminationConfig:
    shingle: int = 5
    threshold: str = "0.8"
    block_hashes: int = 1 << 21


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _K
        out ^= out >> np.uint64(29)
    return out


class Item:
    def __init__(self, item_id: int, text: str | None, size: int):
        words = words_of(text)
        self.item_id, self.size = item_id, min(size, len(words))
        self.shingles = {tuple(words[i : i + self.size]) for i in range(len(words) - self.size + 1)} if words else set()
        self.hashes = np.unique(shingle_hashes(word_hashes(words), self.size)) if words else np.empty(0, dtype=np.uint64)


def size_class(n: int) -> int:
    """The largest size of the partition that ``n`` falls in: powers of the square root of two."""
    u = 1.0
    while int(u) < n:
        u *= 2**0.5
    return int(u)


class Index:
    """Sketches of a block of items by shingle length, sorted, with a bit table before them."""

    def __init__(self, rows: list[tuple[int, str]], config: DecontaminationConfig):
        self.need = Fraction(config.threshold)
        self.items = [x for x in (Item(i, t, config.shingle) for i, t in rows) if x.size]
        by_size = defaultdict(list)
        for at, x in enumerate(self.items):
            by_size[x.size] += [(h, at) for h in sketch(x, config).tolist()]
        self.parts = {}
        for size, got in sorted(by_size.items()):
            got.sort()
            keys, owners = np.array([h for h, _ in got], dtype=np.uint64), np.array([a for _, a in got])
            bits = max(12, min(24, len(keys).bit_length() + 4))
            table = np.zeros(1 << bits, dtype=bool)
            table[keys >> np.uint64(64 - bits)] = True
            self.parts[size] = (keys, owners, table, np.uint64(64 - bits))

    def matches(self, text: str | None) -> list[dict]:
        words = words_of(text)
        hashes = word_hashes(words)
        found: set[int] = set()
        for size, (keys, owners, table, shift) in self.parts.items():
            own = shingle_hashes(hashes, size)
            own = np.unique(own[table[own >> shift]])
            if len(own):
                lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    found.update(owners[a:b].tolist())
        if not found:
            return []
        sets = {s: {tuple(words[i : i + s]) for i in range(len(words) - s + 1)} for s in {self.items[a].size for a in found}}
        out = []
        for a in found:
            x = self.items[a]
            held = len(x.shingles & sets[x.size])
            if held >= self.need * len(x.shingles):
                out.append({"item_id": x.item_id, "n_shingles": len(x.shingles), "n_found": held})
        return sorted(out, key=lambda m: m["item_id"])


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")


def small_benchmark(benchmark: DataFrame, config: DecontaminationConfig) -> list[tuple[int, str]] | None:
    """The items, if they have at most ``block_hashes`` words (of four bytes); else None."""
    rows = items_of(benchmark)
    if (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > 4 * config.block_hashes:
        return None
    return [(r.i, r.t) for r in rows.collect()]


def sketch(x: Item, config: DecontaminationConfig) -> np.ndarray:
    """The item's least shingle hashes, as many as its size class needs."""
    return x.hashes[: int((1 - Fraction(config.threshold)) * size_class(len(x.hashes))) + 1]


def shuffled_matches(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig) -> DataFrame:
    """``d, k, item_id, n_shingles, n_found`` for a large benchmark: d is a doc_id, k a hash of the text, which name a document's equal rows together."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                made = [(Item(i, t, config.shingle), t) for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))]
                made = [(x, t, sketch(x, config)) for x, t in made if x.size]
                hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(h for *_, h in made)]).view(np.int64)
                n = [len(h) for *_, h in made]
                cols = [np.repeat([x.item_id for x, *_ in made], n), np.repeat([x.size for x, *_ in made], n), hashes]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64()))], names=["i", "size", "h"])

    items = items_of(benchmark)
    sketches = written(items.mapInArrow(sketched, "i long, size int, h long"), "sketches")
    sizes = sorted(r[0] for r in sketches.select("size").distinct().collect())  # at most ``shingle`` numbers

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                hashes = word_hashes(words_of(batch.column(2)[row].as_py()))
                for size in sizes:
                    own = np.unique(shingle_hashes(hashes, size)).view(np.int64)
                    for at in range(0, len(own), 1 << 16):
                        h = pa.array(own[at : at + (1 << 16)])
                        whole = [pa.repeat(pa.scalar(batch.column(c)[row].as_py(), pa.int64()), len(h)) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*whole, pa.repeat(pa.scalar(size, pa.int32()), len(h)), h], names=["d", "k", "size", "h"])

    own = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), "text")
    probes = written(own.mapInArrow(shingled, "d long, k long, size int, h long"), "probes")
    found = written(probes.join(sketches, ["size", "h"]).select("d", "k", "i").distinct(), "candidates")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, k, i, t, text in zip(*(c.to_pylist() for c in batch.columns)):
                x, words = Item(i, t, config.shingle), words_of(text)
                held = len(x.shingles & {tuple(words[n : n + x.size]) for n in range(len(words) - x.size + 1)})
                if held >= Fraction(config.threshold) * len(x.shingles):
                    rows.append((d, k, i, len(x.shingles), held))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            cols = [pa.array(c, type=kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "k", "item_id", "n_shingles", "n_found"])

    # An id may name several texts, and items repeat: each pair of texts is verified.
    texts = own.withColumnsRenamed({"d": "e", "k": "l"}).dropDuplicates(["e", "l"])
    both = found.join(texts, F.col("d").eqNullSafe(F.col("e")) & (F.col("k") == F.col("l"))).join(items, "i").select("d", "k", "i", "t", "text")
    return both.mapInArrow(verified, "d long, k long, item_id long, n_shingles int, n_found int")


def matcher(spark, rows: list[tuple[int, str]], config: DecontaminationConfig):
    sent, made = spark.sparkContext.broadcast(rows), []

    @F.arrow_udf(MATCH)
    def matches(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(sent.value, config))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_found", pa.int32())]))
        return pa.array([made[0].matches(t.as_py()) for t in texts], type=kind)

    return matches.asNondeterministic()  # so that no rule evaluates it twice


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shingles, n_found, containment``, whole."""
    rows = small_benchmark(benchmark, config)
    if rows is not None:
        found = docs.select("doc_id", matcher(docs.sparkSession, rows, config)("text").alias("m"))
        found = found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
    else:
        own = docs.select("doc_id", F.xxhash64("text").alias("l"))
        found = own.join(shuffled_matches(docs, benchmark, config), F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("k") == F.col("l")))
        found = found.select("doc_id", "item_id", "n_shingles", "n_found")
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``docs``, all columns, without the rows that hold a test item."""
    rows = small_benchmark(benchmark, config)
    if rows is not None:
        found = free_name(docs, "__matches")
        return docs.withColumn(found, matcher(docs.sparkSession, rows, config)("text")).where(F.size(found) == 0).drop(found)
    key, text = free_name(docs, "__d"), free_name(docs, "__k")
    bad = shuffled_matches(docs, benchmark, config).select(F.col("d").alias(key), F.col("k").alias(text)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_anti")


ORACLE = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), item_shingle AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM item, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0
), doc_shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc, LATERAL (SELECT unnest(generate_series(1, len(w) - 4)) AS i)
), found AS (
  SELECT doc_id, item_id, count(*) AS n FROM doc_shingle JOIN item_shingle USING (s) GROUP BY ALL
), short AS (
  SELECT doc_id, item_id, 1 AS n FROM doc, item
  WHERE len(item.w) BETWEEN 1 AND 4
    AND contains(' ' || array_to_string(doc.w, ' ') || ' ', ' ' || array_to_string(item.w, ' ') || ' ')
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingle GROUP BY 1)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n::INTEGER AS n_found, n / n_shingles AS containment
FROM (SELECT * FROM found UNION SELECT * FROM short) JOIN sizes USING (item_id) WHERE n * 10 >= n_shingles * 8
"""
