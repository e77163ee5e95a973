"""SimHash near-duplicate classes by a binary trie self-join.

Every text becomes one or more 64-bit SimHash fingerprints. Equal fingerprints collapse to one trie
leaf first, so copies never meet one another. The distinct fingerprints are the leaves of a binary
trie; the self-join walks pairs of trie nodes together from the root, adds up the bits in which the
two paths differ, and drops a pair as soon as the sum exceeds the error budget.

The walk is distributed. The upper levels are walked with DataFrame operations: a fingerprint is
sent to every node pair ``(p, q)`` within budget that its own node belongs to. Pairs that
still hold too many fingerprints for one task go on to deeper levels in the next round; the others
are finished inside one task each with sorted arrays, in chunks of bounded size. A task reports
a spanning forest of the links it found, not the links themselves, which keeps the links' classes.

Defined results: a null or empty text, or one of white space only, has no feature and fingerprint
zero, and is linked like any other; texts shorter than a shingle count as one shingle; rows that repeat
give equal rows; a null doc_id keeps its row (its class is named by the least non-null doc_id in it,
else null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chatlake.llm.common import free_name, least_reachable, written


@dataclass(frozen=True)
class SimHashConfig:
    """``shingle``: words in a feature; ``distinct``: count a feature once; ``seeds``: one fingerprint for each.

    ``task_rows``: most fingerprints of one node that a task takes; ``fan_bits``: levels walked in one round;
    ``parallel_bits``: levels walked first for parallel work even when the tasks would be small.
    """

    shingle: int = 3
    distinct: bool = False
    seeds: tuple[int, ...] = (42,)
    budget: int = 2
    task_rows: int = 1 << 19
    fan_bits: int = 4
    parallel_bits: int = 4


OP8 = SimHashConfig()
#: For dropping near copies: sets of words, four independent fingerprints of which one must be within 3 bits. Alone it
#: finds few short or shortened copies (see the README); :class:`JaccardConfig` brings those together.
NEAR_COPIES = SimHashConfig(shingle=1, distinct=True, seeds=(42, 43, 44, 45), budget=3)


@dataclass(frozen=True)
class JaccardConfig:
    """Links are verified: at least ``threshold`` of the union of two texts' sets of ``shingle``-word shingles is common.

    ``bands`` keys of ``rows`` least hashes each bring texts together: of pairs at 0.8, (1 - 0.8 ** 4) ** 24, 3 in a million, share none.
    Under a key of at most ``small_group`` texts every pair is compared, under a larger one every pair that a filter without loss leaves.
    """

    shingle: int = 5
    threshold: Fraction = Fraction(4, 5)
    bands: int = 24
    rows: int = 4
    small_group: int = 8


_LOW = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of ``hashes`` (uint64)."""
    n, counts = len(hashes), np.zeros((8, 8), dtype=np.int64)
    for j in range(8):
        lanes = (hashes >> np.uint64(j)) & _LOW  # bit j of each byte, a lane of 8 bits each
        full = np.add.reduceat(lanes, np.arange(0, n, 255))  # at most 255 ones to a lane
        counts[:, j] = full.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = (counts * 2 > n).reshape(-1)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def features(text: bytes | None, shingle: int, distinct: bool) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space, ``shingle`` of them joined by spaces."""
    words = (text or b"").lower().split()
    if distinct and shingle == 1:
        return list({w.strip(b".,;:!?\"'()") or w for w in words})
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    found = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return list(set(found)) if distinct else found


def fingerprints_of(text: bytes | None, config: SimHashConfig) -> list[int]:
    found = features(text, config.shingle, config.distinct)
    if not found:
        return [0] * len(config.seeds)
    return [
        bit_majority(np.fromiter(map(xxh64_intdigest, found, repeat(seed)), dtype=np.uint64, count=len(found)))
        for seed in config.seeds
    ]


def fingerprints(docs: DataFrame, config: SimHashConfig = OP8) -> DataFrame:
    """``doc_id, f0, f1, ...``: one signed 64-bit fingerprint for each seed."""
    names = [f"f{i}" for i in range(len(config.seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprints_of(t.as_py(), config) for t in batch.column(1)]
            table = np.array(got, dtype=np.uint64).reshape(len(got), len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(table[:, i]) for i in range(len(names)))], names=["doc_id", *names]
            )

    shape = ", ".join(["doc_id long", *(f"{n} long" for n in names)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, shape)


# ---------------------------------------------------------------- inside one task


class Forest:
    """Union-find over 0..n-1 that takes links in arrays; a class is named by its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n, dtype=np.int64)
        self.since = 0

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.since += len(a)
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            if len(a):
                np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
        if self.since > len(self.up):
            self.flatten()

    def flatten(self) -> None:
        self.since, self.up = 0, self.roots(np.arange(len(self.up)))


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, bits: int, budget: int, total: int, chunk: int = 1 << 16):
    """Yields arrays ``i, j`` with ``a[i]`` and ``b[j]`` at most ``total`` bits apart.

    ``a`` and ``b`` are sorted distinct uint64 of one node each; below these nodes ``bits`` bits are left and
    ``budget`` errors may still be made. A trie node is a range of the sorted array; node pairs wait
    on a stack in chunks, the deepest first, so that memory stays bounded.
    """
    z = np.zeros(1, dtype=np.int64)
    stack = [(bits, z, z + len(a), z, z + len(b), z + budget)]
    while stack:
        left, alo, ahi, blo, bhi, may = stack.pop()
        if len(alo) > chunk:
            for k in range(0, len(alo), chunk):
                stack.append((left, *(x[k : k + chunk] for x in (alo, ahi, blo, bhi, may))))
            continue
        area = (ahi - alo) * (bhi - blo)
        few = (area <= 24) if left else np.ones(len(area), dtype=bool)
        if few.any():  # small enough to compare leaf by leaf
            n, first, width, low = area[few], alo[few], (bhi - blo)[few], blo[few]
            for k in range(0, len(n), chunk):
                m = n[k : k + chunk]
                at = np.repeat(np.arange(len(m)), m)
                at_in = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                w = width[k : k + chunk][at]
                i, j = first[k : k + chunk][at] + at_in // w, low[k : k + chunk][at] + at_in % w
                if same:
                    i, j = i[i < j], j[i < j]
                near = np.bitwise_count(a[i] ^ b[j]) <= total
                if near.any():
                    yield i[near], j[near]
        big = ~few
        if not big.any():
            continue
        alo, ahi, blo, bhi, may = (x[big] for x in (alo, ahi, blo, bhi, may))
        bit = np.uint64(left - 1)
        one = np.uint64(1)
        amid = np.clip(np.searchsorted(a, ((a[alo] >> bit) | one) << bit), alo, ahi)
        bmid = np.clip(np.searchsorted(b, ((b[blo] >> bit) | one) << bit), blo, bhi)
        self_ = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), dtype=bool)
        parts = [
            (alo, amid, blo, bmid, may),
            (amid, ahi, bmid, bhi, may),
            (alo, amid, bmid, bhi, may - 1),
            tuple(x[~self_] for x in (amid, ahi, blo, bmid, may - 1)),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] >= 0)
        if keep.any():
            stack.append((left - 1, *(x[keep] for x in nxt)))


# ---------------------------------------------------------------- across tasks


def _deeper(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """From node pairs at ``depth`` to those ``step`` levels below, within ``budget``."""
    masks = sorted((m for m in range(1 << step) if m.bit_count() <= budget), key=lambda m: m.bit_count())
    x = F.shiftrightunsigned(F.shiftleft("fp", depth), 64 - step) if depth else F.shiftrightunsigned("fp", 64 - step)
    own = rows.withColumn("x", x).withColumn(
        "m", F.explode(F.filter(F.array(*[F.lit(m) for m in masks]), lambda m: F.bit_count(m) <= F.lit(budget) - F.col("err")))
    )
    y = F.col("x").bitwiseXOR(F.col("m"))
    same = F.col("p") == F.col("q")
    side = F.when(same, (F.col("x") > y).cast("int")).otherwise(F.col("side"))
    p = F.shiftleft("p", step) + F.when(side == 0, F.col("x")).otherwise(y)
    q = F.shiftleft("q", step) + F.when(side == 0, y).otherwise(F.col("x"))
    return own.select(
        p.alias("p"), q.alias("q"), side.cast("int").alias("side"), (F.col("err") + F.bit_count("m")).cast("int").alias("err"), "fp"
    )


def _finisher(depth: int, budget: int):
    """Finishes the node pairs at ``depth``, a pair at a time: a spanning forest of its links."""

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        same = key[0] == key[1]
        a, b = np.unique(fp[side == 0]), np.unique(fp[side == 1])
        b = a if same else b
        if not len(a) or not len(b) or (same and len(a) < 2):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        all_ = a if same else np.concatenate([a, b])
        trees, off = Forest(len(all_)), 0 if same else len(a)
        for i, j in trie_links(a, b, same, 64 - depth, budget - int(rows["err"].iloc[0]), budget):
            trees.link(i, j + off)
        trees.flatten()
        tied = np.flatnonzero(trees.up != np.arange(len(all_)))
        return pd.DataFrame({"a": all_[tied].view(np.int64), "b": all_[trees.up[tied]].view(np.int64)})

    return finish


def trie_self_join(prints: DataFrame, budget: int, config: SimHashConfig) -> DataFrame:
    """Links ``a, b`` (fingerprints) that join all of ``prints(fp)`` within ``budget`` bits to the same classes."""
    n = prints.count()
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    depth = max(math.ceil(math.log2(max(1, n / config.task_rows))), min(config.parallel_bits, math.ceil(math.log2(max(1, n / 2048)))))
    rows = prints.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("side"), F.lit(0).alias("err"), "fp")
    if depth:
        rows = _deeper(rows, 0, depth, budget)
    links, cap = None, config.task_rows * 4
    while True:
        ready = rows
        if n > cap and depth < 60:
            # Node pairs too large for a task walk on; a pair's size is a count combined before the shuffle.
            rows = written(rows, "trie")
            large = written(rows.groupBy("p", "q").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("p", "q"), "large")
            more = large.count() > 0
            if more:
                ready = rows.join(large, ["p", "q"], "left_anti")
        else:
            more = False
        found = written(ready.groupBy("p", "q").applyInPandas(_finisher(depth, budget), "a long, b long"), "links")
        links = found if links is None else links.union(found)
        if not more:
            return links
        rows = _deeper(rows.join(large, ["p", "q"], "left_semi"), depth, config.fan_bits, budget)
        depth += config.fan_bits


def classes(docs: DataFrame, config: SimHashConfig = OP8) -> DataFrame:
    """``doc_id, f0, ..., component_id``: the least doc_id of the class that the links reach."""
    prints = written(fingerprints(docs, config), "prints")
    links = None
    for i in range(len(config.seeds)):
        nodes = prints.groupBy(F.col(f"f{i}").alias("fp")).agg(F.min("f0").alias("node"))
        nodes = written(nodes, "nodes")
        got = trie_self_join(nodes.select("fp"), config.budget, config)
        if i:
            # Fingerprints of a later seed stand for the first one's: through the least f0 that has them.
            a = nodes.select(F.col("fp").alias("a"), F.col("node").alias("na"))
            b = nodes.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
            got = got.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
            own = prints.select("f0", f"f{i}").distinct().withColumnRenamed(f"f{i}", "fp")
            got = got.union(own.join(nodes, "fp").where("f0 <> node").select(F.col("f0").alias("a"), F.col("node").alias("b")))
        links = got if links is None else links.union(got)
    roots = least_reachable(links)
    least = prints.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least"))
    named = written(least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "named")
    # Written, so that both sides of the join are plain exchanges, which the adaptive skew join can split at a very large class.
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = named.join(ids, "root").select(F.col("node").alias("f0"), "component_id")
    return prints.join(named, "f0")


def simhash_components(docs: DataFrame, config: SimHashConfig = OP8) -> DataFrame:
    """``doc_id, fingerprint (16 lower-case hex digits of the first seed), component_id``."""
    return classes(docs, config).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text shorter than ``size`` words is one shingle, one without words none."""
    found = features(text, size, True)
    return np.unique(np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found)))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common)


def band_keys(hashes: np.ndarray, config: JaccardConfig, chunk: int = 1 << 13) -> np.ndarray:
    """A key for each band, from the least of the set's hashes under ``bands * rows`` orders; none for an empty set."""
    if not len(hashes):
        return hashes
    factors = np.random.default_rng(7).integers(0, 1 << 63, (2, config.bands * config.rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(config.bands * config.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), chunk):
        x = hashes[k : k + chunk] * factors[0]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * factors[1]).min(axis=1))
    return np.array([xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(config.bands, config.rows))], dtype=np.uint64)


def marks(docs: DataFrame, config: SimHashConfig, jaccard: JaccardConfig) -> DataFrame:
    """``doc_id, node, size, keys, hashes, f0, ...``: node is a hash of the shingle set, so that texts with equal sets are one node."""
    names = ["doc_id", "node", "size", "keys", "hashes", *(f"f{i}" for i in range(len(config.seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                sets = [shingle_set(t, jaccard.shingle) for t in texts]
                prints = np.array([fingerprints_of(t, config) for t in texts], dtype=np.uint64).view(np.int64)
                cols = [
                    pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([band_keys(s, jaccard).view(np.int64) for s in sets], type=pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sets], type=pa.binary()),
                    *(pa.array(prints[:, i]) for i in range(len(config.seeds))),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    shape = ", ".join(["doc_id long, node long, size long, keys array<long>, hashes binary", *(f"{n} long" for n in names[5:])])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, shape)


def print_pairs(nodes: DataFrame, config: SimHashConfig) -> DataFrame:
    """Pairs ``a, b`` of nodes that join all of ``nodes(node, f0, ...)`` with near fingerprints of any seed to the same classes."""
    out = None
    for i in range(len(config.seeds)):
        own = nodes.select(F.col(f"f{i}").alias("fp"), "node")
        least = written(own.groupBy("fp").agg(F.min("node").alias("least")), "least")
        links = trie_self_join(least.select("fp"), config.budget, config)
        links = links.join(least.toDF("a", "na"), "a").join(least.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        links = links.union(own.join(least, "fp").where("node <> least").select("node", "least"))
        out = links if out is None else out.union(links)
    return out


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` of nodes with both shingle sets, ``ha`` and ``hb``, for one pass over it."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = sets.select("node", "hashes").join(written(asked, "asked"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    held = written(held, "held")
    return pairs.join(held.toDF("a", "ha"), "a").join(held.toDF("b", "hb"), "b")


def verified(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Those of ``pairs(a, b)`` (nodes of ``sets``) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(h.as_py(), dtype=np.uint64) for h in batch.column(k)] for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([jaccard_at_least(p, q, config.threshold) for p, q in zip(x, y)], type=pa.bool_()))

    pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = with_sets(pairs, sets).select("a", "b", "ha", "hb")
    return written(both.mapInArrow(run, "a long, b long"), "verified")


def small_group_pairs(members: DataFrame, config: JaccardConfig) -> DataFrame:
    """All pairs ``a, b`` of different classes under one key, for keys of at most ``small_group`` members."""
    t = config.threshold
    open_ = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    own = written(members.join(open_, "key"), "small")
    other = own.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("root").alias("r"))
    pairs = own.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("r")))
    pairs = pairs.where(F.least("n", "size") * t.denominator >= F.greatest("n", "size") * t.numerator)
    return pairs.select(F.col("node").alias("a"), "b")


def differences(members: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """A row for each shingle ``e`` in which a member's set and its hub's differ: ``hub, node, root, m, need, e``.

    ``members``: ``hub, node, root, hub_root``. With D the difference to the hub, two members reach the threshold just if
    ``2 * high * |Dx & Dy| >= m(x) + m(y)``, where ``m(x) = high * |Dx| - low * |x|`` and the threshold is (high - low) / (high + low).
    ``need`` is the least that ``m(x) + m(y)`` can be for a partner y of another class: of a member in the hub's class, y is none of the hub's links.
    """
    low, high = config.threshold.denominator - config.threshold.numerator, config.threshold.denominator + config.threshold.numerator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows = [[], [], []]
                for near, h, x in zip(*(part.column(i).to_pylist() for i in (3, 4, 5))):
                    h, x = np.frombuffer(h, dtype=np.uint64), np.frombuffer(x, dtype=np.uint64)
                    d = np.setxor1d(h, x, assume_unique=True).view(np.int64)
                    m = high * len(d) - low * len(x)
                    need = m + (low * len(h) + 1 if near else high - low - low * len(h))
                    for col, v in zip(rows, (m, need, d)):
                        col.append(v)
                cols = [pa.array(rows[0], type=pa.int64()), pa.array(rows[1], type=pa.int64()), pa.array(rows[2], type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *cols], names=["hub", "node", "root", "m", "need", "d"])

    both = with_sets(members.withColumnsRenamed({"hub": "a", "node": "b"}), sets)
    both = both.select(F.col("a").alias("hub"), F.col("b").alias("node"), "root", (F.col("root") == F.col("hub_root")).alias("near"), "ha", "hb")
    got = both.mapInArrow(run, "hub long, node long, root long, m long, need long, d array<long>")
    return got.select("hub", "node", "root", "m", "need", F.explode("d").alias("e"))


def large_group_pairs(members: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Pairs ``a, b`` of different classes under one hub of which none that reaches the threshold is missing; ``members`` as in :func:`differences`.

    Two members of different classes are not both linked to the hub, so they reach the threshold only if they share some of what sets each
    off from the hub, and often much of it. Those shingles are ordered by how few members have them. A pair must share one among
    the first ones (prefix filter), with enough left behind it on both sides, so what all members have in common brings no pair together.
    """
    low, high = config.threshold.denominator - config.threshold.numerator, config.threshold.denominator + config.threshold.numerator
    open_ = members.groupBy("hub").agg(F.count("*").alias("n"), F.bool_or(F.col("root") != F.col("hub_root")).alias("o")).where("n > 1 and o").select("hub")
    each = written(differences(written(members.join(open_, "hub"), "open"), sets, config), "differences")
    shared = each.groupBy("hub", "e").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 1")
    shared = written(shared.select("hub", "e", "n", "lo", (F.col("lo") != F.col("hi")).alias("mixed")), "shared")
    listed = each.join(shared, ["hub", "e"]).groupBy("hub", "node").agg(
        F.max("root").alias("root"), F.max("m").alias("m"), F.max("need").alias("need"), F.sort_array(F.collect_list(F.struct("n", "e", "mixed", "lo"))).alias("s")
    )
    listed = listed.select("hub", "node", "root", "m", "need", F.size("s").alias("k"), F.posexplode("s").alias("i", "s"))
    listed = listed.withColumn("rest", (F.col("k") - F.col("i")).cast("long")).where(F.col("s.mixed") & (F.col("rest") * (2 * high) >= F.col("need")))
    first = written(listed.select("hub", "s.e", "s.lo", "node", "root", "m", "rest"), "first")
    # Of two classes one at least is not the shingle's first, which is the large one as a rule: only those outside it meet all.
    few = first.where("root <> lo").drop("lo")
    other = first.select("hub", "e", F.col("node").alias("b"), F.col("root").alias("r"), F.col("m").alias("n"), F.col("rest").alias("q"))
    pairs = few.join(other, ["hub", "e"]).where((F.col("root") != F.col("r")) & (F.least("rest", "q") * (2 * high) >= F.col("m") + F.col("n")))
    return pairs.select(F.col("node").alias("a"), "b")


def near_copies(docs: DataFrame, config: SimHashConfig, jaccard: JaccardConfig) -> DataFrame:
    """``doc_id, component_id``: classes by links that are verified on the shingle sets.

    The fingerprints' links, and those of a key's nodes with its hub, the node whose keys have most members, come first and join most of a
    large class. Then the pairs of a key whose classes still differ are verified, all of them in small groups and
    in large ones all that can reach the threshold, so that the classes are those of all pairs that share a key and reach it.
    """
    sets = written(marks(docs, config, jaccard), "sets")
    nodes = written(sets.drop("doc_id", "hashes").dropDuplicates(["node"]), "nodes")
    banded = nodes.select("node", "size", F.explode("keys").alias("key"))
    counts = written(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    banded = written(banded.join(counts, "key"), "banded")
    weights = written(banded.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    weighed = written(banded.join(weights, "node"), "weighed")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    banded = written(weighed.drop("weight").join(written(hubs, "hubs"), "key"), "banded")
    pairs = banded.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = verified(pairs.union(print_pairs(nodes, config)), sets, jaccard)
    roots = written(least_reachable(links), "roots")
    named = written(banded.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    own = F.coalesce("hub_root", "hub").alias("hub_root")
    large = named.where(F.col("n") > jaccard.small_group).where("hub <> node").select("hub", "node", "root").distinct()
    large = large.join(roots.toDF("hub", "hub_root"), "hub", "left").select("hub", "node", "root", own)
    rest = small_group_pairs(named.where(F.col("n") <= jaccard.small_group).select("key", "node", "size", "root"), jaccard)
    rest = rest.union(large_group_pairs(written(large, "large"), sets, jaccard))
    roots = least_reachable(links.union(verified(rest, sets, jaccard)))
    least = sets.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "named")
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return sets.select("doc_id", "node").join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, config: SimHashConfig = NEAR_COPIES, jaccard: JaccardConfig = JaccardConfig()) -> DataFrame:
    """``docs`` with all its columns; of each class the document with the least doc_id stays.

    Rows with a null doc_id stay, as do repeated rows of the document that stays.
    """
    kept = free_name(docs, "__kept")
    keep = near_copies(docs, config, jaccard).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    stay = docs.join(keep, F.col("doc_id") == F.col(kept), "left_semi")
    return stay.union(docs.where("doc_id is null"))
