"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector ``w`` is shared by all grades; ordered thresholds cut its score: ``P(grade <= k) = sigmoid(t_k - w.x)``. From the
grades' probabilities come the expected grade and the tail probability of the top grade, by which documents are selected.
Features are the distinct words of the whole text and a few shape buckets (capitals, symbols, repetition, word length), hashed.

The fit takes at most ``sample_docs`` rated documents, those with the least hash of their id (this bound is the only sample; whole
texts are used). Weights have an L1 penalty, and features of fewer than ``min_docs`` rated documents have none, so a rare word does not
decide. Scoring runs over every document, task by task, with the weights (at most 2**bits floats) as the only broadcast data.

Ratings of ``labels``: grade 0 toxic, 1 poor, 2 good. Defined results: a text without a word (null and empty ones too) has expected grade
0 and tail probability 0 and is rejected; several ratings of one document count as the least one; ratings with nulls, or of unknown
documents, are ignored; without ratings of two grades every text with a word is accepted with tail probability 1; repeated rows give
equal rows; an empty table gives no row; other columns pass through the filter and are ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chatlake.llm.common import free_name, written
from chatlake.llm.sampling import hash_cut

_TAIL = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 20
    sample_docs: int = 12_000
    min_docs: int = 4
    l1: float = 1.0  # over the number of rated documents
    steps: int = 2500
    batch: int = 128
    rate: float = 0.25
    grades: int = 3
    accept: float = 0.5


def _bucket(name: str, x: float) -> bytes:
    return f"\x00{name}{min(20, int(x * 20))}".encode()


def feature_ids(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct feature numbers of a text; none if it has no word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.empty(0, dtype=np.int64)
    bare = [w.strip(_EDGE) for w in words]
    kinds = {w.lower() for w in bare if w}
    n = len(words)
    upper = sum(w.isupper() and len(w) > 1 for w in bare)
    letters = len(raw) - raw.count(b" ") - raw.count(b"\n")
    symbols = letters - sum(map(len, bare))
    found = kinds
    found |= {b"\x00tail" + m.group()[:4] for w in set(words) if (m := _TAIL.search(w))}
    found |= {
        _bucket("upper", upper / n), _bucket("symbols", 2 * symbols / max(1, letters)), _bucket("kinds", len(kinds) / n),
        _bucket("long", min(1.0, letters / n / 20)), _bucket("bare", sum(not w for w in bare) / n),
        _bucket("lines", len(set(lines := raw.split(b"\n"))) / len(lines)), _bucket("size", min(1.0, n.bit_length() / 20)),
    }
    hashes = np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    return np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """Weights over 2**bits features and ``grades - 1`` ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k), a column for each k but the last grade."""
        return _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])

    def grade_and_tail(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = self.at_most(score)
        return (1 - below).sum(1), 1 - below[:, -1]

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, config: QualityConfig) -> CumulativeLink | None:
        grades = np.asarray(grades, dtype=np.int64)
        if len(np.unique(grades)) < 2:
            return None
        seen = np.bincount(np.concatenate(rows), minlength=1 << config.bits)
        used = np.flatnonzero((seen >= config.min_docs) & (seen < len(rows)))
        place = np.full(1 << config.bits, -1, dtype=np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        rows = [r[r >= 0] for r in (place[x] for x in rows)]
        w, w2 = np.zeros(len(used)), np.full(len(used), 1e-4)
        share = np.clip(np.cumsum(np.bincount(grades, minlength=config.grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
        t = np.log(share / (1 - share))
        t = t[0] + np.concatenate([[0.0], np.cumsum(np.maximum(np.diff(t), 0.1))])
        t2, order = np.full(len(t), 1e-2), np.random.default_rng(0)
        for _ in range(max(1, config.steps * config.batch // len(rows))):
            perm = order.permutation(len(rows))
            for part in np.array_split(perm, max(1, len(perm) // config.batch)):
                cols, sizes = np.concatenate([rows[i] for i in part]), np.array([len(rows[i]) for i in part])
                of = np.repeat(np.arange(len(part)), sizes)
                score = np.bincount(of, weights=w[cols], minlength=len(part))
                y = grades[part]
                f = np.concatenate([np.zeros((len(part), 1)), _sigmoid(t[None, :] - score[:, None]), np.ones((len(part), 1))], axis=1)
                lo, hi = f[np.arange(len(part)), y], f[np.arange(len(part)), y + 1]
                slope = (hi + lo - 1) / len(part)  # of the mean log-likelihood by the score
                g = np.bincount(cols, weights=slope[of], minlength=len(used))
                p, gt = np.maximum(hi - lo, 1e-9), np.zeros(len(t) + 2)
                np.add.at(gt, y + 1, hi * (1 - hi) / p / len(part))
                np.add.at(gt, y, -lo * (1 - lo) / p / len(part))
                w2 += g * g
                step = config.rate / np.sqrt(w2)
                w += step * g
                w = np.sign(w) * np.maximum(np.abs(w) - step * (config.l1 / len(rows)), 0)
                gt = gt[1:-1]
                t2 += gt * gt
                t = np.maximum.accumulate(t + config.rate / np.sqrt(t2) * gt)
        full = np.zeros(1 << config.bits, dtype=np.float32)
        full[used] = w
        return cls(full, t)


def ratings(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of the table ``labels``: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, config: QualityConfig = QualityConfig()) -> CumulativeLink | None:
    """Fits on the bounded sample, in one task."""
    bits = config.bits
    known = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    found = written(rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")).join(known, "doc_id"), "rated")
    # A cut on the hash leaves about twice the sample, however many tasks there are, of which the least are taken.
    chosen = found.where(hash_cut(F.col("doc_id"), config.sample_docs, found.count())).orderBy("h", "doc_id").limit(config.sample_docs)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([feature_ids(t.as_py(), bits).astype(np.int32).tobytes() for t in texts], type=pa.binary())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i.as_py(), g.as_py(), x.as_py()) for b in batches for i, g, x in zip(*b.columns))
        rows, y = [np.frombuffer(x, dtype=np.int32) for _, _, x in got], np.array([g for _, g, _ in got])
        model = CumulativeLink.fit(rows, y, config) if rows else None
        if model:
            used = np.flatnonzero(model.weights)
            cells = [used.astype(np.int32).tobytes(), model.weights[used].tobytes(), model.thresholds.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], type=pa.binary()) for c in cells], names=["at", "weights", "thresholds"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "grade")), "doc_id").select("doc_id", "grade", ids("text").alias("x"))
    got = got.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("x").alias("x")).where(F.octet_length("x") > 0)
    # One task takes the bounded sample; the driver gets the weights that are not zero.
    row = got.repartition(1).mapInArrow(learn, "at binary, weights binary, thresholds binary").first()
    if row is None:
        return None
    weights = np.zeros(1 << bits, dtype=np.float32)
    weights[np.frombuffer(row["at"], dtype=np.int32)] = np.frombuffer(row["weights"], dtype=np.float32)
    return CumulativeLink(weights, np.frombuffer(row["thresholds"], dtype=np.float64))


SCORED = "struct<expected_grade: double, tail_probability: double>"


def scorer(spark, model: CumulativeLink | None, config: QualityConfig):
    sent = spark.sparkContext.broadcast(None if model is None else (model.weights, model.thresholds))
    bits, top = config.bits, float(config.grades - 1)

    def of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows = [feature_ids(t, bits) for t in texts]
        some = np.array([len(r) > 0 for r in rows], dtype=bool)
        if sent.value is None:
            return some * top, some * 1.0
        m = CumulativeLink(*sent.value)
        grade, tail = m.grade_and_tail(np.array([m.weights[r].sum(dtype=np.float64) for r in rows]))
        return np.where(some, grade, 0.0), np.where(some, tail, 0.0)

    @F.arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        grade, tail = of(t.as_py() for t in texts)
        return pa.StructArray.from_arrays([pa.array(grade, type=pa.float64()), pa.array(tail, type=pa.float64())], names=["expected_grade", "tail_probability"])

    return score.asNondeterministic()


def graded(docs: DataFrame, rated: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, accepted``, a row for each document."""
    own = docs.select("doc_id", "text")
    scored = own.select("doc_id", scorer(docs.sparkSession, fit(docs, rated, config), config)("text").alias("s")).select("doc_id", "s.*")
    return scored.withColumn("accepted", F.col("tail_probability") >= config.accept)


def accepted(docs: DataFrame, rated: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects."""
    score = scorer(docs.sparkSession, fit(docs, rated, config), config)
    at = free_name(docs, "__score")
    return docs.withColumn(at, score("text")).where(F.col(at)["tail_probability"] >= config.accept).drop(at)
