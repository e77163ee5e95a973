"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans (email, ip, card, phone). The field adds spans: its nodes are the tokens that hold a digit or an
``@`` (all other tokens are outside by construction), with potentials on a token's shape and surroundings, between tokens
that follow each other, and between distant tokens with the same or a similar value, such as a number that comes again without
its prefix. Tokens of base spans are observed. Loopy belief propagation passes messages along both kinds of edges, so a document's labels
agree; tokens that reach ``sure`` and lie in no base span become spans, joined when they follow each other.

All potentials, the skip edges' too, are fitted here by pseudo-likelihood on at most ``sample_docs`` documents (those with a digit or ``@`` and the least hash of
their id), labelled by the patterns; half of the examples hide a token's own shape, so that its neighbours along both kinds of edges count. Tasks are
independent, memory is bounded by a document, and whole texts are searched.

Offsets are code points, ends exclusive. Defined results: a null text is an empty one, without spans; repeated rows give equal rows; a
null doc_id is kept; a corpus without digits and ``@`` has no spans; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.sampling import hash_cut

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, and a run is taken whole: equal to the plain pattern, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[@0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")


@dataclass(frozen=True)
class PiiConfig:
    sample_docs: int = 3000
    rounds: int = 300
    messages: int = 20
    sure: float = 0.6  # measured for false and missed spans, see the README


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    if not _HINT.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@dataclass
class Graph:
    """The candidate tokens of a document, their features, their observed labels (-1: none), and edges."""

    spans: list[tuple[int, int]]
    features: list[list[str]]
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _shape(word: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", word))[:24]


def _key(word: str) -> str | None:
    """Tokens with the same key are the same or a similar value."""
    if "@" in word:
        return word.lower()
    digits = _NOT_DIGIT.sub("", word)
    return digits[-7:] if len(digits) >= 5 else None


def graph_of(text: str, base: list[tuple[str, int, int]]) -> Graph:
    words = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    places = [i for i, (a, b) in enumerate(words) if _HINT.search(text, a, b)]
    spans, features, keys = [], [], []
    for i in places:
        a, b = words[i]
        while b > a + 1 and text[b - 1] in ".,;:!?\"'>]}":
            b -= 1
        while a < b - 1 and text[a] in "\"'<[{":
            a += 1
        word = text[a:b]
        digits = _NOT_DIGIT.sub("", word)
        near = []
        for name, j in (("before", i - 1), ("after", i + 1)):
            other = text[words[j][0] : words[j][1]] if 0 <= j < len(words) else ""
            near.append(f"{name}:{_shape(other)}" if _HINT.search(other) or other[:1] == "+" else f"{name}:word")
        own = [f"shape:{_shape(word)}", f"digits:{min(len(digits), 20)}", f"dots:{min(word.count('.'), 4)}"]
        own += [name for name, on in (("at", "@" in word), ("plus", word[0] == "+"), ("luhn", 16 <= len(digits) <= 19 and luhn(digits)), ("letters", any(c.isalpha() for c in word))) if on]
        spans.append((a, b))
        features.append(own + near)
        keys.append(_key(word))
    observed, ends = np.full(len(spans), -1), [y for _, y in spans]
    for kind, a, b in base:  # the tokens lie in order and apart: those that a span touches are a run
        n = bisect.bisect_right(ends, a)
        while n < len(spans) and spans[n][0] < b:
            observed[n] = LABELS.index(kind)
            n += 1
    chain = np.array([(n, n + 1) for n in range(len(places) - 1) if places[n + 1] == places[n] + 1], dtype=np.int64).reshape(-1, 2)
    last: dict[str, int] = {}
    skip = []
    for n, k in enumerate(keys):
        if k is not None:
            if k in last:
                skip.append((last[k], n))
            last[k] = n
    return Graph(spans, features, observed, chain, np.array(skip, dtype=np.int64).reshape(-1, 2))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class SkipChainField:
    def __init__(self, index: dict[str, int], unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.index, self.unary, self.chain, self.skip = index, unary, chain, skip

    def marginals(self, g: Graph, messages: int) -> np.ndarray:
        """Loopy sum-product with damping; a row of label probabilities for each token."""
        n, k = len(g.spans), len(LABELS)
        theta = np.zeros((n, k))
        for i, fs in enumerate(g.features):
            theta[i] = self.unary[0]
            for f in fs:
                if (at := self.index.get(f)) is not None:
                    theta[i] += self.unary[at]
        seen = g.observed >= 0
        theta[seen] = -1e6
        theta[seen, g.observed[seen]] = 0
        pairs = np.concatenate([g.chain, g.skip])
        if len(pairs):
            pot = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            m = np.zeros((len(src), k))
            for _ in range(messages):
                total = theta.copy()
                np.add.at(total, dst, m)
                new = _logsumexp((total[src] - m[back])[:, :, None] + pot, axis=1)
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - m).max() < 1e-6:
                    break
                m = 0.5 * m + 0.5 * new
            np.add.at(theta, dst, m)
        p = np.exp(theta - theta.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, graphs: list[Graph], rounds: int) -> SkipChainField | None:
        """Pseudo-likelihood: each token's label given its features and the labels of its neighbours before, after and along skip edges.

        What the patterns pass over is outside, but for tokens that share a value with one of a base span: their label is not known, and they are left out.
        """
        k = len(LABELS)
        names = sorted({f for g in graphs for fs in g.features for f in fs})
        if not names:
            return None
        index = {f: i + 1 for i, f in enumerate(names)}
        rows, labels, around = [], [], []
        for g in graphs:
            y = np.maximum(g.observed, 0)
            near, tied = np.zeros((len(y), 3, k)), g.observed >= 0
            for a, b in [*g.skip, *g.skip[::-1, ::-1]]:  # the edges of a value follow its tokens' order
                tied[b] |= tied[a]
            known = (g.observed >= 0) | ~tied
            for edges, before, after in ((g.chain, 0, 1), (g.skip, 2, 2)):
                for a, b in edges:
                    near[b, before, y[a]] += known[a]
                    near[a, after, y[b]] += known[b]
            for i, fs in enumerate(g.features):
                if not known[i]:
                    continue
                full = [0, *(index[f] for f in fs)]
                hidden = [0, *(index[f] for f in fs if f.startswith(("digits:", "dots:", "letters")))]
                rows += [full, hidden]
                labels += [y[i], y[i]]
                around += [near[i], near[i]]
        y, x2 = np.array(labels), np.array(around).reshape(len(labels), -1)
        cols, of = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, v = np.zeros((len(names) + 1, k)), np.zeros((3 * k, k))
        w2, v2, want = np.full_like(w, 1e-3), np.full_like(v, 1e-3), np.eye(k)[y]
        for _ in range(rounds):
            score = x2 @ v
            np.add.at(score, of, w[cols])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            slope = (want - p / p.sum(axis=1, keepdims=True)) / len(y)
            gw, gv = np.zeros_like(w), x2.T @ slope - 1e-4 * v
            np.add.at(gw, cols, slope[of])
            gw -= 1e-4 * w
            w2 += gw * gw
            v2 += gv * gv
            w += 0.3 * gw / np.sqrt(w2)
            v += 0.3 * gv / np.sqrt(v2)
        before, after, far = v.reshape(3, k, k)
        return cls(index, w, (before + after.T) / 2, (far + far.T) / 2)


def all_spans(text: str, field: SkipChainField | None, config: PiiConfig) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the field adds."""
    base = base_spans(text)
    if field is None or not _HINT.search(text):
        return base, []
    g = graph_of(text, base)
    p = field.marginals(g, config.messages)
    best = p.argmax(axis=1)
    # The pattern's check digit decides on cards, so the field adds none.
    free = [n for n in range(len(best)) if g.observed[n] < 0 and best[n] and p[n, best[n]] >= config.sure and LABELS[best[n]] != "card"]
    linked = {(int(a), int(b)) for a, b in g.chain}
    added: list[list] = []
    for n in free:
        if added and added[-1][3] == n - 1 and (n - 1, n) in linked and added[-1][0] == LABELS[best[n]]:
            added[-1][2:] = [g.spans[n][1], n]
        else:
            added.append([LABELS[best[n]], *g.spans[n], n])
    return base, [tuple(x[:3]) for x in added]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def fit(docs: DataFrame, config: PiiConfig = PiiConfig()) -> SkipChainField | None:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t.as_py() for b in batches for t in b.column(0))
        field = SkipChainField.fit([graph_of(t, base_spans(t)) for t in texts], config.rounds)
        if field:
            cells = [pa.array([list(field.index)], type=pa.list_(pa.string()))]
            cells += [pa.array([m.astype("<f8").tobytes()], type=pa.binary()) for m in (field.unary, field.chain, field.skip)]
            yield pa.RecordBatch.from_arrays(cells, names=["names", "unary", "chain", "skip"])

    own = docs.select("doc_id", "text").where(F.col("text").rlike("[@0-9]"))
    # A cut on the hash leaves about twice the sample, however many tasks there are, of which the least are taken.
    some = own.where(hash_cut(F.col("doc_id"), config.sample_docs, own.count())).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(config.sample_docs)
    row = some.select("text").repartition(1).mapInArrow(learn, "names array<string>, unary binary, chain binary, skip binary").first()
    if row is None:
        return None
    k = len(LABELS)
    matrix = lambda b: np.frombuffer(b, dtype="<f8").reshape(-1, k)
    return SkipChainField({f: i + 1 for i, f in enumerate(row["names"])}, matrix(row["unary"]), matrix(row["chain"]), matrix(row["skip"]))


FOUND = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, n_added: bigint>"


def _finder(docs: DataFrame, config: PiiConfig):
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, config))
    names = [x.split(":")[0].strip() for x in FOUND[7:-1].split(",")]

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        cols = [[] for _ in names]
        for t in texts:
            base, added = all_spans(t.as_py() or "", sent.value, config)
            count = defaultdict(int)
            for kind, _, _ in base:
                count[kind] += 1
            row = (*(count[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added]), len(added))
            for col, v in zip(cols, row):
                col.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return find.asNondeterministic()


def personal_data(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans`` (all) and ``n_added``; a row for each document."""
    return docs.select("doc_id", _finder(docs, config)("text").alias("p")).select("doc_id", "p.*")


def masked(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``docs``, all columns, with every span of ``text`` replaced by its kind in brackets; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, config))

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None:
                base, added = all_spans(t, sent.value, config)
                parts, end = [], 0
                for kind, a, b in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [t[end:a], f"[{kind.upper()}]"]
                    end = max(end, b)
                t = "".join([*parts, t[end:]])
            out.append(t)
        return pa.array(out, type=pa.string())

    return docs.withColumn("text", mask("text"))
