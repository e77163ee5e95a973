import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from chatlake.llm import binary, packing, tokencount
from chatlake.llm.tokens import default_path, tokenizer

TEXTS = [
    (1, None), (2, ""), (3, "Hello world"), (4, "a<|endoftext|>b"), (5, "été ß Ünï — “quotes” 日本語 \x85\x1c x"), (6, "x" * 40000), (7, " \n\t  lots   of\r\nspace "),
    (8, "The quick brown fox. " * 2000), (3, "Hello world"), (None, "no id at all"), *((100 + i, f"short number {i} " * (i % 90 + 1)) for i in range(120)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1) for d, t in TEXTS], "doc_id long, text string, start int").repartition(3, "doc_id")


def exact_ids(text, end):
    t = Tokenizer.from_file(default_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_ids_equal_the_file_s(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [t for _, t in TEXTS]
    t = Tokenizer.from_file(default_path())
    own = tokenizer(default_path())
    for text in rows:
        assert own.ids(text).tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("window", [1 << 20, 3000])
def test_packing_is_exact_and_tight(docs, window):
    config = packing.PackingConfig(window_tokens=window)
    pieces = packing.packed_documents(docs, config).collect()
    want = sorted(((str(d), tuple(exact_ids(t, 0).tolist())) for d, t in TEXTS))
    ids_of = defaultdict(list)
    for d, ids in want:
        ids_of[d].append(np.array(ids, dtype="<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[str(p.doc_id)].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for d, got in by_doc.items():
        copies = ids_of[d]
        assert sum(p.length for p in got) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for p in sorted(got, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == zlib.crc32(copies[0][p.start : p.start + p.length].tobytes())
                at += p.length
    used = padded = 0
    for got in by_seq.values():
        at = 0
        for p in sorted(got, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and len(got) <= config.segments and sum(p.loss_tokens for p in got) <= config.loss_tokens
        used += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= 0.02 * used


def test_packing_keeps_all_limits_of_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = turns.union(spark.createDataFrame([(None, 1, None, None), (9999, 1, "assistant", "long answer " * 3000)], turns.schema))
    config = packing.PackingConfig(tokens=256, segments=4, loss_tokens=100)
    pieces = packing.packed_conversations(turns, config).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for got in by_seq.values():
        assert sum(p.length for p in got) <= 256 and len(got) <= 4 and sum(p.loss_tokens for p in got) <= 100
    for got in by_doc.values():
        assert sum(p.length for p in got) == got[0].doc_tokens
    assert len(by_doc) == turns.select("conv_id").distinct().count()


def test_packing_of_all_conversations_is_whole_and_bound_by_loss(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    config = packing.packed_conversations.__defaults__[0]
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in packing.packed_conversations(turns).collect():
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    tok, want = tokenizer(default_path()), defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        ids = tok.ids(r.text or "").tolist()
        want[r.conv_id] += zip(ids, [r.role == "assistant"] * len(ids))
    assert set(by_doc) == set(want)
    for d, got in by_doc.items():
        full, at = [*want[d], (config.end_id, True)], 0
        for p in sorted(got, key=lambda p: p.start):
            part = full[p.start : p.start + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array([i for i, _ in part], dtype="<u4").tobytes())
            assert p.loss_tokens == sum(bears for _, bears in part)
            at += p.length
        assert at == len(full) == got[0].doc_tokens
    sums = [(sum(p.length for p in got), len(got), sum(p.loss_tokens for p in got)) for got in by_seq.values()]
    assert all(t <= config.tokens and n <= config.segments and loss <= config.loss_tokens for t, n, loss in sums)
    bound = [s for s in sums if s[0] < config.tokens and s[2] == config.loss_tokens]
    assert bound


def test_room_tree_finds_the_least_room():
    rng = random.Random(4)
    tree, rooms = binary.RoomTree(1024), []
    for _ in range(3000):
        n = rng.randint(1, 1024)
        want = min((r for r in rooms if r >= n), default=None)
        assert tree.least(n) == want
        if want is not None and rng.random() < 0.7:
            rooms.remove(want)
            tree.change(want, -1)
        else:
            rooms.append(n)
            tree.change(n, 1)


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(8)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    rows, left = [], []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fit = [r for r in range(len(rows)) if left[r] >= lengths[i]]
        if fit:
            best = min(left[r] for r in fit)
            left[next(r for r in fit if left[r] == best)] -= lengths[i]
        else:
            rows.append([i])
            left.append(100 - lengths[i])
    got = binary.best_fit_decreasing(lengths, 100)
    assert sorted(i for r in got for i in r) == list(range(400))
    assert sorted(100 - sum(lengths[i] for i in r) for r in got) == sorted(left)


@pytest.mark.parametrize("window", [1 << 20, 3000])
def test_binary_round_trip(docs, window, tmp_path):
    rows = binary.written_rows(docs, str(tmp_path / f"ids{window}"), binary.BinaryConfig(window_tokens=window))
    for r in rows.collect():
        assert len(r.ids) == 1024 * r.id_bytes and len(r.position_ids) == 1024 * r.id_bytes and r.cu_seqlens[-1] == r.n_tokens
        places = np.frombuffer(r.position_ids, dtype=f"<u{r.id_bytes}")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
    back = defaultdict(list)
    for r in binary.unpacked(rows).collect():
        back[str(r.doc_id)].append((r.start, r.ids))
    want = defaultdict(list)
    for d, t in TEXTS:
        ids = exact_ids(t, 50256).tolist()
        want[str(d)] += [(s, ids[s : s + 1024]) for s in range(0, len(ids), 1024)]
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_documents(docs).count() == 0
    assert binary.packed_rows(docs).count() == 0
    assert tokencount.token_counts(docs).count() == 0


def brute_count(model, word):
    marked = tokencount.MARK + word
    best = [(0, 0)] + [(math.inf, 0)] * len(marked)
    one = tokencount._ONE
    for end in range(1, len(marked) + 1):
        n = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + (model.byte // one) * n, best[end - 1][1] + n)]
        for start in range(end):
            if marked[start:end] in model.step:
                options.append((best[start][0] + model.step[marked[start:end]] // one, best[start][1] + 1))
        best[end] = min(options)
    return best[-1][1]


def test_token_counts_equal_brute_force(spark):
    model = tokencount.Unigram.from_file(tokencount.default_path())
    docs = spark.createDataFrame([(d, t, 1) for d, t in [*TEXTS, (50, "日本語 \U0001f600é the theater there"), (51, "y" * 3000)] if t is None or len(t) < 5000], "doc_id long, text string, n_tokens int")
    docs = docs.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30))
    for config in (tokencount.TokenCountConfig(), tokencount.TokenCountConfig(kept_words=10)):
        got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in tokencount.token_counts(docs, config).collect()), key=str)
        kept = {}
        want = []
        for r in docs.collect():
            words = [w.decode() for w in (r.text or "").encode().split()]
            for w in words:
                if w not in kept:
                    kept[w] = brute_count(model, w)
            want.append((r.doc_id, len(words), sum(kept[w] for w in words)))
        assert got == sorted(want, key=str)


def test_both_tokenizers_agree_on_every_plain_character():
    """Ids of the fast library against the file's own, over random texts of all characters that the fast one takes, alone and in runs."""
    import random

    from chatlake.llm import tokens

    tok = tokens.tokenizer(tokens.default_path())
    plain = [chr(i) for i in range(0x2100) if not tokens._PLAIN.search(chr(i))]
    assert len(plain) > 500
    rng = random.Random(9)
    texts = [*plain, *(c * 3 for c in plain), *(f"a{c} {c}b\n{c}{c} 1{c}" for c in plain)]
    texts += ["".join(rng.choices(plain, k=rng.randint(2, 60))) for _ in range(6000)]
    texts += ["".join(rng.choice(("'s", "'LL", " ", "  ", "\n\n", "\t", "Éa", "12", "\u2026", "\u20ac", "x\u2019", "\xa0", "word", ".")) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for text in texts:
        assert tok.fast.encode_ordinary(text) == tok.exact.encode(text, add_special_tokens=False).ids, repr(text)
