import functools
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from xxhash import xxh64_intdigest

from chatlake.llm import imatch, langid


def xx(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value) if isinstance(value, int) else struct.pack("<i", value[0])
    return xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term_set(text):
    return set(regex.split(r"[^\p{L}\p{N}]+", (text or "").lower())) - {""}


def brute_print(text, lexicon, config):
    words, got = term_set(text), {}
    held = {xx(t) for t in words} & lexicon
    for h in held:
        places, base = [0], 1
        for bits, cells in config.subsets:
            cell = xx((bits,), xx(signed(h))) >> (64 - bits)
            if cell < cells:
                places.append(base + cell)
            base += cells
        for j in places:
            got.setdefault(j, []).append(signed(h))
    if not got:
        seed = 42
        for t in sorted({"", *words}, key=lambda t: t.encode()):
            seed = xx(t, seed)
        got = {0: None}
        words_ = [(seed >> 6 << 6)]
    else:
        words_ = [functools.reduce(lambda x, h: xx(h, xx(signed(x))), sorted(hs), j) >> 6 << 6 | j for j, hs in got.items()]
    return sorted(words_, key=signed)


def alike(a, b):
    return len(set(a) & set(b)) / len({w & 63 for w in a} | {w & 63 for w in b})


def brute_rows(rows, config):
    n = len(rows)
    df = Counter(t for _, text in rows for t in term_set(text))
    low = max(2, -(-config.band[0] * n // 1))
    lexicon = {xx(t) for t, k in df.items() if low <= k <= max(config.band[1] * n, low)}
    low_id = -(1 << 63)
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (low_id if r[0] is None else r[0], signed(xx(r[1])), r[1].encode()), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % n][1]
        k = len(t) // 2
        e = t[: len(t) - k] + after[:k]
        a, b, c = (brute_print(x, lexicon, config) for x in (t, e, after))
        h = lambda ws: "".join(f"{w:016x}" for w in ws)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), h(a), h(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=str)


ROWS = [(i * 7 % 101, " ".join(f"t{(i * j) % 37} wort{j % 5}é" for j in range(i % 23))) for i in range(60)]
ROWS += [(None, None), (None, "t1 t2 t3"), (500, ""), (501, "... !!"), (502, "Alone Unique Words"), (502, "t1 t2"), (502, "t1 t2"), (900, "t4 t5 " * 9000), (10**12, "t1 wort1é Große")]


@pytest.mark.parametrize("config", [imatch.IMatchConfig(), imatch.IMatchConfig(band=(0.1, 0.6), knots=3, ranges_per_partition=2, subsets=((1, 2), (2, 3)))])
def test_fingerprints_equal_brute_force(spark, config):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, seq string, fp int")
    got = imatch.fingerprints_with_edits(docs, config).collect()
    assert sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute_rows(ROWS, config)
    plain = sorted((tuple(r) for r in imatch.fingerprints(docs, config).collect()), key=str)
    assert plain == sorted(((r.doc_id, r.fingerprint) for r in got), key=str)


@pytest.mark.parametrize("rows", [[], [(3, "one two three")], [(None, None)]])
def test_tiny_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.fingerprints_with_edits(docs).collect()
    assert len(got) == len(rows) and all(r.near_next == 1 and r.near_edited == 1 or r.n_chars > 1 for r in got)


def test_edited_texts_are_nearer_than_the_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = imatch.fingerprints_with_edits(docs).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.85
    assert got.near_edited.mean() > 10 * got.near_next.mean()


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.1


def test_language_edges(spark):
    text = {"aa": "abcab bcabc cabca ", "zz": "xyzxz zyxzy yzyxz "}
    rows = [(i, text[k] * (i % 7 + 1), k) for i in range(80) for k in text if (i % 2) == (k == "zz")]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "zz"), (None, text["aa"], "zz"), (1003, text["aa"] * 5000, None), (1003, text["aa"] * 5000, None), (1004, "日本語テキスト", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "aa" and not by[None].held_out and by[1003].lang_pred == "aa" and by[1004].rejected
    assert all(by[d].lang_pred == k for d, _, k in rows if d is not None and d < 80)
    none = langid.languages(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null or lang = ''").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.languages(docs.limit(0)).count() == 0


def brute_grams(text, bits):
    """Hashed places of a text's 1-, 2- and 3-grams, straight from the docstring: runs of letters with one blank (0) between, 0 at both ends."""
    low = (text or "").lower()
    runs = regex.findall(r"[\p{L}]+", low)
    if not runs:
        return None
    points = [0]
    for i, run in enumerate(runs):
        points += [0] * (i > 0) + [ord(c) for c in run]
    points += [0] if low[-1].isalpha() else [0, 0]
    grams = [p + (1 << 63) for p in points if p]
    grams += [(a << 21 | b) + (1 << 62) for a, b in zip(points, points[1:])]
    grams += [((a << 21 | b) + 0) << 21 | c for a, b, c in zip(points, points[1:], points[2:])]
    return Counter(((g & (1 << 64) - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits) for g in grams)


def test_nearest_centroid_equals_brute_force(spark):
    """The fitted centroids kept as they are: frequencies, vectors, cosines, nearest language and score worked out term by term."""
    import math

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(900001, None, "en"), (900002, "123 !", "en"), (900003, "Ünïcode straße", None), (900004, "a", None), (900005, "der die und " * 4000 + "?", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = langid.LanguageConfig()
    model = langid.fit(docs, config)
    grams = {d: brute_grams(t, config.dims_bits) for d, t, _ in rows}
    train = [d for d, t, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 5 and grams[d]]
    df = Counter(at for d in train for at in grams[d])
    idf = {at: math.log((1 + len(train)) / (1 + k)) + 0.05 for at, k in df.items()}
    got = {r.doc_id: r for r in langid.languages(docs, config).collect()}
    for d, t, _ in rows:
        if not grams[d]:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        v = {at: (1 + math.log(c)) * idf.get(at, math.log(1 + len(train))) for at, c in grams[d].items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        sims = [sum(x * float(c[at]) for at, x in v.items()) / length for c in model.centres]
        assert abs(got[d].score - min(1, max(0, max(sims)))) < 1e-4
        near = {lang for lang, s in zip(model.langs, sims) if s > max(sims) - 1e-4}
        assert got[d].lang_pred in near
    assert {len([x for x in model.langs if x == lang]) for lang in model.langs} <= {1, 2, 3}


def test_a_hot_id_and_unbroadcast_tables_change_nothing(spark):
    """A sampled id with thousands of equal rows fills its language's sample only up to its size; larger tables are shuffled instead."""
    text = {"aa": "abcab bcabc cabca ", "zz": "xyzxz zyxzy yzyxz "}
    rows = [(i, text[k] * (i % 7 + 1), k) for i in range(80) for k in text if (i % 2) == (k == "zz")]
    hot = next(d for d, _, k in rows if k == "aa" and zlib.crc32(str(d).encode()) % 5)
    docs = spark.createDataFrame(rows + [(hot, text["aa"], "aa")] * 3000, "doc_id long, text string, lang string")
    small = langid.LanguageConfig(sample_docs=20)
    one, other = langid.fit(docs, small), langid.fit(docs, langid.LanguageConfig(sample_docs=20, broadcast_rows=0))
    assert one.langs == other.langs and set(one.langs) == {"aa", "zz"}
    assert np.array_equal(one.centres, other.centres) and np.array_equal(one.idf, other.idf)
    got = {r.doc_id: r.lang_pred for r in langid.languages(docs, small).collect()}
    assert all(got[d] == k for d, _, k in rows)
