import random

import numpy as np
import pytest

import corpus_pipeline
from chatlake.llm import decontaminate, linededup, quality


def corpus(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))]
        grade = (2, 2, 1, 0)[i % 4]
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        if grade == 0:
            words[3:3] = ["grumble", "insultword"]
        out.append((i, " ".join(words), grade))
    return out


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame([(d, g) for d, _, g in corpus(400)] + [(None, 1), (5, None), (99999, 0)], "doc_id long, grade int")


def test_slopes_are_those_of_the_likelihood():
    t = np.array([-0.7, 0.9])
    m = quality.CumulativeLink(np.zeros(4), t)
    for y in range(3):
        def loglik(s):
            f = np.concatenate([[0.0], m.at_most(np.array([s]))[0], [1.0]])
            return np.log(f[y + 1] - f[y]), f
        eps = 1e-6
        value, f = loglik(0.3)
        assert (loglik(0.3 + eps)[0] - value) / eps == pytest.approx(f[y] + f[y + 1] - 1, abs=1e-4)


def test_held_out_accuracy_and_order(spark, rated):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in corpus(600)], "doc_id long, text string, accepted string")
    got = {r.doc_id: r for r in quality.graded(docs, rated).collect()}
    held = [(d, g) for d, _, g in corpus(600) if d >= 400]
    assert np.mean([got[d].accepted == (g == 2) for d, g in held]) >= 0.95
    means = [np.mean([got[d].expected_grade for d, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 1 + r.tail_probability for r in got.values())
    kept = quality.accepted(docs, rated)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in got if got[d].accepted}


def test_edges(spark, rated):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "fine words here"), (4, "dup"), (4, "dup"), (6, "..."), (7, "long " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.union(spark.createDataFrame([(1000 + d, t) for d, t, _ in corpus(80)], docs.schema))
    shifted = rated.selectExpr("doc_id + 1000 as doc_id", "grade")
    got = quality.graded(train, shifted).where("doc_id < 1000 or doc_id is null").collect()
    assert len(got) == len(rows)
    assert all(not r.accepted and r.tail_probability == 0 and r.expected_grade == 0 for r in got if r.doc_id in (1, 2, 3))
    nothing = spark.createDataFrame([], "doc_id long, grade int")
    assert {r.doc_id for r in quality.graded(docs, nothing).where("accepted").collect()} == {None, 4, 6, 7}
    assert quality.graded(docs.limit(0), rated).count() == 0
    assert quality.accepted(docs.limit(0), rated).count() == 0


def test_ratings_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, 0, 1), (5, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.ratings(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: None, 6: None}


def brute_stages(spark, sf):
    """What each stage should keep, from the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        yield name, docs, (out := stage(spark, docs, sf).cache())
        docs = out


def alike(x, y):
    return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)


def test_stages_on_their_own_inputs(spark, sf001):
    sf001 = sf001.replace("0.001", "0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    for name, before, after in brute_stages(spark, sf001):
        a, b = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == before.columns
        ids = {r.doc_id for r in b}
        if name == "quality_classifier":
            clean = [r.doc_id for r in a if r.doc_id in labels and labels[r.doc_id].toxic == 0 and labels[r.doc_id].quality == 1]
            assert sum(d in ids for d in clean) >= 0.97 * len(clean)
            toxic = [d for d in labels if labels[d].toxic]
            assert sum(d in ids for d in toxic) <= 0.1 * len(toxic)
        if name == "line_dedup":
            owners = {}
            for r in sorted(a, key=lambda r: r.doc_id):
                for line in (r.text or "").split("\n"):
                    key = line.strip(linededup.BLANKS)
                    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
                    owners.setdefault(key, r.doc_id)
            got = {r.doc_id: r.text for r in b}
            for r in a:
                want = []
                for line in (r.text or "").split("\n"):
                    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(linededup.BLANKS))
                    if len(key) < 10 or owners[key] == r.doc_id:
                        want.append(line)
                assert got[r.doc_id] == "\n".join(want)
        if name == "simhash_near_dedup":
            # Links are pairs with a Jaccard similarity of 0.8 or more on five-word shingles, whatever brings them together.
            words = {r.doc_id: (r.text or "").encode().lower().split() for r in a}
            sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in words.items()}
            near = {d: [e for e in sets if alike(sets[d], sets[e])] for d in sets}
            want, seen = set(), set()
            for d in sorted(near):
                if d not in seen:
                    want.add(d)
                    todo = [d]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += near[x]
            assert ids == want
        if name == "benchmark_decontamination":
            items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
            sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
            for r in a:
                w = decontaminate.words_of(r.text)
                own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
                assert (r.doc_id in ids) == all(len(s & own) * 10 < 8 * len(s) for s in sets)
        if name == "packing":
            assert ids == {r.doc_id for r in a}


def test_run_equals_the_stages(spark, sf001):
    whole = corpus_pipeline.run(spark, sf001)
    *_, (_, _, last) = brute_stages(spark, sf001)
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert key(whole) == key(last)


def test_samples_do_not_depend_on_partitions_and_stay_near_their_size(spark):
    from pyspark.sql import functions as F

    from chatlake.llm.sampling import hash_cut

    rows = spark.range(20_000)
    few = {r.id for r in rows.where(hash_cut(F.col("id"), 500, 20_000)).collect()}
    assert 800 < len(few) < 1200
    assert few == {r.id for r in rows.repartition(7).where(hash_cut(F.col("id"), 500, 20_000)).collect()}
    least = [r.id for r in rows.orderBy(F.xxhash64("id")).limit(500).collect()]
    assert set(least) <= few
    assert rows.where(hash_cut(F.col("id"), 20_000, 20_000)).count() == 20_000
    assert rows.where(hash_cut(F.col("id"), 5, F.lit(3))).count() == 20_000


def test_near_dedup_stage_equals_brute_force_jaccard(spark, sf001):
    docs = spark.read.parquet(f"{sf001.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    extra = [(900_001, "Les."), (900_002, "Les.\nLes."), (900_003, "one two three four five six"), (900_004, "six five four three two one")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in rows.items()}
    want, seen = set(), set()
    for d in sorted(sets):
        if d not in seen:
            want.add(d)
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [e for e in sets if e not in seen and 5 * len(sets[x] & sets[e]) >= 4 * len(sets[x] | sets[e])]
    assert {900_001, 900_002, 900_003, 900_004} <= want
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf001).collect()} == want


def test_grades_and_tails_equal_brute_force(spark):
    """The fitted weights and thresholds kept as they are: scores, grade probabilities, expectation and tail worked out one by one."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "word " * 30_000), (900004, "  \n ")], "doc_id long, text string")
    docs = docs.union(extra)
    rated = quality.ratings(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    config = quality.QualityConfig()
    model = quality.fit(docs, rated, config)
    assert all(a <= b for a, b in zip(model.thresholds, model.thresholds[1:])) and len(model.thresholds) == config.grades - 1
    text = dict(docs.collect())
    for r in quality.graded(docs, rated, config).collect():
        used = quality.feature_ids(text[r.doc_id], config.bits)
        if not len(used):
            assert (r.expected_grade, r.tail_probability) == (0.0, 0.0)
            continue
        score = sum(float(model.weights[i]) for i in used)
        at_most = [1 / (1 + math.exp(-max(-40, min(40, t - score)))) for t in model.thresholds] + [1.0]
        chance = [b - a for a, b in zip([0.0, *at_most], at_most)]
        assert min(chance) >= 0 and abs(sum(chance) - 1) < 1e-9
        assert abs(r.expected_grade - sum(k * p for k, p in enumerate(chance))) < 1e-6 and abs(r.tail_probability - chance[-1]) < 1e-6
        assert r.accepted == (r.tail_probability >= config.accept)


@pytest.mark.parametrize("name", ["__score", "__SCORE", "tail_probability"])
def test_accepted_keeps_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, None, "y")], f"doc_id long, text string, {name} string")
    rated = spark.createDataFrame([], "doc_id long, grade int")
    out = quality.accepted(docs, rated)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "good words here", "x")]
