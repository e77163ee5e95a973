"""Steps whose memory, shuffles and work must not grow faster than the tables: their plans, and the same results as plainer ways."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import embedding, index, retrieval
from chatlake.plans import queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark):
    texts = ["kedi köpek kedi", "köpek kuş", "kedi köpek kedi", "", None, "kuş kuş balık " * 40, *[f"köpek balık{i % 3}" for i in range(30)]]
    return spark.createDataFrame([(i * 7 % 36, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_postings_are_made_without_a_shuffle(spark, sf001):
    docs = queries.table(spark, sf001, "documents")
    made = index.postings(spark.read.parquet(f"{sf001}/documents.parquet"), "doc_id")
    assert "Exchange" not in plan_of(made)
    want = docs.select("doc_id", F.explode(queries.text.stems(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    lex = index.lexical(docs, "doc_id")
    got = lex.terms.select("doc_id", "term", F.col("tf").cast("long"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_long_texts_are_counted_in_tiles(monkeypatch):
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    texts = [["a", "b", "a", "c"], [], None, ["c"] * 5, ["b", "a"], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.list_(pa.string()))], names=["k", "s"])
    monkeypatch.setattr(index, "WORDS", 3)
    tiles = list(index._counted([batch, batch.slice(0, 0)], "k"))
    rows = [(r["k"], r["doc_len"], dict(zip(r["terms"], r["tfs"]))) for t in tiles for r in t.to_pylist()]
    assert len(tiles) > 2 and rows == [(i, None if t is None else len(t), dict(Counter(t or []))) for i, t in enumerate(texts)]
    monkeypatch.undo()
    words = pa.array([f"w{i}" for i in range(1000)]).take(pa.array([i * i % 1000 for i in range(8000)] * 500))
    long = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.ListArray.from_arrays(pa.array(range(0, 4_000_001, 8000), pa.int32()), words)], names=["k", "s"])
    tracemalloc.start()
    assert sum(t.num_rows for t in index._counted([long], "k")) == 500
    assert tracemalloc.get_traced_memory()[1] < 50e6  # 4 million words; before, arrays of all of them at once
    tracemalloc.stop()


def test_best_documents_are_chosen_in_the_tasks(spark, monkeypatch):
    lex = index.lexical(docs_of(spark), "doc_id")
    asked = spark.createDataFrame([(1, "köpek kedi köpek"), (2, "balık"), (3, "kuş balık1"), (4, "yok"), (5, None), (6, "köpek")], "query_id long, text string")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "doc_id")
    want = index.bm25(asked, lex).withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.bm25, 9)) for r in df.collect())
    best = index.bm25_topk(asked, lex, 4)
    assert "Join" not in plan_of(best) and "MapInArrow" in plan_of(best)  # no row for every query and document
    assert rows(best) == rows(want) and len(rows(want)) == 16
    monkeypatch.setattr(index, "CELLS", 1)  # tiles of one document, blocks of two queries
    assert rows(index.bm25_topk(asked, lex, 4, most_queries=2)) == rows(want)


def test_texts_that_are_null_have_no_length(spark):
    lex = index.lexical(docs_of(spark), "doc_id")
    assert lex.totals.first().n == 36
    assert abs(lex.totals.first().avg_len - (3 + 2 + 3 + 0 + 120 + 60) / 35) < 1e-12  # as SQL's avg(doc_len)


def test_postings_of_an_earlier_index_are_read(spark):
    docs = docs_of(spark).where("text is not null")
    now = index.lexical(docs, "doc_id")
    old = index.lexical_of(now.terms.select("doc_id", "term", F.col("tf").cast("long"), "doc_len"), docs, "doc_id")
    asked = spark.createDataFrame([(1, "köpek kedi"), (2, "kuş")], "query_id long, text string")
    assert sorted(map(tuple, index.bm25_topk(asked, old, 3).collect())) == sorted(map(tuple, index.bm25_topk(asked, now, 3).collect()))
    assert old.totals.first() == now.totals.first()


def brute_vector(text, dims=512):
    import hashlib
    import math
    import re
    from collections import Counter, defaultdict

    w, feats = re.findall(r"\w+", text.lower()), Counter()
    for t in w:
        feats["w:" + t] += 1.0
        for n in (4, 5):
            for i in range(len(t) - n + 1):
                feats["c:" + t[i : i + n]] += 0.5
    for a, b in zip(w, w[1:]):
        feats[f"b:{a}_{b}"] += 0.75
    out = defaultdict(float)
    for f, x in feats.items():
        d = hashlib.md5(f.encode()).hexdigest()
        out[int(d[:8], 16) % dims] += (1 if int(d[8], 16) % 2 else -1) * (1 + math.log(x + 1))
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {b: x / norm for b, x in out.items()}


def test_vectors_are_made_without_a_shuffle(spark, monkeypatch):
    import pyarrow as pa

    # a_b c and a b_c have one feature between them; a word holds a gram twice; a text without words has no vector.
    texts = ["a_b c a b_c", "aaaaaaa aaaa", "", "?!", None, "köpek kuşlar " * 30, "kediler"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2)
    assert "Exchange" not in plan_of(embedding.hashed(spark.range(3).select("id", F.lit("x").alias("text")), "id"))
    assert "Exchange" not in plan_of(embedding.embedded(spark.range(3).select("id", F.lit("x").alias("text")), "id"))
    got = {}
    for r in embedding.hashed(docs, "k").collect():
        got.setdefault(r.k, {})[r.bucket] = r.value
    want = {i: brute_vector(t) for i, t in enumerate(texts) if t and t != "?!"}
    assert got.keys() == want.keys() and all(got[i].keys() == want[i].keys() and all(abs(got[i][b] - x) < 1e-12 for b, x in want[i].items()) for i in want)
    whole = {r.k: r.vector for r in embedding.embedded(docs, "k").collect()}
    assert whole.keys() == want.keys() and all(abs(whole[i][b] - want[i].get(b, 0.0)) < 1e-6 for i in want for b in range(512))
    monkeypatch.setattr(embedding, "WORDS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([t if t is None else t.replace("?!", "").split() for t in texts])], names=["k", "w"])
    tiles = list(embedding._places([batch], 512))
    tiled = {(keys[int(i)].as_py(), int(b)): x for keys, row, bucket, value in tiles for i, b, x in zip(row, bucket, value)}
    assert len(tiles) > 3 and tiled.keys() == {(i, b) for i in want for b in want[i]} and all(abs(x - want[i][b]) < 1e-12 for (i, b), x in tiled.items())


def test_intents_lower_a_text_few_times(spark, sf001):
    assert plan_of(queries.QUERIES["classify_intent"](spark, sf001)).count("lower(") <= 4  # once for each side of the union; before, at each of some hundred words


def test_pools_stream_by_one_question_at_a_time(spark):
    rows = [
        (1, "b", 0.5, "elma armut"), (1, "a", 0.5, "kiraz erik"), (1, "c", 0.9, "elma armut kavun"), (1, "d", 0.4, None), (1, "e", None, "ceviz"), (1, "f", 0.3, "kiraz erik"), (1, None, 0.2, "söz"),
        (2, "x", 0.7, None), (2, "y", 0.6, "elma"), (3, "z", None, "elma"), (4, "u", 0.6, None), (4, "v", 0.5, "!"),
    ]
    pool = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, text string")
    best = retrieval.diversified(pool, 6)
    assert "FlatMapGroupsInArrow" in plan_of(best) and "collect_list" not in plan_of(best)  # a task held the pools of all its questions
    # a and b tie: a is farther from c. f is a copy of a; d has no text, e no score; x has no text to compare y with, and v has one without words.
    assert set(map(tuple, best.collect())) == {(1, "c", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (2, "x", 1), (4, "u", 1), (4, "v", 2)}
