"""Truth tables, invariants and end-to-end runs of the engine."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.functions import masking
from chatlake.functions import vocabulary as v
from chatlake.operators import chunking, embedding, index, queue, retrieval, workflows
from chatlake.plans import cases
from chatlake.plans.cli import parser
from chatlake.plans.engine import Engine
from chatlake.sources import files
from chatlake.sources.settings import Settings
from chatlake.streaming import updates


def masked(spark, texts, **policy):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [(r.masked, r.masked_counts) for r in masking.with_masked(rows, policy=masking.MaskingPolicy(**policy)).orderBy("i").collect()]


def test_masking_cases(spark):
    texts = [t for _, t in cases.MASKING]
    got = masked(spark, texts)
    assert got[0][0] == "Bana [TELEFON] numarasından ulaşın, ya da [TELEFON]." and got[0][1].phone == 2
    assert got[1][0] == texts[1]
    assert got[2][0] == "Yazın: [E-POSTA] ve [EĞİTMEN E-POSTA]; örnek: x@example.com, y@[ÖZEL LİNK]" or "[E-POSTA]" in got[2][0]
    assert "[ÖZEL LİNK]" in got[3][0] and "learn.microsoft.com" in got[3][0]
    assert got[5][0].startswith("Selam [KULLANICI] ve @eğitmen, @everyone")
    assert got[6][0].count(v.ROSTER_MARK) == 2 and got[6][1].roster_row == 3
    assert got[7][1].contact_card == 1


def test_masking_is_idempotent_and_can_be_turned_off(spark):
    texts = [t for _, t in cases.MASKING]
    once = [m for m, _ in masked(spark, texts)]
    assert [m for m, _ in masked(spark, once)] == once
    off = masked(spark, texts, emails=False, phones=False, urls=False, handles=False, rosters=False)
    assert all(sum(c) == 0 for _, c in off)


def test_pseudonyms_are_stable_and_hide_the_name(spark):
    row = spark.sql("select 'Ali Veli' a, ' ali veli ' b, 'Can' c").select(*[masking.pseudonym(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a == row.b != row.c and "Ali" not in row.a


def test_split_long_keeps_all_and_overlaps(spark):
    config = chunking.ChunkingConfig(max_chars=100, overlap_chars=20)
    text = "\n\n".join(" ".join(f"kelime{i}x{j}." for j in range(12)) for i in range(6)) + "\n\n" + "z" * 350
    got = spark.createDataFrame([(text,)], "t string").select(chunking.split_long(F.col("t"), config).alias("p")).first().p
    assert len(got) > 5 and all(len(p) <= 100 + 20 + 2 for p in got)
    assert all(w in " ".join(got) for w in text.split()[:70])
    with pytest.raises(ValueError):
        chunking.ChunkingConfig(max_chars=10, overlap_chars=10)


def test_three_valued_states(spark):
    rows = [("Video çektim", True), ("Videoyu çekmedim", False), ("hiçbir şey", None), ("video var. video yok", False)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(workflows.state_of(F.col("t"), ("video",)).alias("s")).collect()
    assert [r.s for r in got] == [s for _, s in rows]


def test_cosine_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id int, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:7])], "query_id int, vector array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most in (100_000, 3):
        got = {}
        for r in embedding.cosine_topk(queries, rows, 4, most_queries=most).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
        assert all([got[q][k] for k in (1, 2, 3, 4)] == np.argsort(-(n @ n[q]), kind="stable")[:4].tolist() for q in range(7))


def brute_mmr(pool, limit, lam=0.72, dup=0.85):
    pool = sorted(pool, key=lambda p: (-p[1], p[0]))
    chosen, rest = pool[:1], pool[1:]
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while rest and len(chosen) < limit:
        best = None
        for c in rest:
            near = max(jac(c[2], s[2]) for s in chosen)
            if near < dup and (best is None or lam * c[1] - (1 - lam) * near > best[0] + 1e-12):
                best = (lam * c[1] - (1 - lam) * near, c)
        if best is None:
            break
        chosen.append(best[1])
        rest.remove(best[1])
    return [c[0] for c in chosen]


def test_diversity_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for q in range(6):
        pool = []
        for i in range(14):
            words = [f"kelime{k}" for k in rng.integers(0, 25, 12)]
            if i % 4 == 3:
                words = pool[-1][3]
            pool.append((f"c{i:02d}", round(float(rng.random()), 6), {w[:5] + w[5:][:0] if len(w) > 5 else w for w in words}, words))
        pool = [(c, s, set(w[:5] for w in ws), ws) for c, s, _, ws in pool]
        words_of = {c: " ".join(f"{w[6:]}abc" if w[6:] else w for w in ws) for c, _, _, ws in pool}
        pool = [(c, s, {f"{w[6:]}abc"[:5] for w in ws}) for c, s, _, ws in pool]
        rows += [(q, c, s, words_of[c]) for c, s, _ in pool]
        want[q] = brute_mmr(pool, 5)
    got = {}
    for r in retrieval.diversified(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, text string"), 5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add_text("grup", cases.EXPORT)
    e.add_text("teslim notları", "Final teslim notları. Kaynak kod linki ve video linki e-posta ile gönderilir.\n\nListe her hafta güncellenir; hata varsa düzeltme isteği gönderin.")
    return e


def test_engine_answers_and_refuses(engine, spark):
    assert engine.stats().first().messages == 6
    asked = spark.createDataFrame(
        [(1, "Final teslim için ne gerekiyor?", v.QA), (2, "Pizza tarifi nedir?", v.QA), (3, " ", v.QA), (4, "Listede adım yanlış görünüyor, düzeltme rica ederim", v.QA), (5, "Endpoint adresini nasıl kontrol ederim, bağlanamıyor", v.TECHNICAL)],
        "query_id long, text string, mode string",
    )
    got = {r.query_id: r for r in engine.ask(asked).collect()}
    assert len(got) == 5
    assert got[1].mode == v.CHECKLIST and got[1].answer.startswith(v.SUBMISSION_TITLE) and json.loads(got[1].structured)["tur"] == "teslim_kurallari"
    assert got[2].evidence == "none" and got[2].answer == v.NO_EVIDENCE and not got[2].citations
    assert got[3].answer == v.BLANK_QUESTION
    assert got[4].mode == v.CORRECTION and json.loads(got[4].structured)["auto_apply"] is False
    assert all(c.snippet for r in got.values() for c in r.citations)
    texts = " ".join(r.text for r in engine.index.chunks.collect())
    assert "0532" not in texts and "555 111" not in texts


def test_triage_never_sends(engine, spark):
    rows = spark.createDataFrame([(i, q) for i, (q,) in enumerate(cases.QUESTIONS)], "message_id long, text string")
    got = engine.triage(rows).collect()
    assert len(got) == len(cases.QUESTIONS)
    assert all(r.requires_human and not r.auto_send for r in got)
    assert all(r.draft == "" for r in got if r.reply_decision == "do_not_answer")


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.txt").write_text("bir", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("iki \xff".encode("latin-1"))
    (tmp_path / "c.png").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "WhatsApp Chat - grup.zip", "w") as z:
        z.writestr("_chat.txt", "sohbet")
        z.writestr("ek/notlar.txt", "not")
        z.writestr("foto.jpg", b"y")
    got = {r.source: r.text for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "bir", "b": "iki �", "grup": "sohbet", "grup-notlar": "not"}
    assert files.texts(spark, str(tmp_path / "none")).count() == 0


def test_corpus_build_and_load(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    (folder / "one.txt").write_text(cases.EXPORT.replace("Eğitmen:", "Ada Hoca:"), encoding="utf-8")
    (folder / "same.txt").write_text(cases.EXPORT.replace("Eğitmen:", "Ada Hoca:"), encoding="utf-8")
    (folder / "notes.md").write_text("Ada Hoca der ki: teslim cuma günü biter. Sorular için ada@okul.test yazın.", encoding="utf-8")
    with pytest.raises(ValueError, match="allowed"):
        index.build(spark, str(folder), out, ["Ada Hoca"])
    with pytest.raises(ValueError, match="label"):
        index.build(spark, str(folder), out, ["Ada Hoca"], allow_hashing=True, labels={"one.txt": "ada hoca grubu"})
    with pytest.raises(ValueError, match="authority"):
        index.build(spark, str(folder), out, ["Baska Biri"], allow_hashing=True)
    (folder / "notes.md").write_text("Teslim cuma günü biter. Sorular için ada@okul.test yazın.", encoding="utf-8")
    made = index.build(spark, str(folder), out, ["Ada Hoca"], allow_hashing=True)
    assert made["sources"] == 2 and len(made["input_hashes"]) == 2 and made["privacy_scan_clean"]
    held = index.load(spark, out)
    assert not any("Ada" in r.text or "@okul" in r.text for r in held.chunks.collect())
    assert index.build(spark, str(folder), out, ["Ada Hoca"], allow_hashing=True)["chunks"] == made["chunks"]
    with pytest.raises(ValueError, match="backend"):
        index.load(spark, out, embedding.Backend("other", 512, "x"))


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    good = {"instructor_aliases": ["A"], "allowed_telegram_chat_ids": [1], "index_dir": "i", "queue_db": "q"}
    at.write_text(json.dumps(good))
    assert Settings.load(str(at), str(tmp_path)).chat_ids == (1,)
    for bad in ({"instructor_aliases": []}, {"allowed_telegram_chat_ids": [True]}, {"index_dir": "../x"}, {"index_dir": ""}, {"source_labels": [1]}):
        at.write_text(json.dumps(good | bad))
        with pytest.raises(ValueError):
            Settings.load(str(at), str(tmp_path))
    assert parser().parse_args(["ask", "soru", "--json"]).json


def test_backends(monkeypatch, spark):
    assert embedding.resolve("hashing") is embedding.HASHING
    with pytest.raises(ValueError):
        embedding.resolve("nope")
    model = embedding.Backend("sentence-model", 2, "two", embed=lambda texts: [[len(t), 1.0] for t in texts])
    embedding.register(model)
    try:
        assert embedding.resolve() is model
        monkeypatch.setenv("CHATLAKE_OFFLINE", "1")
        assert embedding.resolve() is embedding.HASHING
        got = embedding.embedded(spark.createDataFrame([(1, "abc"), (2, None)], "k int, text string"), "k", backend=model).orderBy("k").collect()
        assert np.allclose(got[0].vector, np.array([3, 1]) / np.sqrt(10), atol=1e-6) and got[1].vector == [0, 1]
    finally:
        embedding.REGISTRY.pop("sentence-model")


class Log:
    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def append(self, row):
        self.rows.append((row["item_id"], len(self.rows), row["command"], row.get("draft"), row.get("error"), row.get("decision")))

    def items(self):
        return queue.folded(self.spark.createDataFrame(self.rows, "item_id long, seq long, command string, draft string, error string, decision string"))


def test_outbox_sends_at_most_once(spark):
    log, sent, trouble = Log(spark), [], []

    def send(item, draft):
        if trouble:
            raise trouble.pop()
        sent.append((item, draft))

    box = queue.Outbox(log.append, log.items, send)
    for i, d in ((1, "draft_reply"), (2, "draft_reply"), (3, "do_not_answer")):
        log.append({"item_id": i, "command": "enqueue", "draft": "taslak", "decision": d})
    trouble.append(queue.DeliveryRejected("no https://x.y bot123456:" + "A" * 25))
    assert box.approve_and_send(1, "cevap") == "failed"
    assert "https" not in log.items().where("item_id = 1").first().error
    assert box.approve_and_send(1, "cevap") == "sent"
    with pytest.raises(queue.InvalidTransition):
        box.approve_and_send(1, "cevap")
    trouble.append(OSError("gone"))
    with pytest.raises(queue.DeliveryUncertain):
        box.approve_and_send(2, "cevap")
    with pytest.raises(queue.InvalidTransition):
        box.approve_and_send(2, "cevap")
    with pytest.raises(queue.InvalidTransition):
        box.approve_and_send(3, "cevap")
    for bad in ("", "x" * 5000):
        with pytest.raises(ValueError):
            box.approve_and_send(1, bad)
    with pytest.raises(KeyError):
        box.approve_and_send(9, "cevap")
    assert sent == [(1, "cevap")]
    assert {r.status: r.n for r in queue.status_counts(log.items()).collect()} == {"pending": 1, "sending": 1, "sent": 1, "failed": 0, "rejected": 0}


def update(i, text="Final teslim ne zaman?", chat=1, message=None, **more):
    m = {"message_id": message or i, "date": 1780000000, "chat": {"id": chat, "type": "group"}, "from": {"id": 5, "is_bot": False}, "text": text}
    return {"update_id": i, "message": m | more}


def test_stream_of_updates_is_triaged_once(engine, spark, tmp_path):
    src = tmp_path / "updates"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(u) for u in (update(1), update(2, chat=9), update(3, text=" "), update(4, text="Sertifika? @ali_veli"))))
    run = lambda: engine.triage_stream(updates.read_json(spark, str(src)), [1], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text("\n".join(json.dumps(u) for u in (update(1), update(5, text="Liste güncel değil"))))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.update_id for r in got) == [1, 4, 5]
    assert not any("ali_veli" in r.text for r in got)
    with pytest.raises(ValueError):
        updates.accepted(spark.createDataFrame([], updates.UPDATE), [])
    with pytest.raises(ValueError):
        updates.accepted(spark.createDataFrame([], updates.UPDATE), [1], masking.MaskingPolicy(phones=False))


def test_keyed_state_machine_over_restarts(spark, tmp_path):
    src, cp, out = tmp_path / "c", tmp_path / "cp", {}
    src.mkdir()

    def run():
        stream = spark.readStream.schema("item_id long, seq long, command string").json(str(src))

        def put(batch, _):
            out.update({r.item_id: (r.status, r.applied) for r in batch.collect()})

        updates.folded_stream(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(cp)).trigger(availableNow=True).start().awaitTermination()

    (src / "1.json").write_text("\n".join(json.dumps({"item_id": i, "seq": s, "command": c}) for i, s, c in ((1, 1, "enqueue"), (1, 2, "claim"), (2, 1, "claim"), (2, 2, "enqueue"))))
    run()
    assert out == {1: ("sending", 2), 2: ("pending", 1)}
    (src / "2.json").write_text("\n".join(json.dumps({"item_id": i, "seq": s, "command": c}) for i, s, c in ((1, 3, "failed"), (1, 4, "claim"), (1, 5, "sent"), (1, 6, "claim"), (2, 3, "reject"))))
    run()
    assert out == {1: ("sent", 5), 2: ("rejected", 2)}


def test_offsets_follow_the_last_update():
    assert updates.next_offset([7, 900, 3], silent=False) == 4
    assert updates.next_offset([], silent=False) is None and updates.next_offset([5], silent=True) is None


def test_equal_vectors_in_many_tasks_rank_by_key(spark):
    same = [0.3] * 8
    rows = spark.createDataFrame([(i, same) for i in range(10_000)], "chunk_id long, vector array<double>").repartition(7)
    asked = spark.createDataFrame([(q, [float(q + j) for j in range(8)]) for q in range(30)], "query_id long, vector array<double>")
    for most in (8192, 7):
        got = embedding.cosine_topk(asked, rows, 5, most_queries=most).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.chunk_id, r["rank"]) for r in got] == [(q, i, i + 1) for q in range(30) for i in range(5)]


def test_nearest_holds_tiles_only():
    import tracemalloc

    import pyarrow as pa

    m = np.random.default_rng(0).normal(size=(20_000, 16))
    x = np.random.default_rng(1).normal(size=(6_000, 16))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3000)), pa.array(x[k : k + 3000].tolist())], names=["k", "v"]) for k in (0, 3000)]
    tracemalloc.start()
    q, s, keys = embedding._nearest(iter(batches), m, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and len(q) == 3 * len(m)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 20_000, 997):
        want = np.lexsort((np.arange(len(x)), -np.round(unit @ m[i], 9)))[:3]
        assert keys[q == i].tolist() == want.tolist()


def test_questions_after_the_first_build_no_postings(spark, tmp_path, monkeypatch):
    from chatlake.operators import index as module

    chunks = spark.createDataFrame(
        [(f"s#{i}", f"teslim linki github deposu sunum {i}", "s", "instructor", [], None, None, 1, 1.0, "submission") for i in range(6)],
        "chunk_id string, text string, source string, role string, senders array<string>, start_time timestamp_ntz, end_time timestamp_ntz, message_count int, instructor_ratio double, category string",
    )
    stats = spark.createDataFrame([("s", 6, 6, 0)], "source string, messages long, authority_messages long, masked long")
    module.publish(spark, str(tmp_path / "at"), chunks, embedding.HASHING, (), module.MaskingPolicy(), stats, [])
    made = []
    monkeypatch.setattr(module, "postings", lambda *a, **k: made.append(1) or 1 / 0)
    loaded = module.load(spark, str(tmp_path / "at"))
    question = spark.createDataFrame([(1, "teslim linki nerede", "qa")], "query_id int, text string, mode string")
    for _ in range(2):
        assert index.bm25(question, loaded.texts, "query_id").count() == 6
    assert not made and loaded.texts is loaded.texts


def test_a_failing_generator_leaves_the_extractive_answers(spark):
    from chatlake.operators import answering

    quotes = spark.createDataFrame([(1, "Teslim nasıl yapılır?", 1, "Teslim için GitHub linki e-posta ile gönderilir ve sunum eklenir.", "qa", "s", "instructor")], "query_id int, question string, citation int, text string, mode string, source string, role string")
    want = answering.extractive(answering.sentences(quotes)).collect()

    def broken(rows):
        fail = F.udf(lambda x: 1 / 0, "string")
        return rows.select("query_id", fail("text").alias("answer"))

    got, by = answering.answered(quotes, broken)
    assert by is None and got.collect() == want
    got, by = answering.answered(quotes, lambda rows: rows.select("query_id", F.lit("cevap [1]").alias("answer")))
    assert by is not None and [r.answer for r in got.collect()] == ["cevap [1]"]


def test_an_output_outside_the_index_folder_is_refused(tmp_path):
    from chatlake.sources.settings import confined

    assert confined(str(tmp_path / "a"), tmp_path) == str(tmp_path / "a")
    for bad in ("", "..", str(tmp_path), "/etc"):
        with pytest.raises(ValueError):
            confined(bad, tmp_path)


def test_windows_stream_a_source_without_gaps(spark):
    rows = spark.range(300_000).select(
        F.concat(F.lit("s"), F.col("id") % 1).alias("source"), F.col("id").alias("line_no"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("a").alias("sender"), F.lit("participant").alias("role"), F.lit("x").alias("text")
    )
    out = chunking.windows(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    got = out.groupBy("island", "window").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).collect()
    assert len(got) == 25_000 and all(r.n == 12 and r.first == 12 * r.window and r.island == 0 for r in got)
