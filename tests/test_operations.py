"""Polling, the durable queue, prompts and models, logs, damaged archives, names."""

import io
import json
import logging
import zipfile

import pytest
from pyspark.sql import functions as F

from chatlake.functions import masking, text
from chatlake.functions import vocabulary as v
from chatlake.operators import generation, queue
from chatlake.operators.approvals import Approvals
from chatlake.sources import files, redaction, settings
from chatlake.streaming import polling


def service(*polls):
    """A service that answers with these lists, then with nothing; ``asked`` keeps the offsets. A list may be an exception."""
    left, asked = list(polls), []

    def fetch(offset):
        asked.append(offset)
        found = left.pop(0) if left else []
        if isinstance(found, Exception):
            raise found
        return found

    return fetch, asked


def ids(rows):
    return [i for i, _ in rows]


def test_poll_offsets_follow_the_last_update_and_end_after_an_empty_poll():
    fetch, asked = service([{"update_id": 7}, {"update_id": 3}, "noise", {"update_id": True}], [], [{"update_id": 9}])
    r = polling.PollReader(fetch, 5, 60, clock=lambda: 100.0)
    rows, at = r.read(r.initialOffset())
    assert ids(rows) == [7, 3] and at["next"] == 4 and at["polls"] == 1
    rows, same = r.read(at)
    assert ids(rows) == [] and same == at
    rows, after = r.read(at)
    assert ids(rows) == [9] and after["next"] == 10
    assert asked == [None, 4, None]


def test_poll_sends_no_offset_after_a_long_silence():
    now = [0.0]
    fetch, asked = service([{"update_id": 1}], [{"update_id": 5}], [{"update_id": 6}])
    r = polling.PollReader(fetch, 5, 60, clock=lambda: now[0])
    _, at = r.read(r.initialOffset())
    now[0] = polling.SILENCE_S - 1
    _, at = r.read(at)
    now[0] += polling.SILENCE_S + 1
    r.read(at)
    assert asked == [None, 2, None]


def test_poll_waits_longer_after_each_failure():
    now = [0.0]
    fetch, asked = service(OSError(), OSError(), [{"update_id": 1}])
    r = polling.PollReader(fetch, 5, 60, clock=lambda: now[0])
    start, calls = r.initialOffset(), []
    for t in range(0, 30):
        now[0] = float(t)
        before = len(asked)
        rows, _ = r.read(start)
        if len(asked) > before:
            calls.append(t)
        if ids(rows):
            break
    assert calls == [0, 5, 15]


def test_a_batch_that_runs_again_is_cut_at_its_last_update():
    r = polling.PollReader(lambda offset: [{"update_id": i} for i in range(offset or 1, 9)], 5, 60)
    assert ids(r.readBetweenOffsets({"next": 3, "polls": 1}, {"next": 6, "polls": 2, "asked": 3})) == [3, 4, 5]


def test_polled_updates_are_a_stream(spark, tmp_path):
    source = tmp_path / "updates.json"
    source.write_text(json.dumps([{"update_id": i, "message": {"message_id": i, "chat": {"id": 1, "type": "group"}, "text": f"t{i}"}} for i in (1, 2, 3)]))

    def fetch(offset, path=str(source)):
        with open(path) as f:
            return [u for u in json.load(f) if offset is None or u["update_id"] >= offset]

    stream = polling.polled(spark, fetch)
    q = stream.select("update_id", "message.text").dropDuplicates(["update_id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "at")).start()
    try:
        for _ in range(120):
            if q.awaitTermination(0.5):
                break
            if (tmp_path / "out").exists() and spark.read.schema("update_id long, text string").parquet(str(tmp_path / "out")).count() == 3:
                break
    finally:
        q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "t1"), (2, "t2"), (3, "t3")]


@pytest.fixture
def approvals(spark, tmp_path):
    table = Approvals(spark, str(tmp_path / "queue"))
    cites = "array(named_struct('citation', 1, 'label', 'l', 'source', 's', 'role', 'instructor', 'snippet', 'x', 'score', 0.5D, 'category', 'general'))"
    rows = spark.createDataFrame([(5, "soru", "draft_reply", "cevap"), (2, "uygunsuz", "do_not_answer", ""), (5, "soru", "draft_reply", "cevap")], "update_id long, text string, reply_decision string, draft string")
    table.enqueue(rows.withColumn("citations", F.expr(cites)))
    table.enqueue(rows)
    return table


def test_queue_lists_by_status_and_id(approvals):
    assert [r.item_id for r in approvals.listed().collect()] == [2, 5]
    assert [r.item_id for r in approvals.listed("pending").collect()] == [2, 5]
    assert approvals.listed("sent").count() == 0
    assert {r.update_id for r in approvals.known_ids().collect()} == {2, 5}
    with pytest.raises(ValueError):
        approvals.listed("lost")


def test_queue_gives_typed_items(approvals):
    item = approvals.get(5)
    assert (item.status, item.incoming_text, item.citations[0].score, item.citations[0].citation) == ("pending", "soru", 0.5, 1)
    with pytest.raises(KeyError):
        approvals.get(99)


def test_queue_survives_a_restart_and_sends_once(approvals, spark):
    sent = []
    assert approvals.outbox(lambda i, d: sent.append((i, d))).approve_and_send(5, "son hali") == "sent"
    again = Approvals(spark, approvals.path)
    assert again.get(5).status == "sent" and again.get(5).draft == "son hali"
    with pytest.raises(queue.InvalidTransition):
        again.outbox(lambda i, d: sent.append((i, d))).approve_and_send(5, "bir daha")
    with pytest.raises(queue.InvalidTransition):
        again.outbox(lambda i, d: sent.append((i, d))).approve_and_send(2, "bu gitmez")
    assert sent == [(5, "son hali")]
    assert again.reject(2) == "rejected" and again.reject(5) == "sent"
    assert {r.status: r.n for r in again.counts().collect()} == {"pending": 0, "sending": 0, "sent": 1, "failed": 0, "rejected": 1}


def test_an_empty_queue(spark, tmp_path):
    empty = Approvals(spark, str(tmp_path / "none"))
    assert empty.listed().count() == 0 and empty.known_ids().count() == 0
    with pytest.raises(KeyError):
        empty.get(1)


def test_prompts_number_sources_in_order(spark):
    rows = [(1, "Ne zaman?", v.QA, 2, "b", "ikinci"), (1, "Ne zaman?", v.QA, 1, "a", "birinci"), (2, "Eksik mi?", v.CHECKLIST, 1, None, None)]
    made = {r.query_id: r.prompt for r in generation.prompts(spark.createDataFrame(rows, "query_id long, question string, mode string, citation int, source string, text string")).collect()}
    assert made[1] == f"{generation.TASKS[v.QA]}\n\nKaynaklar:\n[1] a\nbirinci\n\n[2] b\nikinci\n\nSoru: Ne zaman?"
    assert made[2].startswith(generation.TASKS[v.CHECKLIST]) and made[2].endswith("[1] \n\n\nSoru: Eksik mi?")


def test_models_run_in_batches(spark):
    rows = spark.createDataFrame([(i, f"soru {i}", v.QA, 1, "s", "t") for i in range(20)], "query_id long, question string, mode string, citation int, source string, text string")

    def complete(system, prompts):
        assert len(prompts) <= 3
        return [p.rpartition("Soru: ")[2] for p in prompts]

    assert {r.query_id: r.answer for r in generation.from_model(complete, batch=3)(rows).collect()} == {i: f"soru {i}" for i in range(20)}


def test_which_model_is_taken(monkeypatch):
    monkeypatch.setattr(generation, "MODELS", {})
    monkeypatch.delenv("CHATLAKE_OFFLINE", raising=False)
    monkeypatch.delenv("CHATLAKE_GENERATOR", raising=False)
    assert generation.resolve() is None
    first, second = (lambda q: q), (lambda q: q)
    generation.register("first", first, lambda: False)
    generation.register("second", second)
    assert generation.resolve() is second and generation.resolve("first") is first and generation.resolve("extractive") is None
    monkeypatch.setenv("CHATLAKE_OFFLINE", "1")
    assert generation.resolve() is None and generation.resolve("second") is second
    with pytest.raises(ValueError):
        generation.resolve("third")


def test_correction_prompts(spark):
    row = spark.sql("select 1L query_id, 'adım yanlış' text, map('project', 'P', 'email', 'e') detected, array('full_name') missing_info")
    assert "- email: e\n- project: P\n\nEksikler: full_name\n\nMesaj: adım yanlış" in generation.correction_prompts(row).first().prompt


def test_tokens_stay_out_of_logs():
    log, out = logging.getLogger("chatlake.test"), io.StringIO()
    handler = logging.StreamHandler(out)
    root = logging.getLogger()
    root.addHandler(handler)
    try:
        redaction.install("s3cret")
        assert redaction.install() is redaction.install()
        log.warning("call %s with %s", "https://x/bot123456:" + "A" * 30 + "/get", "s3cret")
        try:
            raise OSError("bot123456:" + "B" * 30)
        except OSError:
            log.exception("failed")
    finally:
        root.removeHandler(handler)
        for h in root.handlers:
            h.filters = [f for f in h.filters if not isinstance(f, redaction.RedactingFilter)]
    said = out.getvalue()
    assert "s3cret" not in said and "A" * 20 not in said and "B" * 20 not in said and "Traceback" in said and said.count(redaction.MARK) == 3


def test_damaged_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("_chat.txt", "bir")
        z.writestr("my_chat_notes.txt", "iki")
        z.writestr("photo.jpg", b"x")
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    (tmp_path / "note.txt").write_text("üç")
    with pytest.raises(Exception, match="cannot read the archive"):
        files.texts(spark, str(tmp_path)).collect()
    rows = files.texts(spark, str(tmp_path), strict=False).collect()
    assert sorted((r.source, r.text) for r in rows) == [("good", "bir"), ("good-my_chat_notes", "iki"), ("note", "üç")]
    broken = files.broken_archives(files.text_files(spark, str(tmp_path))).collect()
    assert [(r.path.rpartition("/")[2], r.error) for r in broken] == [("bad.zip", "BadZipFile")]


def test_names_fold_over_all_marks(spark):
    names = ["Çağrı  İNAN", "Zoë Novák", "Đorđe", "Ｆｕｌｌ Ｗｉｄｔｈ", "Łucja Nguyễn", "Ёлка"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.plain_name(F.col("n"))).collect()]
    assert got == [text.plain_name_value(n) for n in names] == ["cagri inan", "zoe novak", "đorđe", "full width", "łucja nguyen", "елка"]
    two = spark.sql("select 'Ａyşe K' a, 'Ayşe K' b").select(masking.pseudonym(F.col("a")), masking.pseudonym(F.col("b"))).first()
    assert two[0] == two[1]


def test_aliases_and_hosts_of_the_environment(monkeypatch):
    monkeypatch.delenv("CHATLAKE_ALIASES", raising=False)
    assert settings.aliases_of_environment(("x",)) == ("x",)
    monkeypatch.setenv("CHATLAKE_ALIASES", " Ada , ,Bo")
    monkeypatch.setenv("CHATLAKE_PRIVATE_HOSTS", "Files.Example")
    assert settings.aliases_of_environment() == ("Ada", "Bo")
    assert settings.policy_of_environment().private_hosts[-1] == "files.example"
