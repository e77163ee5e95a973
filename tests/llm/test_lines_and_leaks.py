import hashlib

import pytest

from chatlake.llm import decontaminate, linededup


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    last = 1 << 63
    owners, holders = {}, {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                i = last if d is None else d
                owners[key(line)] = min(i, owners.get(key(line), last))
                holders.setdefault(key(line), set()).add(i)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) > 1 and owners[key(x)] != (last if d is None else d) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (5, "A shared line here\nalone five\n  a SHARED line here \t"),
    (2, "x\n\n\na shared line here\r\nsecond shared line"),
    (9, "SECOND shared line\nÉtats ünique line\nshort\nshort"),
    (7, "Étatß"), (8, "états ünique line\nÉtats ünique line"),
    (11, None), (12, ""), (13, "second shared line"),
    (None, "second shared line\nnull's own long line"), (None, "null's own long line"),
    (2, "x\n\n\na shared line here\r\nsecond shared line"), (13, "other text of thirteen"),
    (20, "\n".join(f"line number {i} of many" for i in range(3000))), (21, "\n".join(f"line number {i} of many" for i in range(0, 3000, 2))),
]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup_equals_brute_force(spark, batches):
    docs = spark.createDataFrame([(d, t, "e", 3) for d, t in ROWS], "doc_id long, text string, line string, n_chars int")
    config = linededup.LineDedupConfig(batches=batches)
    got = sorted((tuple(r) for r in linededup.line_digest(docs, config).collect()), key=str)
    assert got == brute_lines(ROWS)


def test_stage_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(d, t, "e", 3) for d, t in ROWS], "doc_id long, text string, __x string, n_chars int")
    out = linededup.without_repeated_lines(docs)
    assert out.schema == docs.schema and out.count() == len(ROWS)
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_line_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.line_digest(docs).count() == 0


def brute_leaks(docs, items):
    out = []
    for d, t in docs:
        w = decontaminate.words_of(t)
        for i, s in items:
            v = decontaminate.words_of(s)
            n = min(5, len(v))
            if i is None or not n:
                continue
            want = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            held = len(want & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
            if held * 10 >= 8 * len(want):
                out.append((d, i, len(want), held, held / len(want)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 21, 20])
def test_decontamination_equals_brute_force(spark, block):
    def words(a, b):
        return " ".join(f"w{i}" for i in range(a, b))
    items = [(1, words(0, 30)), (2, words(100, 160)), (3, "Tiny Item"), (4, ""), (5, None), (None, words(0, 9)), (6, words(0, 30)), (7, "...")]
    docs = [
        (1, "pre " + words(0, 30).upper() + "! post"), (2, words(0, 28)), (3, words(0, 24)), (4, "a tiny, item b"), (5, "tiny"), (6, None), (7, ""),
        (8, words(0, 5000)), (9, words(0, 15) + " zz " + words(15, 30)), (10, words(100, 130) + " q q q " + words(126, 160)), (1, "tiny item"), (None, words(0, 30)),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    config = decontaminate.DecontaminationConfig(block_hashes=block)
    got = sorted((tuple(r) for r in decontaminate.contaminated(d, b, config).collect()), key=str)
    assert got == brute_leaks(docs, items)
    kept = decontaminate.without_contaminated(d, b, config)
    assert kept.columns == d.columns
    bad = {x[0] for x in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if i not in bad)


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text of five words")], "doc_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0
    assert decontaminate.contaminated(one, b).count() == 0
    assert decontaminate.without_contaminated(one, b).count() == 1


@pytest.mark.parametrize("name", ["__id", "__HASH", "__gone", "__kept", "__n_lines", "__n_dropped", "row", "id", "Hash", "gone", "kept", "__matches", "__MATCHES"])
def test_stages_keep_columns_of_any_name(spark, name):
    rows = [(1, "a line of some length\nshort", "x"), (2, "a line of some length\nother", "y"), (3, "one two three four five six", "z")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
    done = linededup.without_repeated_lines(docs)
    assert done.columns == docs.columns
    assert sorted(map(tuple, done.collect())) == [rows[0], (2, "other", "y"), rows[2]]
    items = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == rows[:2]


def test_runs_are_read_in_their_order(spark, monkeypatch):
    """The stored side of a probe has no exchange and no sort; nothing is compacted after the last batch; no table is left behind."""
    plans, compacted = [], []
    store, compact = linededup.LineRuns._store, linededup.LineRuns._compact

    def spy(self, df):
        spark.conf.set(linededup.STORED_ORDER, "true")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set(linededup.STORED_ORDER, "false")
        return store(self, df)

    monkeypatch.setattr(linededup.LineRuns, "_store", spy)
    monkeypatch.setattr(linededup.LineRuns, "_compact", lambda self, i: (compacted.append(i), compact(self, i)))
    docs = spark.createDataFrame([(i, f"line number {i % 90} of them\nline number {i % 50} of others") for i in range(400)], "doc_id long, text string")
    linededup.line_digest(docs, linededup.LineDedupConfig(batches=4)).collect()
    probes = [p for p in plans if "LeftOuter" in p]
    assert len(probes) == 3 and compacted == [0]
    for p in probes:
        assert p.count("Sort [h1") == 1, p  # the batch's own side, once, whatever the number of runs
        assert p.count("Exchange") == 1, p
    merges = [p for p in plans if "FullOuter" in p]
    assert len(merges) == 1 and "Exchange" not in merges[0] and "Sort [h1" not in merges[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_frees_its_runs_when_it_fails(spark, monkeypatch):
    monkeypatch.setattr(linededup.LineRuns, "repeats", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        linededup.line_digest(spark.createDataFrame([(1, "some line of text")], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
