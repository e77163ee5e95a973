"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from chatlake.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf001}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "asDict"):
        return plain(list(x))
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf001, duck, name):
    got = queries.QUERIES[name](spark, sf001)
    want = duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = Counter(str([plain(x) for x in r]) for r in got.select(*cols).collect())
    b = Counter(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, sf001, name):
    assert queries.QUERIES[name](spark, sf001).count() > 0


def test_flagship(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def brute_split(text, most=900, over=150):
    if len(text) <= most:
        return [text]
    units = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text, flags=re.A)):
        for s in [para] if len(para) <= most else (x.strip() for x in re.split(r"(?<=[.!?:])\s+", para, flags=re.A)):
            if s:
                units += [s[k : k + most] for k in range(0, max(1, len(s) - over), most - over)] if len(s) > most else [s]
    done, now = [], ""
    for u in units:
        wider = f"{now}\n\n{u}" if now else u
        if now and len(wider) > most:
            done.append(now)
            wider = f"{now[-over:]}\n\n{u}".strip()
        now = wider
    return [*done, now] if now else done


def test_chunks_of_all_turns_equal_brute_force(spark, sf001):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf001}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        if r.role != "system":
            turns[f"conv{r.conv_id}"].append((r.role, r.text))
    want, long_ = {}, 0
    for source, of in turns.items():
        windows, chars = [], 0
        for role, text in of:
            line = f"[tarihsiz] {role}: {text}"
            if windows and len(line) <= 900 and windows[-1][0] and len(windows[-1][1]) < 12 and chars + len(line) <= 900:
                windows[-1][1].append((role, text, line))
                chars += len(line)
            else:
                windows.append((len(line) <= 900, [(role, text, line)]))
                chars = len(line)
        n = 0
        for short, w in windows:
            bodies = ["\n".join(x[2] for x in w)] if short else [f"{w[0][0]}:\n{p}" for p in brute_split(w[0][1])]
            long_ += not short
            size, own = sum(len(x[1]) for x in w), sum(len(x[1]) for x in w if x[0] == "assistant")
            for b in bodies:
                n += 1
                ratio = own / max(size, 1)
                want[f"{source}#{n:04d}"] = (source, "instructor" if ratio >= 0.5 else "participant", len(w), round(ratio, 6), len({x[0] for x in w}), b.strip())
    got = {r.chunk_id: tuple(r)[1:] for r in queries.QUERIES["chunk_conversations"](spark, sf001).collect()}
    assert long_ > 0 and got == want
