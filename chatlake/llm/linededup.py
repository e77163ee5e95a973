"""Corpus-wide line dedup with levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id. A batch's distinct line hashes (combined before the
shuffle) are merge-joined with the stored runs. A run is bucketed by the hash, one sorted file to a bucket, and is read in that
order: it is neither shuffled nor sorted again, only the batch is. One pass of the join gives both halves: keys that no run holds (the anti-join)
become the batch's own run on level 0; keys that a run holds are repeats. When a level has ``fanout`` runs they are compacted to
one run of the next level by a merge join, bucket by bucket, if a later batch is to read it. As batches rise by doc_id, the first owner of a key is its least doc_id for good.

A key is a line without ASCII white space at its ends and with A-Z lower-cased, known by two independent 64-bit
hashes. Keys of at least ``min_chars`` code points found in two or more documents lose all their lines but
those in the least doc_id that holds them.

Defined results: a null or empty text has one empty line; a text all of whose lines go becomes empty; lines that repeat
within one document alone stay; rows that share a doc_id are one document, each row losing its own lines; rows with a null
doc_id together count as one document after all others; an empty table gives an empty result; other columns, whatever
their names, pass through.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import dropped, fresh_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
LAST = (1 << 63) - 1  # the place of a null doc_id
STORED_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class LineDedupConfig:
    batches: int = 4
    fanout: int = 2
    min_chars: int = 10


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() equals lower-casing A-Z on ASCII, and is faster there than translate().
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The stored runs of line hashes: level -> tables ``h1, h2, owner, seen, again``, bucketed and sorted by the hash."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.batches: list[str] = []
        self.paths: dict[str, DataFrame] = {}

    def _store(self, df: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "run")
        # One file to a bucket, as partitions and buckets are the same; Spark then takes the stored order where this setting tells it to.
        before = self.spark.conf.get(STORED_ORDER, "false")
        self.spark.conf.set(STORED_ORDER, "true")
        try:
            df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.set(STORED_ORDER, before)
        table = self.spark.table(name)
        table._chatlake_path = path
        self.paths[name] = table
        return name

    def _free(self, name: str) -> None:
        table = self.paths.pop(name)
        self.spark.sql(f"DROP TABLE {name}")
        dropped(table)

    def add(self, keys: DataFrame, last: bool = False) -> None:
        """``keys``: ``h1, h2, first, last`` of one batch, a row for each key, later than every batch before. ``last``: none follows."""
        held = keys.withColumn("old", F.lit(None).cast("long"))
        for level in self.levels:
            for run in level:
                stored = self._new_keys(run).withColumnRenamed("owner", "o")
                held = held.join(stored.hint("merge"), ["h1", "h2"], "left").withColumn("old", F.coalesce("old", "o")).drop("o")
        run = self._store(
            held.select(
                "h1", "h2", F.coalesce("old", "first").alias("owner"), F.col("old").isNotNull().alias("seen"),
                (F.col("old").isNotNull() | (F.col("last") > F.col("first"))).alias("again"),
            )
        )
        self.batches.append(run)
        self.levels[0].append(run)
        for i in range(0 if last else len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                self._compact(i)

    def _new_keys(self, run: str) -> DataFrame:
        return self.spark.table(run).where("not seen").select("h1", "h2", "owner")

    def _compact(self, i: int) -> None:
        """Merges the runs of level ``i`` to one of level ``i + 1``; their keys differ, so nothing needs comparing."""
        merged = self._new_keys(self.levels[i][0])
        for r in self.levels[i][1:]:
            other = self._new_keys(r).withColumnRenamed("owner", "o").hint("merge")
            merged = merged.join(other, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "o").alias("owner"))
        merged = merged.select("h1", "h2", "owner", F.lit(False).alias("seen"), F.lit(False).alias("again"))
        if len(self.levels) == i + 1:
            self.levels.append([])
        self.levels[i + 1].append(self._store(merged))
        for r in self.levels[i]:
            if r not in self.batches:
                self._free(r)
        self.levels[i] = []

    def repeats(self) -> DataFrame:
        """``h1, h2, owner`` of the keys found in more than one document so far."""
        found = None
        for name in self.batches:
            part = self.spark.table(name).where("again").select("h1", "h2", "owner")
            found = part if found is None else found.union(part)
        return found.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))

    def close(self) -> None:
        for name in list(self.paths):
            self._free(name)


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns, so that no name can clash), ``id, hash``."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("hash"))


def _text() -> Column:
    return F.coalesce(F.col("row")["text"], F.lit(""))


def dropped_lines(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``id, hash, gone (array of line numbers from 0)`` for documents that lose lines."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    cuts = own.stat.approxQuantile("doc_id", [i / config.batches for i in range(1, config.batches)], 0.01) if config.batches > 1 else []
    batch = sum(((F.col("id") > F.lit(int(c))).cast("int") for c in sorted(set(cuts))), F.lit(0))
    lines = _keyed(own).select("id", "hash", F.posexplode(F.split(_text(), "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("k", line_key(F.col("line"))).where(F.char_length("k") >= config.min_chars)
    lines = lines.select("id", "hash", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"), batch.alias("batch"))
    path = fresh_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    lines._chatlake_path = path
    runs = LineRuns(spark, config.fanout)
    try:
        n = len(set(cuts)) + 1
        for i in range(n):
            part = lines.where(F.col("batch") == i)
            runs.add(part.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")), i == n - 1)
        repeats = written(runs.repeats(), "repeats")
    finally:
        runs.close()
    # Plain exchanges on both sides, so that the adaptive skew join can split a line that very many documents hold.
    gone = lines.join(repeats.hint("merge"), ["h1", "h2"]).where(F.col("id") > F.col("owner"))
    gone = written(gone.groupBy("id", "hash").agg(F.collect_set("at").alias("gone")), "gone")
    dropped(lines)
    dropped(repeats)
    return gone


def line_dedup(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``n_lines long, n_dropped long, kept string``."""
    parts = F.split(_text(), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), _text()).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    joined = _keyed(docs).join(dropped_lines(docs, config), ["id", "hash"], "left")
    return joined.select("row", F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digest(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    done = line_dedup(docs.select("doc_id", "text"), config)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``docs`` with the lines gone from ``text`` and ``n_chars`` brought up to date where there is one; no row goes."""
    new = {"text": F.col("kept")} | ({"n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return line_dedup(docs, config).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS pos)
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT l.*, o.owner IS NOT NULL AND l.doc_id > o.owner AS gone FROM lines l LEFT JOIN owners o USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
