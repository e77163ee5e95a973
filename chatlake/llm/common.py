"""Helpers that the training-data operators share: the shared folder, written tables, class closure."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, as in local tests, a temporary folder of the one machine is used; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
    return at.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made longer by underscores, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chatlake_path = path
    return out


def broadcast_if_small(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most ``rows`` rows; a larger one is joined by a shuffle."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def dropped(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_chatlake_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def least_reachable(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and small-star steps.

    Returns ``node long, root long`` for every node of an edge, root being the smallest node reachable.
    All state is distributed; each round is a written table. A star's hub is only ever
    grouped by ``min`` (combined before the shuffle) or joined (split by the adaptive skew join).
    """
    state = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def print_of(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        return tuple(row)

    before = print_of(state)
    while before[0]:
        # Large star: every larger neighbour of a node hangs on the least of its neighbours and itself.
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join has plain exchanges on both sides and a hub's neighbours can be split over tasks.
        hubs = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = (
            both.where("b > a").join(hubs, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # Small star: every smaller neighbour of a node, and the node, hang on the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = print_of(after)
        dropped(state)
        dropped(hubs)
        state = after
        if now == before:
            break
        before = now
    pairs = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(pairs.select("root", "root").distinct().toDF("node", "root"))
