"""The approval queue on disk: items and commands as Parquet folders, written by one process."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.queue import STATUSES, Outbox, enqueued, folded, status_counts

ITEM = (
    "update_id bigint, chat_id bigint, message_id bigint, incoming_text string, sender_alias string, group_label string, intent string, mode string, evidence string, "
    "reply_decision string, reason string, draft string, received timestamp, categories array<string>, "
    "citations array<struct<citation: bigint, label: string, source: string, role: string, snippet: string, score: double, category: string>>"
)
COMMAND = "item_id bigint, seq bigint, command string, draft string, error string"


class Approvals:
    """Items are known by ``update_id``. Both folders only grow; an item's status is the fold of its commands.

    One process writes (a lock keeps its threads apart), any number read. A write that fails leaves no row, as Spark commits a job's files together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path.rstrip("/"), threading.Lock()

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        """The items as they came, citations typed."""
        return self._read("items", ITEM)

    def known_ids(self) -> DataFrame:
        """The update ids that were queued, for a poller that starts anew."""
        return self.rows().select("update_id")

    def enqueue(self, triaged: DataFrame) -> None:
        """Adds triaged messages, each update once however often it comes; columns that the queue has and ``triaged`` lacks are null."""
        names = {"incoming_text": "text", "received": "received_at"}
        fields = self.spark.createDataFrame([], ITEM).schema
        value = lambda n: next((F.col(c) for c in (n, names.get(n)) if c in triaged.columns), F.lit(None))
        rows = triaged.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in fields])
        with self._lock:
            enqueued(self.rows(), rows).write.mode("append").parquet(f"{self.path}/items")

    def append(self, command: dict) -> None:
        """Writes a command after all others; it is durable when this returns."""
        with self._lock:
            last = self._read("commands", COMMAND).agg(F.max("seq")).first()[0] or 0
            row = (command["item_id"], last + 1, command["command"], command.get("draft"), command.get("error"))
            self.spark.createDataFrame([row], COMMAND).coalesce(1).write.mode("append").parquet(f"{self.path}/commands")

    def items(self) -> DataFrame:
        """``item_id, status, applied, refused, error, draft`` and the item's own columns."""
        rows = self.rows()
        first = rows.select(F.col("update_id").alias("item_id"), F.lit(0).cast("long").alias("seq"), F.lit("enqueue").alias("command"), "draft", F.lit(None).cast("string").alias("error"))
        decided = rows.select(F.col("update_id").alias("item_id"), F.col("reply_decision").alias("decision"))
        log = first.unionByName(self._read("commands", COMMAND)).join(decided, "item_id")
        return folded(log).join(rows.drop("draft").withColumn("item_id", F.col("update_id")), "item_id")

    def listed(self, status: str | None = None) -> DataFrame:
        """Items, of one status or of all, in the order of their ids."""
        if status is not None and status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        found = self.items()
        return (found if status is None else found.where(F.col("status") == status)).orderBy("item_id")

    def get(self, item_id: int):
        """One item as a row; ``KeyError`` if there is none."""
        row = self.items().where(F.col("item_id") == item_id).first()
        if row is None:
            raise KeyError(item_id)
        return row

    def counts(self) -> DataFrame:
        return status_counts(self.items())

    def reject(self, item_id: int) -> str:
        """The status after the command, which a later status than ``pending`` ignores."""
        self.get(item_id)
        self.append({"item_id": item_id, "command": "reject"})
        return self.get(item_id).status

    def outbox(self, send: Callable[[int, str], None]) -> Outbox:
        return Outbox(self.append, self.items, send)
