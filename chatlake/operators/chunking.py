"""Messages and documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chatlake.functions.text import strip
from chatlake.operators.topics import chunk_topic


@dataclass(frozen=True)
class ChunkingConfig:
    max_chars: int = 900
    overlap_chars: int = 150
    gap_minutes: int = 30
    max_messages: int = 12
    min_chars: int = 8

    def __post_init__(self) -> None:
        if self.overlap_chars >= self.max_chars:
            raise ValueError("the overlap must be shorter than a chunk")


def rendered(ts: Column, sender: Column, text: Column) -> Column:
    when = F.coalesce(F.date_format(ts, "dd.MM.yyyy HH:mm"), F.lit("tarihsiz"))
    return F.concat(F.lit("["), when, F.lit("] "), sender, F.lit(": "), text)


def sessions(rows: DataFrame, key: str, ts: str, order: list[str], gap_minutes: int = 30) -> DataFrame:
    """``rows`` with ``session``: a new one after a gap of more than ``gap_minutes`` or a step back in time."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    broken = F.coalesce((gap > gap_minutes * 60_000_000) | (gap < 0), F.lit(False))
    return rows.withColumn("__new", broken.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def windows(messages: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """``messages(source, line_no, ts, sender, role, text)`` with ``rendered``, ``long``, ``island`` and ``window``.

    Gaps and over-long messages cut a source into islands; within an island the caps on messages and characters start new windows. A
    source's messages are shuffled and sorted once and numbered as they stream by, so that no source and no island is ever held as an array.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    rows = messages.repartition("source").withColumn("rendered", rendered(F.col("ts"), F.col("sender"), F.col("text")))
    rows = rows.withColumn("__size", F.char_length("rendered")).withColumn("long", F.col("__size") > config.max_chars)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    cut = F.col("long") | F.coalesce(F.lag("long").over(w), F.lit(False)) | F.coalesce((gap > config.gap_minutes * 60_000_000) | (gap < 0), F.lit(False))
    rows = rows.withColumn("__cut", cut.cast("int")).withColumn("island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")
    most, limit = config.max_messages, config.max_chars

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, chars, window = None, 0, 0, 0
        for batch in batches:
            keys, sizes = zip(batch.column("source").to_pylist(), batch.column("island").to_pylist(), strict=True), batch.column("__size").to_pylist()
            out = []
            for key, size in zip(keys, sizes, strict=True):
                size = size or 0
                if key != now:
                    now, n, chars, window = key, 1, size, 0
                elif n >= most or chars + size > limit:
                    n, chars, window = 1, size, window + 1
                else:
                    n, chars = n + 1, chars + size
                out.append(window)
            yield batch.append_column(pa.field("window", pa.int32()), pa.array(out, pa.int32()))

    schema = StructType([*rows.schema.fields, StructField("window", IntegerType())])
    # The order is the one that the windows above have made already: no second sort.
    return rows.sortWithinPartitions("source", "line_no").mapInArrow(numbered, schema).drop("__size")


def split_long(text: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Array of windows of a text: paragraphs, sentences of long paragraphs, hard cuts of long sentences, packed with an overlap."""
    most, over = config.max_chars, config.overlap_chars
    step = most - over

    def cuts(s: Column) -> Column:
        k = F.greatest(F.lit(0), F.ceil((F.char_length(s) - most) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(s, i * step + 1, F.lit(most)))

    kept = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    sentences = lambda p: F.flatten(F.transform(kept(F.split(p, r"(?<=[.!?:])\s+", -1)), cuts))
    units = F.flatten(F.transform(kept(F.split(text, r"\n\s*\n", -1)), lambda p: F.when(F.char_length(p) <= most, F.array(p)).otherwise(sentences(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(s: Column, u: Column) -> Column:
        wider = F.when(s["now"] == "", u).otherwise(F.concat(s["now"], F.lit("\n\n"), u))
        fits = (s["now"] == "") | (F.char_length(wider) <= most)
        tail = F.right(s["now"], F.lit(over)) if over else F.lit("")
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"),
            F.when(fits, wider).otherwise(strip(F.concat(tail, F.lit("\n\n"), u))).alias("now"),
        )

    packed = F.aggregate(units, start, pack, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(packed)


CHUNK = ["chunk_id", "text", "source", "role", "senders", "start_time", "end_time", "message_count", "instructor_ratio", "category"]


def chunk_id(source: Column, n: Column) -> Column:
    return F.concat(source, F.lit("#"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def chunk_messages(messages: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of conversations: windows joined, over-long messages split."""
    rows = windows(messages.where("not is_system_event") if "is_system_event" in messages.columns else messages, config)
    size = F.char_length("text")
    grouped = rows.groupBy("source", "island", "window").agg(
        F.min("line_no").alias("first"), F.max(F.col("long").cast("int")).alias("long"),
        F.array_sort(F.collect_list(F.struct("line_no", "rendered", "sender", "text", "ts"))).alias("m"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count("*").alias("message_count"), F.sum(F.when(F.col("role") == "instructor", size).otherwise(0)).alias("a"), F.sum(size).alias("n"),
    )
    one = F.col("m")[0]
    header = F.when(one["ts"].isNull(), F.concat(one["sender"], F.lit(":"))).otherwise(F.concat(F.lit("["), F.date_format(one["ts"], "dd.MM.yyyy HH:mm"), F.lit("] "), one["sender"], F.lit(":")))
    parts = F.when(F.col("long") == 1, F.transform(split_long(one["text"], config), lambda p: F.concat(header, F.lit("\n"), p))).otherwise(
        F.array(F.array_join(F.transform("m", lambda x: x["rendered"]), "\n"))
    )
    parted = grouped.select("*", F.posexplode(parts).alias("piece", "body")).where((F.col("long") == 1) | (F.char_length("body") >= config.min_chars))
    ratio = F.col("a") / F.greatest(F.col("n"), F.lit(1))
    number = F.row_number().over(Window.partitionBy("source").orderBy("first", "piece"))
    senders = F.array_distinct(F.filter(F.transform("m", lambda x: x["sender"]), lambda s: s != ""))
    return parted.select(
        chunk_id(F.col("source"), number).alias("chunk_id"), strip(F.col("body")).alias("text"), "source", F.when(ratio >= 0.5, "instructor").otherwise("participant").alias("role"),
        senders.alias("senders"), "start_time", "end_time", F.col("message_count").cast("int").alias("message_count"), ratio.alias("instructor_ratio"),
        chunk_topic(strip(F.col("body")), F.col("source")).alias("category"),
    )


def chunk_documents(docs: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of ``docs(source, text)``; numbers count all pieces, also those too short to keep."""
    parts = docs.select("source", F.posexplode(split_long(strip(F.col("text")), config)).alias("n", "part"))
    body = strip(F.col("part"))
    return parts.where(F.char_length(body) >= config.min_chars).select(
        chunk_id(F.col("source"), F.col("n") + 1).alias("chunk_id"), body.alias("text"), "source", F.lit("document").alias("role"), F.array().cast("array<string>").alias("senders"),
        F.lit(None).cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit(1).alias("message_count"),
        F.lit(0.0).alias("instructor_ratio"), chunk_topic(body, F.col("source")).alias("category"),
    )


def chunk_label(source: Column, role: Column, start: Column) -> Column:
    who = F.when(role == "instructor", "Eğitmen").when(role == "document", "Belge").when(role == "system", "Sistem").otherwise("Katılımcı")
    return F.concat_ws(" · ", source, who, F.coalesce(F.date_format(start, "dd.MM.yyyy"), F.lit("tarihsiz")))
