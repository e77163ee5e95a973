"""Chat updates as a stream: acceptance, first-seen dedup with collisions, sessions, and the keyed state machine."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.masking import MaskingPolicy, group_label, pseudonym, with_masked
from chatlake.operators.queue import MOVES

UPDATE = (
    "update_id bigint, message struct<message_id: bigint, date: bigint, chat: struct<id: bigint, type: string, title: string>, "
    "from: struct<id: bigint, is_bot: boolean, first_name: string, username: string>, sender_chat: string, text: string>"
)


def reject_reason(allowed: Iterable[int]) -> Column:
    """Why an update is left out; null if it is accepted."""
    m = F.col("message")
    return (
        F.when(m.isNull(), "not a new message").when(m["chat"]["id"].isNull(), "no chat").when(~m["chat"]["id"].isin(*allowed), "chat not allowlisted")
        .when(~F.coalesce(m["chat"]["type"].isin("group", "supergroup"), F.lit(False)), "not a group chat").when(m["from"]["id"].isNull(), "no sender")
        .when(F.coalesce(m["from"]["is_bot"], F.lit(True)) | m["sender_chat"].isNotNull(), "bot or channel sender").when(F.trim(F.coalesce(m["text"], F.lit(""))) == "", "not text")
        .when(m["message_id"].isNull(), "no message id")
    )


def accepted(updates: DataFrame, allowed: Iterable[int], policy: MaskingPolicy = MaskingPolicy()) -> DataFrame:
    """Masked messages of the accepted updates; works on batches and on streams alike."""
    allowed = tuple(allowed)
    if not allowed or any(isinstance(a, bool) or not isinstance(a, int) for a in allowed):
        raise ValueError("at least one integer chat id must be allowed")
    if not policy.complete:
        raise ValueError("every privacy control must be on")
    m = F.col("message")
    rows = updates.where("update_id is not null").where(reject_reason(allowed).isNull()).select(
        "update_id", m["chat"]["id"].alias("chat_id"), m["message_id"].alias("message_id"), m["text"].alias("raw"), group_label(m["chat"]["id"], policy).alias("group_label"),
        pseudonym(F.concat(F.lit("sender:"), m["from"]["id"].cast("string")), policy).alias("sender_alias"), F.timestamp_seconds(m["date"]).alias("received_at"),
    )
    return with_masked(rows, "raw", "text", None, policy).drop("raw").where("text <> ''")


def first_seen(updates: DataFrame, key: str = "update_id", order: str = "received") -> DataFrame:
    """``updates`` of a batch with ``kind``: ``new``, ``repeat`` (same chat and message as the first of its key) or ``collision``."""
    w = Window.partitionBy(key).orderBy(order)
    same = (F.first("chat_id").over(w).eqNullSafe(F.col("chat_id"))) & (F.first("message_id").over(w).eqNullSafe(F.col("message_id")))
    return updates.withColumn("kind", F.when(F.row_number().over(w) == 1, "new").when(same, "repeat").otherwise("collision"))


def deduplicated(stream: DataFrame, key: str = "update_id", ts: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key. State never expires, unless a watermark column and a delay are given."""
    if ts and within:
        return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def read_json(spark, folder: str, max_files: int = 1) -> DataFrame:
    """A folder of JSON updates as a stream."""
    return spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", max_files).json(folder)


def next_offset(seen: list[int], silent: bool) -> int | None:
    """After a poll: one more than the last update observed (ids may be renumbered, so not the largest); none after an empty poll or a long silence."""
    return None if silent or not seen else seen[-1] + 1


def folded_stream(commands: DataFrame, item: str = "item_id") -> DataFrame:
    """``item, status, applied`` after each batch of a command stream ``item, seq, command``; one keyed state for each item."""

    def step(key, batches, state):
        status, applied = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for command in rows["command"]:
            if command == "enqueue":
                after = status or "pending"
            else:
                before, after = MOVES.get(command, ((), status))
                after = after if status in before else status
            applied += int(after != status)
            status = after
        state.update((status, applied))
        yield pd.DataFrame({item: [key[0]], "status": [status], "applied": [applied]})

    kind = dict(commands.dtypes)[item]
    return commands.groupBy(item).applyInPandasWithState(step, f"{item} {kind}, status string, applied int", "status string, applied int", "update", "NoTimeout")
