"""The approval queue as a table of items and a log of commands folded by a guarded state machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.masking import safe_error

STATUSES = ("pending", "sending", "sent", "failed", "rejected")
#: command -> (statuses it may leave, status it enters)
MOVES = {"claim": (("pending", "failed"), "sending"), "reject": (("pending",), "rejected"), "sent": (("sending",), "sent"), "failed": (("sending",), "failed")}
MAX_MESSAGE = 4096


class InvalidTransition(RuntimeError):
    """A command that the item's status does not allow."""


class DeliveryRejected(RuntimeError):
    """The message was certainly not delivered; another approval may try again."""


class DeliveryUncertain(RuntimeError):
    """The message may have been delivered; it must not be tried again."""


def enqueued(items: DataFrame, new: DataFrame, key: str = "update_id") -> DataFrame:
    """Rows of ``new`` to insert: one for each key, the first by ``received``, and only keys that ``items`` lacks."""
    order = Window.partitionBy(key).orderBy("received")
    first = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.join(items.select(key), key, "left_anti")


def moved(status: Column, command: Column, allowed: Column | None = None) -> Column:
    """The status after a command; an impossible one leaves it. ``allowed`` false blocks a claim."""
    out = status
    for name, (before, after) in MOVES.items():
        may = status.isin(*before)
        if name == "claim" and allowed is not None:
            may = may & allowed
        out = F.when((command == name) & may, F.lit(after)).otherwise(out)
    return out


def folded(log: DataFrame, item: str = "item_id", order: str = "seq") -> DataFrame:
    """``item, status, applied, refused, error, draft`` after an ordered log of ``item, seq, command, draft, error, decision``.

    ``enqueue`` starts an item; commands before it, and a second one, change nothing. A blank draft, or a decision not to answer, cannot be claimed.
    """
    cmd = F.struct(order, F.col("command").alias("c"), F.col("draft").alias("d"), F.col("error").alias("e"), F.col("decision").alias("v"))
    logs = log.groupBy(item).agg(F.array_sort(F.collect_list(cmd)).alias("log"))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("status"), none.alias("decision"), none.alias("draft"), none.alias("error"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def step(s: Column, m: Column) -> Column:
        new = (m["c"] == "enqueue") & s["status"].isNull()
        can = (F.coalesce(s["decision"], F.lit("")) != "do_not_answer") & (F.trim(F.coalesce(m["d"], F.lit(""))) != "")
        after = F.when(new, F.lit("pending")).when(s["status"].isNotNull(), moved(s["status"], m["c"], can))
        ok = new | F.coalesce(after != s["status"], F.lit(False))
        claimed = ok & (m["c"] == "claim")
        return F.struct(
            after.alias("status"), F.when(new, m["v"]).otherwise(s["decision"]).alias("decision"), F.when(new | claimed, m["d"]).otherwise(s["draft"]).alias("draft"),
            F.when(ok & (m["c"] == "failed"), safe_error(F.coalesce(m["e"], F.lit("")))).when(ok, F.lit("")).otherwise(s["error"]).alias("error"),
            (s["applied"] + ok.cast("int")).alias("applied"), (s["refused"] + (~ok).cast("int")).alias("refused"),
        )

    done = logs.select(item, F.aggregate("log", start, step).alias("s"))
    return done.where("s.status is not null").select(item, "s.status", "s.applied", "s.refused", "s.error", "s.draft")


def status_counts(items: DataFrame) -> DataFrame:
    """``status, n`` of every status, those without items too."""
    domain = items.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return F.broadcast(domain).join(items.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def can_send(status: Column, decision: Column) -> Column:
    return status.isin("pending", "failed") & (decision != "do_not_answer")


def can_reject(status: Column) -> Column:
    return status == "pending"


class Outbox:
    """The one way out: the claim is written before the call, and the outcome after it, so a message goes at most once.

    ``append(command row)`` must be durable when it returns; ``items()`` gives the folded log; ``send(item, draft)`` is the caller's transport.
    """

    def __init__(self, append: Callable[[dict], None], items: Callable[[], DataFrame], send: Callable[[int, str], None]):
        self.append, self.items, self.send = append, items, send

    def _status(self, item_id: int) -> str | None:
        row = self.items().where(F.col("item_id") == item_id).select("status").first()
        return row.status if row else None

    def approve_and_send(self, item_id: int, draft: str) -> str:
        if len(draft) > MAX_MESSAGE:
            raise ValueError(f"a message has at most {MAX_MESSAGE} characters")
        if not draft.strip():
            raise ValueError("the draft is empty")
        before = self._status(item_id)
        if before is None:
            raise KeyError(item_id)
        if before not in MOVES["claim"][0]:
            raise InvalidTransition(f"item {item_id} is {before}")
        self.append({"item_id": item_id, "command": "claim", "draft": draft})
        if self._status(item_id) != "sending":
            raise InvalidTransition(f"item {item_id} cannot be sent")
        try:
            self.send(item_id, draft)
        except DeliveryRejected as e:
            self.append({"item_id": item_id, "command": "failed", "error": str(e)})
            return "failed"
        except Exception as e:  # an unknown outcome stays in "sending", which no claim reopens
            raise DeliveryUncertain(f"item {item_id} may have been delivered") from e
        self.append({"item_id": item_id, "command": "sent"})
        return "sent"
