"""A polled service of chat updates as a stream: offsets, replay, silence and backoff."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from chatlake.streaming.updates import UPDATE, next_offset

#: ``fetch(offset)`` gives the waiting updates from ``offset`` on (all of them for None), oldest first, as dicts. It must be picklable.
Fetch = Callable[[int | None], list]
#: After so many seconds without an update the service may have numbered anew, so no offset is sent.
SILENCE_S = 3600


class PollReader(SimpleDataSourceStreamReader):
    """One reader, in the driver's Python worker: a chat's updates are few, and a service hands them to one caller at a time.

    An offset is ``{"next": id or None, "polls": n, "at": seconds}``; ``polls`` grows with every poll that brought something, so renumbered ids
    still move the stream. The service may drop what lies below an offset only once that offset is sent, which is after the batch before it ended:
    a batch that runs again is fetched from its first offset and cut at its last update.
    """

    def __init__(self, fetch: Fetch, backoff: float, most_backoff: float, clock: Callable[[], float] = time.time):
        self.fetch, self.backoff, self.most_backoff, self.clock = fetch, backoff, most_backoff, clock
        self.empty, self.failures, self.until = False, 0, 0.0

    def initialOffset(self) -> dict:
        return {"next": None, "polls": 0, "at": self.clock()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.clock()
        if now < self.until:
            return iter([]), start
        silent = self.empty or now - start["at"] > SILENCE_S
        try:
            rows = _usable(self.fetch(None if silent else start["next"]))
        except (OSError, TimeoutError, ValueError):  # the connection or its answer; anything else is an error of the caller's and ends the query
            self.failures += 1
            self.until = now + min(self.backoff * 2 ** (self.failures - 1), self.most_backoff)
            return iter([]), start
        self.failures, self.empty = 0, not rows
        if not rows:
            return iter([]), start
        end = {"next": next_offset([i for i, _ in rows], False), "polls": start["polls"] + 1, "at": now, "asked": None if silent else start["next"]}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for i, row in _usable(self.fetch(end.get("asked"))):
            yield i, row
            if i == end["next"] - 1:
                return

    def commit(self, end: dict) -> None:
        """The next poll's offset tells the service."""


def _usable(found: list) -> list[tuple[int, str]]:
    """Dicts with an integer id; whatever else a service sends is left out."""
    ok = (u for u in found if isinstance(u, dict) and isinstance(u.get("update_id"), int) and not isinstance(u["update_id"], bool))
    return [(u["update_id"], json.dumps(u)) for u in ok]


def polled(spark: SparkSession, fetch: Fetch, name: str = "chat_updates", backoff: float = 5, most_backoff: float = 300) -> DataFrame:
    """The updates of ``fetch`` as a stream in the schema of :data:`UPDATE`. Stop the query to stop polling; a failing poll waits and is tried again."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "update_id bigint, value string"

        def simpleStreamReader(self, schema):
            return PollReader(fetch, backoff, most_backoff)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load().select(F.from_json("value", UPDATE).alias("u")).select("u.*")
