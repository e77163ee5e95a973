"""The engine: ingest, index, ask, triage, in one place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from chatlake.functions import vocabulary as v
from chatlake.functions.masking import MaskingPolicy
from chatlake.operators import answering, index, triage
from chatlake.operators.chunking import ChunkingConfig
from chatlake.operators.embedding import Backend, embedded, resolve
from chatlake.operators.retrieval import RetrievalConfig
from chatlake.sources.files import texts
from chatlake.sources.settings import aliases_of_environment, policy_of_environment
from chatlake.streaming import updates


class Engine:
    """Holds masked messages, documents, chunks and vectors as DataFrames; every call works on batches of questions."""

    def __init__(
        self, spark: SparkSession, aliases: Iterable[str] | None = None, policy: MaskingPolicy | None = None, chunking: ChunkingConfig = ChunkingConfig(),
        backend: Backend | str | None = None, retrieval: RetrievalConfig | None = None, generator=None,
    ):
        self.spark, self.chunking = spark, chunking
        self.aliases = aliases_of_environment() if aliases is None else tuple(aliases)
        self.policy = policy_of_environment() if policy is None else policy
        self.backend = backend if isinstance(backend, Backend) else resolve(backend)
        self.retrieval = retrieval or RetrievalConfig.calibrated_for(self.backend.name)
        self.generator = generator
        self.reset()

    def reset(self) -> None:
        self._messages: DataFrame | None = None
        self._documents: DataFrame | None = None
        self._index: index.Index | None = None

    def add(self, files: DataFrame) -> None:
        """Adds ``files(source, text)``; an earlier index is made anew at the next question."""
        messages, documents = index.ingest(files.select("source", "text"), self.aliases, self.policy)
        self._messages = messages if self._messages is None else self._messages.unionByName(messages)
        self._documents = documents if self._documents is None else self._documents.unionByName(documents)
        self._index = None

    def add_folder(self, folder: str) -> None:
        self.add(texts(self.spark, folder))

    def add_text(self, source: str, text: str) -> None:
        self.add(self.spark.createDataFrame([(source, text)], "source string, text string"))

    @property
    def is_empty(self) -> bool:
        return self._index is None and self._messages is None

    @property
    def index(self) -> index.Index:
        if self._index is None:
            if self._messages is None:
                raise ValueError("nothing was added")
            chunks = index.chunked(self._messages, self._documents, self.chunking).persist()
            self._index = index.Index(chunks, embedded(chunks, "chunk_id", "text", self.backend).persist(), self.backend, {})
        return self._index

    def use(self, path: str) -> None:
        """Takes a published index instead."""
        self._index = index.load(self.spark, path, self.backend)

    def stats(self) -> DataFrame:
        return answering.stats(self._messages, self._documents, self.index.chunks)

    def ask(self, questions: DataFrame | str, mode: str = v.QA, top_k: int | None = None) -> DataFrame:
        if isinstance(questions, str):
            questions = self.spark.createDataFrame([(0, questions, mode)], "query_id long, text string, mode string")
        return answering.ask(questions, self.index, self.retrieval, self.generator, top_k)

    def triage(self, messages: DataFrame, key: str = "message_id") -> DataFrame:
        return triage.triage(messages, self.index, key)

    def triage_stream(self, stream: DataFrame, allowed: Iterable[int], out: str, checkpoint: str):
        """Accepted updates of a stream, each once, triaged batch by batch and appended at ``out``. A batch that runs again writes the same folder."""
        taken = updates.deduplicated(updates.accepted(stream, allowed, self.policy))

        def put(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.triage(batch, "update_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

        return taken.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
