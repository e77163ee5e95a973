"""Token counts under a unigram vocabulary: forward scores over a trie of the distinct pre-tokens.

A pre-token is a run without ASCII white space, behind the word mark. Its count is the number of pieces in the segmentation
of least total cost (on equal cost, of fewest pieces). The forward score of a prefix depends on that prefix alone, so the distinct
pre-tokens of a batch are put in a trie and a prefix that many share is scored once; the score at a terminal
gives the count, which is kept for later batches. Sorted pre-tokens are the trie in depth-first order: the
walk keeps the scores along the current path and goes on from the node where the next pre-token branches off.

A character that no piece covers costs its UTF-8 bytes, a token each. Costs come from the vocabulary's order (the k-th piece costs
ln(k + 2), in integers of 1e-4), as a rank-frequency law has it; nothing is trained.

Tasks are independent: no shuffle, and the kept counts of a worker are bounded by ``kept_words``.

Defined results: null, empty and white-space texts have 0 tokens; rows that repeat give equal rows; null doc_ids are kept;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_ONE = 1 << 40  # a total is cost * _ONE + pieces, whose number a text in memory cannot reach


@dataclass(frozen=True)
class TokenCountConfig:
    vocabulary_path: str | None = None
    kept_words: int = 500_000
    kept_chars: int = 64  # longer pre-tokens are counted again when they come again


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    def __init__(self, costs: dict[str, int]):
        self.step = {p: c * _ONE + 1 for p, c in costs.items()}
        # The pieces from their last character backwards: a walk from an end stops where no piece goes on.
        self.backwards: dict = {}
        for p, c in self.step.items():
            node = self.backwards
            for char in reversed(p):
                node = node.setdefault(char, {})
            node[""] = c
        self.byte = (max(costs.values(), default=0) + 10_000) * _ONE + 1

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        s = SentencePieceProcessor(model_file=path)
        pieces = [
            s.id_to_piece(i) for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))
        ]
        return cls({p: round(math.log(k + 2) * 10_000) for k, p in enumerate(dict.fromkeys(pieces))})

    def counts(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct ``words``, each scored behind the word mark."""
        out, back, byte = {}, self.backwards, self.byte
        path, before = [0], ""
        for word in sorted(words):
            marked = MARK + word
            shared = len(os.path.commonprefix((before, marked)))
            del path[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                char = marked[end - 1]
                best = path[end - 1] + byte * (1 if char < "\x80" else len(char.encode("utf-8", "replace")))
                node, start = back.get(char), end - 1
                while node is not None:
                    c = node.get("")
                    if c is not None and path[start] + c < best:
                        best = path[start] + c
                    if not start:
                        break
                    start -= 1
                    node = node.get(marked[start])
                path.append(best)
            out[word], before = path[-1] % _ONE, marked
        return out


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> tuple[Unigram, dict[str, int]]:
    return Unigram.from_file(path), {}


def token_counts(docs: DataFrame, config: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """``doc_id, n_words, n_tokens``."""
    path = config.vocabulary_path or default_path()

    @F.arrow_udf("struct<n_words: bigint, n_tokens: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        model, kept = unigram(path)
        out = []
        for at in range(0, len(texts), 256):
            words = [(t or "").encode("utf-8", "replace").split() for t in texts.slice(at, 256).to_pylist()]
            new = {w for ws in words for w in ws if w not in kept}
            text_of = {w.decode("utf-8", "replace"): w for w in new}
            got = {text_of[w]: n for w, n in model.counts(list(text_of)).items()}
            if len(kept) + len(got) > config.kept_words:
                here = {w: kept[w] for ws in words for w in ws if w in kept}
                kept.clear()
                kept.update(here)
            kept.update(got)
            out += [{"n_words": len(ws), "n_tokens": sum(map(kept.__getitem__, ws))} for ws in words]
            for w in [w for w in got if len(w) > config.kept_chars]:
                del kept[w]
        return pa.array(out, type=pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64())]))

    return docs.select("doc_id", count.asNondeterministic()("text").alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
