"""Public byte-level BPE vocabularies inside tasks: exact ids of the ``tokenizers`` file, made faster by ``tiktoken``."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Fixed value: the pattern of byte-level BPE before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone are split alike by both libraries; any other text goes to ``tokenizers``.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xac\xae-ɏ‐-‟…€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BytePairTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letter[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1 + len(self.added)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` (null: empty), as uint32, without special tokens around them."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        if (text.isascii() or not _PLAIN.search(text)) and not any(t in text for t in self.added):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> BytePairTokenizer:
    """One for each worker process and file."""
    return BytePairTokenizer(path)
