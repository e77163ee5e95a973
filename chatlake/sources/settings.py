"""Private settings from a JSON file, strictly checked."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from chatlake.functions import vocabulary as v
from chatlake.functions.masking import MaskingPolicy


def _listed(name: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in os.environ.get(name, "").split(",") if x.strip())


def aliases_of_environment(default: Iterable[str] = v.AUTHORITY_ALIASES) -> tuple[str, ...]:
    """The authority's names from ``CHATLAKE_ALIASES``, comma separated; the default where it is unset or empty."""
    return _listed("CHATLAKE_ALIASES") or tuple(default)


def policy_of_environment(policy: MaskingPolicy = MaskingPolicy()) -> MaskingPolicy:
    """``policy`` with the hosts of ``CHATLAKE_PRIVATE_HOSTS``, comma separated, masked too."""
    return policy.with_private_hosts(*_listed("CHATLAKE_PRIVATE_HOSTS"))


def confined(value: object, root: Path) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError("a path is missing")
    at = (root / value).resolve() if not Path(value).is_absolute() else Path(value).resolve()
    if not at.is_relative_to(root.resolve()) or at == root.resolve():
        raise ValueError("a path lies outside the index folder")
    return str(at)


@dataclass(frozen=True)
class Settings:
    aliases: tuple[str, ...]
    chat_ids: tuple[int, ...]
    labels: dict[str, str]
    index_dir: str
    queue_dir: str

    @classmethod
    def load(cls, path: str, root: str = "data/index") -> Settings:
        """Aliases must be given, chat ids be integers, and both folders lie below ``root``."""
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(raw, dict):
            raise ValueError("the settings are not an object")
        aliases, ids, labels = raw.get("instructor_aliases"), raw.get("allowed_telegram_chat_ids", []), raw.get("source_labels", {})
        if not isinstance(aliases, list) or not aliases or not all(isinstance(a, str) and a.strip() for a in aliases):
            raise ValueError("aliases are missing")
        if not isinstance(ids, list) or any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
            raise ValueError("chat ids must be integers")
        if not isinstance(labels, dict) or not all(isinstance(k, str) and isinstance(x, str) for k, x in labels.items()):
            raise ValueError("labels must map names to names")
        at = Path(root)
        return cls(tuple(a.strip() for a in aliases), tuple(ids), dict(labels), confined(raw.get("index_dir"), at), confined(raw.get("queue_db"), at))
