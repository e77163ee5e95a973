"""Tokens and addresses with tokens stay out of logs."""

from __future__ import annotations

import logging
import re

#: A bot token, alone or in an address.
TOKEN = re.compile(r"(?:bot)?[0-9]{6,}:[A-Za-z0-9_-]{20,}")
MARK = "[redacted-token]"


class RedactingFilter(logging.Filter):
    """Replaces tokens in a record's whole message, its arguments and traceback included; registered ones whatever their form."""

    def __init__(self) -> None:
        super().__init__()
        self.secrets: set[str] = set()

    def register(self, secret: str) -> None:
        if secret.strip():
            self.secrets.add(secret.strip())

    def clean(self, text: str) -> str:
        for secret in sorted(self.secrets, key=len, reverse=True):
            text = text.replace(secret, MARK)
        return TOKEN.sub(MARK, text)

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = self.clean(record.getMessage()), None
        if record.exc_info:
            record.exc_text, record.exc_info = self.clean(logging.Formatter().formatException(record.exc_info)), None
        return True


def install(*secrets: str) -> RedactingFilter:
    """One filter on every handler of the root logger, which records of all loggers pass; more secrets can be registered later."""
    handlers = logging.getLogger().handlers
    found = next((f for h in handlers for f in h.filters if isinstance(f, RedactingFilter)), None) or RedactingFilter()
    for secret in secrets:
        found.register(secret)
    for h in handlers:
        if found not in h.filters:
            h.addFilter(found)
    return found
