"""The separator rule for single strings, for parsers that run in Python."""

from __future__ import annotations

import re

_SEPARATOR = re.compile(r"[*·~—#§•\-–_ \t]+")


def only_separators(text: str) -> bool:
    stripped = text.strip()
    return bool(stripped) and _SEPARATOR.fullmatch(stripped) is not None
