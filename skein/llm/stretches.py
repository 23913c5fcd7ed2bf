"""Small helpers for Python stages that read words of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator


def ascii_lower(text: str | None) -> str:
    """text with A-Z in lower case and nothing else changed; null as the empty text."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""


def stretches(text: str, cut: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """text in parts of about size code points; a part ends after a match of cut, so that no unit is torn."""
    at = 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]
