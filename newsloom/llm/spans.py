"""Spans found in texts: order, digests, and texts with spans replaced."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]  # kind, start, end; code points, end exclusive


def ordered(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by kind as listed."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parsed(text: str | None) -> list[Span]:
    """Reads joined spans back."""
    parts = [s.split(":") for s in text.split(",")] if text else []
    return [(k, int(a), int(b)) for k, a, b in parts]


def replaced(text: str, spans: Iterable[Span], marks: dict[str, str]) -> str:
    """The text with each span replaced by its kind's mark; overlapping spans go together, under the first's mark."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], marks[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def free(spans: Iterable[Span], start: int, end: int) -> bool:
    """True when no span meets [start, end)."""
    return all(end <= a or b <= start for _, a, b in spans)
