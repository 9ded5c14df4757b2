"""Spans found in UTF-8 bytes, reported in code points."""

from __future__ import annotations

import hashlib

import numpy as np

Span = tuple[int, int, str]  # start, end (exclusive), kind


def in_code_points(raw: bytes, spans: list[Span]) -> list[Span]:
    """Byte spans as code point spans."""
    if not spans or raw.isascii():
        return spans
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), int(before[b]), kind) for a, b, kind in spans]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the place of the kind in ``kinds``."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
