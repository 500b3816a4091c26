"""Text spans found by kind: their digest, and taking them out of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

#: kind, start and end in code points, end exclusive
Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``, then end; comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def parse(text: str | None) -> list[Span]:
    """The spans of a joined string."""
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in (text or "").split(",") if x)]


def bracketed(kind: str, value: str) -> str:
    return f"[{kind.upper()}]"


def replace(text: str, spans: Iterable[Span], mask: Callable[[str, str], str] = bracketed) -> str:
    """``text`` with every span replaced by ``mask(kind, value)``; overlapping spans become one,
    of the kind of the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], mask(kind, text[a:b])]
        at = b
    return "".join(out) + text[at:]
