"""A short brief of a project under a cap of tokens."""

from __future__ import annotations

import math

from tracewright.functions.scalars import marked_text

#: Tokens of a brief at most, and the characters that a token is reckoned to have.
MOST_TOKENS, CHARS = 600, 4


def tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS)


def render(title: str, facts: list[tuple[str, str]], narrative: dict[str, str] | None = None, most: int = MOST_TOKENS) -> str:
    """A title, facts in the order of their weight, and written sections, each in a region of its own.

    Written sections are kept whole; facts come in while the cap allows, one that does not fit being passed over.
    """
    head = f"# {title}\n"
    written = [marked_text("narrative", name, body) for name, body in (narrative or {}).items() if body.strip()]
    kept: list[str] = []

    def whole(lines: list[str]) -> str:
        return "\n".join([head, marked_text("generated", "facts", "\n".join(lines)), *written]) + "\n"

    for name, value in facts:
        line = f"- {name}: {' '.join(str(value).split())}"
        if tokens(whole([*kept, line])) <= most:
            kept.append(line)
    return whole(kept)
