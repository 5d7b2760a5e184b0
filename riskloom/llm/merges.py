"""Byte-pair merging by rank, shared by the tokenizer operators.

``merge_by_rank`` is the definition: merge the adjacent pair of the lowest
rank, the leftmost of equals, until no pair merges.  The operators use it for
short strings only, to ask whether two neighbouring tokens are stable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


def merge_by_rank(symbols: Sequence, join: Callable) -> list:
    """``symbols`` after all merges; ``join(a, b)`` is ``(rank, merged)`` or None."""
    parts = list(symbols)
    while len(parts) > 1:
        best = None
        for i in range(len(parts) - 1):
            found = join(parts[i], parts[i + 1])
            if found is not None and (best is None or found[0] < best[0]):
                best = (found[0], i, found[1])
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [best[2]]
    return parts
