"""Which tokens can stand side by side in a byte-pair encoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

NEVER = 1 << 40


def can_meet(left: Sequence, left_ends: Sequence[int], right: Sequence, right_ends: Sequence[int], rank: Callable[..., int], limit: int = NEVER) -> bool:
    """Whether no merge of rank under ``limit`` crosses the seam of two tokens while both are built.

    left: the pieces at the right edge of the left token while it is built, first to last, and the rank of the merge that
    ends each (NEVER for the last); right: likewise at the left edge of the right token. At every moment the seam lies
    between a piece of each. A merge of the two wins if its rank is below that of the merge that ends the left piece
    (which lies further left and so comes first when equal) and not above the one that ends the right piece.
    """
    i = j = 0
    while True:
        r = rank(left[i], right[j])
        if r < limit and r < left_ends[i] and r <= right_ends[j]:
            return False
        if left_ends[i] == right_ends[j] == NEVER:
            return True
        if left_ends[i] <= right_ends[j]:
            i += 1
        else:
            j += 1
