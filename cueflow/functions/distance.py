"""Edit distance for ordered folds, where Spark's own can't be called."""

from __future__ import annotations


def similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length, by code points; 1 for equal strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))
