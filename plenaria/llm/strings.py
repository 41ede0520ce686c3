"""String folding and edit distance shared by the matching operators."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
# Characters that scans and hasty typing confuse, folded to one of them.
CONFUSED = str.maketrans({"0": "o", "1": "i", "l": "i", "3": "e"})


def fold(text: str) -> str:
    """Case, accents and compatibility forms removed."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def skeleton(text: str) -> str:
    """``fold`` with confusable characters folded too; digits of pure numbers stay."""
    return " ".join(w if w.isdigit() else w.translate(CONFUSED) for w in words(text))


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        now = [i] + [most + 1] * len(b)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now[lo - 1 : hi + 1]) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)
