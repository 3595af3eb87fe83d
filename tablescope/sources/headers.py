"""Header naming: fill blank names and tell repeated ones apart.

Works on the names of one header row, which is metadata and not data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def unique_names(fields: Sequence[str], first_repeat: int = 1) -> list[str]:
    """Blank names become ``Column N``; repeats get a number.

    Delimited files number the first repeat 1, sheets number it 2.
    """
    seen: Counter[str] = Counter()
    names = []
    for place, field in enumerate(fields, start=1):
        base = (field or "").strip() or f"Column {place}"
        repeats = seen[base]
        seen[base] += 1
        names.append(base if repeats == 0 else f"{base} ({repeats - 1 + first_repeat})")
    return names
