"""String and category expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import _c


def split_into(text, names: Sequence[str], pattern: str = "[^A-Za-z0-9]+") -> list[Column]:
    """Columns from the pieces of ``text``; an empty name drops its piece, missing pieces are NULL."""
    parts = F.split(_c(text), pattern)
    return [F.get(parts, i).alias(n) for i, n in enumerate(names) if n]


def extract(text, pattern: str, group: int = 0) -> Column:
    """Matched text, NULL (not '') when there is no match."""
    text = _c(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def value_map(x, mapping: Mapping[str, object], keep_unmatched: bool = True) -> Column:
    """Replace values by a fixed map; others are kept or become NULL."""
    x = _c(x)
    found = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])[x]
    return F.coalesce(found, x) if keep_unmatched else found


def drawn_index(name, pattern: str = r"\[(\d+),(\d+)\]") -> list[Column]:
    """Group ``k`` and grid point ``m`` out of a draw name like ``yhat[3,17]``."""
    name = _c(name)
    return [extract(name, pattern, i).cast("int").alias(n) for i, n in ((1, "k"), (2, "m"))]
