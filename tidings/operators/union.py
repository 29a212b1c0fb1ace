"""One branch per source type, put together in configuration order; faults as rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.schemas import ERROR_COLUMNS, ITEM_COLUMNS


def dispatch(bound: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each source type through its own branch (a function from bound payloads to items)."""
    return union_items(*[branch(bound.filter(F.col("source_type") == kind)) for kind, branch in branches.items()])


def union_items(*parts: DataFrame) -> DataFrame:
    """All items, nothing dropped or merged. Order is ``source_ord, page_no, item_pos`` and not row order."""
    return reduce(DataFrame.unionByName, [p.select(*ITEM_COLUMNS) for p in parts])


def union_errors(*parts: DataFrame) -> DataFrame:
    """Everything that could not be read; a bad source or row never stops the others."""
    return reduce(DataFrame.unionByName, [p.select(*ERROR_COLUMNS) for p in parts])
