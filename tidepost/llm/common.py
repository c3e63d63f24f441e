"""What the operators of this subpackage share: stored work tables and typed input columns."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.session import through_table


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The written table survives lost executors, and later steps read it instead
    of computing it again.
    """
    return through_table(df, purpose)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` is called so (in any case)."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` that ``kept`` names; all columns of ``docs`` and no other.

    ``columns`` maps a column of ``kept`` to the expression over ``docs`` that must
    equal it; null equals null. Only copies under unused names meet in the join, so
    columns of any name may stand in ``docs``.
    """
    left_names = [fresh(docs, f"__row_{i}") for i in range(len(columns))]
    right_names = [fresh(docs, f"__keep_{i}") for i in range(len(columns))]
    right = kept.select(*[F.col(k).alias(n) for k, n in zip(columns, right_names)])
    left = docs.withColumns(dict(zip(left_names, columns.values())))
    on = F.lit(True)
    for a, b in zip(left_names, right_names):
        on = on & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return left.join(right, on, "left_semi").drop(*left_names)


def one_of_each(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """One row of ``docs`` for each value of ``keys`` (null equals null), columns unchanged."""
    names = [fresh(docs, f"__key_{i}") for i in range(len(keys))]
    return docs.withColumns(dict(zip(names, keys))).dropDuplicates(names).drop(*names)


def release_memory() -> None:
    """Give freed memory back to the system; a reused worker would hold it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An iterator function of a task that releases what its run has used when it ends."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        release_memory()

    return run
