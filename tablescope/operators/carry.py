"""Carry the last seen value forward through an ordered group of any size.

A plain window would put a whole document into one task.  Here rows are cut
into blocks by their place; blocks are filled independently, and only one row
per block takes part in the pass over a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Mapping[str, str],
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add, for each entry ``new: source`` of ``values``, the latest non-null
    ``source`` at or before each row of its group.

    ``block`` maps a row's place to a block number and must grow with the
    order.  ``per_group`` (unique on ``keys``) may bring columns along; it joins
    the block rows, not the rows, so that a group with a third of all rows does
    not become one join task.
    """
    rows = df.withColumn("_block", block)
    place = F.struct(*[F.col(c) for c in order])
    last = [
        F.max_by(F.col(source), F.when(F.col(source).isNotNull(), place)).alias(f"_last_{new}")
        for new, source in values.items()
    ]
    blocks = rows.groupBy(*keys, "_block").agg(*last)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *keys, "_block",
        *[F.last(f"_last_{new}", ignorenulls=True).over(before).alias(f"_in_{new}") for new in values],
    )
    if per_group is not None:
        carried = carried.join(per_group, list(keys), "left")
    within = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = rows.join(carried, [*keys, "_block"])
    for new, source in values.items():
        here = F.last(source, ignorenulls=True).over(within)
        filled = filled.withColumn(new, F.coalesce(here, F.col(f"_in_{new}")))
    return filled.drop("_block", *[f"_in_{new}" for new in values])
