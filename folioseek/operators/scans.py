"""Running totals and last values of ordered rows, for keys of any size.

A window over a key puts all its rows in one task. Here ordered rows are cut
into ranges of about equal size wherever they fall, each range runs on its own,
and only one row for each range and key is brought together to carry on what
came before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioseek.sources.scratch import written

RANGE, TIE = "range of the scan", "tie of the scan"


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[name].eqNullSafe(right[name]) for name in names))


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``rows`` with a column for each name: what holds at the row and all before it of its key.

    ``sums`` adds values, ``xors`` combines them bit by bit, and ``lasts`` takes
    the latest value that is not null. ``order`` names ascending columns, nulls
    first; rows that are equal in it stand in any order, but in the same one for
    all names.
    """
    sums, xors, lasts = sums or {}, xors or {}, lasts or {}
    names = [*sums, *xors, *lasts]
    value = {name: f"value of {name}" for name in names}
    valued = rows.withColumns({value[name]: column for name, column in {**sums, **xors, **lasts}.items()})
    tied = valued.withColumn(TIE, F.monotonically_increasing_id())
    ranged = written(tied.repartitionByRange(*keys, *order, TIE).withColumn(RANGE, F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy(RANGE, *keys).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*order, TIE)

    def total(name: str) -> Column:
        column = F.col(value[name])
        if name in sums:
            return F.sum(column)
        return F.bit_xor(column) if name in xors else F.max_by(column, F.when(column.isNotNull(), place))

    def within(name: str) -> Column:
        return F.last(value[name], ignorenulls=True).over(so_far) if name in lasts else total(name).over(so_far)

    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = {name: f"carry of {name}" for name in names}

    def carried(name: str) -> Column:
        column = F.col(name)
        if name in lasts:
            return F.last(column, ignorenulls=True).over(before)
        return (F.sum(column) if name in sums else F.bit_xor(column)).over(before)

    ends = ranged.groupBy(RANGE, *keys).agg(*[total(name).alias(name) for name in names])
    starts = ends.select(RANGE, *keys, *[carried(name).alias(carry[name]) for name in names])
    # Most keys lie in one range and carry nothing.
    starts = written(starts.where(reduce(lambda a, b: a | b, (F.col(carry[name]).isNotNull() for name in names))), "carried")

    def both(name: str) -> Column:
        own, earlier = F.col(name), F.col(carry[name])
        if name in lasts:
            return F.coalesce(own, earlier)
        zero = F.lit(0)
        if name in sums:
            return F.coalesce(own, zero) + F.coalesce(earlier, zero)
        return F.coalesce(own, zero).bitwiseXOR(F.coalesce(earlier, zero))

    local = ranged.withColumns({name: within(name) for name in names})
    joined = local.join(starts, _same(local, starts, [RANGE, *keys]), "left").select(*[local[c] for c in local.columns], *carry.values())
    return joined.select(*[F.col(c) for c in rows.columns], *[both(name).alias(name) for name in names])
