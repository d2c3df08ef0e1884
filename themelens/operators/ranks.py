"""Running sums and ranks over a whole table, or over very large groups, without one task for any of them.

Rows are dealt to partitions by range; every partition sums up what it has, the partitions' totals
give each its offset, and a row's sum is the offset and the sum within its partition.  No window is without
a partition of its own, and the driver sees one number a partition at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import written


def running_total(df: DataFrame, keys, order, value, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``keys`` up to this one in ``order``.

    ``keys``: column names; ``order``: columns or names that tell all rows of a key apart.  ``value`` is of a
    whole-number column or a literal.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    dealt = df.withColumn("_value", value.cast("long")).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt)  # the partition numbers hold from here on
    totals = dealt.groupBy("_part", *keys).agg(F.sum("_value").alias("_total"))
    inside = F.sum("_value").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_inside", inside)
    if keys:  # a key has at most one total a partition
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
        names = ["_part", *keys]
        same = [offsets[k].eqNullSafe(found[k]) for k in names]
        offset = found.join(offsets, same[0] if len(same) == 1 else _all(same), "left")
        found = offset.select(*[found[c] for c in found.columns], offsets["_offset"])
    else:
        sums, at = {r["_part"]: r["_total"] for r in totals.collect()}, 0  # one number a partition
        offsets = [0] * (max(sums, default=-1) + 1)
        for part in sorted(sums):
            offsets[part], at = at, at + sums[part]
        found = found.withColumn("_offset", F.get(vx.json_literal(offsets, "array<long>"), F.col("_part")))
    return found.withColumn(out, F.col("_offset") + F.col("_inside")).drop("_value", "_part", "_inside", "_offset")


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def global_rank(df: DataFrame, order, out: str) -> DataFrame:
    """``df`` with ``out``: its place in ``order`` (from 1), which must tell all rows apart."""
    return running_total(df, [], order, F.lit(1), out)
