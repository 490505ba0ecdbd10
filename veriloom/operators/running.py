"""Running sums over ordered rows of a key, in two levels, so that a hot key is many tasks' work."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import kept

RANGE = "__range"


Order = Sequence[str | Column]


def dealt(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """``df`` written in ranges of keys and order, with the number of the range. Rows that are equal in
    both are in one range; bounds of ranges pass the driver, so these columns are not to be long."""
    return kept(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Order, values: dict[str, Column], inclusive: bool = False, combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``df`` (of ``dealt``) with a column per value: its sum over the rows of the same keys that come
    before in ``order``, with the row's own if ``inclusive``; 0 where there are none. ``combine`` may be
    F.max instead, whose result is null where there are none. A null key is a key.

    A range's own sums, one row per key and range, say where it begins; rows are then summed within
    their range alone.
    """
    none = F.lit(0) if combine is F.sum else F.lit(None)
    own = df.withColumns({f"__v_{name}": value for name, value in values.items()})
    sums = own.groupBy(RANGE, *keys).agg(*(combine(f"__v_{name}").alias(f"__of_{name}") for name in values))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(RANGE, *keys, *(F.coalesce(combine(f"__of_{name}").over(earlier), none).alias(f"__of_{name}") for name in values))
    within = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = own.select("*", *(combine(f"__v_{name}").over(within).alias(f"__here_{name}") for name in values))
    of = {c: f"__of_key{i}" for i, c in enumerate((RANGE, *keys))}
    met = here.join(starts.withColumnsRenamed(of), reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(o)) for c, o in of.items())))

    def both(name: str) -> Column:
        before, own = F.col(f"__of_{name}"), F.col(f"__here_{name}")
        return before + F.coalesce(own, none) if combine is F.sum else F.greatest(before, own)

    return met.select(*df.columns, *(both(name).alias(name) for name in values))
