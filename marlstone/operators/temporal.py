"""As-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str]) -> DataFrame:
    """`left` with the columns `take` of the last row of `right` with the same `by` and no later `on`; null where none.

    Both sides are put in one order and the last value is carried along, so each is shuffled once and nothing is
    compared pairwise. Rows of `right` should be unique in (by, on); of ties one is taken."""
    l = left.select(F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), by, on, *[F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in take])  # noqa: E741
    r = right.select(F.lit(0).alias("side"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), by, on, *[F.col(c).alias(f"r_{c}") for c in take])
    seen = Window.partitionBy(by).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = l.unionByName(r).withColumns({f"r_{c}": F.last(f"r_{c}", ignorenulls=True).over(seen) for c in take})
    return carried.where("side = 1").select("row.*", *[F.col(f"r_{c}").alias(c) for c in take])


def between(ranges: DataFrame, points: DataFrame, low: str, high: str, at: str, width: float) -> DataFrame:
    """Pairs of `ranges` and `points` with low <= at <= high, without any key to meet by: both are dealt to buckets of
    `width`, a range to all that it touches, and the bounds decide. A point has one bucket, so no pair comes twice. Nulls meet
    nothing. `width` near the usual range keeps both the buckets of a range and the points of a bucket few."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    wide = ranges.where(F.col(low) <= F.col(high)).withColumn("range_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    placed = points.withColumn("point_bucket", bucket(at))
    met = wide.join(placed, (F.col("range_bucket") == F.col("point_bucket")) & F.col(at).between(F.col(low), F.col(high)))
    return met.drop("range_bucket", "point_bucket")
