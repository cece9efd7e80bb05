"""Numbers for the rows of a whole table in its order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimloom.sources.shared import scratch

#: monotonically_increasing_id() counts the rows of a partition in so many low bits.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "position", start: int = 1) -> DataFrame:
    """df with the place of each row in `order`, which should leave no ties: equal rows get neighbouring numbers in any order.

    Rows are dealt by ranges of the order, sorted where they are and written with their number within the range; ranges
    are counted, and sums of those counts, a number a range, are added on reading. Rows that are equal in order share a range, so that a value which
    a large part of all rows has should be followed by a further column."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch(df.sparkSession, "numbered")
    ranges.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_row", LongType())])).parquet(path).withColumn("_range", F.shiftright("_row", ROW_BITS))
    sizes = dict(sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect()))  # a row a range
    begins, total = [], start
    for k in range(max(sizes, default=-1) + 1):
        begins.append(total)
        total += sizes.get(k, 0)
    first = F.element_at(F.lit(begins or [start]), F.col("_range").cast("int") + 1)
    return rows.withColumn(name, (first + F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).cast("long")).drop("_row", "_range")
