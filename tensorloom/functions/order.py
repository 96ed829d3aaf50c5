"""Global numbering of sorted rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.sources.shared import written


def numbered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df with the number of each row, 1 up, in the order of keys, which must be unique. Ranges are sorted in parallel and
    written, so a lost executor can't change the numbers; only the row count of each range comes to the driver."""
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    offsets, total = [], 0
    for p, n in sorted(map(tuple, rows.groupBy(part.alias("p")).count().collect())):
        offsets.append((p, total))
        total += n
    if not offsets:
        offsets = [(0, 0)]
    starts = df.sparkSession.createDataFrame(offsets, "__p long, __off long")  # one row for each range
    out = rows.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return out.withColumn(name, F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__off", "__at")
