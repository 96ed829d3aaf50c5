"""How the rows of two operands meet: on shared labels, on labels some of which are hot, or all with all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 250_000  # entries that a task takes, where a table's number is known
FEW = 100_000  # numbers of an operand that goes to every task
HOT = 1000  # at most so many labels are hot on a side, since each has over a HOT-th of the rows


def dealt(df: DataFrame, by: list[str], rows: int | None) -> DataFrame:
    """Rows by columns in partitions whose number grows with the rows, where the session's number is too small for them."""
    n = -(-(rows or 0) // ROWS)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def met(left: DataFrame, right: DataFrame, on: list[str], spread: int | None = None, numbers: tuple[int, int] | None = None, rows: int | None = None) -> DataFrame:
    """The equi-join on `on`; without shared columns all pairs, in a grid; with `spread`, hot labels are split. numbers: at most so
    many are in each side, by its dimensions; a side of FEW meets the other where that lies, so that the few values of a label
    don't become few tasks. rows: about how many entries both sides were made of."""
    if numbers and spread is None and min(numbers) <= FEW:
        left, right = (F.broadcast(left), right) if numbers[0] < numbers[1] else (left, F.broadcast(right))
        return left.join(right, on) if on else left.crossJoin(right)
    if not on:
        return grid(left, right)
    if spread is None:
        left, right = (dealt(x, on, rows) for x in (left, right))
    return left.join(right, on) if spread is None else salted(left, right, on, spread)


def _rest(df: DataFrame, but: list[str]) -> list[str]:
    """Columns to hash a row by; complex values and blocks too."""
    return [c for c in df.columns if c not in but]


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows by an equi-join: each row of the left goes to one line of a square grid and to all its cells, each row of
    the right to one column. A row is sent as often as the grid is wide, about the root of the session's shuffle partitions, and
    a cell meets its share of both sides."""
    wide = max(1, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(wide)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    a = left.withColumn("__line", place(left)).withColumn("__column", every)
    b = right.withColumn("__column", place(right)).withColumn("__line", every)
    return a.join(b, ["__line", "__column"]).drop("__line", "__column")


def hot_labels(left: DataFrame, right: DataFrame, on: list[str], spread: int) -> DataFrame:
    """(on..., __left, __right): into how many parts each side's rows of a label are split, for labels with more than `spread` rows
    and more than a HOT-th of a side. At most 2 * HOT rows, from counts with partial sums on each task."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        total = df.agg(F.count(F.lit(1)).alias("__all"))  # one row
        some = counts.crossJoin(F.broadcast(total)).where(f"__n > {spread} and __n * {HOT} > __all")
        return some.select(*on, F.ceil(F.col("__n") / spread).cast("int").alias(name))

    both = counted(left, "__left").join(counted(right, "__right"), on, "full_outer")
    return both.select(*on, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("__left", "__right")])


def salted(left: DataFrame, right: DataFrame, on: list[str], spread: int) -> DataFrame:
    """The equi-join, with hot labels split on both sides: of a label in p parts on the left and q on the right, each left row
    goes to its own part and to all q parts of the other side, each right row likewise, and only equal (label, p, q) meet. No task
    then takes more than about `spread` rows of a label from a side."""
    hot = F.broadcast(hot_labels(left, right, on, spread))

    def split(df: DataFrame, own: str, other: str) -> DataFrame:
        known = df.join(hot, on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__left", "__right")})
        part = F.pmod(F.xxhash64(*_rest(df, on)), F.col(own)).cast("int")
        return known.select(*df.columns, part.alias(f"{own}_part"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_part"))

    salts = ["__left_part", "__right_part"]
    return split(left, "__left", "__right").join(split(right, "__right", "__left"), [*on, *salts]).drop(*salts)
