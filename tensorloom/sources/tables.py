"""Tensors derived from the sales, events and vector tables. Keys start at 0 there; coordinates start at 1."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.meta import Axis
from tensorloom.operators.meet import dealt
from tensorloom.tensor import Tensor

BIG = 2**31 - 1  # a dimension that nothing depends on


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one(col: str):
    return (F.col(col) + 1).cast("int")


def sold(spark, sf) -> tuple[DataFrame, int]:
    """Lines of sales by supplier i and part r, and their number, which the files' footers have."""
    df = read(spark, sf, "lineitem")
    n = df.count()
    return dealt(df.withColumns({"i": one("l_suppkey"), "r": one("l_partkey")}), ["i", "r"], n), n


def supply(spark, sf) -> Tensor:
    """A(i supplier, r part): quantity sold."""
    df, n = sold(spark, sf)
    df = df.groupBy("i", "r").agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return replace(Tensor.coo(df, [Axis("i", BIG), Axis("r", BIG)], unique=True), rows=n)


def sizes(spark, sf) -> Tensor:
    """B(r part, j size): 1."""
    df = read(spark, sf, "part").select(one("p_partkey").alias("r"), F.col("p_size").alias("j"), F.lit(1).cast("long").alias("v"))
    return Tensor.coo(df, [Axis("r", BIG), Axis("j", 50)], unique=True)


def lines(spark, sf) -> Tensor:
    """T(i supplier, r part, q line number 1 to 7): quantity sold."""
    df, n = sold(spark, sf)
    df = df.groupBy("i", "r", F.col("l_linenumber").alias("q")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return replace(Tensor.coo(df, [Axis("i", BIG), Axis("r", BIG), Axis("q", 7)], unique=True), rows=n)


def vectors(spark, sf) -> Tensor:
    """E(label, vec ; x): a block of 64 for each vector."""
    df = read(spark, sf, "embeddings").select(one("label").alias("label"), one("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("blk"))
    return Tensor((Axis("label", 10), Axis("vec", BIG), Axis("x", 64)), df, 1)


def nations(spark, sf) -> Tensor:
    """G(n nation, g region): one-hot."""
    df = read(spark, sf, "nation").select(one("n_nationkey").alias("n"), one("n_regionkey").alias("g"), F.lit(1).cast("long").alias("v"))
    return Tensor.coo(df, [Axis("n", 25), Axis("g", 5)], unique=True)


def customers(spark, sf) -> Tensor:
    """N(n nation, m segment 1 to 5): customers."""
    segment = F.array_position(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), F.col("c_mktsegment")).cast("int")
    df = read(spark, sf, "customer").groupBy(one("c_nationkey").alias("n"), segment.alias("m")).agg(F.count(F.lit(1)).alias("v"))
    return Tensor.coo(df.where("m > 0"), [Axis("n", 25), Axis("m", 5)], unique=True)
