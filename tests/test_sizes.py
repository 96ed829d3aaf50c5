"""What queries move and hold as their tables grow."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tensorloom import queries as Q
from tensorloom.operators import algebra, meet
from tensorloom.sources import tables as S
from tensorloom.sources.shared import folder

SMALL = "/root/testdata/sf0.001"


def tables(spark, name: str) -> set[str]:
    """The folders of the tables that were written under this name."""
    made = Path(f"{folder(spark)}/tensorloom/{spark.sparkContext.applicationId}".removeprefix("file://"))
    return {str(p) for p in made.glob(f"{name}-*")}


def test_complex_aliased_pairs_only_what_it_returns(spark):
    before = tables(spark, "level")
    rows = Q.complex_aliased(spark, SMALL).collect()
    assert {r.i for r in rows} == {1, 2} and {r.k for r in rows} == {1, 2, 3}
    level = spark.read.parquet(*(tables(spark, "level") - before))
    assert level.agg(F.max("i"), F.max("k")).first()[:] == (2, 3)


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Tables with so many customers that products of their counts go beyond 64 bits: (folder, R, H, customers by region)."""
    path = str(tmp_path_factory.mktemp("crowd"))
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    named = F.element_at(F.array(*map(F.lit, segments)), (F.col("id") % 11 % 5 + 1).cast("int"))
    spark.range(1_000_000).select(F.col("id").alias("c_custkey"), (F.floor(F.col("id") / 13) % 25).cast("int").alias("c_nationkey"), named.alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")
    spark.read.parquet(f"{SMALL}/nation.parquet").write.parquet(f"{path}/nation.parquet")
    rows = spark.read.parquet(f"{path}/customer.parquet").join(spark.read.parquet(f"{path}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").count().collect()
    d = {(r[0] + 1, segments.index(r[1]) + 1): r[2] for r in rows}
    at = range(1, 6)
    r = {(x, y): sum(d[x, m] * d[y, m] for m in at) for x in at for y in at}
    h = {(x, y): sum(d[g, x] * (d[g, y] + g) for g in at) for x in at for y in at}
    return path, r, h, {g: sum(d[g, m] for m in at) for g in at}


def times(a, b):
    at = range(1, 6)
    return {(x, y): sum(a[x, k] * b[k, y] for k in at) for x in at for y in at}


def by_place(df):
    return {(r.x, r.y): int(r.v) for r in df.collect()}


def test_sandwich_beyond_64_bits(spark, crowd):
    path, r, h, _ = crowd
    want = times(times(r, h), r)
    assert max(want.values()) > 2**63 and by_place(Q.sandwich(spark, path)) == want
    assert dict(Q.sandwich(spark, SMALL).dtypes)["v"] == "bigint"


def test_commutator_norm_beyond_64_bits(spark, crowd):
    path, r, h, _ = crowd
    left, right = times(r, h), times(h, r)
    want = math.sqrt(sum((left[k] - right[k]) ** 2 for k in left))
    assert max(left.values()) > 2**63 and Q.commutator_norm(spark, path).first()[0] == pytest.approx(want, rel=1e-14)


def test_expectation_beyond_64_bits(spark, crowd):
    path, r, _, s = crowd
    want = sum(s[x] * r[x, y] * s[y] for x, y in r)
    assert want > 2**63 and [int(x.v) for x in Q.expectation(spark, path).collect()] == [want]
    assert dict(Q.expectation(spark, SMALL).dtypes)["v"] == "bigint"


def test_operator_product_beyond_64_bits(spark, crowd):
    path, r, h, _ = crowd
    want = times(r, h)
    assert max(want.values()) > 2**63 and by_place(Q.operator_product(spark, path)) == want
    assert dict(Q.operator_product(spark, SMALL).dtypes)["v"] == "bigint"


@pytest.mark.parametrize("query", [Q.block_svd, Q.complex_block_svd])
def test_sectors_of_block_svd_are_not_gathered(spark, query):
    """What is kept of a sector doesn't grow with its blocks: 7 numbers of each left vector, whatever the suppliers."""
    before = tables(spark, "sectors")
    assert all(r.exact for r in query(spark, "/root/testdata/sf0.01").collect())
    made = spark.read.parquet(*(tables(spark, "sectors") - before))
    widest = F.greatest(*[F.size(c) for c, kind in made.dtypes if kind.startswith("array")], F.lit(0))
    assert made.agg(F.max(widest)).first()[0] == 7


def test_large_sources_are_dealt_to_more_tasks(spark, monkeypatch):
    """The session has 4 shuffle partitions; a table of 6000 rows takes 7 where a task takes 900."""
    monkeypatch.setattr(meet, "ROWS", 900)
    parts = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 900)
    assert parts > 4
    t, a = S.lines(spark, SMALL), S.supply(spark, SMALL)
    for df in (t.df, a.df, t.to_block(1).df, algebra.add(a, a).df):
        assert df.rdd.getNumPartitions() == parts


@pytest.mark.parametrize("query", [Q.coo_contract_batch, Q.coo_block_tail, Q.block_dense_tail])
def test_few_labels_do_not_gather_the_large_operand(spark, monkeypatch, query):
    """A line has 7 numbers: by these, seven tasks would take all sales. The small operand goes to the large one."""
    monkeypatch.setattr(meet, "ROWS", 900)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert query(spark, SMALL).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_labels_meet_in_blocks(spark):
    """A supplier's 21 numbers go with each of its parts as one row."""
    plan = Q.hot_label_contract(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner, (((h") :] if "Join Inner, (((h" in plan else plan
    assert "bb#" in join
