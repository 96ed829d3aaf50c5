"""Canonical form, labels that repeat, joins of hot labels and grids, exact products, whole factorizations, logs and chains."""

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import queries as Q
from tensorloom.meta import Axis
from tensorloom.operators import algebra, factor, meet, reduce, restricted, spectral
from tensorloom.operators.contract import contract
from tensorloom.plans import network, sites
from tensorloom.sources.clustered import Clustered
from tensorloom.sources.log import TensorLog
from tensorloom.streaming import both
from tensorloom.tensor import Tensor
from tests.test_tensors import array, make, make_complex, sparse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (2, 2, 4.0), (2, 2, -4.0)], "i int, j int, v double")
    return Tensor.coo(df, [Axis("i", 2), Axis("j", 2)])


def test_repeated_keys_are_summed_in_every_form(spark, repeated):
    want = np.array([[3.0, 0], [0, 0]])
    for t in (repeated, repeated.to_block(1), repeated.to_block(2), repeated.to_block(1).to_aliased(), Q.stored(repeated.to_block(1))):
        assert np.array_equal(array(t, "ij"), want) and t.to_coo().df.count() == 1
        assert reduce.norm(t).first()[0] == 3.0 == reduce.max_abs(t).first()[0]
        assert reduce.difference(t, t).first()[0] == 0.0 == reduce.difference(t, repeated).first()[0]
        assert t.get(i=1, j=1).first()[0] == 3.0 and t.get(i=2, j=2).first()[0] == 0.0
        assert t.to_dense().count() == 4
        assert np.array_equal(array(algebra.zip_map(t, t, lambda x, y: x * y), "ij"), want * want)
    assert Tensor.load(spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0)], "i int, j int, v double"), list(repeated.axes)).df.count() == 1
    twice = spark.createDataFrame([(1, 1, 5.0), (1, 1, 6.0)], "i int, j int, v double")
    assert repeated.upsert(twice).get(i=1, j=1).first()[0] == 11.0
    for rows in ([(1, 1, 1.0), (1, 1, 2.0)], [(1, 3, 1.0)]):
        with pytest.raises(ValueError):
            Tensor.coo(spark.createDataFrame(rows, "i int, j int, v double"), list(repeated.axes), check=True)


def test_zero_scalars_have_a_row(spark):
    a, b = make(spark, "i", np.array([1.0, 0])), make(spark, "i", np.array([0, 1.0]))
    none = Tensor.empty(spark, [Axis("i", 2)])
    for x, y in ((a, b), (a, none), (a.to_block(1), b.to_block(1)), (a.to_block(1).to_aliased(), b.to_block(1))):
        assert [r.v for r in network.inner(x, y).collect()] == [0.0]
        assert network.overlap(x, y).first()[0] == 0.0
    z = make_complex(spark, "i", np.array([1j, 0]))
    assert [tuple(r.v) for r in network.inner(z, b).collect()] == [(0.0, 0.0)]
    nil = Tensor.empty(spark, [Axis("x", 2), Axis("x", 2, 1)])
    assert network.hermiticity(nil).first()[0] == 0.0 and reduce.normalised(nil).df.count() == 0


def test_names_and_complex_sources(spark):
    for name in ("v", "blk", "tid", "alpha", "__x"):
        with pytest.raises(ValueError):
            Tensor.empty(spark, [Axis(name, 2)])
    rows = spark.createDataFrame([(1, 1, 3.0, 4.0), (1, 2, 0.0, 0.1), (2, 2, 0.0, 6.0)], "p int, r int, re double, im double").select("p", "r", F.struct("re", "im").alias("v"))
    axes = [Axis("p", 2), Axis("r", 2)]
    t = Tensor.dense(rows, axes, atol=1.0)
    assert {(r.p, r.r) for r in t.df.collect()} == {(1, 1), (2, 2)}
    assert restricted.violations(t, ["p"], "r", [("p", "r")]).count() == 0
    assert restricted.violations(Tensor.coo(rows, axes), [], "p", [("p", "r")]).count() == 1
    assert reduce.footprint(t.to_block(1)).first()[0] == 2 * (2 * 16 + 4)


def test_axes_of_one_label(spark):
    a = sparse((3, 2, 3, 2), 51)
    axes = [Axis("l", 3, 0, True), Axis("s", 2), Axis("l", 3, 0, True, 1), Axis("l", 2, 0, True, 2)]
    rows = [(*(int(i) + 1 for i in at), float(a[at])) for at in zip(*np.nonzero(a), strict=True)]
    t = Tensor.coo(spark.createDataFrame(rows, "l int, s int, l__c1 int, l__c2 int, v double"), axes)
    for form in (t, t.to_block(1), t.to_block(2), Q.stored(t.to_block(2)), t.to_block(1).to_aliased()):
        got = {(r.l, r.s): r.v for r in form.to_dense().collect()}
        want = a.transpose(1, 0, 2, 3).reshape(2, 18, order="F")
        assert len(got) == 36 and all(got[j + 1, i + 1] == want[i, j] for i in range(2) for j in range(18))
    square = Tensor(t.axes[:3], t.df.where("l__c2 = 1").drop("l__c2"))
    assert [{r.s: r.v for r in square.trace("l").df.collect()}.get(s + 1, 0) for s in range(2)] == np.einsum("lsl->s", a[..., 0]).tolist()
    assert np.array_equal(array(square.diagonal("l"), "ls"), np.einsum("lsl->ls", a[..., 0]))
    both = Tensor((Axis("l", 3), Axis("l", 3, copy=1)), spark.createDataFrame([(1, 2, 5.0)], "l int, l__c1 int, v double"))
    assert [r.v for r in both.trace("l").df.collect()] == [0.0]
    with pytest.raises(ValueError):
        contract(both, make(spark, "lk", sparse((3, 2), 52)))
    with pytest.raises(ValueError):
        Tensor.empty(spark, [Axis("l", 3), Axis("l", 3)])


BLOCKED = ["coo_block_prefix", "coo_block_tail", "block_block_prefix", "block_block_tail", "block_block_multi", "block_block_to_dense", "block_dense_prefix", "block_dense_tail", "block_dense_multi", "block_block_tail_grid"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", BLOCKED)
def test_block_queries_multiply_blocks(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "blk" in text and "posexplode" in text


def test_no_all_pairs_joins(spark):
    a, b = sparse((5, 4, 3), 61), sparse((6, 4, 2), 62)
    x, y = Q.stored(make(spark, "irk", a, 2)), Q.stored(make(spark, "jrl", b, 2))
    cases = [(contract(x, y, plan="block"), "ikjl", "irk,jrl->ikjl"), (contract(x.to_aliased(), y), "ikjl", "irk,jrl->ikjl"), (contract(make(spark, "irk", a), y.rename("r", "s")), "irkjsl", "irk,jsl->irkjsl")]
    for made, names, sums in cases:
        text = made.df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert np.allclose(array(made, names), np.einsum(sums, a, b))


@pytest.mark.parametrize("form", ("coo", "block", "aliased"))
def test_hot_labels_are_spread(spark, form):
    rng = np.random.default_rng(63)
    label = np.where(rng.random(4000) < 0.5, 0, rng.integers(1, 50, 4000))
    a, b = np.zeros((50, 4000), int), np.zeros((50, 60), int)
    a[label, np.arange(4000)] = rng.integers(1, 9, 4000)
    b[rng.random(b.shape) < 0.2] = 3
    b[0] = 2
    rows = lambda m, n: spark.createDataFrame([(int(i) + 1, int(j) + 1, int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], f"h int, {n} int, v long")
    x, y = Tensor.coo(rows(a, "i"), [Axis("h", 50), Axis("i", 4000)]), Tensor.coo(rows(b, "j"), [Axis("h", 50), Axis("j", 60)])
    if form != "coo":
        y = Q.stored(y.to_block(1))
        y = y.to_aliased() if form == "aliased" else y
    assert np.array_equal(array(contract(x, y, spread=100, plan="block"), "ij"), a.T @ b)
    if form == "coo":
        left, right = x.df.withColumnRenamed("v", "a"), y.df.withColumnRenamed("v", "b")
        hot = {r.h: (r["__left"], r["__right"]) for r in meet.hot_labels(left, right, ["h"], 100).collect()}
        assert hot[1] == (-(-int((a[0] != 0).sum()) // 100), 1)
        # what one task gets of the hot label: rows dealt by label and part
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = meet.salted(left, right, ["h"], 100)
            held = spark.conf.get("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", "64")
            sizes = [r["n"] for r in meet.salted(left, right, ["h"], 100).where("h = 1").groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("i").alias("n")).collect()]
            assert joined.count() == sum(int((a[h] != 0).sum() * (b[h] != 0).sum()) for h in range(50))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
            spark.conf.set("spark.sql.adaptive.enabled", held)
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(sizes) > 8 and max(sizes) < 500 < sum(sizes)


def test_exact_contractions(spark):
    rng = np.random.default_rng(42)
    a = rng.standard_normal((4, 3, 4)) * 10.0 ** rng.integers(-12, 12, (4, 3, 4))
    b = rng.standard_normal((3, 4, 3)) * 10.0 ** rng.integers(-12, 12, (3, 4, 3))
    a[:, 2], b[2] = -a[:, 0], b[0] * (1 + 2.0**-50)  # nearly everything cancels
    for na, nb in ((0, 0), (1, 1), (2, 1)):
        got = contract(make(spark, "ark", a, na), make(spark, "rkb", b, nb), exact=True)
        exact = {(i, j): sum((Fraction(float(a[i, r, k])) * Fraction(float(b[r, k, j])) for r, k in itertools.product(range(3), range(4))), Fraction(0)) for i, j in itertools.product(range(4), range(3))}
        found = array(got, "ab")
        assert all(found[i, j] == float(v) for (i, j), v in exact.items())
    scalar = contract(make(spark, "i", np.array([2.0**60, 1, -(2.0**60)])), make(spark, "i", np.ones(3)), exact=True)
    assert [r.v for r in scalar.df.collect()] == [1.0]
    assert [r.v for r in contract(make(spark, "i", np.array([1.0, 0])), make(spark, "i", np.array([0, 1.0])), exact=True).df.collect()] == [0.0]
    with pytest.raises(ValueError):
        contract(make_complex(spark, "i", np.array([1j])), make(spark, "i", np.ones(1)), exact=True)


def rows_of(t, n):
    out = np.zeros((n, t.blksize))
    for r in t.df.collect():
        out[r[0] - 1] = r["blk"]
    return out


VALUES = [("equal", [3, 3, 1.5, 1.5, 0.7, 0.2], 1e-13), ("threefold", [3, 3, 1.5, 0.7, 0.7, 0.7], 0), ("nearly", [3, 3 + 1e-13, 1.5, 1.5 - 1e-13, 0.7, 0.2], 1e-13), ("apart", [3, 2.4, 1.7, 1.1, 0.6, 0.2], 1e-13)]


@pytest.mark.parametrize("name,values,noise", VALUES)
def test_fixed_gauge_of_tables(spark, name, values, noise):
    """F1 to F4 through tables: noise, and other bases of equal values, leave both factors where they are."""
    rng = np.random.default_rng(7)
    u, w = (np.linalg.qr(rng.standard_normal((6, 6)))[0] for _ in range(2))
    m = u * np.array(values) @ w.T
    turn = np.eye(6)
    if not noise:
        turn[:2, :2], turn[3:, 3:] = np.linalg.qr(rng.standard_normal((2, 2)))[0], np.linalg.qr(rng.standard_normal((3, 3)))[0]
    n = (u @ turn) * np.array(values) @ (w @ turn).T + noise * rng.standard_normal((6, 6))
    found = [spectral.full_svd(make(spark, "ij", x), ["i"], 6, rounds=1, stable=True) for x in (m, n)]
    (l1, r1), (l2, r2) = ((rows_of(f.left, 6), rows_of(f.right, 6)) for f in found)
    assert np.abs(l1 * found[0].values @ r1.T - m).max() < 1e-10
    assert np.abs(l1 - l2).max() < 1e-9 and np.abs(r1 - r2).max() < 1e-9
    # ortho right: the values on the left
    assert np.abs(l1 * found[0].values - l2 * found[1].values).max() < 1e-9
    s = factor.stable_svd(m)
    assert np.abs(s[0] * s[1] @ s[2] - m).max() < 1e-10


def test_second_weight():
    same = np.eye(3)
    other = np.diag([3.0, 1.0, 2.0])
    assert np.allclose(np.abs(factor.fixed_basis([same, other])), np.eye(3)[:, [1, 2, 0]])


def test_full_svd_of_many_shapes(spark):
    rng = np.random.default_rng(71)
    a = rng.standard_normal((40, 5)) @ rng.standard_normal((5, 30))
    a[rng.random(a.shape) < 0.1] = 0
    s = np.linalg.svd(a)[1]
    f = spectral.full_svd(make(spark, "ij", a), ["i"], 12, rounds=4)
    assert np.allclose(f.values[:5], s[:5], rtol=1e-6) and len(f.values) == 12
    low = rng.standard_normal((20, 3)) @ rng.standard_normal((3, 24))
    t = make(spark, "ijk", low.reshape(20, 4, 6))
    f = spectral.full_svd(t, ["j", "k"], 10)
    assert len(f.values) == 3 and np.allclose(array(f.product(), "jki"), low.T.reshape(4, 6, 20))
    assert np.allclose(f.values, np.linalg.svd(low)[1][:3])
    empty = spectral.full_svd(Tensor.empty(spark, [Axis("i", 3), Axis("j", 3)]), ["i"], 2, stable=True)
    assert len(empty.values) == 0 and empty.left.df.count() == 0
    with pytest.raises(ValueError):
        spectral.full_svd(t, ["j"], 5000)


def test_lanczos(spark):
    rng = np.random.default_rng(72)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    values, top = spectral.lanczos(make(spark, "ij", a), "i", "j", 12)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.allclose(values, want)
    v = np.zeros(12)
    for r in top.df.collect():
        v[r.j - 1] = r.v
    assert np.allclose(a @ v, want[0] * v, atol=1e-8)
    values, _ = spectral.lanczos(make(spark, "ij", np.eye(5) * 4), "i", "j", 5)
    assert np.allclose(values, [4.0])  # the space is closed after one step
    assert len(spectral.lanczos(Tensor.empty(spark, [Axis("i", 3), Axis("j", 3)]), "i", "j", 2)[0]) == 0


def test_log(spark, tmp_path):
    t = make(spark, "ij", np.array([[1.0, 2], [0, 4]]))
    log = TensorLog.create(t, str(tmp_path / "log"))
    rows = lambda *r: spark.createDataFrame(r, "i int, j int, v double")
    assert log.append(rows((1, 1, 5.0), (1, 1, 6.0), (2, 2, 0.0))) == 1
    assert log.append(rows((1, 1, 1.0), (2, 1, 7.0), (2, 2, 2.0)), "add") == 2
    assert log.append(rows((1, 2, 9.0))) == 3
    states = [[[1.0, 2], [0, 4]], [[11, 2], [0, 0]], [[12, 2], [7, 2]], [[12, 9], [7, 2]]]
    for compacted in (False, True):
        for n, want in enumerate(states):
            assert np.array_equal(array(log.read(n), "ij"), want)
        assert log.read().df.count() == 4
        if not compacted:
            assert log.compact() == 3 == log.compact()
            assert "append" not in "".join(log.read().df.inputFiles())
    assert log.append(rows((1, 1, -12.0)), "add") == 4 and log.read().df.count() == 3
    (tmp_path / "log" / "append=00000009").mkdir()  # a writer that was lost
    assert log.version == 4
    for wrong in (lambda: log.read(5), lambda: log.append(rows((1, 1, 1.0)), "put")):
        with pytest.raises(ValueError):
            wrong()
    z = make_complex(spark, "i", np.array([1j, 2]))
    log = TensorLog.create(z, str(tmp_path / "z"))
    log.append(spark.createDataFrame([(1, 1.0, 0.0)], "i int, re double, im double").select("i", F.struct("re", "im").alias("v")), "add")
    assert {r.i: tuple(r.v) for r in log.read().df.collect()} == {1: (1.0, 1.0), 2: (2.0, 0.0)}


def test_chains(spark):
    rng = np.random.default_rng(81)
    link = lambda n, d: Axis(n, d, 0, True)

    def tensor(axes, m):
        rows = [(*(int(i) + 1 for i in at), float(m[at])) for at in np.ndindex(m.shape)]
        return Tensor.coo(spark.createDataFrame(rows, ", ".join(f"{a.col} int" for a in axes) + ", v double"), list(axes), unique=True)

    a = [rng.standard_normal(s) for s in ((2, 4), (4, 3, 4), (4, 2))]
    a[0][:, 3], a[1][..., 3] = a[0][:, 0], a[1][..., 1]  # bonds wider than they need to be
    state = sites.Chain((tensor((Axis("s1", 2), link("l1", 4)), a[0]), tensor((link("l1", 4), Axis("s2", 3), link("l2", 4)), a[1]), tensor((link("l2", 4), Axis("s3", 2)), a[2])))
    want = np.einsum("ap,pbq,qc->abc", *a)
    assert np.allclose(array(state.whole(), ["s1", "s2", "s3"]), want)
    small = sites.compressed(state, 10)
    assert small.bonds() == [2, 2] and np.allclose(array(small.whole(), ["s1", "s2", "s3"]), want)
    cut = sites.compressed(state, 1)
    rest = np.linalg.norm(array(cut.whole(), ["s1", "s2", "s3"]) - want)
    assert cut.bonds() == [1, 1] and 0 < rest < np.linalg.norm(want)
    w = [rng.standard_normal(s) for s in ((2, 2, 2), (2, 3, 3, 2), (2, 2, 2))]
    op = sites.Chain((
        tensor((Axis("s1", 2), Axis("s1", 2, 1), link("k1", 2)), w[0]), tensor((link("k1", 2), Axis("s2", 3), Axis("s2", 3, 1), link("k2", 2)), w[1]), tensor((link("k2", 2), Axis("s3", 2), Axis("s3", 2, 1)), w[2]),
    ))
    whole = np.einsum("axk,kbyl,lcz->abcxyz", *w)
    got = op @ state
    assert got.bonds() == [8, 8] and np.allclose(array(got.whole(), ["s1", "s2", "s3"]), np.einsum("abcxyz,xyz->abc", whole, want))
    twice = op @ op
    names = ["s1", "s2", "s3", "s1__p1", "s2__p1", "s3__p1"]
    assert np.allclose(array(twice.whole(), names), np.einsum("abcxyz,xyzdef->abcdef", whole, whole))
    with pytest.raises(ValueError):
        sites.Chain((state.sites[0], state.sites[2]))


def test_two_streams_restarted(spark, tmp_path):
    a, b = (Axis("i", 4), Axis("r", 5)), (Axis("r", 5), Axis("j", 3))
    rng, want = np.random.default_rng(4), {"a": np.zeros((4, 5)), "b": np.zeros((5, 3))}
    path = {n: str(tmp_path / n) for n in ("a", "b", "sums", "checkpoint")}

    def arrive(name, schema, n):
        rows = [(int(x) + 1, int(y) + 1, float(v)) for x, y, v in zip(*(rng.integers(0, d, n) for d in want[name].shape), rng.integers(-4, 5, n), strict=True)]
        for x, y, v in rows:
            want[name][x - 1, y - 1] += v
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path[name])

    def run(salts, partitions=2):
        streams = [Tensor(axes, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path[n])) for n, axes, schema in (("a", a, "i int, r int, v double"), ("b", b, "r int, j int, v double"))]
        products = both.product_entries(*streams, salts=salts)
        before = {k: spark.conf.get(k, None) for k in (*both.STATE, "spark.sql.shuffle.partitions")}
        both.accumulate(products, path["sums"], path["checkpoint"], partitions).awaitTermination()
        assert before == {k: spark.conf.get(k, None) for k in before}
        assert len(list((tmp_path / "checkpoint" / "state" / "0").glob("[0-9]*"))) == 2  # of the first start, whatever comes later
        return array(both.accumulated(spark, path["sums"], products.axes), "ij")

    assert both.accumulated(spark, path["sums"], a).df.count() == 0
    for n in (9, 14):  # the second round starts from the checkpoint; repeated coordinates add up
        arrive("a", "i int, r int, v double", n)
        arrive("a", "i int, r int, v double", 3)
        arrive("b", "r int, j int, v double", n)
        assert np.array_equal(run(3), want["a"] @ want["b"])
    # a batch that fails after its folder was written is run again and counts once
    arrive("b", "r int, j int, v double", 5)
    last = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    assert np.array_equal(run(3, 5), want["a"] @ want["b"])
    with pytest.raises(ValueError, match="never meet"):
        both.product_entries(*(Tensor((x,), spark.createDataFrame([], f"{x.col} int, v double")) for x in (a[0], b[1])))


def test_two_streams_to_a_scalar(spark, tmp_path):
    axis = (Axis("r", 5),)
    spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 1.0)], "r int, v double").write.parquet(str(tmp_path / "in"))
    a, b = (Tensor(axis, spark.readStream.schema("r int, v double").parquet(str(tmp_path / "in"))) for _ in range(2))
    both.accumulate(both.product_entries(a, b), str(tmp_path / "sums"), str(tmp_path / "checkpoint")).awaitTermination()
    assert both.accumulated(spark, str(tmp_path / "sums"), ()).df.collect()[0].v == 20.0
    assert both.accumulated(spark, str(tmp_path / "none"), ()).df.collect()[0].v == 0.0


@pytest.mark.parametrize("form", ["coo", "block"])
def test_clustered_files(spark, tmp_path, form):
    rng = np.random.default_rng(8)
    cells = {(int(i), int(r) + 1, int(q)) for i, r, q in zip(rng.integers(1, 60, 6000), rng.integers(0, 3000, 6000), rng.integers(1, 4, 6000), strict=True)}
    cells |= {(7, r, 1) for r in range(1, 2001)}  # a hot coordinate
    t = Tensor.coo(spark.createDataFrame([(*c, float(n + 1)) for n, c in enumerate(sorted(cells))], "i int, r int, q int, v double"), [Axis("i", 60), Axis("r", 2**31 - 1), Axis("q", 3)])
    t = t if form == "coo" else t.to_block(1)
    whole = {tuple(x) for x in t.to_coo().df.select("i", "r", "q", "v").collect()}
    kept = Clustered.write(t, str(tmp_path / "t"), by=["i", "r"], rows=100)
    every = kept.files()
    assert len(every) > 40 and {tuple(x) for x in kept.read().to_coo().df.select("i", "r", "q", "v").collect()} == whole
    for at, most in (({"i": 9}, 0.5), ({"i": 7}, 0.6), ({"r": (100, 130)}, 0.5), ({"i": (3, 5), "r": (1, 400)}, 0.2), ({"i": 9, "r": 17}, 0.1), ({"i": 61}, 0.0)):
        got = kept.read(**at)
        span = {c: w if isinstance(w, tuple) else (w, w) for c, w in at.items()}
        assert {tuple(x) for x in got.to_coo().df.select("i", "r", "q", "v").collect()} == {c for c in whole if all(lo <= c["ir".index(k)] <= hi for k, (lo, hi) in span.items())}
        assert len(kept.files(**at)) <= most * len(every)
        if most:
            assert len(got.df.inputFiles()) == len(kept.files(**at))
    by_i = Clustered.write(t, str(tmp_path / "hot"), by=["i"], rows=100)
    assert len(by_i.files(i=7)) > 5  # a third of all rows takes several files
    for wrong in ({"x": 1}, {"v": 1}):
        with pytest.raises(ValueError, match="coordinates"):
            kept.read(**wrong)
    empty = Clustered.write(t.__class__(t.axes, t.df.limit(0), t.n_dense), str(tmp_path / "none"))
    assert empty.read(i=1).df.count() == 0 and empty.read().df.count() == 0


def test_svd_of_long_rows_has_no_joins(spark, monkeypatch):
    """a side no longer than the width is a row's block; nothing is contracted by coordinates, whichever side it is."""
    rng = np.random.default_rng(78)
    a = rng.standard_normal((300, 6)) * (rng.random((300, 6)) < 0.5)
    a[:, 5] = a[:, 0]
    monkeypatch.setattr(spectral, "contract", None)
    monkeypatch.setattr(spectral, "NUMBERS", 128)
    for names, rows, m in (("ij", ["i"], a), ("ji", ["i"], a.T), ("ijk", ["i"], a.reshape(300, 2, 3))):
        t = make(spark, names, m)
        f = spectral.full_svd(t, rows, 8, stable=True)
        assert np.allclose(f.values, np.linalg.svd(a)[1][:5])
        assert reduce.difference(t, f.product().to_coo().permute(list(names))).first()[0] < 1e-12
        for x in (f.left, f.right):
            assert factor.isometry_defect(x, x.keys, x.tail[0].col).first()[0] < 1e-12
            assert factor.isometry_defect(x.to_coo(), x.keys, x.tail[0].col).first()[0] < 1e-12


def test_two_streams_keep_a_row_a_label(spark, tmp_path, monkeypatch):
    """the entries of a label that arrive together are one row of state, a hot label's a few, wherever the task is cut."""
    monkeypatch.setattr(both, "PACK", 50)
    monkeypatch.setattr(both, "HELD", 700)
    rng = np.random.default_rng(79)
    cells = [(i, r, float(rng.integers(1, 9))) for r in range(1, 21) for i in range(1, 31)] + [(100 + i, 3, 2.0) for i in range(400)]
    other = [(r, j, float(r - j)) for r in range(1, 21) for j in range(1, 6)]
    for name, rows, schema in (("a", cells, "i int, r int, v double"), ("b", other, "r int, j int, v double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    a, b = (Tensor(axes, spark.readStream.schema(s).parquet(str(tmp_path / n))) for n, axes, s in (("a", (Axis("i", 500), Axis("r", 20)), "i int, r int, v double"), ("b", (Axis("r", 20), Axis("j", 5)), "r int, j int, v double")))
    products = both.product_entries(a, b, salts=2)
    query = both.accumulate(products, str(tmp_path / "sums"), str(tmp_path / "checkpoint"), 3)
    query.awaitTermination()
    assert sum(o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"]) <= 19 + 9 + 2 * 20 < len(cells)
    want = np.zeros((500, 5))
    for i, r, v in cells:
        for j in range(1, 6):
            want[i - 1, j - 1] += v * (r - j)
    assert np.array_equal(array(both.accumulated(spark, str(tmp_path / "sums"), products.axes), "ij"), want)


@pytest.mark.parametrize("z", [False, True])
def test_qr_takes_rows_whole(spark, monkeypatch, z):
    """a row of Q is made of the row's entries in one step, with no table of all pairs of columns, and blocks are taken as rows."""
    rng = np.random.default_rng(80)
    a = rng.standard_normal((90, 6)) * (rng.random((90, 6)) < 0.7) + (1j * rng.standard_normal((90, 6)) if z else 0)
    a[:, 4], a[::7] = 0, 0
    a[:, 5] = a[:, 0] - a[:, 1]
    make_ = make_complex if z else make
    for t in (make_(spark, "ijc", a.reshape(9, 10, 6)), make_(spark, "ijc", a.reshape(9, 10, 6), 1)):
        rows, r, cols = factor.qr_rows(t, ["i", "j"], "c")
        got = np.zeros((90, 4), complex if z else float)
        for x in rows.collect():
            got[(x.i - 1) * 10 + x.j - 1] = np.array(x.blk).view(got.dtype)
        assert list(cols) == [1, 2, 3, 4, 6] and np.allclose(got @ r, a[:, cols - 1]) and np.allclose(got.conj().T @ got, np.eye(4))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert factor.qr_rows(Tensor.empty(spark, [Axis("i", 3), Axis("c", 3)]), ["i"], "c") is None
