"""Kernels against NumPy on small tensors, error cases, and the queries against DuckDB."""

import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.meta import Axis, sort_links, split_bra_ket
from tensorloom.operators import algebra, factor, reduce, restricted
from tensorloom.operators.contract import align_links, canonical_bonds, contract
from tensorloom.plans import network
from tensorloom.queries import ORACLE_SQL, QUERIES
from tensorloom.tensor import Tensor

SF = "/root/testdata/sf0.001"


def make(spark, names, array, n_dense=0):
    axes = [Axis(n, d) for n, d in zip(names, array.shape, strict=True)]
    rows = [(*(int(i) + 1 for i in at), float(array[at])) for at in zip(*np.nonzero(array), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", v double")
    t = Tensor.coo(df, axes, check=True)
    return t.to_block(n_dense) if n_dense else t


def array(t, names):
    t = t.to_coo()
    out = np.zeros([t.axis(n).dim for n in names])
    for row in t.df.collect():
        out[tuple(row[n] - 1 for n in names)] = row["v"]
    return out


def sparse(shape, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(-3, 4, shape) * (rng.random(shape) < 0.5)


@pytest.mark.parametrize("na,nb", itertools.product((0, 1, 2), (0, 1, 2)))
@pytest.mark.parametrize("alias", (False, True))
def test_contract_all_forms(spark, na, nb, alias):
    a, b = sparse((3, 4, 2), 1), sparse((4, 2, 3), 2)
    x, y = make(spark, "irk", a, na), make(spark, "rkj", b, nb)
    if alias and na:
        x = x.to_aliased()
    for plan in ("auto", "block"):
        assert np.array_equal(array(contract(x, y, plan=plan), "ij"), np.einsum("irk,rkj->ij", a, b))


def test_fixture_product(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (3, 2, -2.0), (2, 4, 3.0)], "i int, r int, v double")
    b = spark.createDataFrame([(1, 2, 5.0), (2, 1, -1.0), (4, 2, 2.0)], "r int, j int, v double")
    c = contract(Tensor.coo(a, [Axis("i", 3), Axis("r", 4)]), Tensor.coo(b, [Axis("r", 4), Axis("j", 2)]))
    assert {(r.i, r.j): r.v for r in c.df.collect()} == {(3, 1): 2.0, (1, 2): 5.0, (2, 2): 6.0}


def test_outer_and_strict(spark):
    a, b = sparse((3, 2), 3), sparse((2, 2), 4)
    assert np.array_equal(array(contract(make(spark, "ab", a, 1), make(spark, "cd", b, 1)), "abcd"), np.einsum("ab,cd->abcd", a, b))
    with pytest.raises(ValueError):
        contract(make(spark, "ab", a, 1), make(spark, "bc", sparse((2, 3), 5), 1), strict=True)
    with pytest.raises(ValueError):
        make(spark, "ab", a, 1).permute(["b", "a"], strict=True)


def test_layout_and_points(spark):
    a = sparse((3, 4, 2), 6)
    t = make(spark, "irk", a, 2)
    assert np.array_equal(array(t.permute(["i", "k", "r"]), "irk"), a)
    assert np.array_equal(array(t.fuse("r", "k", "f"), "if"), a.reshape(3, 8, order="F"))
    assert t.get(i=2, r=3, k=1).first()[0] == a[1, 2, 0]
    assert t.upsert(spark.createDataFrame([(1, 1, 1, 0.0)], "i int, r int, k int, v double")).get(i=1, r=1, k=1).first()[0] == 0
    assert np.array_equal(array(t.to_aliased().expand(), "irk"), a)
    with pytest.raises(ValueError):
        Tensor.coo(spark.createDataFrame([(1, 1.0), (1, 2.0)], "i int, v double"), [Axis("i", 3)], check=True)


def test_algebra(spark):
    a, b = sparse((3, 4), 7), sparse((3, 4), 8)
    x, y = make(spark, "ij", a), make(spark, "ij", b)
    assert np.array_equal(array(algebra.add(x, y), "ij"), a + b)
    assert np.array_equal(array(algebra.subtract(make(spark, "ij", a, 1), make(spark, "ij", b, 1)), "ij"), a - b)
    assert reduce.difference(x, y).first()[0] == np.abs(a - b).max()
    assert np.isclose(reduce.norm(make(spark, "ij", a, 1).to_aliased()).first()[0], np.linalg.norm(a))
    assert Tensor.empty(spark, [Axis("i", 3)]).df.count() == 0


def test_network(spark):
    p, h = sparse((3, 3), 9), sparse((3, 3), 10)
    of = lambda m: Tensor(tuple([Axis("x", 3), Axis("x", 3, 1)]), make(spark, "xy", m).df.withColumnRenamed("y", "x__p1"))
    got = network.sandwich(of(p), of(h))
    assert np.array_equal(array(got, ["x", "x__p1"]), p @ h @ p)
    assert np.isclose(network.commutator_norm(of(p), of(h)).first()[0], np.linalg.norm(p @ h - h @ p))


def test_stable_svd():
    rng = np.random.default_rng(0)
    q, w = np.linalg.qr(rng.standard_normal((6, 6)))[0], np.linalg.qr(rng.standard_normal((6, 6)))[0]
    m = q * np.array([3, 3, 1.5, 1.5, 0.7, 0.2]) @ w
    u, s, vt = factor.stable_svd(m)
    u2, s2, vt2 = factor.stable_svd(m + 1e-13 * rng.standard_normal((6, 6)))
    assert np.abs(u * s @ vt - m).max() < 1e-12 and np.abs(u - u2).max() < 1e-9 and np.abs(vt - vt2).max() < 1e-9


def test_restricted_and_meta(spark):
    t = make(spark, "prc", sparse((2, 2, 3), 11))
    n = (np.count_nonzero(array(t, "prc"), axis=2) > 1).sum()
    assert restricted.violations(t, ["p"], "r").count() == n
    assert [a.level for a in sort_links([Axis("b,l=2", 2, link=True), Axis("a,l=1", 2, link=True)])] == [1, 2]
    assert split_bra_ket([Axis("s", 2), Axis("s", 2, 1)])[1][0].plev == 1


def test_stream(spark, tmp_path):
    from tensorloom.streaming.deltas import contract_stream

    spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "i int, r int, v double").write.parquet(str(tmp_path / "in"))
    other = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0)], "r int, j int, w double")
    sums = contract_stream(spark.readStream.schema("i int, r int, v double").parquet(str(tmp_path / "in")), other, ["r"], ["i", "j"])
    sums.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sums").collect()[0].v == 31.0


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number, bool)) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


# -- complex values, the missing forms, and the fixtures of the survey


def make_complex(spark, names, array, n_dense=0):
    axes = [Axis(n, d) for n, d in zip(names, array.shape, strict=True)]
    rows_ = [(*(int(i) + 1 for i in at), float(array[at].real), float(array[at].imag)) for at in zip(*np.nonzero(array), strict=True)]
    t = Tensor.coo(spark.createDataFrame(rows_, ", ".join(f"{n} int" for n in names) + ", re double, im double"), axes, F.struct("re", "im"))
    return t.to_block(n_dense) if n_dense else t


def complex_array(t, names):
    t = t.to_coo()
    out = np.zeros([t.axis(n).dim for n in names], complex)
    for row in t.df.collect():
        out[tuple(row[n] - 1 for n in names)] = complex(row["v"]["re"], row["v"]["im"])
    return out


@pytest.mark.parametrize("na,nb", ((0, 0), (1, 1), (2, 1), (1, 2)))
@pytest.mark.parametrize("alias", (False, True))
def test_complex_forms(spark, na, nb, alias):
    a, b = sparse((3, 4, 2), 21) + 1j * sparse((3, 4, 2), 22), sparse((4, 2, 3), 23) - 1j * sparse((4, 2, 3), 24)
    x, y = make_complex(spark, "irk", a, na), make_complex(spark, "rkj", b, nb)
    x = x.to_aliased() if alias and na else x
    for plan in ("auto", "block"):
        assert np.allclose(complex_array(contract(x, y, plan=plan), "ij"), np.einsum("irk,rkj->ij", a, b))
    assert np.allclose(complex_array(algebra.conjugate(x), "irk"), a.conj())
    assert np.allclose(complex_array(x * 2j, "irk"), 2j * a)
    assert np.isclose(reduce.norm(x).first()[0], np.linalg.norm(a)) and np.isclose(reduce.max_abs(x).first()[0], np.abs(a).max())
    got = x.get(i=1, r=2, k=1).first()[0]
    assert complex(got.re, got.im) == a[0, 1, 0]
    # a real operand becomes complex
    c = sparse((4, 2, 3), 25)
    assert np.allclose(complex_array(x @ make(spark, "rkj", c, nb), "ij"), np.einsum("irk,rkj->ij", a, c))


def test_complex_dense_clean_difference(spark):
    a = np.array([[1 + 1e-13j, 0.5j + 1e-12], [0, -1j + 1e-14]])
    t = make_complex(spark, "xy", a)
    assert np.array_equal(complex_array(algebra.clean(t), "xy"), [[1, 0.5j], [0, -1j]])
    dense = {(r.x, r.y): complex(r.v.re, r.v.im) for r in make_complex(spark, "xy", a, 1).to_dense(fill=7j).collect()}
    assert dense[2, 1] == 7j and dense[1, 1] == a[0, 0]
    b = np.array([[1, 0], [3j, 0]])
    assert np.isclose(reduce.difference(t, make_complex(spark, "xy", b)).first()[0], np.abs(a - b).max())
    assert np.allclose(complex_array(algebra.add(t, make_complex(spark, "xy", b, 1)), "xy"), a + b)
    with pytest.raises(ValueError):
        t.retype("double")


def test_axes_named_x_and_y(spark):
    a, b = sparse((3, 3), 31), sparse((3, 3), 32)
    x, y = make(spark, "xy", a), make(spark, "xy", b)
    assert reduce.difference(x, y).first()[0] == np.abs(a - b).max()
    assert np.array_equal(array(algebra.zip_map(x, y, lambda p, q: p * p - q), "xy"), a * a - b)
    with pytest.raises(Exception, match="patterns differ"):
        algebra.zip_map(x, y, lambda p, q: p, same_pattern=True).df.collect()


@pytest.mark.parametrize("size", (3, 70))
def test_repeated_coordinates_are_summed(spark, size):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, size, 3.0), (2, 2, 4.0), (2, 2, -4.0)], "i int, j int, v double")
    t = Tensor((Axis("i", 2), Axis("j", size)), df).to_block(1)
    blocks = {r.i: r.blk for r in t.df.collect()}
    assert blocks[1][0] == 3.0 and blocks[1][-1] == 3.0 and not any(blocks[2]) and len(blocks[1]) == size


def test_block_loading(spark):
    a = np.zeros((4, 3))
    a[0], a[2, 1] = [5.0, 0.1, 0], 0.2
    t = make(spark, "ij", a)
    assert {r.i for r in t.to_block(1, rtol=0.1).df.collect()} == {1} and {r.i for r in t.to_block(1, keep=0.15).df.collect()} == {1, 3}
    whole = t.to_block(1, all_blocks=True)
    assert whole.is_dense() and not t.to_block(1).is_dense() and np.array_equal(array(whole, "ij"), a)


def test_api(spark):
    a, b = sparse((3, 4), 41), sparse((4, 2), 42)
    x, y = make(spark, "ir", a), make(spark, "rj", b)
    assert np.array_equal(array(x @ y, "ij"), a @ b) and np.array_equal(array(x * y, "ij"), a @ b)
    assert np.array_equal(array(3 * x - x + x, "ir"), 3 * a)
    for form in ("coo", "block", "aliased"):
        assert contract(make(spark, "ir", a, 1), make(spark, "rj", b, 1), form=form).form == form
    assert [r.i for r in x.sorted(["i", "r"]).collect()] == sorted(r.i for r in x.df.collect())
    s, l1, l2 = Axis("s", 2), Axis("u,l=1", 2, link=True), Axis("u,l=2", 2, link=True)
    df = spark.createDataFrame([(1, 1, 1, 2, 2.0)], "s int, s__p1 int, u_l_1 int, u_l_2 int, v double")
    t = Tensor.load(df, [l2, s.primed(1), l1, s], "block", ["u,l=1"])
    assert [x.col for x in t.axes] == ["s", "s__p1", "u_l_2", "u_l_1"] and t.form == "block" and t.n_dense == 1
    assert [x.name for x in sort_links([l2, l1], by="id")] == ["u,l=1", "u,l=2"] and l2.key == "u,l=2'0:2" and Axis("s,n=3", 2).site == 3
    assert t.setprime(4, ["u,l=2"]).axis("u,l=2").plev == 4
    assert x.prime(2).replaceprime(2, 5).noprime().axes == x.axes
    for form, n in (("coo", 0), ("block", 1), ("aliased", 1)):
        e = Tensor.empty(spark, [Axis("r", 4), Axis("q", 2)], n, form)
        assert e.form == form and (x @ e).to_coo().df.count() == 0
    with pytest.raises(Exception, match="beyond byte"):
        Tensor((Axis("i", 100),), spark.createDataFrame([(300, 1.0)], "i int, v double")).rekey("byte").df.collect()
    with pytest.raises(Exception, match="exactly"):
        Tensor(x.axes, x.df.withColumn("v", F.lit(0.5))).retype("int").df.collect()


def test_dense_merges_links(spark):
    u = [Axis("u", 2, link=True), Axis("w", 3, link=True)]
    a = sparse((2, 3), 51)
    t = make(spark, "uw", a)
    t = Tensor(tuple(u), t.df)
    flat = {r[0]: r.v for r in t.to_dense(merges=[("u", "w")]).collect()}
    assert [flat[i + 1] for i in range(6)] == a.reshape(-1, order="F").tolist()


def test_align_links(spark):
    a = sparse((2, 2, 3), 61)
    df = make(spark, "spq", a).df
    t = Tensor((Axis("s", 2), Axis("p", 2, link=True), Axis("q", 3, link=True)), df)
    target = Tensor((Axis("s", 2), Axis("big", 6, link=True)), df.limit(0))
    got = align_links(target, t)
    assert np.array_equal(array(got, ["s", "big"]), a.reshape(2, 6, order="F"))
    same = Tensor((Axis("s", 2), Axis("p", 2, 1, link=True), Axis("q", 3, link=True)), df)
    assert [x.label for x in align_links(same, t).axes] == [("s", 0), ("p", 1), ("q", 0)]
    with pytest.raises(ValueError):
        align_links(Tensor((Axis("big", 5, link=True),), df), t)


def test_canonical_bonds(spark):
    a = sparse((2, 2, 2, 2), 62)
    t = Tensor((Axis("s", 2), Axis("a,l=1", 2, link=True), Axis("b,l=1", 2, link=True), Axis("r", 2)), make(spark, "sabr", a).df.toDF("s", "a_l_1", "b_l_1", "r", "v"))
    catalog: dict = {}
    one = canonical_bonds(t, catalog, ["a,l=1"], ["b,l=1"])
    two = canonical_bonds(t, catalog, ["a,l=1"], ["b,l=1"])
    assert len(catalog) == 1 and one.axes == two.axes
    assert np.array_equal(array(one, [x.col for x in one.axes]), a.reshape(2, 4, 2, order="F"))


def test_restricted_round_trip(spark):
    a = np.zeros((2, 2, 2, 3))
    a[0, 0, 0, 2], a[1, 1, 0, 0], a[1, 1, 1, 1] = 4, 5, -6
    t = make(spark, "abrc", a)
    slim = restricted.to_restricted(t, ["a", "b"], "r", "c", [("a", "b")])
    assert slim.columns == ["a", "r", "sel", "val"] and slim.count() == 3
    assert np.array_equal(array(restricted.from_restricted(slim, t, ["a", "b"], "r", "c", [("a", "b")]), "abrc"), a)
    assert restricted.prefix_states(t, ["a", "b"], [("a", "b")]) == 2
    with pytest.raises(ValueError):
        restricted.to_restricted(make(spark, "abrc", np.ones((2, 2, 2, 3))), ["a", "b"], "r", "c")


def entries(spark, names, dims, rows_, n_dense=0):
    a = np.zeros(dims)
    for *at, v in rows_:
        a[tuple(i - 1 for i in at)] = v
    return make(spark, names, a, n_dense), a


#: id: (names, dims, dense axes, entries) of both operands, and the result's axes
FIXTURES = {
    "C2": (("abr", (2, 3, 4), 0, [(1, 1, 1, 2), (2, 3, 2, -1), (1, 2, 4, 3.5)]), ("rcd", (4, 2, 2), 0, [(1, 1, 2, 7), (2, 2, 1, -2), (4, 1, 1, 1)]), "abcd"),
    "C3": (("ir", (3, 4), 0, [(1, 1, 2), (3, 2, -1), (2, 4, 0.5)]), ("rjk", (4, 2, 3), 2, [(1, 1, 2, 7), (2, 2, 1, -2), (4, 1, 3, 1)]), "ijk"),
    "C4": (("ri", (4, 3), 0, [(1, 1, 2), (2, 3, -1), (4, 2, 0.5)]), ("rjk", (4, 2, 2), 2, [(1, 1, 2, 7), (2, 2, 1, -2)]), "ijk"),
    "C5": (("ir", (3, 4), 0, [(1, 1, 2), (3, 2, -1), (2, 4, 0.5)]), ("jxr", (2, 3, 4), 2, [(1, 1, 1, 7), (2, 2, 2, -2), (1, 3, 4, 1)]), "ijx"),
    "C6": (("ir", (2, 3), 0, [(1, 1, 1), (2, 3, -2)]), ("jrx", (3, 3, 2), 2, [(1, 1, 1, 4), (2, 2, 2, 5), (3, 3, 1, -1)]), "ijx"),
    "C7": (("ir", (3, 4), 0, [(1, 1, 2), (3, 2, -1), (2, 4, 0.5)]), ("xr", (5, 4), 2, [(2, 1, 7), (5, 2, -2), (1, 4, 1)]), "ix"),
    "C8": (("pir", (2, 3, 4), 0, [(1, 1, 1, 2), (2, 3, 2, -1), (1, 2, 4, 0.5)]), ("yxr", (3, 2, 4), 3, [(1, 2, 1, 7), (3, 1, 2, -2), (2, 2, 4, 1)]), "piyx"),
    "C9": (("ir", (3, 4), 0, [(2, 3, 1)]), ("xr", (5, 4), 2, [(1, 1, 2)]), "ix"),
    "C10": (("irx", (3, 4, 2), 1, [(1, 1, 1, 2), (2, 1, 2, -1), (3, 3, 1, 0.5), (1, 4, 2, 1.5)]), ("jry", (2, 4, 3), 1, [(1, 1, 2, 7), (2, 1, 1, -2), (2, 3, 3, 1), (1, 4, 1, 0.25)]), "ijxy"),
    "C11": (("par", (2, 4, 3), 2, [(1, 1, 1, 2), (2, 3, 2, -1), (1, 4, 3, 0.5)]), ("qbr", (3, 5, 3), 2, [(1, 2, 1, 7), (3, 5, 2, -2), (2, 1, 3, 1)]), "pqab"),
    "C12": (
        ("irsabkl", (2,) * 7, 4, [(1, 1, 1, 1, 2, 1, 2, 2), (1, 2, 1, 2, 1, 2, 1, -1), (2, 1, 2, 1, 1, 2, 2, 0.5), (2, 2, 2, 2, 2, 1, 1, 1.5)]),
        ("jrsklx", (3, 2, 2, 2, 2, 2), 3, [(1, 1, 1, 1, 2, 2, 7), (1, 2, 1, 2, 1, 1, -2), (3, 1, 2, 2, 2, 2, 1), (2, 2, 2, 1, 1, 1, 0.25)]), "ijabx",
    ),
    "C14": (("irx", (3, 4, 2), 1, [(1, 1, 1, 2), (2, 1, 2, -1), (3, 3, 1, 0.5), (1, 4, 2, 1.5)]), ("jry", (2, 4, 3), 3, [(1, 1, 2, 7), (2, 1, 1, -2), (2, 3, 3, 1)]), "ixjy"),
}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixtures(spark, name):
    left, right, names = FIXTURES[name]
    (x, a), (y, b) = (entries(spark, n, d, e, k) for n, d, k, e in (left, right))
    for plan in ("auto", "block"):
        assert np.allclose(array(contract(x, y, plan=plan), names), np.einsum(f"{left[0]},{right[0]}->{names}", a, b))


def test_precision_and_large_blocks(spark):
    """C15, and blocks heavy enough for NumPy and wide enough for sums by place."""
    rng = np.random.default_rng(42)
    for shape, other in (((4, 3, 4), (3, 3)), ((8, 6, 8), (6, 6)), ((2, 40, 30), (30, 40))):
        a, b = 50 * rng.standard_normal(shape), rng.standard_normal(other)
        inner = shape[1] == other[0]
        names, spelled = ("lrd", "rb", "ldb") if inner else ("lcr", "rb", "lcb"), None
        spelled = f"{names[0]},{names[1]}->{names[2]}"
        for na, nb in ((1, 1), (2, 2)):
            got = contract(make(spark, names[0], a, na), make(spark, names[1], b, nb), plan="block")
            assert np.abs(array(got, names[2]) - np.einsum(spelled, a, b)).max() < 1e-11


def test_exact_sums(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(5000) * 10.0 ** rng.integers(-200, 200, 5000), [1e300, 1.0, -1e300, 5e-324]])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)], "g int, v double")
    import math

    from tensorloom.functions import blocks as B

    assert {r.g: r.v for r in B.exact_sums(df, ["g"], "v").collect()} == {g: math.fsum(x[g::3]) for g in range(3)}
    t = Tensor((Axis("g", 3),), df.withColumn("g", F.col("g") + 1))
    assert {r.g: r.v for r in reduce.exact_total(t, ["g"]).collect()} == {g + 1: math.fsum(x[g::3]) for g in range(3)}


def svd_matrix(values, seed):
    rng = np.random.default_rng(seed)
    q, w = np.linalg.qr(rng.standard_normal((6, 6)))[0], np.linalg.qr(rng.standard_normal((6, 6)))[0]
    return q, np.array(values), w


@pytest.mark.parametrize("values", ([3, 3, 1.5, 1.5, 0.7, 0.2], [3, 3, 1.5, 0.7, 0.7, 0.7], [3, 3 + 1e-13, 1.5, 1.5 - 1e-13, 0.7, 0.2], [3, 2.4, 1.7, 1.1, 0.6, 0.2]))
def test_stable_svd_fixtures(values):
    """F1 to F4: the result doesn't depend on the basis of equal singular values, on either side."""
    q, s, w = svd_matrix(values, 12)
    rng = np.random.default_rng(13)
    for m in (q * s @ w, (q * s @ w).T):
        u, sv, vt = factor.stable_svd(m)
        u2, sv2, vt2 = factor.stable_svd(m + 1e-13 * rng.standard_normal((6, 6)))
        assert np.abs(u * sv @ vt - m).max() < 1e-12 and np.abs(sv - sv2).max() < 1e-12
        assert np.abs(u - u2).max() < 1e-9 and np.abs(vt - vt2).max() < 1e-9


def test_truncation_rule(spark):
    values = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 0.0)], "label int, k int, sv double")
    kept = lambda **o: sorted(r.sv for r in factor.truncate(values, "label", **o)[0].collect())
    assert kept(cutoff=0.5) == [1.0, 2.0] and kept(cutoff=0.0) == [0.0, 1.0, 2.0]
    assert kept(maxdim=1, mindim=2) == [2.0] and kept(cutoff=0.9, mindim=2) == [1.0, 2.0]


@pytest.mark.parametrize("ortho", ("left", "right"))
def test_block_svd(spark, ortho):
    a = np.random.default_rng(14).standard_normal((2, 3, 2, 2)) * (np.random.default_rng(15).random((2, 3, 1, 1)) < 0.8)
    t = make(spark, "lrsq", a, 2)
    u, w, sv, discarded = factor.block_svd(t, ortho=ortho)
    assert np.allclose(array(contract(u, w), "lrsq"), a) and discarded.first()[0] == 0
    if ortho == "left":
        assert factor.isometry_defect(u, ["l", "s"], "bond").first()[0] < 1e-12
    else:  # sectors share right axes, so only the rows of one sector are orthogonal
        rows_, sector = array(w, ["bond", "r", "q"]).reshape(-1, 6), np.abs(array(u, ["l", "bond", "s"])).sum(axis=2).argmax(axis=0)
        assert np.allclose((rows_ @ rows_.T)[sector[:, None] == sector], np.eye(len(rows_))[sector[:, None] == sector])
    assert sorted(r.bond for r in sv.collect()) == list(range(1, u.axis("bond").dim + 1))


def test_qr_of_dependent_columns(spark):
    a = np.random.default_rng(16).standard_normal((30, 3))
    a = np.concatenate([a, a[:, :1] + a[:, 1:2], np.zeros((30, 1))], axis=1)
    t = make(spark, "rc", a)
    q, r = factor.left_qr(t, ["r"], "c")
    qa, ra = np.zeros((30, 3)), np.zeros((3, 5))
    for x in q.collect():
        qa[x.r - 1, x.q - 1] = x.v
    for x in r.collect():
        ra[x.q - 1, x.c - 1] = x.v
    assert np.allclose(qa @ ra, a) and np.allclose(qa.T @ qa, np.eye(3)) and np.allclose(np.tril(ra[:, :3], -1), 0) and (np.diag(ra) > 0).all()


@pytest.mark.parametrize("ortho", ("left", "right"))
def test_complex_block_svd(spark, ortho):
    rng = np.random.default_rng(17)
    a = (rng.standard_normal((2, 3, 2, 2)) + 1j * rng.standard_normal((2, 3, 2, 2))) * (rng.random((2, 3, 1, 1)) < 0.8)
    u, w, sv, discarded = factor.block_svd(make_complex(spark, "lrsq", a, 2), ortho=ortho)
    assert np.allclose(complex_array(contract(u, w), "lrsq"), a) and discarded.first()[0] == 0
    want = np.concatenate([np.linalg.svd(x.transpose(1, 0, 2).reshape(2, 6), compute_uv=False) for x in a])
    assert np.allclose(sorted(r.sv for r in sv.collect()), sorted(want))
    if ortho == "left":
        assert factor.isometry_defect(u, ["l", "s"], "bond").first()[0] < 1e-12
    values = factor.sector_svd(make_complex(spark, "lsq", a[:, 0]), "l", "s", "q").collect()
    number = lambda xs: np.array([complex(x.re, x.im) for x in xs])
    for one in range(2):
        back = sum((r.sv * np.outer(number(r.u), number(r.vt)) for r in values if r.l == one + 1), np.zeros((2, 2)))
        assert np.allclose(back, a[one, 0])


def test_complex_qr(spark):
    rng = np.random.default_rng(18)
    a = rng.standard_normal((30, 3)) + 1j * rng.standard_normal((30, 3))
    a = np.concatenate([a, a[:, :1] - 2j * a[:, 1:2], np.zeros((30, 1))], axis=1)
    q, r = factor.left_qr(make_complex(spark, "rc", a), ["r"], "c")
    qt = Tensor((Axis("r", 30), Axis("q", 3)), q)
    qa, ra = complex_array(qt, "rq"), complex_array(Tensor((Axis("q", 3), Axis("c", 5)), r), "qc")
    assert np.allclose(qa @ ra, a) and np.allclose(qa.conj().T @ qa, np.eye(3)) and np.allclose(np.tril(ra[:, :3], -1), 0)
    assert np.allclose(np.diag(ra).imag, 0) and (np.diag(ra).real > 0).all() and factor.isometry_defect(qt, ["r"], "q").first()[0] < 1e-12


def test_complex_stable_svd_and_power(spark):
    rng = np.random.default_rng(19)
    unitary = lambda: np.linalg.qr(rng.standard_normal((6, 6)) + 1j * rng.standard_normal((6, 6)))[0]
    m = unitary() * np.array([3, 3, 1.5, 1.5, 0.7, 0.2]) @ unitary()
    u, sv, vt = factor.stable_svd(m)
    u2, _, vt2 = factor.stable_svd(m + 1e-13 * rng.standard_normal((6, 6)))
    assert np.abs(u * sv @ vt - m).max() < 1e-12 and np.abs(u - u2).max() < 1e-9 and np.abs(vt - vt2).max() < 1e-9
    h = np.array([[2, 1j], [-1j, 2]])  # eigenvalues 1 and 3
    assert abs(factor.power_iteration(make_complex(spark, "xy", h), "x", "y", 10) - 3) < 1e-3


def plaquette(spark, n=1):
    """P2 and P3: spin-1 operators of 2 n + 2 sites as coordinates; for n = 1 the operators are 81 x 81."""
    sx = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]]) / np.sqrt(2)
    sy = np.array([[0, -1j, 0], [1j, 0, -1j], [0, 1j, 0]]) / np.sqrt(2)
    sz = np.diag([1.0, 0, -1])

    def turned(m):  # exp(i pi m) for eigenvalues 1, 0, -1
        return np.eye(3) - 2 * m @ m

    def at(**ops):
        out = np.eye(1)
        for site in range(1, 2 * n + 3):
            out = np.kron(out, ops.get(f"s{site}", np.eye(3)))
        return out

    h = sum(at(**{f"s{2 * j - 1}": sz, f"s{2 * j}": sz}) for j in range(1, n + 2))
    h = h + sum(at(**{f"s{2 * j - 1}": sx, f"s{2 * j + 2}": sx}) + at(**{f"s{2 * j}": sy, f"s{2 * j + 1}": sy}) for j in range(1, n + 1))
    p = (at() + at(s1=turned(sy), s2=turned(sx), s3=turned(sx), s4=turned(sy))) / 2
    of = lambda m: Tensor((Axis("x", 81), Axis("x", 81, 1)), make_complex(spark, "xy", m).df.withColumnRenamed("y", "x__p1"))
    return p, h, of(p), of(h)


def test_plaquette(spark):
    """P4 and P5: the projected operator and the energy of a projected state, sparse and dense."""
    p, h, sp, sh = plaquette(spark)
    assert np.allclose(p @ p, p)
    got = network.sandwich(sp, sh)
    assert np.abs(complex_array(algebra.clean(got), ["x", "x__p1"]) - p @ h @ p).max() < 1e-12
    assert network.hermiticity(got).first()[0] < 1e-12
    assert network.check_commute(sp, sh) == (np.linalg.norm(p @ h - h @ p) <= 1e-10)
    rng = np.random.default_rng(42)
    state = p @ (rng.standard_normal(81) + 1j * rng.standard_normal(81))
    state /= np.linalg.norm(state)
    s = make_complex(spark, "x", state)
    v = network.expectation(s, sh).first()[0]
    assert abs(complex(v.re, v.im) - state.conj() @ h @ state) < 1e-12
    assert np.isclose(network.overlap(s, s).first()[0], 1.0)
    assert np.isclose(reduce.max_norm([sp, sh]).first()[0], max(np.linalg.norm(p), np.linalg.norm(h)))
    assert network.first_difference([(sp, sp), (sp, sh)], 1e-12) == 1


def test_windowed_stream(spark, tmp_path):
    from tensorloom.streaming.deltas import windowed

    rows_ = [("2024-01-01 00:00:01", 1, 2.0), ("2024-01-01 00:00:09", 1, 3.0), ("2024-01-01 00:00:11", 1, 4.0)]
    spark.createDataFrame(rows_, "t string, i int, v double").selectExpr("timestamp(t) as t", "i", "v").write.parquet(str(tmp_path / "in"))
    sums = windowed(spark.readStream.schema("t timestamp, i int, v double").parquet(str(tmp_path / "in")), "t", "10 seconds", "5 seconds", ["i"])
    sums.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.table("windows").collect()) == [4.0, 5.0]
