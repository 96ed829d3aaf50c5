"""Contractions by labels: an equi-join on shared labels and a grouped sum over the rest.

Catalyst picks the join: a side under the session's broadcast threshold is broadcast, others are sort-merge joined. Labels that
are hot can be spread over tasks, and operands without a shared sparse label meet in a grid (see operators/meet.py). Blocks
stay blocks where the shared axes allow it; an axis that is prefix on one side and tail on the other is exploded first.
Aliased operands compute each pair of templates once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions import blocks as B
from tensorloom.meta import Axis, output_axes, shared, size
from tensorloom.operators.meet import met
from tensorloom.sources.shared import written
from tensorloom.tensor import Tensor, _one_row, made_of


def contract(a: Tensor, b: Tensor, keep: list[str] = (), strict: bool = False, plan: str = "auto", form: str | None = None, spread: int | None = None, exact: bool = False) -> Tensor:
    """Sum over all labels that a and b share, except those to keep (batch labels); without any, the outer product.

    plan: "element" joins coordinates on all shared labels, so nothing is paired that doesn't meet; "block" multiplies whole
    blocks; "auto" takes coordinates where both blocks were made of them and a product is small. form: the result's.
    spread: labels with more stored rows than that on a side are split over tasks. exact: real doubles are multiplied and summed
    without any rounding but one at the end, by coordinates. A result without axes has one row, zero too.
    """
    common = shared(a.axes, b.axes)
    if a.is_complex != b.is_complex:
        a, b = a.as_complex(), b.as_complex()
    if exact:
        out = _exactly(a, b, common, keep, spread)
    elif "aliased" in (a.form, b.form) and not keep:
        out = _aliased(a, b, common, strict, spread)
    elif "block" in (a.form, b.form) and not keep:
        if plan == "element" or plan == "auto" and _known(a) and _known(b) and _work(a, b, common) < B.HEAVY:
            out = _by_elements(a, b, common, strict, spread)
        else:
            out = _blocks(a.expand(), b.expand(), common, strict, spread)
    else:
        out = _elements(a.to_coo(), b.to_coo(), common, keep, spread)
    if not out.axes:
        t = out.to_coo()
        out = Tensor((), _one_row(t.df, t.kind))
    return out if form is None else out.converted(form)


def _known(t: Tensor) -> bool:
    return t.form == "coo" or bool(t.origin) and t.origin[0] is t.df and t.origin[1].axes == t.axes


def _tails(a: Tensor, b: Tensor, common: list[Axis]) -> list[Axis]:
    labels = {x.label for x in common}
    return [x for t in (a, b) for x in t.tail if x.label not in labels]


def _work(a: Tensor, b: Tensor, common: list[Axis]) -> int:
    """Multiplications of a product of blocks."""
    inner = {x.label for x in common} & {x.label for x in a.tail} & {x.label for x in b.tail}
    return size(_tails(a, b, common)) * size([x for x in a.tail if x.label in inner])


def _crossing(a: Tensor, b: Tensor, common: list[Axis]) -> set:
    return {x.label for x in common if (x.label in {y.label for y in a.tail}) != (x.label in {y.label for y in b.tail})}


def _by_elements(a: Tensor, b: Tensor, common: list[Axis], strict: bool, spread: int | None) -> Tensor:
    if strict and _crossing(a, b, common):
        raise ValueError("a shared axis is prefix on one side and tail on the other")
    tail = _tails(a, b, common)
    out = _elements(a.to_coo(), b.to_coo(), common, (), spread)
    axes = output_axes([x for x in out.axes if x not in tail], tail)
    return out.permute([x.col for x in axes]).to_block(len(tail))


def _pairs(a: Tensor, b: Tensor, common: list[Axis], keep, spread: int | None) -> tuple[tuple[Axis, ...], DataFrame]:
    """The result's axes, and the rows that meet with both values."""
    on = [x.col for x in common]
    reduced = {x.label for x in common if x.col not in keep}
    axes = output_axes([x for x in a.axes if x.label not in reduced] + [x for x in b.axes if x.label not in {y.label for y in common}], [])
    left, right = a.df.withColumnRenamed("v", "__va"), b.df.withColumnRenamed("v", "__vb")
    return axes, met(left, right, on, spread, (size(a.axes), size(b.axes)), made_of(a, b))


def _exactly(a: Tensor, b: Tensor, common: list[Axis], keep, spread: int | None) -> Tensor:
    """Each product becomes two doubles whose sum it is, and these are summed exactly: rounded once, in whatever order."""
    if a.is_complex:
        raise ValueError("exact contractions take real values")
    n = len(_tails(a, b, common))
    axes, joined = _pairs(a.to_coo(), b.to_coo(), common, keep, spread)
    cols = [x.col for x in axes]
    both = F.explode(F.array(*B.two_product(F.col("__va").cast("double"), F.col("__vb").cast("double"))))
    out = Tensor(axes, B.exact_sums(joined.select(*cols, both.alias("__v")), cols, "__v")).pruned()
    return out.to_block(n) if n and "coo" not in (a.form, b.form) and axes[-n:] == tuple(_tails(a, b, common)) else out


def _elements(a: Tensor, b: Tensor, common: list[Axis], keep, spread: int | None) -> Tensor:
    axes, joined = _pairs(a, b, common, keep, spread)
    cols = [x.col for x in axes]
    # a complex product is made once, before its parts are summed
    made = joined.select(*cols, B.mul(F.col("__va"), F.col("__vb"), a.is_complex).alias("__v"))
    return Tensor(axes, made.groupBy(*cols).agg(B.total(F.col("__v"), a.is_complex).alias("v"))).pruned()


def _lift(t: Tensor, axes: list[Axis]) -> Tensor:
    """Tail axes become prefix axes: each block is cut into its slices."""
    axes = [x for x in axes if x in t.tail]
    for x in axes:
        t = t.permute([y.col for y in t.axes if y != x] + [x.col])
        step = t.blksize // x.dim
        index = F.explode(F.sequence(F.lit(1), F.lit(x.dim))).alias(x.col)
        cut = t.df.select("*", index).withColumn("blk", F.slice("blk", (F.col(x.col) - 1) * step + 1, step))
        t = replace(t, axes=(*t.prefix, x, *t.tail[:-1]), n_dense=t.n_dense - 1, df=cut.where(B.nonzero(F.col("blk"), t.is_complex)).select(*t.keys, x.col, "blk"))
    return t


def _as_block(t: Tensor) -> Tensor:
    return t if t.form != "coo" else replace(t, df=t.df.select(*t.keys, F.array("v").alias("blk")))


def _align(a: Tensor, b: Tensor, common: list[Axis], strict: bool):
    """Both operands with each shared axis in both prefixes or in both tails; the tails as (own, shared) and (shared, own)."""
    names = _crossing(a, b, common)
    if names and strict:
        raise ValueError("a shared axis is prefix on one side and tail on the other")
    a, b = (_lift(_as_block(t), [x for x in t.tail if x.label in names]) for t in (a, b))
    inner = [x for x in a.tail if x.label in {y.label for y in common}]
    labels = {x.label for x in inner}
    own_a, own_b = ([x for x in t.tail if x.label not in labels] for t in (a, b))
    if inner:
        a = a.permute([x.col for x in (*a.prefix, *own_a, *inner)])
        b = b.permute([x.col for x in (*b.prefix, *inner, *own_b)])
    on = [x.col for x in a.prefix if x.label in {y.label for y in common}]
    keep = [x for x in (*a.prefix, *b.prefix) if x.col not in on]
    return a, b, on, keep, own_a, own_b, inner


def _product(df: DataFrame, left: str, right: str, own_a, own_b, inner) -> DataFrame:
    """df with column blk: the product of the blocks left and right, whose columns go."""
    m, k, n = size(own_a), size(inner), size(own_b)
    if inner and m * k * n >= B.HEAVY and df.schema[left].dataType.elementType.simpleString() == "double":
        return B.gemm_arrow(df, left, right, "blk", m, k, n)
    a, b, kind = F.col(left), F.col(right), df.schema[left].dataType.elementType
    z = isinstance(kind, T.StructType)
    if inner:
        blk = B.gemm(a, b, m, k, n, kind)
    elif m == 1:
        blk = B.scale(b, F.get(a, F.lit(0)), z)
    else:
        blk = B.outer(a, b, z)
    return df.withColumn("blk", blk).drop(left, right)


def _blocks(a: Tensor, b: Tensor, common: list[Axis], strict: bool, spread: int | None = None) -> Tensor:
    a, b, on, keep, own_a, own_b, inner = _align(a, b, common, strict)
    left, right = a.df.withColumnRenamed("blk", "ba"), b.df.withColumnRenamed("blk", "bb")
    joined = met(left, right, on, spread, (size(a.axes), size(b.axes)), made_of(a, b))
    axes = output_axes(keep, [*own_a, *own_b])
    keys = [x.col for x in axes[: len(keep)]]
    made = _product(joined.select(*keys, "ba", "bb"), "ba", "bb", own_a, own_b, inner)
    return Tensor(axes, B.sum_blocks(made, keys, "blk", size([*own_a, *own_b])), len(own_a) + len(own_b))


def _aliased(a: Tensor, b: Tensor, common: list[Axis], strict: bool, spread: int | None = None) -> Tensor:
    """Join the narrow block tables, multiply each distinct pair of templates once, sum scalars of one template, and make an
    own template where a key has several."""
    labels = {x.label for x in common}
    if _crossing(a, b, common):
        if strict:
            raise ValueError("a shared axis is prefix on one side and tail on the other")
        return _blocks(a.expand(), b.expand(), common, strict, spread).to_aliased()
    a, b = (_as_block(t).to_aliased() for t in (a, b))
    inner = [x for x in a.tail if x.label in labels]
    own_a, own_b = ([x for x in t.tail if x.label not in labels] for t in (a, b))
    if inner:
        a = a.permute([x.col for x in (*a.prefix, *own_a, *inner)])
        b = b.permute([x.col for x in (*b.prefix, *inner, *own_b)])
    on = [x.col for x in a.prefix if x.label in labels]
    keep = [x for x in (*a.prefix, *b.prefix) if x.col not in on]
    axes = output_axes(keep, [*own_a, *own_b])
    keys = [x.col for x in axes[: len(keep)]]
    z = a.is_complex
    left, right = (t.df.withColumnsRenamed({"tid": f"t{s}", "alpha": f"x{s}"}) for t, s in ((a, "a"), (b, "b")))
    joined = met(left, right, on, spread)
    joined = joined.select(*keys, "ta", "tb", B.mul(F.col("xa"), F.col("xb"), z).alias("x"))
    level = joined.groupBy(*keys, "ta", "tb").agg(B.total(F.col("x"), z).alias("alpha")).where(B.present(F.col("alpha"), z))
    # both are read by several of the steps below, and again by whatever the result is joined with
    level = written(level.withColumn("tid", B.identity("ta", "tb")), "level")
    pairs = level.select("tid", "ta", "tb").distinct()
    with_a = pairs.join(a.templates.select(F.col("tid").alias("ta"), F.col("blk").alias("ba")), "ta")
    with_b = with_a.join(b.templates.select(F.col("tid").alias("tb"), F.col("blk").alias("bb")), "tb")
    made = written(_product(with_b.select("tid", "ba", "bb"), "ba", "bb", own_a, own_b, inner).where(B.nonzero(F.col("blk"), z)), "made")
    level = level.join(made.select("tid"), "tid", "left_semi")
    if keys:
        counts = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        level = level.join(counts, keys)
    else:
        level = level.crossJoin(level.agg(F.count(F.lit(1)).alias("__n")))
    shared_rows = level.where("__n = 1").select(*keys, "tid", "alpha")
    mixed = level.where("__n > 1").join(made, "tid").select(*keys, B.scale(F.col("blk"), F.col("alpha"), z).alias("blk"))
    n = size([*own_a, *own_b])
    own = B.sum_blocks(mixed, keys, "blk", n).withColumn("tid", F.concat(F.lit("own:"), B.identity(*keys, "blk")))
    one = B.number(1, True) if z else F.lit(1).cast(level.schema["alpha"].dataType)
    df = shared_rows.unionByName(own.select(*keys, "tid", one.alias("alpha")))
    templates = made.join(shared_rows.select("tid").distinct(), "tid", "left_semi").select("tid", "blk").unionByName(own.select("tid", "blk"))
    return Tensor(axes, df, len(own_a) + len(own_b), templates)


def contract_and_fuse(a: Tensor, b: Tensor, bonds: dict[str, tuple[str, str]], catalog: dict[tuple[str, str], str] | None = None) -> Tensor:
    """Contract, then fuse each pair of bond axes under its name; the catalog gives neighbours the same name for a pair."""
    out = contract(a, b)
    for name, (x, y) in bonds.items():
        named = catalog.setdefault((x, y), name) if catalog is not None else name
        out = out.fuse(x, y, named)
    return out


def canonical_bonds(t: Tensor, catalog: dict[tuple, str], left: list[str], right: list[str]) -> Tensor:
    """Fuse each link of `left` with the link of `right` of the same level and region (prefix or tail), under one name.

    The name is created once for (left link, right link, region) and looked up by the neighbour that shares the bond. A link
    without a partner in its region meets the partner of its level in the other one, through coordinates.
    """
    for x in sorted((t.axis(n) for n in left), key=lambda x: (x.level is None, x.level or 0)):
        others = [t.axis(n) for n in right if any(n in (y.col, y.name) for y in t.axes)]
        others = [y for y in others if y.level == x.level]
        if not others:
            continue
        y = min(others, key=lambda y: (y in t.tail) != (x in t.tail))
        region = "tail" if x in t.tail and y in t.tail else "prefix"
        name = catalog.setdefault((x.label, y.label, region), f"bond{len(catalog) + 1},l={x.level}" if x.level is not None else f"bond{len(catalog) + 1}")
        t = t.fuse(x.col, y.col, name)
    return t


def align_links(target: Tensor, t: Tensor) -> Tensor:
    """t with its links named as those of target: each link of target takes the first free one of t with its name, dimension
    and prime level, else with its name and dimension, else some free ones whose dimensions multiply to its own, fused."""
    taken: list = []
    for want in (x for x in target.axes if x.link):
        free = [x for x in t.axes if x.link and x.label not in taken]
        same = [x for x in free if x.dim == want.dim and x.name == want.name]
        found = [x for x in same if x.plev == want.plev] or same
        group = found[:1] or _factors(free, want.dim)
        if not group:
            raise ValueError(f"no link matches {want.label} of dimension {want.dim}")
        first, *rest = group
        for x in rest:
            t = t.fuse(first.col, x.col, first.name)
            first = t.axis(first.col) if any(first.col == y.col for y in t.axes) else next(y for y in t.axes if y.name == first.name)
        t = t.relabel(lambda x: want if x == first else x)  # noqa: B023
        taken.append(want.label)
    return t


def _factors(axes: list[Axis], product: int) -> list[Axis]:
    """The first axes in their order whose dimensions multiply to the product, else none."""
    for i, x in enumerate(axes):
        if product % x.dim == 0:
            rest = product // x.dim
            if rest == 1:
                return [x]
            if more := _factors(axes[i + 1 :], rest):
                return [x, *more]
    return []
