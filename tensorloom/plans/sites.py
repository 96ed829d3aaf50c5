"""Chains of site tensors: a state or an operator as a product of tensors that neighbours' links connect.

A site has link axes (one at the ends of the chain, two inside) and site axes at prime level 0, and 1 too for operators. Products go
site by site, with the pairs of links fused to bonds that both neighbours name alike. Compression makes all sites but the last
orthonormal by QR trees, left to right, and cuts the bonds by singular values on the way back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import functions as F

from tensorloom.meta import Axis
from tensorloom.operators.contract import contract, contract_and_fuse
from tensorloom.operators.factor import left_qr
from tensorloom.operators.spectral import full_svd
from tensorloom.sources.shared import written
from tensorloom.tensor import Tensor


@dataclass(frozen=True)
class Chain:
    sites: tuple[Tensor, ...]

    def __post_init__(self):
        for i, (x, y) in enumerate(zip(self.sites, self.sites[1:], strict=False), 1):
            if len(self.links(i - 1, i)) != 1:
                raise ValueError(f"sites {i} and {i + 1} need one link in common, {x.axes} and {y.axes}")

    def links(self, i: int, j: int) -> list[Axis]:
        """The links that sites i and j share."""
        other = {a.label for a in self.sites[j].axes}
        return [a for a in self.sites[i].axes if a.link and a.label in other]

    def bond(self, i: int) -> Axis:
        """The link between site i and the next one."""
        return self.links(i, i + 1)[0]

    def bonds(self) -> list[int]:
        return [self.bond(i).dim for i in range(len(self.sites) - 1)]

    def whole(self) -> Tensor:
        """The product of all sites, as one tensor."""
        return reduce(contract, (t.to_coo() for t in self.sites))

    def __matmul__(self, other: Chain) -> Chain:
        return product(self, other)


def _marked(t: Tensor, mark: str, move: tuple[int, int]) -> Tensor:
    return t.to_coo().relabel(lambda a: replace(a, name=f"{a.name}_{mark}") if a.link else a.primed(move[1]) if a.plev == move[0] else a)


def product(a: Chain, b: Chain) -> Chain:
    """(a b): an operator chain on a state or on another operator. Site axes of a at level 1 meet those of b at level 0. Each pair of
    links becomes a bond once, in a catalog that the neighbour's site reads."""
    if len(a.sites) != len(b.sites):
        raise ValueError("chains of different lengths")
    catalog: dict[tuple[str, str], str] = {}
    out = []
    for i in range(len(a.sites)):
        x, y = _marked(a.sites[i], "a", (1, 7)), _marked(b.sites[i], "b", (0, 7))
        pairs = {}
        for n in (j for j in (i - 1, i) if 0 <= j < len(a.sites) - 1):
            left, right = (x.axis(f"{a.bond(n).name}_a"), y.axis(f"{b.bond(n).name}_b"))
            pairs[f"bond{n + 1}"] = (left.col, right.col)
        made = contract_and_fuse(x, y, pairs, catalog)
        out.append(made.relabel(lambda q: replace(q, plev=0, link=True) if q.name.startswith("bond") else q))
    return Chain(tuple(out))


def compressed(chain: Chain, maxdim: int, cutoff: float = 1e-12) -> Chain:
    """The same chain with bonds of at most maxdim, and of what singular values above cutoff times the largest need.

    Each site is written once a pass, so plans don't grow along the chain.
    """
    sites = [t.to_coo() for t in chain.sites]
    sites = [Tensor(t.axes, t.df.withColumn("v", F.col("v").cast("double"))) for t in sites]
    for i in range(len(sites) - 1):
        link = chain.bond(i)
        head = [x for x in sites[i].axes if x.label != link.label]
        q, r = left_qr(sites[i], [x.col for x in head], link.col)
        q, r = (written(df.withColumnRenamed("q", "bond_q"), "qr") for df in (q, r))
        rank = r.agg(F.max("bond_q")).first()[0] or 1
        new = Axis("bond_q", rank, 0, True)
        right = contract(Tensor((new, link), r), sites[i + 1])
        named = lambda t, name=link.name: t.relabel(lambda x: replace(x, name=name) if x.name == "bond_q" else x)
        sites[i] = named(Tensor((*head, new), q))
        sites[i + 1] = named(Tensor(right.axes, written(right.df, "site")))
    for i in range(len(sites) - 1, 0, -1):
        link = next(x for x in sites[i].axes if x.link and x.label in {y.label for y in sites[i - 1].axes})
        f = full_svd(sites[i], [link.col], min(maxdim, link.dim))
        kept = int((f.values > cutoff * f.values[0]).sum()) if len(f.values) else 0
        spell = lambda t, name="bond_k": t.to_coo().relabel(lambda x: replace(x, name=name, link=True) if x == t.tail[0] else x)
        right, left = spell(f.right), spell(f.left)
        bond = Axis("bond_k", max(1, kept), 0, True)
        cutting = lambda t, bond=bond: Tensor(tuple(bond if x.name == "bond_k" else x for x in t.axes), t.df.where(F.col("bond_k") <= bond.dim))
        right, left = cutting(right), cutting(left)
        values = F.array(*map(F.lit, f.values[: bond.dim].tolist())) if kept else F.array(F.lit(0.0))
        scaled = Tensor(left.axes, left.df.withColumn("v", F.col("v") * F.element_at(values, F.col("bond_k"))))
        before = contract(sites[i - 1], scaled)
        back = lambda t, name=link.name: t.relabel(lambda x: replace(x, name=name) if x.name == "bond_k" else x)
        sites[i] = back(Tensor(right.axes, written(right.df, "site")))
        sites[i - 1] = back(Tensor(before.axes, written(before.df, "site")))
    return Chain(tuple(sites))
