"""Named axes: what a tensor's columns mean. Labels are (name, prime level); equal labels join."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from math import prod


@dataclass(frozen=True)
class Axis:
    name: str
    dim: int
    plev: int = 0
    link: bool = False
    copy: int = 0  # tells apart the axes of one tensor that share a label

    @property
    def col(self) -> str:
        """The axis's column."""
        return sanitize(self.name) + (f"__p{self.plev}" if self.plev else "") + (f"__c{self.copy}" if self.copy else "")

    @property
    def label(self) -> tuple[str, int]:
        return self.name, self.plev

    @property
    def level(self) -> int | None:
        """The number of an `l=<n>` tag, else None."""
        found = re.search(r"l=(\d+)", self.name)
        return int(found[1]) if found else None

    @property
    def site(self) -> int | None:
        """The number of an `n=<n>` tag, else None."""
        found = re.search(r"n=(\d+)", self.name)
        return int(found[1]) if found else None

    @property
    def key(self) -> str:
        return f"{self.name}'{self.plev}:{self.dim}"

    def primed(self, plev: int) -> Axis:
        return replace(self, plev=plev)


def sanitize(tag: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", tag)


def strides(dims) -> list[int]:
    """Column-major: the first axis is the fast one."""
    out, now = [], 1
    for d in dims:
        out.append(now)
        now *= d
    return out


def check_permutation(perm, n: int) -> None:
    if sorted(perm) != list(range(n)):
        raise ValueError(f"{perm} is no permutation of {n} axes")


def shared(a: tuple[Axis, ...], b: tuple[Axis, ...]) -> list[Axis]:
    other = {x.label: x for x in b}
    for own, labels in ((a, other), (b, {x.label for x in a})):
        for x in own:
            if x.copy and x.label in labels:
                raise ValueError(f"several axes share the label {x.label}: merge them or take their diagonal before they meet another tensor")
    out = [x for x in a if x.label in other]
    for x in out:
        if x.dim != other[x.label].dim:
            raise ValueError(f"axis {x.label} has dimensions {x.dim} and {other[x.label].dim}")
    return out


def output_axes(prefix: list[Axis], tail: list[Axis]) -> tuple[Axis, ...]:
    """Sparse links by level, then other sparse axes, then the dense tail."""
    links = sorted((x for x in prefix if x.link), key=lambda x: (x.level is None, x.level or 0))
    return (*links, *(x for x in prefix if not x.link), *tail)


def sort_links(axes, missing: str = "last", by: str = "level") -> list[Axis]:
    """Links by level, those without a level last, first, or refused; or by id, which is the label."""
    if by == "id":
        return sorted(axes, key=lambda x: x.label)
    if missing == "error" and any(x.level is None for x in axes):
        raise ValueError("a link has no level")
    return sorted(axes, key=lambda x: ((x.level is None) != (missing == "first"), x.level or 0))


def split_bra_ket(axes) -> tuple[list[Axis], list[Axis]]:
    """Site axes with the lower and with the higher prime level of each name; links are left out."""
    low: dict[str, int] = {}
    sites = [x for x in axes if not x.link]
    for x in sites:
        low[x.name] = min(low.get(x.name, x.plev), x.plev)
    return [x for x in sites if x.plev == low[x.name]], [x for x in sites if x.plev != low[x.name]]


def merge_groups(axes) -> list[tuple[int, ...]]:
    """Positions of links with one name and prime level, which a dense form merges."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(axes):
        if x.link:
            groups.setdefault(x.label, []).append(i)
    return [tuple(g) for g in groups.values() if len(g) > 1]


def fused(a: Axis, b: Axis, name: str | None = None) -> Axis:
    return Axis(name or f"{a.name}_{b.name}", a.dim * b.dim, max(a.plev, b.plev), a.link or b.link)


def size(axes) -> int:
    return prod(x.dim for x in axes)
