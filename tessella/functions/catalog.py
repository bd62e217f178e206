"""The catalogue: variables with flags and shapes, packages, their resolution, and selection of columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Built-in flags. Fixed values.
FLAGS = (
    "Ignore None Cell Face Edge Node Particle Swarm Private Provides Requires Overridable Vector Tensor Boolean Integer Real "
    "Independent Derived Advected Conserved Intensive Restart Sparse SparseCommunication OneCopy FillGhost WithFluxes "
    "ForceRemeshComm GMGProlongate GMGRestrict ForceAllocOnNewBlocks Fine Flux CellMemAligned CoordinatesVec"
).split()
#: Of each group a variable has one flag; the first is the default.
TOPOLOGIES = ("None", "Cell", "Face", "Edge", "Node", "Particle", "Swarm")
ROLES = ("Provides", "Private", "Requires", "Overridable")
TYPES = ("Real", "Boolean", "Integer")
SPARK_TYPES = {"Real": "double", "Integer": "int", "Boolean": "boolean"}


@dataclass(frozen=True)
class Metadata:
    """Flags, shape and component labels of a variable, with the defaults and rules that make them valid."""

    flags: frozenset[str]
    shape: tuple[int, ...] = ()
    labels: tuple[str, ...] = ()

    @classmethod
    def of(cls, *flags: str, shape: Iterable[int] = (), labels: Iterable[str] = (), user: Iterable[str] = ()) -> Metadata:
        known, out = set(FLAGS) | set(user), set(flags)
        if out - known:
            raise ValueError(f"unknown flags {sorted(out - known)}")
        for group in (TOPOLOGIES, ROLES, TYPES):
            own = [f for f in group if f in out]
            if len(own) > 1:
                raise ValueError(f"{own} exclude each other")
            out |= set() if own else {group[0]}
        if {"Independent", "Derived"} <= out:
            raise ValueError("Independent and Derived exclude each other")
        if "Independent" not in out:
            out.add("Derived")
        if {"Vector", "Tensor"} <= out:
            raise ValueError("Vector and Tensor exclude each other")
        shape, labels = tuple(shape), tuple(labels)
        if out & {"Cell", "Face", "Edge", "Node"} and len(shape) > 3:
            raise ValueError("variables on the mesh have at most three tensor dimensions")
        if labels and len(labels) != math.prod(shape):
            raise ValueError("a label for each component, or none")
        return cls(frozenset(out), shape, labels)

    def all_set(self, *flags: str) -> bool:
        return self.flags.issuperset(flags)

    def any_set(self, *flags: str) -> bool:
        return not self.flags.isdisjoint(flags)

    def none_set(self, *flags: str) -> bool:
        return self.flags.isdisjoint(flags)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark_type(self) -> str:
        kind = SPARK_TYPES[next(t for t in TYPES if t in self.flags)]
        for _ in self.shape:
            kind = f"array<{kind}>"
        return kind


@dataclass(frozen=True)
class FlagCollection:
    """A set expression over flags: any of ``unions``, all of ``intersections``, none of ``exclusions``."""

    unions: frozenset[str] = frozenset()
    intersections: frozenset[str] = frozenset()
    exclusions: frozenset[str] = frozenset()

    @classmethod
    def all_of(cls, *flags: str) -> FlagCollection:
        return cls(intersections=frozenset(flags))

    @classmethod
    def any_of(cls, *flags: str) -> FlagCollection:
        return cls(unions=frozenset(flags))

    def __or__(self, other: FlagCollection) -> FlagCollection:
        """Union; an intersection in a union has no such form unless it is a single flag."""
        single = lambda c: c.unions | (c.intersections if len(c.intersections) == 1 and not c.unions else frozenset())
        if any(len(c.intersections) > 1 or c.intersections and c.unions for c in (self, other)):
            raise ValueError("a union of intersections cannot be expressed")
        return FlagCollection(single(self) | single(other), frozenset(), self.exclusions | other.exclusions)

    __add__ = __or__

    def __and__(self, other: FlagCollection) -> FlagCollection:
        if self.unions and other.unions:
            raise ValueError("an intersection of unions cannot be expressed")
        return FlagCollection(self.unions | other.unions, self.intersections | other.intersections, self.exclusions | other.exclusions)

    __mul__ = __and__

    def __sub__(self, other: FlagCollection) -> FlagCollection:
        return FlagCollection(self.unions, self.intersections, self.exclusions | other.unions | other.intersections)

    def matches(self, m: Metadata) -> bool:
        return m.all_set(*self.intersections) and (not self.unions or m.any_set(*self.unions)) and m.none_set(*self.exclusions)


def var_name(base: str, sparse_id: int | None) -> str:
    return base if sparse_id is None else f"{base}_{sparse_id}"


@dataclass
class Package:
    """Variables, parameters and callbacks of a module."""

    name: str
    fields: dict[tuple[str, int | None], Metadata] = field(default_factory=dict)
    swarms: dict[str, dict[str, Metadata]] = field(default_factory=dict)
    params: dict[str, tuple[object, str]] = field(default_factory=dict)
    history: list[tuple[str, object, str]] = field(default_factory=list)
    derived: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def add_field(self, name: str, meta: Metadata) -> bool:
        """False for a name there is already. A field with fluxes brings a flux field with it."""
        if "Sparse" in meta.flags:
            raise ValueError("sparse variables come with add_sparse_pool")
        if (name, None) in self.fields:
            return False
        self.fields[name, None] = meta
        if "WithFluxes" in meta.flags:
            self.fields.setdefault((f"bnd_flux::{name}", None), Metadata(meta.flags - {"WithFluxes", "Cell", "Independent", "FillGhost"} | {"Face", "Flux", "Derived"}, meta.shape))
        return True

    def add_sparse_pool(self, name: str, meta: Metadata, ids: Iterable[int]) -> bool:
        if any(base == name for base, _ in self.fields):
            return False
        meta = Metadata(meta.flags | {"Sparse"}, meta.shape, meta.labels)
        self.fields.update({(name, i): meta for i in ids})
        return True

    def add_param(self, key: str, value: object, mutability: str = "Immutable") -> None:
        """``Immutable``, ``Mutable``, or ``Restart``: mutable and written with snapshots."""
        if key in self.params:
            raise KeyError(f"parameter {key} is there already")
        self.params[key] = (value, mutability)

    def update_param(self, key: str, value: object) -> None:
        old, mutability = self.params[key]
        if mutability == "Immutable":
            raise TypeError(f"parameter {key} is immutable")
        if type(old) is not type(value):
            raise TypeError(f"parameter {key} is a {type(old).__name__}")
        self.params[key] = (value, mutability)

    def param(self, key: str) -> object:
        return self.params[key][0]


@dataclass
class Catalog:
    """The resolved variables of all packages, in order of declaration."""

    fields: dict[tuple[str, int | None], Metadata]

    def select(self, names: Iterable[str] = (), flags: FlagCollection | None = None, sparse_ids: Iterable[int] = (), fluxes: str = "NoFlux", regex: bool = False) -> list[str]:
        """Column names: by name in the order given (unknown ones skipped, repeats once), else by flags, else all; of sparse
        variables the ids asked for, or all. ``fluxes``: ``NoFlux``, ``OnlyFlux`` or ``Any``. With ``regex`` names match in full."""
        ids = set(sparse_ids)
        chosen: dict[tuple[str, int | None], None] = {}
        wanted = lambda key: key[1] is None or not ids or key[1] in ids
        if names := list(names):
            for name in names:
                match = (lambda k, n=name: re.fullmatch(n, var_name(*k)) is not None) if regex else (lambda k, n=name: n in (k[0], var_name(*k)))
                chosen.update({k: None for k in self.fields if match(k) and wanted(k)})
        else:
            chosen.update({k: None for k in self.fields if wanted(k)})
        if flags is not None:
            chosen = {k: None for k in chosen if flags.matches(self.fields[k])}
        flux = {"NoFlux": (False,), "OnlyFlux": (True,), "Any": (False, True)}[fluxes]
        return [var_name(*k) for k in chosen if ("Flux" in self.fields[k].flags) in flux]

    def meta(self, column: str) -> Metadata:
        return next(m for k, m in self.fields.items() if var_name(*k) == column)

    def size(self, columns: Iterable[str]) -> int:
        """Components of a selection."""
        return sum(self.meta(c).size for c in columns)

    def index(self, columns: Iterable[str]) -> dict[str, tuple[int, int]]:
        """First and last component of each column of a selection."""
        out, at = {}, 0
        for c in columns:
            out[c] = (at, at + self.meta(c).size - 1)
            at += self.meta(c).size
        return out


def resolve(packages: Iterable[Package]) -> Catalog:
    """Private variables get their package's name, two providers of one name are an error, as is a requirement that
    nobody provides; an overridable variable counts only if nobody provides its name."""
    provided: dict[tuple[str, int | None], Metadata] = {}
    required: dict[tuple[str, int | None], str] = {}
    fallback: dict[tuple[str, int | None], Metadata] = {}
    for package in packages:
        for (name, sparse_id), meta in package.fields.items():
            role = next(r for r in ROLES if r in meta.flags)
            if role == "Private":
                provided[f"{package.name}::{name}", sparse_id] = meta
            elif role == "Provides":
                if (name, sparse_id) in provided:
                    raise ValueError(f"{name} is provided twice")
                provided[name, sparse_id] = meta
            elif role == "Requires":
                required[name, sparse_id] = package.name
            else:
                fallback.setdefault((name, sparse_id), meta)
    for key, meta in fallback.items():
        provided.setdefault(key, meta)
    for (name, sparse_id), package in required.items():
        if (name, sparse_id) not in provided:
            raise ValueError(f"{package} requires {name}, which nobody provides")
    return Catalog(provided)


def project(df: DataFrame, catalog: Catalog, keys: Iterable[str], **selection) -> DataFrame:
    """The key columns and the selected variables that ``df`` has."""
    chosen = [c for c in catalog.select(**selection) if c in df.columns]
    return df.select(*keys, *(F.col(f"`{c}`") for c in chosen))


def flattened(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Long form: the keys, ``var`` and ``value``; null (not allocated) values go."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("var"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns)))
    return df.select(*keys, pairs.alias("cell")).select(*keys, "cell.var", "cell.value").filter(F.col("value").isNotNull())


def uid_intersection(a: DataFrame, b: DataFrame, uid: str) -> DataFrame:
    """The uids that both lists have, once each; null is none."""
    return a.select(uid).intersect(b.select(uid)).filter(F.col(uid).isNotNull())
