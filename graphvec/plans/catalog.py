"""Index and constraint metadata. Columns are the indexes; the catalog says which properties may be filtered on and which are unique."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import DuplicateKey, IndexNotFound, VectorIndexNotFound
from ..functions.similarity import VectorConfig


@dataclass
class Catalog:
    #: (label, property) pairs.
    node_props: set[tuple[str, str]] = field(default_factory=set)
    edge_props: set[tuple[str, str]] = field(default_factory=set)
    node_unique: set[tuple[str, str]] = field(default_factory=set)
    edge_unique: set[tuple[str, str]] = field(default_factory=set)
    vectors: dict[tuple[str, str], tuple[int, VectorConfig]] = field(default_factory=dict)

    def props(self, kind: str) -> set[tuple[str, str]]:
        return self.node_props if kind == "node" else self.edge_props

    def unique(self, kind: str) -> set[tuple[str, str]]:
        return self.node_unique if kind == "node" else self.edge_unique

    def require(self, kind: str, label: str | None, prop: str) -> None:
        if label is None:
            raise IndexNotFound("property filters need a label")
        if (label, prop) not in self.props(kind):
            raise IndexNotFound(f"no property index for {label}::{prop}")

    def add_property(self, kind: str, label: str, prop: str) -> None:
        if (label, prop) in self.props(kind):
            raise DuplicateKey(f"property index for {label}::{prop} already exists")
        self.props(kind).add((label, prop))

    def add_unique(self, kind: str, label: str, prop: str) -> None:
        if (label, prop) in self.unique(kind):
            raise DuplicateKey(f"unique index for {label}::{prop} already exists")
        self.unique(kind).add((label, prop))
        self.props(kind).add((label, prop))

    def drop_property(self, kind: str, label: str, prop: str) -> None:
        """Drops the constraint along with the index."""
        if (label, prop) not in self.props(kind):
            raise IndexNotFound(f"no property index for {label}::{prop}")
        self.props(kind).discard((label, prop))
        self.unique(kind).discard((label, prop))

    def add_vector(self, label: str, prop: str, dim: int, config: VectorConfig) -> None:
        config.storable()
        if (label, prop) in self.vectors:
            raise DuplicateKey(f"vector index for {label}::{prop} already exists")
        self.vectors[label, prop] = (dim, config)

    def drop_vector(self, label: str, prop: str) -> None:
        if (label, prop) not in self.vectors:
            raise IndexNotFound(f"no vector index for {label}::{prop}")
        del self.vectors[label, prop]

    def vector(self, label: str, prop: str) -> tuple[int, VectorConfig]:
        if (label, prop) not in self.vectors:
            raise VectorIndexNotFound(f"no vector index for {label}::{prop}")
        return self.vectors[label, prop]

    def listed(self, kind: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for label, prop in sorted(self.props(kind)):
            out.setdefault(label, []).append(prop)
        return out

    def copy(self) -> Catalog:
        return Catalog(set(self.node_props), set(self.edge_props), set(self.node_unique), set(self.edge_unique), dict(self.vectors))

    def to_json(self) -> dict:
        pairs = {k: sorted(getattr(self, k)) for k in ("node_props", "edge_props", "node_unique", "edge_unique")}
        vectors = [[*key, dim, c.m, c.ef_construction, c.ef_search, c.similarity] for key, (dim, c) in sorted(self.vectors.items())]
        return {**pairs, "vectors": vectors}

    @staticmethod
    def from_json(data: dict) -> Catalog:
        out = Catalog(**{k: {tuple(x) for x in data[k]} for k in ("node_props", "edge_props", "node_unique", "edge_unique")})
        for label, prop, dim, *config in data["vectors"]:
            out.vectors[label, prop] = (dim, VectorConfig(*config))
        return out
