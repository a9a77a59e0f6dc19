"""Relation trees: the declaration of nested documents.

A tree names a root entity and, level by level, children that are left-joined to their parent by
``child.JoinKey = parent.ParentKey``. Files hold JSON arrays of root relations.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse


class RelationError(ValueError):
    """A relation tree that cannot be built."""


@dataclass(frozen=True)
class Relation:
    entity: str
    denormalized_name: str | None = None
    join_key: str | None = None
    parent_key: str | None = None
    children: tuple[Relation, ...] = ()

    @staticmethod
    def from_json(node: dict) -> Relation:
        unknown = set(node) - {"Entity", "DenormalizedName", "JoinKey", "ParentKey", "Children"}
        if unknown:
            raise RelationError(f"unknown properties {sorted(unknown)}")
        return Relation(
            node.get("Entity") or "",
            node.get("DenormalizedName"),
            node.get("JoinKey"),
            node.get("ParentKey"),
            tuple(Relation.from_json(c) for c in node.get("Children") or ()),
        )

    def to_json(self) -> dict:
        names = {"DenormalizedName": self.denormalized_name, "Entity": self.entity, "JoinKey": self.join_key, "ParentKey": self.parent_key}
        out = {k: v for k, v in names.items() if v is not None}
        return out | ({"Children": [c.to_json() for c in self.children]} if self.children else {})

    def walk(self) -> Iterator[Relation]:
        """This relation and all below it, parents first."""
        yield self
        for child in self.children:
            yield from child.walk()


@dataclass(frozen=True)
class Edge:
    """One parent-child step of a root's tree; ``path`` tells it from other steps with the same entities."""

    root: str
    path: tuple[str, ...]
    parent: Relation
    child: Relation

    @property
    def join_index(self) -> str:
        return f"JK|{self.child.entity}|{self.child.join_key}"

    @property
    def parent_index(self) -> str:
        return f"PaK|{self.path[0]}|{self.parent.entity}|{self.child.parent_key}"

    @property
    def id(self) -> str:
        return "/".join((*self.path, self.child.entity))


def edges(root: Relation) -> list[Edge]:
    """All steps of the tree, parents first. An entity that occurs repeatedly has a step for each place."""

    def below(node: Relation, path: tuple[str, ...]) -> Iterator[Edge]:
        for child in node.children:
            yield Edge(root.denormalized_name or root.entity, path, node, child)
            yield from below(child, (*path, child.entity))

    return list(below(root, (root.entity,)))


def entities(roots: Iterable[Relation]) -> list[str]:
    """All entities, those that are only children first, each group in alphabetical order."""
    roots = list(roots)
    top = {r.entity for r in roots}
    every = {n.entity for r in roots for n in r.walk()}
    return [*sorted(every - top), *sorted(top)]


def find(root: Relation, entity: str) -> list[tuple[Relation | None, Relation]]:
    """Every place of ``entity`` in the tree as (parent, relation); the root has no parent; none gives []."""
    here: list[tuple[Relation | None, Relation]] = [(None, root)] if root.entity == entity else []
    return here + [(e.parent, e.child) for e in edges(root) if e.child.entity == entity]


def validate(roots: Iterable[Relation]) -> list[Relation]:
    """The roots, after checking every level of every tree."""
    roots = list(roots)

    def check(node: Relation, where: str) -> None:
        siblings = [c.entity for c in node.children]
        for twice in {e for e in siblings if siblings.count(e) > 1}:
            raise RelationError(f"{where}: two children of the entity {twice!r}")
        for child in node.children:
            for name, value in (("Entity", child.entity), ("JoinKey", child.join_key), ("ParentKey", child.parent_key)):
                if not value:
                    raise RelationError(f"{where}: a child without {name}")
            check(child, f"{where}/{child.entity}")

    for root in roots:
        if not root.denormalized_name:
            raise RelationError("a root without DenormalizedName")
        if not root.entity:
            raise RelationError(f"{root.denormalized_name}: a root without Entity")
        if not root.children:
            raise RelationError(f"{root.denormalized_name}: a root without Children")
        check(root, root.denormalized_name)
    names = [r.denormalized_name for r in roots]
    for twice in {n for n in names if names.count(n) > 1}:
        raise RelationError(f"two roots named {twice!r}")
    return roots


def local_path(uri: str) -> Path:
    """The file of a plain path or a ``file:`` URI."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return Path(unquote(parsed.path) if parsed.scheme else uri)
    raise RelationError(f"{uri}: only files are read here")


def load(uris: Iterable[str]) -> list[Relation]:
    """The valid roots of all files, in order."""
    nodes = [node for uri in uris for node in json.loads(local_path(uri).read_text())]
    return validate(map(Relation.from_json, nodes))
