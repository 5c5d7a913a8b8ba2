"""The query algebra: immutable terms that are lowered to DataFrames, compared, signed and serialised."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Type:
    """All objects of a class and of its subclasses."""

    name: str


@dataclass(frozen=True)
class Tag:
    """A label: kind is str, enum, obj or class; scope is a field's name for scoped tags."""

    key: str
    kind: str = "str"
    scope: str = ""


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class Not:
    """Each term is taken away from the conjunction that it stands in."""

    terms: tuple


@dataclass(frozen=True)
class Ids:
    oids: tuple


@dataclass(frozen=True)
class Range:
    """Index entries with low <= key <= high; null keys count as first or last."""

    index: str
    low: Any = None
    high: Any = None
    null_first: bool = False


@dataclass(frozen=True)
class At:
    """A query as of an earlier state."""

    query: Any
    state: int


@dataclass(frozen=True)
class Split:
    tags: tuple
    query: Any
    exclusive: bool = True


@dataclass(frozen=True)
class Filter:
    """A predicate over objects of a type: a Column expression (text), or a Python function (not serialised)."""

    query: Any
    type: str
    expr: str | None = None
    fn: Any = field(default=None, compare=False)
    columns: tuple = ()


@dataclass(frozen=True)
class Sort:
    """By keys of an index; a query that is itself a Sort gives the minor keys."""

    index: str
    query: Any
    desc: bool = False
    null_first: bool = False


@dataclass(frozen=True)
class Slice:
    query: Any
    start: int | None = None
    stop: int | None = None
    step: int = 1


NODES = {c.__name__: c for c in (Type, Tag, And, Or, Not, Ids, Range, At, Split, Filter, Sort, Slice)}


def term(x: Any) -> Any:
    """Terms from plain values: str a tag, tuple a conjunction, list a disjunction."""
    if is_dataclass(x):
        return x
    if hasattr(x, "ir"):
        return x.ir
    if isinstance(x, str):
        return Tag(x)
    if isinstance(x, tuple | list):
        inner = tuple(term(y) for y in x)
        if any(isinstance(y, Not) for y in inner):
            raise NotImplementedError("no() stands only at the top of find()")
        return And(inner) if isinstance(x, tuple) else Or(inner)
    raise TypeError(f"not a query term: {x!r}")


def no(*terms: Any) -> Not:
    inner = tuple(term(t) for t in terms)
    if any(isinstance(t, Not) for t in inner):
        raise NotImplementedError("no() inside no()")
    return Not(inner)


def to_json(x: Any) -> Any:
    if is_dataclass(x):
        return {"node": type(x).__name__, **{f.name: to_json(getattr(x, f.name)) for f in fields(x) if f.name != "fn"}}
    if isinstance(x, tuple):
        return [to_json(y) for y in x]
    if x is None or isinstance(x, str | int | float | bool):
        return x
    return {"value": type(x).__name__, "text": x.isoformat() if hasattr(x, "isoformat") else str(x)}


def from_json(x: Any) -> Any:
    import datetime
    import decimal

    if isinstance(x, list):
        return tuple(from_json(y) for y in x)
    if isinstance(x, dict) and "node" in x:
        return NODES[x["node"]](**{k: from_json(v) for k, v in x.items() if k != "node"})
    if isinstance(x, dict):
        kind = x["value"]
        return decimal.Decimal(x["text"]) if kind == "Decimal" else getattr(datetime, kind).fromisoformat(x["text"])
    return x


def serialize(x: Any) -> bytes:
    return json.dumps(to_json(x), sort_keys=True).encode()


def deserialize(data: bytes) -> Any:
    return from_json(json.loads(data))


def _canonical(x: Any) -> Any:
    """JSON in which the order of operands of and, or, no doesn't matter."""
    if isinstance(x, And | Or | Not):
        return {"node": type(x).__name__, "terms": sorted((_canonical(t) for t in x.terms), key=lambda j: json.dumps(j, sort_keys=True))}
    if is_dataclass(x):
        return {"node": type(x).__name__, **{f.name: _canonical(getattr(x, f.name)) for f in fields(x) if f.name != "fn"}}
    return [_canonical(y) for y in x] if isinstance(x, tuple) else to_json(x)


def signature(x: Any) -> str:
    """Equal for queries that differ only in the order of operands."""
    return base64.b32encode(hashlib.sha256(json.dumps(_canonical(x), sort_keys=True).encode()).digest()).decode().rstrip("=")


def compare(a: Any, b: Any) -> float:
    """Difference of two queries: 0 for equal ones, 1 for those with nothing in common."""
    if _canonical(a) == _canonical(b):
        return 0.0
    if isinstance(a, And | Or | Not) and type(a) is type(b):
        left = list(b.terms)
        gap = 0.0
        for t in a.terms:
            best = min(range(len(left)), key=lambda i: compare(t, left[i]), default=None)
            gap += 1.0 if best is None else compare(t, left.pop(best))
        return (gap + len(left)) / max(len(a.terms), len(b.terms))
    if type(a) is type(b) and hasattr(a, "query"):
        return (compare(a.query, b.query) + 1) / 2 if a.query != b.query else 0.5
    return 1.0
