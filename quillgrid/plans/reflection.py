"""Stored queries, and notes on functions: a registry that tools can read."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: Any = None
    required: bool = True


@dataclass
class Stored:
    """A function with its notes: immutable, fulltext, table_view, complete_with and the like."""

    name: str
    fn: Callable
    notes: dict[str, Any] = field(default_factory=dict)

    def parameters(self) -> list[Parameter]:
        """Name, declared type, default and whether it must be given."""
        out = []
        for p in inspect.signature(self.fn).parameters.values():
            kind = "" if p.annotation is p.empty else getattr(p.annotation, "__name__", str(p.annotation))
            out.append(Parameter(p.name, kind, None if p.default is p.empty else p.default, p.default is p.empty))
        return out

    def __call__(self, *args: Any, **named: Any) -> Any:
        return self.fn(*args, **named)


class Registry:
    """Functions by name."""

    def __init__(self) -> None:
        self.stored: dict[str, Stored] = {}

    def query(self, fn: Callable) -> Callable:
        """Decorator: register a function as a query."""
        self.stored[fn.__name__] = Stored(fn.__name__, fn, dict(getattr(fn, "_notes", {})))
        return fn

    def get(self, name: str) -> Stored:
        return self.stored[name]

    def names(self, **notes: Any) -> list[str]:
        """Of all functions, or of those with these notes."""
        return sorted(n for n, s in self.stored.items() if all(s.notes.get(k) == v for k, v in notes.items()))


def note(**notes: Any) -> Callable[[Callable], Callable]:
    """Decorator: put notes on a function, below ``query``."""

    def put(fn: Callable) -> Callable:
        fn._notes = getattr(fn, "_notes", {}) | notes
        return fn

    return put


def noted(fn: Callable, name: str) -> Any:
    """A function's note; None if it has none of that name."""
    return getattr(fn, "_notes", {}).get(name)


def immutable(fn: Callable) -> Callable:
    return note(immutable=True)(fn)


def fulltext(fn: Callable) -> Callable:
    return note(fulltext=True)(fn)


def table_view(fn: Callable) -> Callable:
    return note(table_view=True)(fn)


def complete_with(action: Callable) -> Callable[[Callable], Callable]:
    """The function that completes what the noted one begins."""
    return note(complete_with=action)
