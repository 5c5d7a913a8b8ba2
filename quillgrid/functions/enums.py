"""Enumerations: ordered names whose values are tags, keys and columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ir import Tag


@dataclass(frozen=True)
class EnumValue:
    """One value; equal to that of any enumeration of the same name, whatever its prefix."""

    enum: str
    name: str
    index: int

    @property
    def tag(self) -> Tag:
        return Tag(f"{self.enum}.{self.name}", "enum")

    def serialize(self) -> str:
        return f"{self.enum}.{self.name}"

    def __hash__(self) -> int:
        return hash((self.enum, self.name))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, EnumValue) and (self.enum, self.name) == (other.enum, other.name)


class Enum:
    """E.X, E["X"] and E[i] give a value; values() all, in order; len() how many."""

    def __init__(self, name: str, names: Sequence[str]):
        if len(set(names)) != len(names):
            raise ValueError(f"{name} names a value twice")
        self._name, self._values = name, {n: EnumValue(name, n, i) for i, n in enumerate(names)}

    def values(self) -> list[EnumValue]:
        return list(self._values.values())

    def tags(self) -> list[Tag]:
        return [v.tag for v in self.values()]

    def __getattr__(self, name: str) -> EnumValue:
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, key: str | int) -> EnumValue:
        return self.values()[key] if isinstance(key, int) else self._values[key]

    def __len__(self) -> int:
        return len(self._values)

    def __iter__(self) -> Iterator[EnumValue]:
        return iter(self.values())

    def deserialize(self, text: str) -> EnumValue:
        enum, _, name = text.partition(".")
        if enum != self._name:
            raise ValueError(f"{text} is no value of {self._name}")
        return self._values[name]

    def index_of(self, name: Column) -> Column:
        """The place of a value's name; null for other names."""
        return F.nullif(F.array_position(F.array(*[F.lit(n) for n in self._values]), name), F.lit(0)).cast("int") - 1


def is_enum(x: object) -> bool:
    return isinstance(x, Enum)


def is_enum_value(x: object) -> bool:
    return isinstance(x, EnumValue)
