"""Methods of lists, tuples, sets, dicts and byte arrays as column functions (null in, null out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# lists and tuples (0-based, negative places count from the end)


def get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def cut(a: Column, start: int = 0, stop: int | None = None) -> Column:
    n = F.size(a)
    at = lambda x: F.least(F.lit(x), n) if x >= 0 else F.greatest(F.lit(0), n + x)
    first, last = at(start), n if stop is None else at(stop)
    return F.slice(a, first + 1, F.greatest(F.lit(0), last - first))


def append(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def extend(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y.eqNullSafe(x)))


def index(a: Column, x: Column) -> Column:
    """Place of the first x; null if there is none."""
    return F.nullif(F.array_position(a, x), F.lit(0)) - 1


def remove_first(a: Column, x: Column) -> Column:
    at = F.array_position(a, x)
    return F.when(at > 0, F.filter(a, lambda _, i: i != at - 1)).otherwise(a)


def pop(a: Column, i: int = -1) -> Column:
    """What stays without the element at i."""
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.filter(a, lambda _, j: j != at)


# sets (arrays of different elements)


def set_of(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def add(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(x)))


def discard(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def live(refs: Column, existing: Column) -> Column:
    """A weak set without the ids that no longer exist."""
    return F.array_intersect(refs, existing)


# dicts


def dict_get(m: Column, k: Column, default: Column | None = None) -> Column:
    got = F.element_at(m, k)
    return got if default is None else F.when(F.map_contains_key(m, k), got).otherwise(default)


def dict_update(m: Column, n: Column) -> Column:
    """m with n's entries, which win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(n, k)), n)


def dict_setdefault(m: Column, k: Column, v: Column) -> Column:
    return F.when(F.map_contains_key(m, k), m).otherwise(F.map_concat(m, F.create_map(k, v)))


def dict_pop(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def dict_fromkeys(a: Column, v: Column) -> Column:
    keys = F.array_distinct(a)
    return F.map_from_arrays(keys, F.transform(keys, lambda _: v))


# byte arrays


def bytes_insert(b: Column, i: int, x: Column) -> Column:
    return F.concat(F.substring(b, 1, i), x, F.substring(b, F.lit(i + 1), F.length(b)))


def bytes_count(b: Column, x: bytes) -> Column:
    """How often one byte stands."""
    pairs = F.hex(b)
    return F.size(F.filter(F.sequence(F.lit(0), F.length(b) - 1), lambda i: F.substring(pairs, 2 * i + 1, F.lit(2)) == F.lit(x.hex().upper())))


def bytes_append(b: Column, x: int) -> Column:
    return F.concat(b, F.unhex(F.lit(f"{x:02x}")))


def bytes_get(b: Column, i: int) -> Column:
    """The byte at a place (negative ones count from the end), as a number; null beyond."""
    one = F.hex(F.substring(b, i + 1 if i >= 0 else i, 1))
    return F.when((F.length(b) > i) if i >= 0 else (F.length(b) >= -i), F.conv(one, 16, 10).cast("int"))


# comparison and hashing


def compare(a: Column, b: Column, tags_a: Column | None = None, tags_b: Column | None = None) -> Column:
    """Equality of contents; nulls are equal.  With arrays of tags, those are to be the same too, in any order."""
    same = a.eqNullSafe(b)
    if tags_a is None or tags_b is None:
        return same
    return same & set_of(tags_a).eqNullSafe(set_of(tags_b))


def stable_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)
