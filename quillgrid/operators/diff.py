"""Differences between two states of a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import Query, View


def _both(q: Query, before: View | None, after: View) -> tuple[DataFrame | None, DataFrame]:
    old = Query(before, q.ir).ids().select("oid").distinct() if before is not None else None
    return old, Query(after, q.ir).ids().select("oid").distinct()


def select_new(q: Query, before: View | None, after: View) -> DataFrame:
    """oid of members after that were none before."""
    old, new = _both(q, before, after)
    return new if old is None else new.join(old, "oid", "left_anti")


def select_deleted(q: Query, before: View | None, after: View) -> DataFrame:
    """oid of members before that are none after; losing the tag counts."""
    old, new = _both(q, before, after)
    return new.filter("false") if old is None else old.join(new, "oid", "left_anti")


def select_modified(q: Query, before: View, after: View, type_name: str, same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(oid, old, new) of members of both states with a newer version; ``same`` tells of two structs whether to skip it."""
    old, new = _both(q, before, after)
    both = new.join(old, "oid", "left_semi")
    side = lambda v, name: v.objects(type_name).select("oid", F.struct("*").alias(name))
    rows = both.join(side(before, "old"), "oid").join(side(after, "new"), "oid").filter(F.col("new.version") > F.col("old.version"))
    return rows.filter(~F.coalesce(same(F.col("old"), F.col("new")), F.lit(False))) if same else rows


class SnapshotWindow:
    """The views of two states, from first to last, as a context: ``with SnapshotWindow(p, 3, 7) as (before, after)``.

    ``source`` gives the view of a state: a prefix, or a function.  Without a first state (or one under 1) the window
    begins at state 1; without a last one it ends at the present.
    """

    def __init__(self, source, first: int | None = None, last: int | None = None):
        at = getattr(source, "snapshot", source)
        self.views = at(max(first or 1, 1)), at(last)

    def __enter__(self) -> tuple[View, View]:
        return self.views

    def __exit__(self, *error) -> None:
        return None


def split_by_snapshots(q: Query, *views: View, type_name: str) -> DataFrame:
    """oid and the versions (struct s1 .. sn) of the query's objects in each view; inner join on oid."""
    out = q.ids().select("oid").distinct()
    for n, v in enumerate(views, 1):
        out = out.join(v.objects(type_name).select("oid", F.struct("*").alias(f"s{n}")), "oid")
    return out
