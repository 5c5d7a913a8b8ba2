"""Prefixes: versioned stores of tagged objects as append-only Parquet logs.

A prefix is a folder.  Each commit appends, under its state number, rows of changes: objects (a new version, or its
end), tags and index entries (added or removed).  A snapshot at state s takes of each key the last change up to s.
A commit counts once its mark is in ``_states``; what a broken commit left is never read.  One writer at a time.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid as uuids
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.query import Query, View
from ..plans.ir import Tag, term

TAGS = "oid long, kind string, scope string, key string, gone boolean"


class Workspace:
    """All prefixes under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict[str, Prefix] = {}

    def path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.path(*parts))

    def children(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(*parts))) if self.exists(*parts) else []

    def get_prefixes(self) -> list[str]:
        return [p for p in self.children() if not p.startswith(("_", "."))]

    def open(self, name: str, mode: str = "rw") -> Prefix:
        if mode == "r" and not self.exists(name):
            raise FileNotFoundError(name)
        self._open[name] = Prefix(self, name, mode)
        return self._open[name]

    def close(self, name: str | None = None) -> None:
        """Close a prefix, or all: staged changes are forgotten, its autocommit ends, later changes are refused."""
        for n in [name] if name is not None else list(self._open):
            if n in self._open:
                self._open.pop(n).close()

    def drop(self, name: str, if_exists: bool = True) -> None:
        if not self.exists(name) and not if_exists:
            raise FileNotFoundError(name)
        self._fs.delete(self.path(name), True)

    def copy_prefix(self, name: str, output: str) -> None:
        """A backup; refuses an output that exists."""
        if self.exists(output):
            raise FileExistsError(output)
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self._fs, self.path(name), self._fs, self.path(output), False, self.spark._jsc.hadoopConfiguration())


class Atomic:
    """Within atomic(): cancel() gives up what was staged in it."""

    def __init__(self) -> None:
        self.cancelled = False

    def cancel(self) -> None:
        self.cancelled = True


class Prefix:
    def __init__(self, ws: Workspace, name: str, mode: str):
        self.ws, self.spark, self.name, self.mode = ws, ws.spark, name, mode
        self._staged: dict[str, list[DataFrame]] = {}
        self._depth, self._lock, self._seen = 0, threading.RLock(), None
        self._mutations: list[list[tuple[str, int]]] = []
        self._timer: threading.Thread | None = None
        self._stop = threading.Event()
        self.parents: dict[str, str] = {}
        #: by type: what load() gives for an object's row instead of its plain values
        self.loaders: dict[str, Callable[[dict], Any]] = {}

    def _where(self, *parts: str) -> str:
        return "/".join([self.ws.root, self.name, *parts])

    # changes, staged until commit()

    def _stage(self, table: str, df: DataFrame) -> None:
        if self.mode != "rw":
            raise PermissionError(f"{self.name} is {'closed' if self.mode == 'closed' else 'open for reading'}")
        with self._lock:
            self._staged.setdefault(table, []).append(df)

    def close(self) -> None:
        self.mode = "closed"
        self._stop.set()
        if self._timer is not None:
            self._timer.join()
        self._staged.clear()

    def put(self, type_name: str, rows: DataFrame) -> None:
        """New objects, or new versions of them: oid and attributes.  Also carries touch() and assign()."""
        self._stage(f"objects_{type_name}", rows.drop("version").withColumn("gone", F.lit(False)))

    def delete(self, type_name: str, oids: DataFrame) -> None:
        self._stage(f"objects_{type_name}", oids.select("oid", F.lit(True).alias("gone")))

    def touch(self, type_name: str, oids: DataFrame) -> None:
        """A new version of objects as they are."""
        self.put(type_name, self.snapshot().types[type_name].join(oids.select("oid"), "oid", "left_semi"))

    def assign(self, type_name: str, oids: DataFrame, **values: Any) -> None:
        now = self.snapshot().types[type_name].join(oids.select("oid"), "oid", "left_semi")
        self.put(type_name, now.withColumns({k: F.lit(v).cast(now.schema[k].dataType) if k in now.columns else F.lit(v) for k, v in values.items()}))

    def remove_attributes(self, type_name: str, oids: DataFrame, *names: str) -> None:
        """A new version of objects without these attributes (null)."""
        self.assign(type_name, oids, **dict.fromkeys(names))

    def rename_field(self, type_name: str, old: str, new: str) -> None:
        """From the next commit on, readers find the attribute under its new name, in versions of any age."""
        self._stage("meta_renames", self.spark.createDataFrame([(type_name, old, new)], "type string, old string, new string"))

    def migrate(self, type_name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A new version of all objects of a type, as ``change`` makes it from their rows."""
        self.put(type_name, change(self.snapshot().types[type_name]))

    def tag(self, oids: DataFrame, *tags: Any, remove: bool = False) -> None:
        found: Sequence[Tag] = [term(t) for t in tags]
        labels = F.explode(F.array(*[F.struct(F.lit(t.kind).alias("kind"), F.lit(t.scope).alias("scope"), F.lit(t.key).alias("key")) for t in found]))
        self.tag_rows(oids.select("oid", labels.alias("t")).select("oid", "t.*"), remove)

    def tag_rows(self, rows: DataFrame, remove: bool = False) -> None:
        """Rows of (oid, kind, scope, key)."""
        self._stage("tags", rows.select("oid", "kind", "scope", "key", F.lit(remove).alias("gone")))

    def index(self, name: str, entries: DataFrame, remove: bool = False) -> None:
        """Entries (key, oid); an object may stand under many keys; null keys are allowed."""
        kind = entries.schema["key"].dataType
        old = self._logs().get(f"index_{name}")
        if old is not None and not isinstance(old.schema["key"].dataType, T.NullType) and old.schema["key"].dataType != kind and not isinstance(kind, T.NullType):
            raise TypeError(f"index {name} has keys of {old.schema['key'].dataType.simpleString()}")
        self._stage(f"index_{name}", entries.select("key", "oid", F.lit(remove).alias("gone")))

    def index_clear(self, name: str) -> None:
        """Remove all entries of an index."""
        self.index(name, self.snapshot().indexes[name], remove=True)

    def index_len(self, name: str) -> int:
        return self.snapshot().indexes[name].count()

    def cancel(self) -> None:
        """Forget staged changes."""
        self._staged.clear()

    @contextlib.contextmanager
    def atomic(self) -> Iterator[Atomic]:
        """All changes within or, after an error or cancel(), none; published by the next commit.

        May be nested: an inner context gives up its own changes alone, the outermost all.
        """
        with self._lock:
            before = {t: list(parts) for t, parts in self._staged.items()}
            self._depth += 1
            inside = Atomic()
            try:
                yield inside
            except BaseException:
                inside.cancel()
                raise
            finally:
                self._depth -= 1
                if inside.cancelled:
                    self._staged = before

    @contextlib.contextmanager
    def locked(self, await_commit: bool = False) -> Iterator[list[tuple[str, int]]]:
        """The only writer of this session; gives the log of (prefix, state) of the commits made within."""
        with self._lock:
            log: list[tuple[str, int]] = []
            self._mutations.append(log)
            try:
                yield log
                if await_commit:
                    self.commit()
            finally:
                self._mutations.remove(log)

    def autocommit(self, seconds: float = 0.367) -> None:
        """Commit staged changes in the background, this long after they were noticed, until the prefix is closed."""

        def run() -> None:
            while not self._stop.wait(seconds):
                with self._lock:
                    if self._staged and not self._depth:
                        self.commit()

        self._timer = threading.Thread(target=run, daemon=True)
        self._timer.start()

    def commit(self) -> int:
        """Publish staged changes as one state; without any, the state stays."""
        if self._depth:
            raise RuntimeError("no commit within atomic()")
        if not self._staged:
            return self.get_state_num()
        state = self.get_state_num() + 1
        for table, parts in self._staged.items():
            df = parts[0]
            for n, p in enumerate(parts):
                p = p.withColumn("seq", F.lit(n))
                df = p if n == 0 else df.unionByName(p, allowMissingColumns=True)
            df.write.mode("overwrite").parquet(self._where(table, f"state={state}"))
        self.spark.createDataFrame([(state, uuids.uuid4().hex)], "state long, mark string").coalesce(1).write.mode("overwrite").parquet(self._where("_states", str(state)))
        self._staged.clear()
        for log in self._mutations:
            log.append((self.name, state))
        return state

    # reading

    def get_state_num(self, finalized: bool = True) -> int:
        """The last committed state; or the one that staged changes will make."""
        if not finalized and self._staged:
            return self.get_state_num() + 1
        return max((int(s) for s in self.ws.children(self.name, "_states") if self.ws.exists(self.name, "_states", s, "_SUCCESS")), default=0)

    def refresh(self) -> bool:
        """Has another state been committed since the last call?  (Snapshots read what is there when they are taken.)"""
        now, before = self.get_state_num(), self._seen
        self._seen = now
        return before is not None and now != before

    def wait(self, state: int, timeout: float | None = None, every: float = 0.05) -> bool:
        """Wait until a state is committed, by whomever; False after the timeout."""
        end = None if timeout is None else time.monotonic() + timeout
        while self.get_state_num() < state:
            if end is not None and time.monotonic() >= end:
                return False
            time.sleep(every)
        return True

    async def async_wait(self, state: int, timeout: float | None = None) -> bool:
        import asyncio

        return await asyncio.to_thread(self.wait, state, timeout)

    async def await_commit(self, timeout: float | None = None) -> bool:
        """Wait until what is staged now is committed."""
        return await self.async_wait(self.get_state_num(finalized=False), timeout)

    def _renamed(self, type_name: str, at: int, log: DataFrame) -> DataFrame:
        """A type's log with renamed attributes under their newest names."""
        if not self.ws.exists(self.name, "meta_renames"):
            return log
        renames = self.spark.read.parquet(self._where("meta_renames")).filter((F.col("state") <= at) & (F.col("type") == type_name))
        for r in renames.orderBy("state", "seq").collect():  # a row for each renaming of a field
            if r["old"] in log.columns:
                log = log.withColumn(r["new"], F.coalesce(r["new"], r["old"]) if r["new"] in log.columns else F.col(r["old"])).drop(r["old"])
        return log

    def _logs(self) -> dict[str, DataFrame]:
        if not self.ws.exists(self.name):
            return {}
        return {t: self.spark.read.option("mergeSchema", "true").parquet(self._where(t)) for t in self.ws.children(self.name) if not t.startswith(("_", "meta_"))}

    def snapshot(self, state: int | None = None) -> View:
        """The view at a state, by default the last one committed.  Partition pruning skips later states."""
        at = self.get_state_num() if state is None else state
        if not 0 <= at <= self.get_state_num():
            raise ValueError(f"no state {at}")
        objects, indexes, tags = {}, {}, self.spark.createDataFrame([], TAGS).drop("gone")
        for name, log in self._logs().items():
            log = log.filter(F.col("state") <= at)
            if name.startswith("objects_"):
                log = self._renamed(name[8:], at, log)
            keys = {"t": ["oid", "kind", "scope", "key"], "i": ["key", "oid"], "o": ["oid"]}[name[0]]
            rest = [c for c in log.columns if c not in (*keys, "gone", "seq", "state")]
            last = log.groupBy(*keys).agg(F.max_by(F.struct("gone", F.col("state").cast("long").alias("version"), *rest), F.struct("state", "seq")).alias("v")).filter("not v.gone")
            now = last.select(*keys, *[F.col(f"v.`{c}`") for c in rest], *([F.col("v.version")] if name[0] == "o" else []))
            if name == "tags":
                tags = now
            elif name.startswith("index_"):
                indexes[name[6:]] = now
            else:
                objects[name[8:]] = now
        return View(objects, tags, indexes, self.parents, self.snapshot, at, f"{self.ws.root}/{self.name}")

    def exists(self, type_name: str, oid: int) -> bool:
        view = self.snapshot()
        return type_name in view.types and not view.types[type_name].filter(F.col("oid") == oid).isEmpty()

    def fetch(self, type_name: str, oid: int | None = None) -> dict:
        """One object as plain values; without an id, a type's only object."""
        df = self.snapshot().types[type_name]
        found = (df if oid is None else df.filter(F.col("oid") == oid)).limit(2).collect()
        if len(found) != 1:
            raise KeyError(f"{type_name}: {'none' if not found else 'more than one'}")
        return found[0].asDict(recursive=True)

    def find_singleton(self, type_name: str) -> dict | None:
        """A type's only object; None if there is none."""
        view = self.snapshot()
        if type_name not in view.types or view.types[type_name].isEmpty():
            return None
        return self.fetch(type_name)

    def load(self, type_name: str, oid: int, exclude: Iterable[str] = (), references: dict[str, str] | None = None) -> Any:
        """An object as plain values, without the attributes in ``exclude``.

        ``references``: attributes that hold ids, and the types that they refer to; those objects are loaded in their
        place, each with its own exclusions none.  An id that is being loaded already stays an id.  A type's entry in
        ``loaders`` makes the value from the row.
        """
        return self._load(type_name, oid, frozenset(exclude), references or {}, frozenset())

    def _load(self, type_name: str, oid: int, exclude: frozenset, references: dict[str, str], under: frozenset) -> Any:
        row = self.fetch(type_name, oid)
        if type_name in self.loaders:
            return self.loaders[type_name](row)
        out = {k: v for k, v in row.items() if k not in exclude}
        for name, to in references.items():
            if out.get(name) is not None and out[name] != oid and out[name] not in under:
                out[name] = self._load(to, out[name], frozenset(), references, under | {oid})
        return out

    def load_all(self, query: Query, type_name: str, exclude: Iterable[str] = ()) -> Iterator[Any]:
        """The results of a query as plain values, a partition at a time (they don't all come to the driver at once)."""
        make = self.loaders.get(type_name, lambda row: row)
        for r in query.rows(type_name).drop(*exclude).toLocalIterator():
            yield make(r.asDict(recursive=True))

    # reflection

    def classes(self) -> list[str]:
        """The types of which objects have been stored."""
        return sorted(t[8:] for t in self.ws.children(self.name) if t.startswith("objects_"))

    def attributes(self, type_name: str) -> list[tuple[str, str]]:
        """Names and SQL types of a type's attributes."""
        return [(f.name, f.dataType.simpleString()) for f in self.snapshot().types[type_name].schema if f.name not in ("oid", "version")]

    def describe(self) -> DataFrame:
        """(class, attribute, type, place) of all classes."""
        rows = [(c, a, t, i) for c in self.classes() for i, (a, t) in enumerate(self.attributes(c))]
        return self.spark.createDataFrame(rows, "class string, attribute string, type string, place int")

    def storage_stats(self) -> DataFrame:
        """Files and bytes by table."""
        rows = []
        for t in self.ws.children(self.name):
            s = self.ws._fs.getContentSummary(self.ws.path(self.name, t))
            rows.append((t, int(s.getFileCount()), int(s.getLength())))
        return self.spark.createDataFrame(rows, "table string, files long, bytes long")

    def stats(self) -> DataFrame:
        """Rows of change and of states by table."""
        parts = [log.groupBy("state").count().select(F.lit(t).alias("table"), F.col("state").cast("long").alias("state"), F.col("count").alias("n_rows")) for t, log in self._logs().items()]
        out = self.spark.createDataFrame([], "table string, state long, n_rows long")
        for p in parts:
            out = out.union(p)
        return out

    def find(self, *criteria: Any) -> Query:
        return self.snapshot().find(*criteria)
