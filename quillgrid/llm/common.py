"""What the operators share: table access, word patterns and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it (Java, RE2 and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master (as in tests) gets a temporary folder, removed at exit; on a cluster that is an
    error, as executors would not see it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quillgrid_scratch", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._quillgrid_scratch = tempfile.mkdtemp(prefix="quillgrid-")
        atexit.register(shutil.rmtree, base, True)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written, by the run that owns them; the run at hand ("" outside any).
_tables: dict[str, list[str]] = {"": []}
_owner = contextvars.ContextVar("owner", default="")


@contextlib.contextmanager
def owned(run: str) -> Iterator[None]:
    """What is written within belongs to a run: only that run's ``forget_tables`` deletes it."""
    mark = _owner.set(_owner.get() or run)
    _tables.setdefault(_owner.get(), [])
    try:
        yield
    finally:
        _owner.reset(mark)


def tables_so_far() -> int:
    return len(_tables[_owner.get()])


def forget_tables(docs: DataFrame, since: int = 0) -> None:
    """Delete the tables that the run at hand has written (after the first ``since``) and that ``docs`` doesn't read.

    For a stage whose predecessors' results have been written elsewhere: theirs are no longer needed.  Outside a run
    nothing goes, as lazy results of other queries may read it.
    """
    spark, own = docs.sparkSession, _tables[_owner.get()]
    if not _owner.get():
        return
    used = "\n".join(docs.inputFiles())
    for path in [p for p in own[since:] if p.rsplit("/", 1)[1] not in used]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        own.remove(path)
    release_shuffles(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor costs no recomputation of what is written.
    """
    path = fresh_path(df.sparkSession, name)
    _tables[_owner.get()].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now, not at the next garbage collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to BATCH_BYTES, where Spark's own bounds are 10,000 rows and 64 MB.

    For the session, as a stage's result runs after the stage has returned; a session's own setting stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def give_back() -> None:
    """Return a Python worker's freed memory to the system; idle workers would hold it beside the next stage's."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def trimming(fn: Callable) -> Callable:
    """A function of batches that gives freed memory back when its task is done."""

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        give_back()

    return run
