"""What the operators of this package share: staged tables, row keys, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a null id, which sorts last.
NO_ID = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a local master gets a temporary folder; a cluster is an error, as its
    machines don't see each other's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The tables that each scratch() this thread is in has staged and will remove, innermost last.
_RUNS: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())
#: Folders of applications that are marked for removal.
_FOLDERS: set[str] = set()


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that are staged inside when it ends, also by an error. Each has a list of its own, so
    what another one staged, before, outside or in another thread, stays. Tables staged with keep=True go
    with the scratch() around this one, or with the application if there is none."""
    mine: list[str] = []
    token = _RUNS.set((*_RUNS.get(), mine))
    try:
        yield
    finally:
        _RUNS.reset(token)
        for path in mine:
            remove(spark, path)


def scratched(operator):
    """An operator whose staged tables go before it returns, but for those it keeps; its first argument is a
    DataFrame."""

    @wraps(operator)
    def run(df, *args, **named):
        with scratch(df.sparkSession):
            return operator(df, *args, **named)

    return run


def remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which is removed when the application ends."""
    folder = f"{shared_dir(spark)}/quarryline/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(whole)
        system.deleteOnExit(whole)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    keep: the table outlives the scratch() it is staged in. All go when the application ends.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    runs = _RUNS.get()
    if runs[keep:]:
        runs[-1 - keep].append(path)
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than a thousandth of a join's rows, and LEAST_HOT at least, is hot; so there are fewer than HOT.
HOT, LEAST_HOT = 1000, 1000


def split_join(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """rows that have one of keys (on, which is unique, and c: how many of rows have it) with its columns.

    Rows of a hot key would meet in one task of a shuffle; they find their key in a broadcast table of fewer
    than HOT rows and stay where they are. Both tables are read more than once, so they should be staged.
    """
    # the same plan at every size: keys grow with the rows, so Spark is not to broadcast them while they are few
    hot = F.col("c") > max((keys.agg(F.sum("c")).first()[0] or 0) // HOT, LEAST_HOT)
    if keys.filter(hot).isEmpty():
        return rows.join(keys.hint("merge"), on)
    many = F.broadcast(keys.filter(hot))
    few = rows.join(F.broadcast(keys.filter(hot).select(on)), on, "left_anti").join(keys.filter(~hot).hint("merge"), on)
    return few.unionByName(rows.join(many, on).select(few.columns))


def row_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends Python workers 1000 rows at a time unless its user has set a number: the
    10000 of Spark's default can be gigabytes of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def clipped_batches(batch, most_bytes: int = 16 << 20):
    """Slices of an Arrow batch whose buffers hold about most_bytes at most (one row at least)."""
    rows = batch.num_rows
    step = max(1, int(rows * most_bytes / max(batch.nbytes, 1))) if rows else 1
    for at in range(0, rows, step):
        yield batch.slice(at, step)


class Remembered(dict):
    """What has been found out about words, for two generations of `most` words each: a word that is not
    asked for while `most` others are new is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def unknown(self, words: set) -> list:
        """The words to find out about; all others of them are in self afterwards."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
            new = list(words)
        if not self.old:
            return new
        old, out = self.old, []
        for w in new:
            if w in old:
                self.promote(w)
            else:
                out.append(w)
        return out

    def promote(self, word) -> None:
        self[word] = self.old[word]


def trim() -> None:
    """Returns the memory that this process no longer uses to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back:
        give_back(0)


def trim_driver(spark: SparkSession) -> None:
    """trim() of the driver's Python, and the same of its JVM, if that has the command. A plan of many exchanges
    starts a thread for each and compiles much; what they have allocated beside the heap would stay."""
    trim()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values = (name, "systemTrimNativeHeap", new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0))
        kinds, args = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for k, (kind, value) in enumerate(zip(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"), values)):
            kinds[k], args[k] = jvm.java.lang.Class.forName(kind), value
        # by the interface, as the server's class is not open to reflection
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM or system without it
        pass


def tidied(run):
    """A function over Arrow batches that returns the memory it no longer uses to the system when it ends,
    as its worker may then be idle beside other tasks for long."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


_CACHE: dict = {}


def only_cache(key, make):
    """A worker's cache under key, made if it is not there; another key's cache is dropped first, so that a
    worker that serves several operators holds one at a time."""
    if key not in _CACHE:
        _CACHE.clear()
        gc.collect()
        _CACHE[key] = make()
    return _CACHE[key]


def with_fields(df: DataFrame, *fields: str) -> StructType:
    """df's schema and the fields, each given as "name type"."""
    out = StructType(list(df.schema.fields))
    for field in fields:
        out.add(*field.split())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
