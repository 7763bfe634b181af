"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsift.session import scratch_path, ship_package

#: Texts are worked on in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 2_000_000
#: Entries of each of the two generations of a worker's memo of words.
MEMO_ENTRIES = 150_000
#: Longer words are not kept in a memo.
MEMO_WORD = 64

#: Seeds of the folds: a row is held out when this remainder is 0.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS, is 0. A null id is held out (never trained on)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Tables that ``written`` makes inside are removed at the end: what is to stay must have been stored by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for name in _PASSING.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, read back: its rows are
    fixed from here on, whatever executor is lost later."""
    path = scratch_path(df.sparkSession, name)
    if _PASSING:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of all other columns: so their names clash with none of an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))


def restored(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from carried ``rows``, in their order; ``changed`` gives some of them anew."""
    def column(c: str):
        if c in changed:
            return changed[c]
        return F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c)

    return rows.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers. A worker that comes to
    it from another operator's tasks first lets go of what those remembered (``owner``: the
    operator's module, that of ``fn`` unless given), and gives back what a task has freed."""
    ship_package(df.sparkSession)
    owner = owner or fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make``.

    It holds a bounded number of entries: when it is full, its entries become the old
    generation, from which those that are asked for again come back.
    """

    def __init__(self, make: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if isinstance(key, int) or len(key) <= MEMO_WORD:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_OWN: dict = {}


def forget(owner: str) -> None:
    """Drops what ``once`` keeps for operators in other modules than ``owner``."""
    others = [key for key in _OWN if key[0].__module__ != owner]
    for key in others:
        del _OWN[key]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers stay alive between tasks and stages, and
    would keep what the largest of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def once(make: Callable, *args):
    """``make(*args)``, made once in each worker process: its memo serves all tasks that the process runs."""
    key = (make, *args)
    if key not in _OWN:
        _OWN[key] = make(*args)
    return _OWN[key]


def groups(batches: Iterator[pa.RecordBatch], size: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        ends = np.cumsum([n or 0 for n in pa.compute.binary_length(text).to_pylist()])
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: ``values`` cut into runs of ``lengths``."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def numbered(df: DataFrame, key: str, name: str, out: str, make: Callable | None = None, made: str | None = None) -> DataFrame:
    """Adds ``out``: within each value of the int column ``key`` (null-free, few values) the
    rows are numbered from 0 without gaps.

    make: a function for ``map_arrow`` with the result ``made``; what it makes of ``df`` is
    numbered in the same pass, which takes one Python worker a task instead of two.

    Each task numbers its own rows as they stream by; the result is written once, so those
    numbers stay as they are. The sizes per task and key are then turned into offsets (one
    small row for each task and key) and added. No key's rows meet in one task, however
    large its share.
    """
    fields = T.StructType.fromDDL(made).fields if make else df.schema.fields
    schema = T.StructType([*fields, T.StructField("_task", T.LongType()), T.StructField("_at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in make(batches) if make else batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            found, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
            at = np.empty(len(keys), np.int64)
            for k, f, n in zip(found.tolist(), first.tolist(), counts.tolist()):
                at[order[f:f + n]] = seen.get(k, 0) + np.arange(n)
                seen[k] = seen.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), task)), pa.array(at)],
                                             names=[*batch.schema.names, "_task", "_at"])

    rows = written(map_arrow(df, number, schema, make.__module__ if make else None), name)
    sizes = rows.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (rows.join(offsets, [key, "_task"])
            .withColumn(out, F.col("_offset") + F.col("_at")).drop("_task", "_at", "_offset"))


def ordered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the row's place in its group (from 0, without gaps) by ``order``, nulls
    first, and ``size``, the number of rows of the group (a null-free column).

    Rows are dealt out by ranges of (group, order), sorted and written with their place in
    their task; rows that are equal in all of these are told apart by where they were read,
    so that no run of them is too long for a task. The sizes per task and group (one row for
    each) then give the offsets.
    """
    keys = [group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_task", F.shiftright("_at", 33))
    sizes = rows.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                          F.sum("_n").over(own).alias("size"))
    return rows.join(shifts, [group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")
