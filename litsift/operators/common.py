"""Shared plan helpers: top-k per group, numbering, hot keys and size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.session import scratch_path

#: Bytes of the largest side that is broadcast, as measured.
MAX_BROADCAST_BYTES = 64 << 20


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Rows ranked ``1..k`` per ``part`` by ``order``.

    The ``row_number() <= k`` filter is planned as WindowGroupLimit (partial, before the
    shuffle, and final), so a hot partition key ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "place", group: list[str] | None = None) -> DataFrame:
    """Adds ``name``, each row's place (from 1) by ``order`` within its group (null-free columns;
    default: all rows), and ``<name>_of``, the number of rows there.

    Rows are dealt out by ranges, sorted and written with their place in their task; one small
    row for each task and group then gives the offsets. So no window takes a whole group, and
    a group that holds a third of all rows is spread like any other.
    """
    group = group or []
    keys = [F.col(g) for g in group] + order
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(dealt, "numbered").withColumn("_task", F.shiftright("_at", 33))
    sizes = rows.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
                          F.sum("_n").over(own).alias(f"{name}_of"))
    return rows.join(shifts, [*group, "_task"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


#: Keys that a sketch of hot keys follows, and how finely a hot key is split.
HOT_KEYS, SPLIT = 64, 4


def join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on string ``keys`` that may be hot on both sides: keys with more rows of
    ``left`` than a mean partition (found by a sketch of the most frequent ones) are split by
    salt there, and their rows of ``right`` are copied to every salt."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("\x1f", *keys)
    seen = left.select(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {HOT_KEYS}, {HOT_KEYS * 100})").alias("top")).first()
    hot = [t["item"] for t in seen["top"] or [] if t["count"] * parts > seen["n"]]
    if not hot or parts == 1:
        return left.join(right, keys)
    salts = F.when(key.isin(*hot), F.lit(parts * SPLIT)).otherwise(F.lit(1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def measured_bytes(df: DataFrame) -> int:
    """The bytes of all values of ``df``, about: strings and nested values as text, 8 for each other one."""
    plain = {"long", "int", "double", "float", "boolean", "date", "timestamp", "short", "byte"}
    size = [F.lit(8) if f.dataType.typeName() in plain or f.dataType.simpleString() == "bigint" else
            F.coalesce(F.octet_length(F.col(f"`{f.name}`") if f.dataType.typeName() == "string" else F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
            for f in df.schema.fields]
    return df.agg(F.sum(sum(size[1:], size[0]).cast("long"))).first()[0] or 0


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size is within the bound; else as it is, and
    the join shuffles (with AQE's skew handling). The result is the same."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back (cuts the lineage;
    each consumer reads only the columns it needs).

    Used where one result feeds several consumers (where a model is called, it is so paid
    once), or where codegen would otherwise re-evaluate a per-row expression once per joined
    pair (a Project's deterministic expressions are evaluated where the consumer first uses
    them, e.g. inside a nested-loop join's inner loop).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
