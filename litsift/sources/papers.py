"""Stored papers (typed table, Parquet/CSV sink and scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsift.functions.mail import parse_rfc2822
from litsift.operators.filters import require_columns

REQUIRED = ["title", "authors"]


def to_papers(df: DataFrame, require_rows: bool = False) -> DataFrame:
    """Typed papers. ``title``/``authors`` must exist (checked at plan time);
    ``email_date`` -> timestamp and ``relevance`` -> double, bad values -> NULL.

    ``require_rows=True`` also raises on an empty input; that check costs a (cheap, LIMIT 1)
    job, so it is opt-in.
    """
    require_columns(df, REQUIRED)
    if require_rows and df.isEmpty():
        raise ValueError("the input has no papers")
    out = df
    if "email_date" in df.columns:
        dt = df.schema["email_date"].dataType
        if isinstance(dt, T.StringType):
            s = F.col("email_date")
            # RFC 2822 first, then ISO-like strings.
            out = out.withColumn("email_date", F.coalesce(parse_rfc2822(s), F.try_to_timestamp(s)))
    if "relevance" in df.columns:
        out = out.withColumn("relevance", F.col("relevance").cast("string").try_cast("double"))
    return out


def _csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


#: Bytes of a row group in files that are sorted for look-ups by id, and ids that a file's filter is made for.
LOOKUP_GROUP, LOOKUP_IDS = 1 << 20, 1_000_000


def write_papers(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, sorted_by: str | None = None) -> None:
    """S3: write papers. Parquet keeps types; CSV joins arrays with ", ".

    sorted_by: an id column that single papers will be looked up by. Files then hold ranges
    of it, in small row groups with statistics and a Bloom filter of the ids.
    """
    if sorted_by:
        df = df.repartitionByRange(sorted_by).sortWithinPartitions(sorted_by)
    w = (_csv_ready(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
        return
    if sorted_by:
        w = (w.option("parquet.block.size", LOOKUP_GROUP).option(f"parquet.bloom.filter.enabled#{sorted_by}", "true")
             .option(f"parquet.bloom.filter.expected.ndv#{sorted_by}", LOOKUP_IDS))
    w.format(fmt).save(path)


def read_papers(spark: SparkSession, path: str, schema: T.StructType | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Scan stored papers (a missing path raises ``AnalysisException``)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)
