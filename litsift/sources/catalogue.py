"""The catalogue snapshot (the remote paper index, as a table) and its stored keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from litsift.operators.lookup import catalogue_index
from litsift.schemas import CATALOGUE

#: Files (and tasks of a join) of a stored key table.
BUCKETS = 64


def read_catalogue(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(CATALOGUE)
    return reader.format(fmt).load(path)


def write_key_table(catalogue: DataFrame, path: str, name: str, buckets: int = BUCKETS, self_col: str | None = None) -> None:
    """The catalogue's lookup keys, bucketed and sorted by normalised title under ``path``, as
    the table ``name``. Lookups that pass it as ``index`` shuffle papers only."""
    keys = catalogue_index(catalogue, self_col)
    keys.repartition(buckets, "nkey").write.mode("overwrite").bucketBy(buckets, "nkey").sortBy("nkey").option("path", path).saveAsTable(_named(name))


def read_key_table(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """A stored key table; a session whose catalog doesn't know it gets it from its files."""
    if not spark.catalog.tableExists(_named(name)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (nkey) SORTED BY (nkey) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def _named(name: str) -> str:
    if not re.fullmatch(r"\w+(\.\w+)?", name):
        raise ValueError(f"not a table's name: {name}")
    return name
