"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks and racks in regions, in the order of their numbers. Each shard draws
-ln(u) / weight for a row, u being a hash of the shard's number and the row's key. A rack's
draw is the least of its shards', a region's the least of its racks': so a node's draw has
the sum of the weights below it as its rate. A row descends to the region, the rack and the
shard of the least draw, and shares are in proportion to the weights at every level.

A changed weight changes the draws on the way to its shard alone. Rows move only between
that shard and others: into it if its weight grew, out of it if it fell. The tree of n shards
is part of that of n + 1 shards, so one more shard takes rows only into itself, whatever
rack it stands in. A row costs one draw for each shard.

Law ``key``: the key and the shard count decide. Defined results: rows with a null key all
draw alike and share a shard; a null text counts no bytes; a shard of weight 0 gets no rows;
repeated rows go to one shard and get slots of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import written

#: Shards of a rack and racks of a region.
RACK, REGION = 4, 2
#: Rows of a bucket in which slots are counted, about.
BUCKET = 200_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def layout(shards: int) -> list[list[list[int]]]:
    """Regions of racks of shards 0 to ``shards`` - 1."""
    racks = [list(range(a, min(a + RACK, shards))) for a in range(0, shards, RACK)]
    return [racks[a:a + REGION] for a in range(0, len(racks), REGION)]


def _draw(shard: int, weight: float, key: Column) -> Column:
    """struct(draw, shard) of a shard."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(f"shard/{shard}"), key), 11).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def _descent(node: list | int, weights: Sequence[float], key: Column) -> Column | None:
    """struct(draw, shard) of the least draw below a node; None if nothing there has a weight."""
    if isinstance(node, int):
        return _draw(node, weights[node], key) if weights[node] > 0 else None
    below = [x for x in (_descent(child, weights, key) for child in node) if x is not None]
    return F.array_min(F.array(*below)) if below else None


def assign(rows: DataFrame, key: str, tree: list[list[list[int]]], added: int = 0, weights: Sequence[float] | None = None) -> DataFrame:
    """Adds ``shard``, ``rack`` and ``region`` and, where shards are ``added``, ``grown_shard``:
    the shard when these have joined the tree. ``weights``: of all shards, by number (1 each)."""
    places = {shard: (r, sum(map(len, tree[:r])) + k) for r, racks in enumerate(tree) for k, rack in enumerate(racks) for shard in rack}
    n = len(places)
    weights = [1.0] * (n + added) if weights is None else weights
    if len(weights) != n + added or min(weights) < 0 or not sum(weights[:n]):
        raise ValueError("one weight for each shard, not negative and not all 0")
    found = _descent(tree, weights, F.col(key))
    place = lambda i: F.get(F.array(*[F.lit(places[x][i]) for x in range(n)]), F.col("shard"))
    out = rows.withColumn("shard", found["shard"]).withColumn("region", place(0)).withColumn("rack", place(1))
    if added:
        new = _descent(list(range(n, n + added)), weights, F.col(key))
        out = out.withColumn("grown_shard", F.col("shard") if new is None else F.least(found, new)["shard"])
    return out


def _slots(rows: DataFrame, times: str) -> DataFrame:
    """Adds ``slot``: rows (each standing for ``times`` equal ones) numbered gaplessly within their shard, by buckets of bounded size."""
    total = rows.agg(F.sum(times)).first()[0] or 0
    buckets = total // BUCKET + 1
    cut = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    sizes = cut.groupBy("shard", "_bucket").agg(F.sum(times).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_at", F.coalesce(F.sum(times).over(inside), F.lit(0))).join(offsets, ["shard", "_bucket"])
    start = F.col("_offset") + F.col("_at")
    return placed.withColumn("slot", F.explode(F.sequence(start, start + F.col(times) - 1))).drop("_bucket", "_at", "_offset", times)


def shard_documents(docs: DataFrame, shards: int = 24, added: int = 1, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack: one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times")), "doc_id", layout(shards), added, weights)
    if not added:
        rows = rows.withColumn("grown_shard", F.lit(None))
    placed = _slots(written(rows, "shards"), "times")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.col("grown_shard").cast("int").alias("grown_shard"), F.col("region").cast("int").alias("region"), F.col("rack").cast("int").alias("rack"))
