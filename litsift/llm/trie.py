"""Prefix trie of conversations by Spark SQL ROLLUP.

Every conversation is a row of positional columns t1 to t8, one for each turn. GROUP BY
ROLLUP over them, told apart by grouping_id, aggregates all prefixes of up to eight turns at
once: each group is a node. Longer conversations go on in further rows of eight columns
(blocks), grouped under the key of the node that the block before ended in.

A turn's id is 128 bits over its place, role and text, as four numbers of 32 bits. A node's
key is its depth and the four sums of the ids down to it, so the keys of all blocks follow
from running sums and no block has to wait for the one before. (Sums of one depth are equal
for different prefixes with a chance of about 2 to the -128.)

Sums over subtrees take one more ROLLUP. A node belongs to its smallest member. The members
of a node other than its owner own nodes below it only, so the sum over its subtree is that
of all its members' own nodes, less what its owner owns above it.

No conversation, node or list of members meets in one task whole: turns are numbered over
range partitions, running sums go by lots, counts are aggregated before the shuffle. The
contract hashes each node's list of ids as one text, which only one process can do; it gets
the ids as ready pieces of text in order and keeps the state of the hash alone.

Defined results: rows without a conv_id take no part. Null role and text are empty. Turns
with one number are in the order of SHA-256 of their byte count of role, ``:``, role and
text. Repeated rows are turns of their own. No rows give no nodes. Other columns are not
read. ``conv_id % shared`` has the sign of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import map_arrow, ordered, written

#: Turns in a block.
WIDTH = 8
#: Blocks or depths that a running sum takes at once.
LOT = 1024
#: Ids in a piece of a node's list.
PIECE = 50_000
LANES = ["a", "b", "c", "d"]
KEY = ["depth", *LANES]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), size (of the conversation), mark, n: the turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.length(text).cast("long").alias("n"))
    return written(ordered(rows, "conv_id", ["turn", "mark"], "trie-order").drop("turn"), "trie-turns")


def rebuilt(own: DataFrame, shared: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(ids, turns): each conversation c begins with the first h turns of c - c % shared and
    goes on with its own after its first h, h being its CRC-32 modulo ``heads``."""
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("of", F.expr(f"conv_id - conv_id % {shared}"))
    first = own.where("conv_id = of").select("of", F.col("pos").alias("at"), "mark", "n", F.col("size").alias("there"))
    ids = own.where("pos = 0").select("conv_id", "h", "of")
    taken = ids.join(first.where(F.col("at") < heads), "of").where("at < h").select("conv_id", F.col("at").alias("pos"), "mark", "n")
    kept = (own.where("pos >= h").join(first.where("at = 0").select("of", "there"), "of", "left")
            .select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("pos"), "mark", "n"))
    return ids.select("conv_id"), taken.unionByName(kept)


def running(df: DataFrame, key: str, at: str, sums: list[str]) -> DataFrame:
    """Adds before_<s>: the sum of s over the rows of the key with a smaller ``at`` (a place
    that no other row of the key has), summed by lots."""
    rows = df.withColumn("_lot", F.expr(f"{at} div {LOT}"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lots = until(Window.partitionBy(key).orderBy("_lot"))
    inner = until(Window.partitionBy(key, "_lot").orderBy(at))
    starts = rows.groupBy(key, "_lot").agg(*[F.sum(s).alias(s) for s in sums]).select(
        key, "_lot", *[F.coalesce(F.sum(s).over(lots), F.lit(0)).alias(f"_from_{s}") for s in sums])
    summed = rows.join(starts, [key, "_lot"])
    return summed.select(*df.columns, *[(F.col(f"_from_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"before_{s}") for s in sums])


def blocks(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, block, the key's lanes of the node that it continues, and its turns t1 to t8
    as structs of lanes and code points. Every conversation has a first block, turns or none."""
    bits = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("mark")))
    lanes = [F.conv(F.substring(bits, 1 + 8 * i, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(LANES)]
    cells = rows.select("conv_id", F.expr(f"pos div {WIDTH}").alias("block"), (F.col("pos") % WIDTH).alias("slot"), F.struct(*lanes, "n").alias("id"))
    empty = ids.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("slot"),
                       F.lit(None).cast(cells.schema["id"].dataType).alias("id"))
    slots = [F.max(F.when(F.col("slot") == i, F.col("id"))).alias(f"t{i + 1}") for i in range(WIDTH)]
    sums = [F.coalesce(F.sum(f"id.{x}"), F.lit(0)).alias(x) for x in LANES]
    found = cells.unionByName(empty).groupBy("conv_id", "block").agg(*slots, *sums, F.count("id").alias("filled"))
    found = running(found, "conv_id", "block", LANES)
    ends = [(F.col(f"before_{x}") + F.col(x)).alias(f"end_{x}") for x in LANES]
    return written(found.select("conv_id", "block", *[F.col(f"before_{x}").alias(x) for x in LANES], *ends, "filled",
                                *[f"t{i + 1}" for i in range(WIDTH)]), "trie-blocks")


def rollup(rows: DataFrame, *sums: str) -> DataFrame:
    """All prefixes of all blocks with the aggregates ``sums``: KEY, the parent's depth and
    lanes as up_<name>, n (code points of the last turn; null at the root)."""
    t = [f"t{i + 1}" for i in range(WIDTH)]
    found = rows.sparkSession.sql(
        f"SELECT block, {', '.join(LANES)}, {', '.join(t)}, grouping_id() AS level, {', '.join(sums)} "
        f"FROM {{rows}} GROUP BY block, {', '.join(LANES)}, ROLLUP({', '.join(t)})", rows=rows)
    within = WIDTH - F.bit_count("level")
    last = F.get(F.array(*t), within - 1)
    found = found.select("*", within.cast("long").alias("within"), last.alias("last"))
    found = found.where(F.col("last").isNotNull() | ((F.col("within") == 0) & (F.col("block") == 0)))

    def total(x: str) -> Column:
        return sum((F.coalesce(F.col(f"{c}.{x}"), F.lit(0)) for c in t), F.col(x))

    depth = F.col("block") * WIDTH + F.col("within")
    above = F.col("last").isNotNull()
    named = [c.split(" AS ")[1] for c in sums]
    return found.select(depth.alias("depth"), *[total(x).alias(x) for x in LANES],
                        F.when(above, depth - 1).alias("up_depth"), *[F.when(above, total(x) - F.col(f"last.{x}")).alias(f"up_{x}") for x in LANES],
                        F.col("last.n").alias("n"), *named)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (KEY, conv_id) -> (KEY, first, ids): the ids of a node as pieces of text."""
    open_key, ids = None, []

    def piece():
        columns = [[x] for x in (*open_key, ids[0], ",".join(map(str, ids)))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:-1]] + [pa.array(columns[-1], pa.string())],
                                          names=[*KEY, "first", "ids"])

    for batch in batches:
        for *key, conv_id in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv_id")]):
            if ids and (key != open_key or len(ids) >= PIECE):
                yield piece()
                ids = []
            open_key = key
            ids.append(conv_id)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (KEY, ends_sha256); of a node only the state of its hash is kept."""
    key, state = None, None
    for batch in batches:
        done = []
        for *now, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
            if now != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield _table(done)
    if state is not None:
        yield _table([(*key, state.hexdigest())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    *key, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in key] + [pa.array(text, pa.string())], names=[*KEY, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(KEY of the node in which it ends, conv_id) -> (KEY, ends_sha256), by ascending id."""
    key = ", ".join(f"{x} long" for x in KEY)
    dealt = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = map_arrow(dealt, _pieces, f"{key}, first long, ids string")
    return map_arrow(pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first"), _hashed, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: int = 100, heads: int = 6) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = blocks(*rebuilt(turns(conversations), shared, heads))
    nodes = rollup(rows, "count(1) AS n_convs", "min(conv_id) AS conv_id")
    nodes = written(nodes.withColumn("own", F.coalesce((F.col("n_convs") - 1) * F.col("n"), F.lit(0))).drop("n"), "trie-nodes")

    up = [F.col(f"up_{x}").alias(x) for x in KEY]
    children = nodes.where("up_depth is not null").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "trie-children")

    owned = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    below = rollup(rows.join(owned, "conv_id", "left").na.fill(0, ["saved", "leaves"]), "sum(saved) AS saved", "sum(leaves) AS n_leaves")
    parents = nodes.select(*[F.col(x).alias(f"up_{x}") for x in KEY], F.col("conv_id").alias("parent_conv_id"))
    last = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    ended = rows.select("conv_id", "block", (F.col("block") * WIDTH + F.col("filled")).alias("depth"), *[F.col(f"end_{x}").alias(x) for x in LANES])
    ended = ended.withColumn("nth", F.row_number().over(last)).where("nth = 1").select(*KEY, "conv_id")
    found = (running(nodes, "conv_id", "depth", ["own"])
             .join(parents, [f"up_{x}" for x in KEY], "left")
             .join(below.select(*KEY, "saved", "n_leaves"), KEY)
             .join(ends(ended), KEY, "left"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        (F.col("saved") - F.col("before_own")).alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
