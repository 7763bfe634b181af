"""Merkle manifest of a dataset by slot pivot.

Each row is a leaf. The leaves of a part (all rows of one ``lang``) are put in order, and a
tree over them gives the part's subroot; a tree over the subroots gives the root. A tree is
built in blocks of ``levels`` levels: conditional aggregates spread the ``fanout ** levels``
nodes under a block's top into as many slot columns, runs of ``fanout`` columns are
concatenated and hashed into the columns of the next level, and a node's siblings are its
run without its own slot. The way down joins each block with the siblings above it and
turns its slots back into rows, so a leaf meets its proof without a join of its own.

Places are counted over range partitions (``ordered``), and every aggregate and join goes by
(part, block): no part meets in one task, however large its share. The driver learns one
number, the size of the largest part.

Defined results: a null field is hashed as ``-``; null ``lang`` is a part of its own and the
first one; null ids come first in their part; rows of one id are ordered by their leaf,
equal rows in any order (they give the same rows). An empty table has no rows. Columns
other than FIELDS are not read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import ordered, written

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes in a run, and levels of the tree in a block of slot columns.
FANOUT, LEVELS = 2, 4
#: A row is tampered with where this divides the CRC-32 of its id.
TAMPER = 7
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A field by its UTF-8 byte count and value; ``-`` if it is null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return digest(*[framed(changed.get(c, F.col(c))) for c in FIELDS])


def tampered() -> Column:
    """The leaf after n_chars grew by one; null where the row is left as it is."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))


def _height(size: Column, fanout: int) -> Column:
    """Levels above ``size`` nodes: how many powers of the fanout are less than it."""
    powers = [fanout ** i for i in range(64) if fanout ** i < 2 ** 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < size))


def _block(nodes: DataFrame, first: int, fanout: int, levels: int) -> DataFrame:
    """(part, size, pos, node) with node.h -> one row a block: its nodes by slot, those of the
    levels above as n<level>_<slot>, and h, its top. ``first``: the level of ``nodes``."""
    width = fanout ** levels
    slot = F.col("pos") % width
    found = nodes.groupBy("part", "size", F.expr(f"pos div {width}").alias("block")).agg(
        *[F.max(F.when(slot == s, F.col("node"))).alias(f"s{s}") for s in range(width)])
    found = found.select("*", _height(F.col("size"), fanout).alias("height"), *[F.col(f"s{s}.h").alias(f"n0_{s}") for s in range(width)])
    for level in range(levels):
        tops = []
        for s in range(width // fanout ** (level + 1)):
            run = [F.col(f"n{level}_{s * fanout + i}") for i in range(fanout)]
            up = F.when(run[0].isNotNull(), digest(*[F.coalesce(x, F.lit("")) for x in run]))
            tops.append(F.when(F.col("height") > first + level, up).otherwise(run[0]).alias(f"n{level + 1}_{s}"))
        found = found.select("*", *tops)
    return found.withColumnRenamed(f"n{levels}_0", "h")


def _siblings(slot: int, first: int, fanout: int, levels: int) -> Column:
    """The runs from a slot to the block's top, without the nodes on the way."""
    steps = []
    for level in range(levels):
        own = slot // fanout ** level
        run = [F.coalesce(F.col(f"n{level}_{own - own % fanout + i}"), F.lit("")) for i in range(fanout)]
        side = lambda xs: F.concat(*xs) if xs else F.lit("")
        step = F.struct(side(run[:own % fanout]).alias("left"), side(run[own % fanout + 1:]).alias("right"))
        steps.append(F.when(F.col("height") > first + level, step))
    return F.array_compact(F.array(*steps))


def build(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """(part, size, pos, node) -> the written block tables from the lowest to that of the tops."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tables, width = [], fanout ** levels
    while True:
        tables.append(written(_block(nodes, levels * len(tables), fanout, levels), "merkle-blocks"))
        if width ** len(tables) >= largest:
            return tables
        nodes = tables[-1].select("part", "size", F.col("block").alias("pos"), F.struct("h").alias("node"))


def proofs(tables: list[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """part, pos, node and ``path`` (its siblings up to the root) of every node, and the
    columns of ``above``: (part, path, ...), what stands over each part's top."""
    rest = [c for c in above.columns if c not in ("part", "path")]
    over = above.withColumn("block", F.lit(0).cast("long"))
    for depth in range(len(tables) - 1, -1, -1):
        blocks = tables[depth].join(over, ["part", "block"])
        slots = F.array_compact(F.array(*[
            F.when(F.col(f"s{s}").isNotNull(),
                   F.struct((F.col("block") * fanout ** levels + s).alias("pos"), F.col(f"s{s}").alias("node"),
                            _siblings(s, levels * depth, fanout, levels).alias("inner"))) for s in range(fanout ** levels)]))
        out = blocks.select("part", "path", *rest, F.explode(slots).alias("x"))
        out = out.select("part", "x.pos", "x.node", F.concat("x.inner", "path").alias("path"), *rest)
        over = out.select("part", "path", F.col("pos").alias("block"), *rest)
    return out


def _tops(tables: list[DataFrame]) -> DataFrame:
    return tables[-1].where("block = 0").select("part", "h")


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, shown (the tampered leaf, null where the row was left), subroot, root and
    path, the siblings from the leaf to the root as an array of (left, right) hex digests."""
    part = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before all others, the rest bytewise
    leaves = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), leaf().alias("h"), tampered().alias("shown")), "merkle-leaves")
    placed = ordered(leaves, "part", ["doc_id", "h"], "merkle-order")
    trees = build(placed.select("part", "size", "pos", F.struct("h", "doc_id", "shown").alias("node")), fanout, levels)
    subroots = _tops(trees).select(F.lit("").alias("part"), F.struct("h", F.col("part").alias("of")).alias("node"))
    listed = ordered(subroots.withColumn("of", F.col("node.of")), "part", ["of"], "merkle-parts")
    crown = build(listed.select("part", "size", "pos", "node"), fanout, levels)
    above = proofs(crown, _tops(crown).select("part", F.expr(f"cast(array() as array<{STEP}>)").alias("path"), F.col("h").alias("root")), fanout, levels)
    above = above.select(F.col("node.of").alias("part"), "path", F.col("node.h").alias("subroot"), "root")
    return (proofs(trees, above, fanout, levels)
            .select("node.doc_id", F.col("node.h").alias("leaf"), "node.shown", "subroot", "root", "path"))


def folded(leaf: str | Column, path: str = "path") -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def verify(found: DataFrame) -> DataFrame:
    """The manifest checked row by row against what is shown now."""
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return (found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                         folded(F.coalesce("shown", "leaf")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
