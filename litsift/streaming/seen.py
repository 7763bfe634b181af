"""Keys of stored papers (D4): which of a batch are stored, without reading the history.

The sink's batches are the truth; beside them lie *runs*, sorted out of them: the keys of
the batches a to b in buckets by key hash, and a Bloom filter for each bucket. Runs double:
after batch n there is one for each binary digit of n + 1 (20 batches: 0-15 and 16-19), so
a batch meets few runs however long the history is, and each key is rewritten once for
every doubling. A batch first asks the filters, then reads the buckets that may hold one of
its keys; new keys read (nearly) none. A run that is missing is built again from the sink,
so a replayed or interrupted batch needs no repair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a run, and bits of a filter for each key of a run (two of them are set).
BUCKETS, BITS = 16, 16
#: Bits of one bitmap of ``bitmap_construct_agg``.
PART = 32768


def cover(batches: int) -> list[tuple[int, int]]:
    """The runs (first, last batch) that hold the batches 0 to ``batches`` - 1."""
    runs, at = [], 0
    for digit in range(batches.bit_length() - 1, -1, -1):
        if batches >> digit & 1:
            runs.append((at, at + (1 << digit) - 1))
            at += 1 << digit
    return runs


class SeenKeys:
    """The stored keys of a sink with folders ``batch_id=<n>``."""

    def __init__(self, spark: SparkSession, sink: str, key: list[str]):
        self.spark, self.sink, self.key = spark, sink.rstrip("/"), key
        #: (runs, buckets read) of the last batch asked.
        self.read = (0, 0)

    def _path(self, kind: str, run: tuple[int, int]) -> str:
        return f"{self.sink}/_seen/{kind}-{run[0]}-{run[1]}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _keys(self, run: tuple[int, int]) -> DataFrame:
        """The keys of a run from its halves, or from the sink."""
        first, last = run
        middle = (first + last) // 2
        if first < last and all(self._exists(self._path("keys", half) + "/_SUCCESS") for half in ((first, middle), (middle + 1, last))):
            halves = [self.spark.read.parquet(self._path("keys", half)).select(*self.key) for half in ((first, middle), (middle + 1, last))]
            return halves[0].unionByName(halves[1])
        folders = [f for n in range(first, last + 1) if self._exists(f := f"{self.sink}/batch_id={n}")]
        return self.spark.read.parquet(*folders).select(*self.key) if folders else None

    def build(self, run: tuple[int, int]) -> None:
        """Writes a run unless it is there."""
        if self._exists(self._path("filters", run) + "/_SUCCESS"):
            return
        keys = self._keys(run)
        if keys is None:
            return
        h = self._hash()
        placed = keys.withColumn("bucket", F.pmod(h, F.lit(BUCKETS)).cast("int"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("keys", run))
        stored = self.spark.read.schema(placed.schema).parquet(self._path("keys", run))
        parts = stored.count() * BITS // (BUCKETS * PART) + 1
        bits = stored.select("bucket", F.explode(F.array(*self._bits(parts))).alias("bit"))
        filters = bits.groupBy("bucket", F.expr(f"bit div {PART}").alias("part")).agg(
            F.bitmap_construct_agg(F.col("bit") % PART).alias("bits"))
        filters.withColumn("parts", F.lit(parts).cast("long")).write.mode("overwrite").parquet(self._path("filters", run))

    def _bits(self, parts: int | Column) -> list[Column]:
        """The two bits of a key in its bucket's filter of ``parts`` bitmaps."""
        size = F.lit(parts).cast("long") * PART if isinstance(parts, int) else parts * PART
        return [F.pmod(F.xxhash64(self._hash(), F.lit(i)), size) for i in (1, 2)]

    def _may_hold(self, keys: DataFrame, runs: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
        """For each run the buckets that may hold one of the keys: (runs x BUCKETS) numbers at most."""
        filters = None
        for i, run in enumerate(runs):
            one = self.spark.read.parquet(self._path("filters", run)).select(F.lit(i).alias("run"), "bucket", "part", "parts", "bits")
            filters = one if filters is None else filters.unionByName(one)
        sizes = filters.select("run", "bucket", "parts").distinct()  # BUCKETS rows a run
        hashed = keys.select(self._hash().alias("h"), *self.key).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
        asked = hashed.join(F.broadcast(sizes), "bucket").select("h", "run", "bucket", F.explode(F.array(*self._bits(F.col("parts")))).alias("bit"))
        asked = asked.select("h", "run", "bucket", F.expr(f"bit div {PART}").alias("part"), (F.col("bit") % PART).cast("int").alias("at"))
        byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
        is_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, at % 8)")) != 0, F.lit(False))
        found = asked.join(filters.drop("parts"), ["run", "bucket", "part"], "left").groupBy("run", "bucket", "h").agg(F.min(is_set).alias("held"))
        hits = found.where("held").select("run", "bucket").distinct().collect()
        out: dict[tuple[int, int], list[int]] = {}
        for r in hits:
            out.setdefault(runs[r.run], []).append(r.bucket)
        return out

    def unseen(self, papers: DataFrame, batch_id: int) -> DataFrame:
        """The papers whose key no batch before ``batch_id`` has stored."""
        runs = cover(batch_id)
        for run in runs:
            self.build(run)
        runs = [run for run in runs if self._exists(self._path("filters", run) + "/_SUCCESS")]
        hits = self._may_hold(papers, runs) if runs else {}
        self.read = len(runs), sum(map(len, hits.values()))
        for run, buckets in hits.items():
            held = self.spark.read.parquet(self._path("keys", run)).where(F.col("bucket").isin(buckets)).select(*self.key)
            papers = papers.join(held, self.key, "left_anti")
        return papers
