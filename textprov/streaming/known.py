"""Which texts a growing table holds already, without reading the table.

Texts are known by their hash (a hexadecimal string), the table is partitioned by the first digits of it. Beside the table
lies an index: per partition, Bloom filters in blocks of 32,768 bits, as bitmaps that merge by OR; each batch adds its own
bitmaps. A batch meets the filter blocks of its own hashes by an equality join. Hashes that miss a bit are new for sure;
only the others, and only the partitions they fall in, are looked up in the table itself, exactly. A filter that says too
much costs a lookup and changes no result.

The filter is written before the table: a batch that was stopped in between finds its bits, looks its hashes up, and adds
its rows. With five bits a hash, a block of 2,500 hashes has 0.3 % false positives (by formula); ``bits`` is set per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 15  # what one bitmap of the built-in functions holds
FILTER_SCHEMA = "block bigint, bits binary, prefix string"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


class KnownTexts:
    """The table ``target`` and its index.

    ``digits`` hexadecimal digits name a partition: 16 partitions, or 4,096 with three digits for a table of billions, where
    a batch of a few thousand texts then reads a few of them. ``bits`` is the size of a partition's filter.
    """

    def __init__(self, spark: SparkSession, target: str, index: str | None = None, digits: int = 1, bits: int = 1 << 20, hashes: int = 5) -> None:
        self.spark, self.target, self.index = spark, target, index or target.rstrip("/") + "_index"
        self.digits, self.blocks, self.hashes = digits, max(1, bits // BLOCK_BITS), hashes

    def prefix(self, key: Column | str) -> Column:
        """Partition of a hash; the letter keeps it from being read as a number."""
        return F.concat(F.lit("x"), F.substring(key, 1, self.digits))

    def _block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def _places(self, key: str) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(self.hashes)])

    def filters(self, prefixes: list[str]) -> DataFrame:
        """prefix, block, bits of the named partitions, those of all batches as one."""
        held = read_or_empty(self.spark, self.index, FILTER_SCHEMA).filter(F.col("prefix").isin(prefixes))
        return held.groupBy("prefix", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def add(self, rows: DataFrame, key: str = "text_hash") -> None:
        """Append the bits of some hashes to the index."""
        places = rows.select(self.prefix(key).alias("prefix"), self._block(key).alias("block"), F.explode(self._places(key)).alias("place"))
        bits = places.groupBy("prefix", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits.select("block", "bits", "prefix").hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(self.index)

    def maybe(self, rows: DataFrame, prefixes: list[str], key: str = "text_hash") -> DataFrame:
        """Rows whose bits are all set: known, or one of few that only look so."""
        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1

        keyed = rows.withColumn("_prefix", self.prefix(key)).withColumn("_block", self._block(key))
        blocks = self.filters(prefixes).select(F.col("prefix").alias("_prefix"), F.col("block").alias("_block"), "bits")
        found = keyed.select(key, "_prefix", "_block").join(blocks, ["_prefix", "_block"]).filter(F.forall(self._places(key), is_set))
        return found.select(key, F.col("_prefix").alias("prefix"))

    def stored(self, prefixes: list[str], key: str = "text_hash") -> DataFrame:
        """Hashes of the named partitions; no other partition is listed in the plan's file scan."""
        return read_or_empty(self.spark, self.target, f"{key} string, prefix string").filter(F.col("prefix").isin(prefixes)).select(key)

    def unknown(self, rows: DataFrame, key: str = "text_hash") -> DataFrame:
        """Rows whose hash the table does not hold. The names of partitions, not hashes, go through the driver."""
        names = lambda df: [r[0] for r in df.distinct().collect()]
        maybe = self.maybe(rows, names(rows.select(self.prefix(key).alias("p"))), key).persist()
        known = maybe.select(key).join(self.stored(names(maybe.select("prefix")), key), key, "left_semi")
        return rows.join(known, key, "left_anti")

    def append(self, rows: DataFrame, key: str = "text_hash") -> None:
        """Append the rows that are new. Hashes within ``rows`` are distinct. A repeated call appends nothing."""
        rows = rows.persist()
        new = self.unknown(rows, key).withColumn("prefix", self.prefix(key)).persist()
        try:
            self.add(new, key)
            new.hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(self.target)
        finally:
            new.unpersist()
            rows.unpersist()
