"""What the operators of this subpackage share: words, tables, folders that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a class for regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words of a text in order; an empty array for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir.  Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_llm_folder", None) or tempfile.mkdtemp(prefix="fleetsift-llm-")
        spark._llm_folder = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a key filter for each wanted key, rounded up to a power of two; at most MOST_BITS (32 MB) in all.
BITS_FOR_KEY, MOST_BITS, BITS_IN_MAP = 8, 1 << 28, 1 << 15


class KeyFilter:
    """A bitmap of the wanted keys' hashes, in a table of at most 32 MB, for joins that few rows survive.

    `mark` adds a column that is true for every row with a wanted key and for a few others, without
    shuffling the rows.  A task makes four maps of 4096 bytes.  It only spares the join that follows some rows: where there are more wanted
    keys than the bitmap has room for, more rows pass, and the answer is the same.  Null keys hash
    like any value.
    """

    def __init__(self, wanted: DataFrame, *keys: str):
        n = max(1, wanted.count())
        self.bits = min(MOST_BITS, max(BITS_IN_MAP, 1 << (BITS_FOR_KEY * n - 1).bit_length()))
        places = wanted.select(self._place(keys).alias("place"))
        maps = (places.select(F.expr(f"place div {BITS_IN_MAP}").alias("_map"), F.pmod("place", F.lit(BITS_IN_MAP)).alias("bit"))
                .repartition(-(-self.bits // (4 * BITS_IN_MAP)), "_map").groupBy("_map").agg(F.bitmap_construct_agg("bit").alias("_bits")))
        self.maps = written(maps, "key-filter")

    def _place(self, keys) -> Column:
        return F.pmod(F.xxhash64(F.lit("filter"), *keys), F.lit(self.bits))

    def mark(self, rows: DataFrame, *keys: str, name: str = "_hit") -> DataFrame:
        place = self._place(keys)
        byte = F.conv(F.hex(F.substr("_bits", F.expr("cast(_bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
        set_there = F.expr("pmod(_bit, 8)").cast("int")
        placed = rows.withColumn("_place", place).withColumn("_map", F.expr(f"_place div {BITS_IN_MAP}")).withColumn("_bit", F.expr(f"pmod(_place, {BITS_IN_MAP})"))
        hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), set_there).cast("int")) != 0, F.lit(False))
        return placed.join(F.broadcast(self.maps), "_map", "left").withColumn(name, hit).drop("_place", "_map", "_bit", "_bits")

    def keep(self, rows: DataFrame, *keys: str) -> DataFrame:
        """The rows that may have a wanted key."""
        return self.mark(rows, *keys).where("_hit").drop("_hit")


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone, the same in every run and engine."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def splitters(keyed: DataFrame, key: str, size: str, ranges: int, oversample: int = 32, seed: str = "split") -> list:
    """Boundaries that part the rows into about `ranges` ranges of equal total `size` (positive).

    A row is drawn with probability proportional to its size, at most 1, so about
    ranges * oversample keys are looked at whatever the table's length; a drawn row stands for the
    size it was drawn by, and boundaries are the quantiles of those.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    step = max(1.0, total / (ranges * oversample))
    chance = F.col(size) / F.lit(step)
    drawn = keyed.where(uniform(seed, key) < chance).groupBy(key).agg(F.sum(F.greatest(F.col(size), F.lit(step))).alias("stands_for"))
    upto = F.sum("stands_for").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = drawn.select(key, F.floor(upto * ranges / F.sum("stands_for").over(Window.partitionBy())).alias("range"))
    return sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in placed.where("range > 0").groupBy("range").agg(F.min(key).alias("low")).select("low").distinct().collect())


def range_of(key: str, boundaries: list) -> Column:
    """How many boundaries are at or below the key, by binary search."""
    if not boundaries:
        return F.lit(0)
    bounds = F.array(*[F.lit(bytearray(b) if isinstance(b, (bytes, bytearray)) else b) for b in boundaries])
    steps = F.array(*[F.lit(1 << k) for k in range(len(boundaries).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(boundaries)) & (F.element_at(bounds, F.least(at + step, F.lit(len(boundaries)))) <= F.col(key)), at + step).otherwise(at))
