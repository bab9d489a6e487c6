"""Shards of nearly equal bytes by sampled splitters, with DataFrame operations only.

Records are ordered by a key, the hash of the text and then of the id, so equal texts lie side by
side and a large group of them can still be cut.  Splitters drawn by size part the keys into many
ranges, ranges that turn out overfull are divided again, and only then is the place of every record
in the whole order known: the bytes of the ranges before its own plus those before it in its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import range_of, splitters, written

#: Ranges: one for so many rows, within these bounds.
ROWS_IN_RANGE, FEWEST, MOST = 100_000, 64, 4096


def with_ranges(keyed: DataFrame, rounds: int = 4) -> DataFrame:
    """Adds `range` to rows (key, size): ascending in the key, none with over twice its share of the
    bytes unless a single key holds them (or `rounds` divisions did not suffice)."""
    total = keyed.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    ranges = min(MOST, max(FEWEST, (total["n"] or 0) // ROWS_IN_RANGE))
    boundaries = splitters(keyed, "key", "size", ranges)
    share = (total["bytes"] or 0) / ranges
    for _ in range(rounds):
        placed = keyed.withColumn("range", range_of("key", boundaries))
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")) \
            .where((F.col("bytes") > 2 * share) & (F.col("low") < F.col("high"))).select("range", "bytes").collect()
        more = set()
        for row in full:
            inside = placed.where(F.col("range") == row["range"])
            more |= set(splitters(inside, "key", "size", 1 + int(row["bytes"] / share), seed="again"))
        if not more - set(boundaries):
            break
        boundaries = sorted(more | set(boundaries))
    return keyed.withColumn("range", range_of("key", boundaries))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, size, text_crc32, law, shard, slot, grown_shard): one row per row of `docs`.

    Law `bytes`: each shard holds total / shards bytes, give or take the record at either end; a
    record belongs where its middle lies.  Size is the UTF-8 length of the text (0 for null) plus
    1; the checksum of a null text is that of an empty one.  `slot` numbers the records of a shard
    from 0 in key order.  A null id is a key like any other; rows that agree in id and text are
    interchangeable, each gets its own slot.  An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = written(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.concat(F.md5(text.cast("binary")), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-keys")
    ranged = written(with_ranges(keyed), "shard-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_start"),
                         F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The table of starts has a row for each range: at most a few times MOST.
    places = (ranged.select("*", (F.sum("size").over(inside) - F.col("size")).alias("bytes_in"), (F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1).alias("row_in"))
              .join(F.broadcast(starts), "range")
              .select("doc_id", "key", "size", "text_crc32", (F.col("row_start") + F.col("row_in")).alias("place"),
                      F.expr(f"cast(least({shards - 1}, ((2 * (byte_start + bytes_in) + size) * {shards}) div (2 * total)) as int)").alias("shard")))
    placed = written(places, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "key", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the records as shard=N/ folders of Parquet, each sorted by slot."""
    key = F.concat(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # Rows that agree in id and text have one key but several slots; they take them in turn.
    turn = Window.partitionBy("key").orderBy("slot")
    placed = assigned.select("key", "shard", "slot").withColumn("turn", F.row_number().over(turn))
    rows = docs.withColumn("key", key).withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    (rows.join(placed, ["key", "turn"]).drop("key", "turn").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
