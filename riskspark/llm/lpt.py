"""Sharding by longest-processing-time scheduling (operator 10).

Groups that must stay together are sorted by size, largest first, and each
goes to the least-loaded shard, which a heap yields.  A heap over every group
would put the whole corpus through one process, so the schedule runs over at
most ``2 * FINE + LEVELS * CRATES`` items whatever the input is:

* groups heavier than 1 / ``FINE`` of the total are items of their own (there
  can be no more than ``FINE`` of them);
* all lighter groups fall by the hash of their key into crates.  Level j holds
  1 / 2^(j+1) of the key space in ``CRATES`` crates, so crates come in sizes
  from coarse to fine, as the tail of an LPT schedule needs.

A crate is a unit of the schedule, so its groups stay together as well.  The
crates' sizes come from one partially aggregated ``groupBy``; items are ordered
by (size descending, item id), so equal inputs give equal shards.

Results for odd input: a null text counts as an empty one (size 1, CRC 0) and
shares its group; repeated rows with the same id get slots of their own; an
empty table gives an empty result; columns other than the key, the id and the
size are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

FINE = 4096
CRATES = 1024
LEVELS = 14
#: Sub-ranges of a shard whose rows are numbered apart.
SLOT_RANGES = 4096


def crate_of(key: Column) -> Column:
    """Item id of a light group: (level, crate) from its key's hash."""
    h = F.xxhash64(key)
    low = F.shiftrightunsigned(h, 40)
    bits = F.length(F.bin(low.bitwiseAND((1 << LEVELS) - 1)))
    # the number of leading zeros of LEVELS bits: half of the keys have none
    level = F.least(F.lit(LEVELS) - bits, F.lit(LEVELS - 1))
    return (level * CRATES + h.bitwiseAND(CRATES - 1)).cast("long")


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item id -> shard for (item id, size) pairs."""
    loads = [(0, s) for s in range(shards)]
    place = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        place[item] = s
        heapq.heappush(loads, (load + size, s))
    return place


def shard_groups(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """Add ``shard`` to ``rows``: equal keys share one, sizes are near equal.

    ``rows`` is read twice; pass something cheap or staged.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(size)).first()[0] or 0
    heavy_limit = total / FINE
    groups = rows.groupBy(key).agg(F.sum(size).alias("_size"))
    heavy = (groups.filter(F.col("_size") > heavy_limit)
             .orderBy(F.desc("_size"), key).collect())  # at most FINE rows
    heavy_item = {g[0]: LEVELS * CRATES + i for i, g in enumerate(heavy)}
    heavy_df = spark.createDataFrame(list(heavy_item.items()), f"_key {dict(rows.dtypes)[key]}, _heavy long")
    joined = rows.join(F.broadcast(heavy_df), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    joined = joined.withColumn("_item", F.coalesce("_heavy", crate_of(F.col(key)))).drop("_heavy")
    sizes = joined.groupBy("_item").agg(F.sum(size).alias("s")).collect()  # bounded, see above
    place = schedule([(r[0], r[1]) for r in sizes], shards)
    place_df = spark.createDataFrame(list(place.items()), "_item long, shard int")
    return joined.join(F.broadcast(place_df), "_item").drop("_item")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of each ``shard`` from 0 without gaps.

    Rows fall into ``SLOT_RANGES`` hash ranges of the first ordering column;
    counts per (shard, range) give the offsets, so no task numbers a shard.
    """
    ranged = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(SLOT_RANGES)))
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("shard", "_range").orderBy(*[F.col(c) for c in order])
    return (ranged.withColumn("_row", F.row_number().over(own) - 1)
            .join(offsets, ["shard", "_range"])
            .withColumn("slot", (F.col("_row") + F.col("_offset")).cast("long"))
            .drop("_row", "_offset", "_range"))


def op10_lpt_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in shards 0 to 15, equal texts together (law ``bytes``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("_text")), "lpt-rows")
    placed = with_slots(shard_groups(rows, "_text", "size", shards), ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
