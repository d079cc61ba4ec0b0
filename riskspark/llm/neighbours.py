"""Approximate nearest neighbours by shifted space-filling curves (operator 6).

Each of ``CURVES`` curves projects all vectors on ``DIMS`` random directions,
shifts them at random and orders them by their Hilbert key.  Spark range-partitions the keys, numbers them
along the curve and cuts each curve into blocks.  A query searches its own
block and both neighbours on every curve; the ten best of each block are
merged and ranked by exact distance, ties to the smaller id.

A curve has ``BLOCKS`` blocks (fewer if they would fall under ``LEAST_BLOCK``
rows), so a query sees a tenth of the table on each curve.  That share is what the recall
of 0.9 costs on vectors without any structure; it is a parameter, and
structured vectors need less.  Blocks of more than ``PART_ROWS`` rows are dealt
to several tasks, as are their queries, so a task's memory does not grow.

Results for odd input: null, empty or zero vectors, and those with null or
non-finite components, take no part; nor do vectors of another length than most
have; a repeated row is a candidate of its own; fewer candidates than ``k``
give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

CURVES, DIMS, KEY_BITS = 16, 8, 7
BLOCKS, LEAST_BLOCK = 30, 256
PART_ROWS, PART_QUERIES = 20_000, 2_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of rows of integer coordinates below
    2^bits (transpose method: undo the excess work bit by bit, then Gray-encode)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top = np.uint64(1 << b)
        below = top - one
        for i in range(len(x)):
            set_ = (x[i] & top) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = (key << one) | (((column ^ flip) >> np.uint64(b)) & one)
    return key


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _curve_keys(middle: np.ndarray, scale: float, seed: int):
    dims = min(DIMS, len(middle))
    random = np.random.default_rng(seed)
    turns = [np.linalg.qr(random.standard_normal((len(middle), dims)))[0] for _ in range(CURVES)]
    shifts = random.uniform(0, 0.2, (CURVES, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            with np.errstate(all="ignore"):
                for c in range(CURVES):
                    y = np.nan_to_num((rows - middle) / scale @ turns[c])
                    cells = (0.8 / (1 + np.exp(-1.7 * np.clip(y, -50, 50))) + shifts[c]) * (1 << KEY_BITS)
                    key = hilbert_keys(cells.astype(np.uint64), KEY_BITS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), c, np.int32)), pa.array(key.astype(np.int64)), batch.column(0)], ["curve", "key", "row"])

    return run


def _best(k: int):
    def run(queries, rows):
        import pandas as pd
        out = {"query_row": [], "row": [], "score": []}
        if len(queries) and len(rows):
            base = np.stack(rows["vector"].to_numpy())
            ids, own = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            for q, v in zip(queries["row"].to_numpy(), queries["vector"]):
                with np.errstate(over="ignore"):
                    apart = base - np.asarray(v)
                    score = np.sqrt((apart * apart).sum(1))
                score[own == q] = np.nan
                there = np.flatnonzero(~np.isnan(score))
                if len(there) > k:
                    there = there[score[there] <= np.partition(score[there], k - 1)[k - 1]]
                there = there[np.lexsort((ids[there], score[there]))[:k]]
                out["query_row"] += [q] * len(there)
                out["row"] += own[there].tolist()
                out["score"] += score[there].tolist()
        return pd.DataFrame(out).astype({"query_row": "int64", "row": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(usable(F.col("vector")))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    length, n = lengths["n"], lengths["count"]
    rows = rows.filter(F.size("vector") == length)
    parts = rows.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = {r["i"]: (r["m"], r["s"]) for r in parts.collect()}  # one row per component
    middle = np.array([moments[i][0] for i in range(length)])
    scale = float(np.sqrt(np.mean([moments[i][1] ** 2 for i in range(length)])))
    if not np.isfinite(middle).all() or not np.isfinite(scale) or scale == 0:
        middle, scale = np.zeros(length), 1.0
    keys = rows.select("row", "vector").mapInArrow(_curve_keys(middle, scale, seed), "curve int, key long, row long")
    # row numbers along each curve: sorted ranges, and the counts of the ranges before
    ordered = staged(keys.repartitionByRange("curve", "key", "row").sortWithinPartitions("curve", "key", "row")
                     .withColumn("at", F.monotonically_increasing_id()), "curves")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    before = Window.partitionBy("curve").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ordered.groupBy("curve", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
               .select("curve", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    count = max(1, min(blocks, n // LEAST_BLOCK))
    rank = F.col("at") - F.col("first") + F.col("offset")
    placed = ordered.join(offsets, ["curve", "range"]).select("curve", "row", F.floor(rank * count / n).cast("int").alias("block"))
    full = staged(placed.join(rows, "row"), "curve-blocks")
    per_block = -(-n // count)
    n_parts = -(-per_block // PART_ROWS)
    n_queries = rows.filter("is_query").count()
    q_parts = max(1, -(-3 * n_queries // (count * PART_QUERIES)))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    found = full.withColumn("part", dealt(n_parts)).withColumn("qpart", each(q_parts))
    near = F.filter(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1), lambda b: (b >= 0) & (b < count))
    asked = (full.filter("is_query").withColumn("block", F.explode(near))
             .withColumn("part", each(n_parts)).withColumn("qpart", dealt(q_parts)))
    by = ["curve", "block", "part", "qpart"]
    fresh = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in (*by, *cols)]).groupBy(*by)  # noqa: E731  columns of its own
    best = (fresh(asked, "row", "vector")
            .cogroup(fresh(found, "row", "vec_id", "vector"))
            .applyInPandas(lambda q, r: _best(k)(q, r), "query_row long, row long, score double")).distinct()
    ids = rows.select("row", "vec_id")
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = best.join(ids, "row").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(ids.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row").select(
        "query_id", "rank", "vec_id", "score")


def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
