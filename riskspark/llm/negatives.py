"""Hard negatives by Four-Russians scoring (operator 13).

Vectors are integers, their score is the inner product.  A candidate is kept as
bit planes: plane k of a group of eight dimensions is one byte, the k-th bits
of its eight components.  For each anchor and group, a table holds the sums of
all 256 subsets of the anchor's eight components; a plane's share of the score
is the table entry at the plane's byte, summed over the groups, and the planes
are joined from the highest (the sign, counted negatively) down by doubling and
adding.  That gives full exact scores without a multiplication.

Rows and anchors are dealt to a grid of cells by their row number, so equal
ids, labels or vectors fill no cell, and every anchor meets every row in
exactly one cell.  A first pass keeps each anchor's best rows of its own label
in every cell, a second one the best rows of other labels within the window
that each positive's score opens; both are merged by a ranked window.

Results for odd input: a row with a null label, a null vector or a null or
non-finite component takes no part; missing components of a shorter vector
count as 0, an empty vector scores 0 with all; a null id comes last among ties;
every repeated row is a candidate and an anchor of its own, an anchor's other
rows are those with another id; ties go to the smaller id; a table without
anchors, positives or negatives gives an empty result; other columns are not
looked at.  Vectors whose scores could pass 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import dropped, staged, table

POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Most candidates and anchors of one cell, and anchors scored at once in it.
CELL_ROWS, CELL_ANCHORS, AT_ONCE = 65_536, 32_768, 8
_LIMIT = 1 << 62
#: Stands for a null id inside the operator; the last one in order.
NO_ID = (1 << 63) - 1


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256): sums of the subsets of each group's eight components."""
    groups = anchors.reshape(len(anchors), -1, 8)
    sums = np.zeros((*groups.shape[:2], 256), anchors.dtype)
    for bit in range(8):  # the subsets with this bit are those without it plus one component
        sums[:, :, 1 << bit:2 << bit] = sums[:, :, :1 << bit] + groups[:, :, bit, None]
    return sums


def bit_planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """(bits, groups, vectors) bytes: bit k of eight components at a time, two's complement."""
    groups = vectors.reshape(len(vectors), -1, 8)
    planes = np.empty((bits, groups.shape[1], len(vectors)), np.uint8)
    for k in range(bits):
        planes[k] = np.packbits((groups >> k) & 1, axis=2, bitorder="little")[:, :, 0].T
    return planes


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) inner products by table lookups and doubling."""
    bits, groups, n = planes.shape
    total = np.zeros((len(sums), n), np.int64)
    for k in range(bits - 1, -1, -1):
        plane = np.zeros((len(sums), n), np.int64)
        for g in range(groups):
            plane += sums[:, g].take(planes[k, g], axis=1)
        total = -plane if k == bits - 1 else (total << 1) + plane
    return total


def _first(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep``, higher scores and then smaller ids first."""
    if len(score) > keep:
        at = np.flatnonzero(score >= np.partition(score, -keep)[-keep])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:keep]]


def whole_vectors(vectors: DataFrame, vector: Column, label: Column, anchor: Column) -> DataFrame:
    """Staged rows that take part: row, vec_id, label, v, anchor."""
    usable = label.isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = vectors.filter(usable).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("long").alias("label"),
                                         vector.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


class _Grid:
    """Cells of rows and anchors; ``row`` numbers deal them evenly."""

    def __init__(self, rows: DataFrame):
        longest = F.max(F.size("v"))
        largest = F.max(F.greatest(F.array_max("v"), -1 - F.array_min("v")))
        s = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), longest.alias("dims"), largest.alias("top")).first()
        self.dims = max(8, -(-(s["dims"] or 0) // 8) * 8)
        self.bits = (s["top"] or 0).bit_length() + 1
        if self.dims << (2 * self.bits - 2) > _LIMIT:
            raise ArithmeticError("scores of these vectors do not fit in 64 bits")
        tasks = rows.sparkSession.sparkContext.defaultParallelism
        # as many cells as there are cores while cells stay worth their task, more when they would grow too large
        self.row_cells = max(-(-s["n"] // CELL_ROWS), min(2 * tasks, -(-s["n"] // 1024)), 1)
        self.anchor_cells = max(-(-s["anchors"] // CELL_ANCHORS), 1)

    def run(self, rows: DataFrame, anchors: DataFrame, pick: Callable, schema: str) -> DataFrame:
        """``pick(candidates, anchor, scores)`` -> rows, for every anchor in every cell."""
        cell = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select(cell(self.row_cells).alias("r"), each(self.anchor_cells).alias("a"), "vec_id", "label", "v")
        right = anchors.select(each(self.row_cells).alias("r"), cell(self.anchor_cells).alias("a"), *anchors.columns)
        dims, bits, names = self.dims, self.bits, [x.split()[0] for x in schema.split(", ")]

        def whole(column: pd.Series) -> np.ndarray:
            out = np.zeros((len(column), dims), np.int64)
            for i, v in enumerate(column):
                out[i, :len(v)] = v
            return out

        def cell_of(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            if candidates.empty or anchors.empty:
                return pd.DataFrame([], columns=names)
            planes = bit_planes(whole(candidates["v"]), bits)
            ids = candidates["vec_id"].to_numpy(np.int64)
            labels, found = candidates["label"].to_numpy(np.int64), []
            for at in range(0, len(anchors), AT_ONCE):
                part = anchors.iloc[at:at + AT_ONCE]
                for anchor, s in zip(part.itertuples(), scores(subset_sums(whole(part["own_v"])), planes)):
                    found += pick(ids, labels, anchor, s)
            return pd.DataFrame(found, columns=names)

        return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInPandas(cell_of, schema)


def hard_negatives(vectors: DataFrame, vector: Column, label: Column, anchor: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has ``vec_id``; ``vector`` gives whole numbers, ``label`` the
    label, ``anchor`` says which rows are anchors.  A negative's score lies
    between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = whole_vectors(vectors, vector, label, anchor)
    grid = _Grid(rows)
    anchors = rows.filter("anchor").select("row", F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("own_v"))

    def alike(ids: np.ndarray, labels: np.ndarray, a: object, s: np.ndarray) -> list:
        at = np.flatnonzero((labels == a.own) & (ids != a.anchor_id))
        return [(a.row, a.anchor_id, int(ids[i]), int(s[i])) for i in at[_first(s[at], ids[at], positives)]]

    near = grid.run(rows, anchors, alike, "row long, anchor_id long, positive_id long, positive_score long")
    order = [F.desc("positive_score"), "positive_id"]
    best = staged(near.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
                  .filter(F.col("place") <= positives), "negatives-positives")
    wanted = best.groupBy("row").agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))  # at most ``positives`` values

    def unlike(ids: np.ndarray, labels: np.ndarray, a: object, s: np.ndarray) -> list:
        at = np.flatnonzero(labels != a.own)
        own, out = s[at], []
        for p in map(int, a.wanted):
            inside = at[(own >= -(-low * p // 100)) & (own <= high * p // 100)]
            out += [(a.row, p, int(ids[i]), int(s[i])) for i in inside[_first(s[inside], ids[inside], negatives)]]
        return out

    far = grid.run(rows, anchors.join(wanted, "row"), unlike, "row long, positive_score long, negative_id long, negative_score long")
    order = [F.desc("negative_score"), "negative_id"]
    kept = far.withColumn("rank", F.row_number().over(Window.partitionBy("row", "positive_score").orderBy(*order))).filter(F.col("rank") <= negatives)
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    out = staged(best.join(kept, ["row", "positive_score"]).select(
        shown("anchor_id"), shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score"), "negatives")
    dropped(rows, best)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every anchor and positive, each seventh id under the next label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    finite = F.when(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.col("embedding"))
    whole = F.transform(finite, lambda x: F.floor(x.cast("double") * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, whole, label, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT a, b, score FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)
QUALIFY row_number() OVER w <= 3
"""
