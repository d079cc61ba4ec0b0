"""Order statistics: running totals and exact quantiles.

Running totals are built so that no task ever holds a whole column or a whole group:

* rows are first collapsed to distinct values with counts (partial
  aggregation, so a value held by a third of all rows is one row after the
  map-side combine);
* the distinct values of each group are cut into ``buckets`` ranges of about
  equal size using ``percentile_approx`` over the *distinct* values;
* bucket totals (``groups x buckets`` rows) give each bucket an offset;
* a window partitioned by (group, bucket) adds the running total inside the
  bucket.

The result is exact; only the work split uses approximate boundaries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.keys import count_below

DEFAULT_BUCKETS = None     # None: one bucket per shuffle partition of the session


def _n_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return buckets
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _bucketed(t: DataFrame, keys: list[str], order_col: str, buckets: int) -> DataFrame:
    """Attach a bucket id ``_b`` (0..buckets-1) balanced over distinct values.
    With group keys the per-group boundaries are joined by key; without keys
    the boundaries are one small fitted array used as literals (no join)."""
    if buckets <= 1:
        return t.withColumn("_b", F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(F.col(order_col).cast("double"), probs, max(100, 10 * buckets))
    if not keys:
        bnd = t.agg(sketch.alias("_bnd")).first()["_bnd"] or []
        return t.withColumn("_b", count_below(F.col(order_col).cast("double"), bnd))
    bnd = t.groupBy(*keys).agg(sketch.alias("_bnd"))
    return t.join(bnd, keys).withColumn(
        "_b", F.size(F.filter("_bnd", lambda x: x < F.col(order_col)))).drop("_bnd")


def running_totals(t: DataFrame, keys: Sequence[str], order_col: str,
                   sum_cols: Sequence[str], buckets: int | None = DEFAULT_BUCKETS,
                   descending: bool = False) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``sum_cols`` ordered by
    ``order_col`` within ``keys``.  ``order_col`` must be distinct within a
    key (aggregate first).  ``descending`` accumulates from the largest."""
    keys = list(keys)
    buckets = _n_buckets(t, buckets)
    ob = F.col(order_col).desc() if descending else F.col(order_col).asc()
    tb = _bucketed(t, keys, order_col, buckets)
    if descending:
        tb = tb.withColumn("_b", F.lit(buckets) - F.col("_b"))
    tot = tb.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    w_prev = (Window.partitionBy(*keys).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_bt_{c}").over(w_prev), F.lit(0)).alias(f"_off_{c}")
        for c in sum_cols])
    w_in = (Window.partitionBy(*keys, "_b").orderBy(ob)
            .rowsBetween(Window.unboundedPreceding, 0))
    out = tb.join(off, [*keys, "_b"]).select(
        *t.columns,
        *[(F.sum(c).over(w_in) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols])
    return out


# Tuning values of the brackets; results do not depend on them.
ACCURACY = 1_000            # of a part's approximate quantiles
POINTS = 256                # quantiles that stand for a part
MARGIN = 0.01               # half a bracket's width, as a share of the rows


def interpolated(lo: float, hi: float, d: float) -> float:
    """Linear interpolation between neighbours, from the nearer one."""
    return hi - (hi - lo) * (1 - d) if d >= 0.5 else lo + (hi - lo) * d


def quantile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                 approx: bool = False, persist: bool = True) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles as ``{col: [q(p) ...]}``; nulls are
    skipped, a column without values gives None.

    Every part of the rows gives ``POINTS`` approximate quantiles of its own
    values; their quantiles, weighted by the parts' counts, bracket every wanted
    rank.  So a task reads the sketches of a few parts or of one column, never
    those of all parts and columns.  A second pass counts the
    rows below each bracket; a third one collapses the rows inside to distinct
    values with counts and picks the wanted ranks with a running sum per bracket.  So
    only a few of 100 rows are grouped, a value of a third of all rows is one
    row, and the driver gets the neighbours of the wanted ranks alone.  A rank
    outside its bracket (few values, or very uneven parts) is sought again in the whole column.
    ``approx`` stops after the first pass.
    """
    out: dict[str, list] = {c: [None] * len(probs) for c in cols}
    if not cols:
        return out
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if persist:
        src = src.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = src.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                         for c in cols]).first()
        live = [c for c in cols if size[c]["n"]]
        if not live:
            return out
        if approx:
            row = src.agg(*[F.percentile_approx(c, list(probs), 10 * ACCURACY).alias(c) for c in live]).first()
            return out | {c: list(row[c]) for c in live}
        wide = MARGIN + 2 / max(size[c]["n"] for c in live)
        ends = [min(max(p + side * wide, 0.0), 1.0) for p in probs for side in (-1, 1)]
        row = _approximate(src, live, ends)
        places = {(c, p): (size[c]["n"] - 1) * float(p) for c in live for p in probs}
        ranks = {(c, k) for (c, _), at in places.items() for k in (math.floor(at), math.ceil(at))}
        brackets = {c: _merged([(size[c]["lo"] if ends[2 * i] == 0 else row[c][2 * i],
                                 size[c]["hi"] if ends[2 * i + 1] == 1 else row[c][2 * i + 1])
                                for i in range(len(probs))]) for c in live}
        found = _at_ranks(src, brackets, ranks)
        if missed := ranks - found.keys():
            found |= _at_ranks(src, {c: [(size[c]["lo"], size[c]["hi"])] for c, _ in missed}, missed)
        for c in live:
            out[c] = [interpolated(found[c, math.floor(at)], found[c, math.ceil(at)], at - math.floor(at))
                      for at in (places[c, p] for p in probs)]
        return out
    finally:
        if persist:
            src.unpersist()


def _approximate(src: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """About the quantiles ``probs`` of each column, from the quantiles of its
    parts.  The driver gets one row per column."""
    grid = [(i + 0.5) / POINTS for i in range(POINTS)]
    parts = src.groupBy(F.spark_partition_id().alias("_part")).agg(*[
        F.struct(F.count(c).alias("n"), F.percentile_approx(c, grid, ACCURACY).alias("q")).alias(c) for c in cols])
    points = parts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c)["n"].alias("n"), F.col(c)["q"].alias("q"))
                                              for c in cols])).alias("x")).select("x.name", "x.n", F.explode("x.q").alias("v"))
    return {r["name"]: r["q"] for r in points.groupBy("name").agg(F.percentile("v", list(probs), F.col("n")).alias("q")).collect()}


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets without overlap, so that a value lies in one of them at most."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _at_ranks(src: DataFrame, brackets: dict[str, list[tuple[float, float]]],
              ranks: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """(column, rank) -> value, of the ranks that lie in a bracket of their column."""
    parts = [(c, lo, hi) for c, bs in brackets.items() for lo, hi in bs]
    below = src.agg(*[F.count_if(F.col(c) < lo).alias(f"b{i}") for i, (c, lo, _) in enumerate(parts)]).first()
    inside = []
    for c in brackets:
        part = F.lit(None).cast("int")
        for i, (of, lo, hi) in enumerate(parts):
            if of == c:
                part = F.when(F.col(c).between(lo, hi), F.lit(i)).otherwise(part)
        inside.append(F.when(part.isNotNull(), F.struct(part.alias("part"), F.col(c).alias("v"))))
    values = src.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).select("x.part", "x.v")
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (values.groupBy("part", "v").agg(F.count(F.lit(1)).alias("m"))
               .withColumn("upto", F.sum("m").over(upto)))
    wanted = src.sparkSession.createDataFrame(       # columns x probabilities x 2 rows at most
        [(i, k, k - below[i]) for i, (c, _, _) in enumerate(parts) for of, k in ranks if of == c],
        "part int, k bigint, rel bigint")
    hits = counted.join(F.broadcast(wanted), "part").where(
        (F.col("rel") >= F.col("upto") - F.col("m")) & (F.col("rel") < F.col("upto")))
    return {(parts[r["part"]][0], r["k"]): r["v"] for r in hits.select("part", "k", "v").collect()}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: str | None = None) -> dict[tuple, list[float | None]]:
    """``{(group, col): [q(p) ...]}`` per value of ``by`` (a column of few
    values, such as the label; the group is None without ``by``).  A group's
    values are a column of their own, so all groups share the passes of
    ``quantile_map``."""
    if by is None:
        return {(None, c): q for c, q in quantile_map(df, cols, probs).items()}
    groups = [r[0] for r in df.select(by).distinct().collect()]
    name = {(g, c): f"{i}_{c}" for i, g in enumerate(groups) for c in cols}
    split = df.select(*[F.when(F.col(by).eqNullSafe(F.lit(g)), F.col(c)).alias(n) for (g, c), n in name.items()])
    found = quantile_map(split, list(name.values()), probs)
    return {key: found[n] for key, n in name.items()}
