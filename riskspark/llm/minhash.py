"""MinHash near-duplicate detection (operator 1).

A text's set holds its distinct shingles of five words.  ``BANDS * ROWS``
universal hash minima give a signature; texts that agree in all rows of a band
share a bucket.  A pair misses every bucket with a probability of 2e-9 at a
similarity of 0.85 and 3e-6 at 0.80.

The threshold is a parameter: 0.80 unless given; ``op1_minhash_dedup`` links from
0.85 on.

* Texts with equal sets form a class first, with the smallest id as its node,
  so thousands of copies cost one row each.
* In a bucket every member is compared with the bucket's smallest node only (a
  star).  Pairs pass a check of their signatures (one bit of each minimum; a
  pair at the threshold fails it with a probability below 1e-8) and are then
  confirmed on their full sets.
* Components of the confirmed links follow by alternating large-star and
  small-star.  Members that did not end in the component of their bucket's
  smallest node are then compared with the bucket's members of other components,
  so no link is lost for want of a common centre: the bucket's task compares
  signatures and then full sets in blocks of ``PART_ROWS`` members, each pair in
  its first common bucket only, and returns the links that join components.
  Links inside a component change nothing and are never looked for.

Results for odd input: texts without words have an empty set and stay alone;
fewer than five words are one shingle; repeated rows are copies of each other;
rows that share an id count as one document with the links of all its texts; a
row without an id takes part by its text, but its component has an id only if
one with an id is in it; ids are below 2^62; texts may have any length; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.components import components
from riskspark.llm.shared import release_unused, staged, table, tidy

WORDS = 5
BANDS, ROWS = 42, 6
#: Similarity from which on two texts are linked, in hundredths.
PERCENT = 80
#: Up to so many ids a join with the documents may broadcast them (8 bytes each).
BROADCAST_IDS = 500_000
#: Members of a bucket in one block of the second comparison.
PART_ROWS = 1_500
#: Words whose hashes a task remembers.
KNOWN_WORDS = 100_000
#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 500
#: Rows without an id are told apart by their texts: their numbers start here, above all ids.
NO_ID = 1 << 62
_SHINGLE_CHUNK = 2048


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8").lower().split() if text else []  # lower() of bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n] + np.uint64(1))
    return np.unique(out)


def _signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _SHINGLE_CHUNK):
        np.minimum(least, (a[:, None] * low[None, at:at + _SHINGLE_CHUNK] + b[:, None]).min(1), out=least)
    return least


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(1)
    a = random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    return a, random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


_SETS = "doc_id long, n_shingles long, fp1 long, fp2 long, bits array<long>, bands array<long>"


def _own() -> Column:
    """The id, or for a null one a number above all ids by the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut after ``SLICE_ROWS`` rows, so that few texts and results are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id (see ``_own``), n_shingles, fingerprint of the set, signature bits, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = _WordHash(), _parameters()
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in _slices(batches):
            n, fp, bits, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                x = shingle_set(text, hashes)
                n.append(len(x))
                if not len(x):
                    fp.append((0, 0))
                    bits.append([])
                    keys.append([])
                    continue
                fp.append((int(x.sum(dtype=np.uint64).view(np.int64)), int(_mixed(x).sum(dtype=np.uint64).view(np.int64))))
                least = _signature(x, a, b)
                packed = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31))
                bits.append(np.pad(packed, (0, -len(packed) % 8)).view(np.int64).tolist())
                key = band.copy()
                for r in range(ROWS):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS].astype(np.uint64))
                keys.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                pa.array([f[0] for f in fp], pa.int64()), pa.array([f[1] for f in fp], pa.int64()),
                pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp1", "fp2", "bits", "bands"])

    return docs.select(_own().alias("doc_id"), "text").mapInArrow(tidy(run), _SETS)


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of documents, whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for part in _slices(batches):
            sets = [shingle_set(t, hashes).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(tidy(run), "node long, shingles array<long>")


def bits_apart(percent: int) -> int:
    """Signature bits that a pair at the threshold may differ in: the mean plus six deviations."""
    q = (100 - percent) / 200
    return int(np.ceil(BANDS * ROWS * q + 6 * np.sqrt(BANDS * ROWS * q * (1 - q))))


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and signatures leave room for the threshold."""
    apart = F.lit(0)
    for i in range(-(-BANDS * ROWS // 64)):
        apart = apart + F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i]))
    small = F.least(f"{a}.n_shingles", f"{b}.n_shingles")
    large = F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (small * 100 >= large * percent) & (apart <= bits_apart(percent))


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes; copies of a node's text give equal
    sets, and one of each is enough."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return full_sets(docs.select(_own().alias("own"), "text").join(wanted, F.col("own") == F.col("node")).select("node", "text")).dropDuplicates(["node", "shingles"])


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    pairs = staged(pairs, "pairs")
    ids = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-ids")
    sets = staged(_sets_of(ids, docs), "pair-sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - common
    return both.filter(common * 100 >= union * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of (doc_id, text); texts
    are linked from a similarity of ``percent`` hundredths on."""
    docs = docs.select("doc_id", "text")
    sets = staged(signatures(docs), "sets")
    filled = sets.filter("n_shingles > 0")
    fp = ["fp1", "fp2", "n_shingles"]
    nodes = staged(filled.groupBy(*fp).agg(F.min("doc_id").alias("node"),
                                           F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes")
    small = nodes.select("node", "n_shingles", "bits")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    members = staged(rows.join(shared, "key"), "buckets")
    star = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    likely = (star.join(small.alias("x"), F.col("a") == F.col("x.node")).join(small.alias("y"), F.col("b") == F.col("y.node"))
              .filter(_alike("x", "y", percent)).select("a", "b").distinct())
    links = staged(_confirmed(likely, docs, percent).unionByName(_same_id(sets, nodes)).distinct(), "links")
    groups = staged(components(links), "components")
    more = staged(_left_over_links(members, groups, nodes, docs, percent), "more-links")
    if not more.isEmpty():
        groups = staged(components(links.unionByName(more)), "components")
    classes = (nodes.join(groups, "node", "left")
               .select(*fp, F.coalesce("component", "node").alias("component"), F.col("node").alias("class_id")))
    known = sets.select("doc_id", *fp).join(classes, fp, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    given = lambda c: F.when(c < NO_ID, c)
    return known.select(given(F.col("doc_id")).alias("doc_id"), "n_shingles", given(component).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_id(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that share an id."""
    several = sets.filter("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    fp = ["fp1", "fp2", "n_shingles"]
    found = sets.join(several, "doc_id").join(nodes.select(*fp, "node"), fp).select("doc_id", "node")
    least = found.groupBy("doc_id").agg(F.min("node").alias("b"))
    return found.join(least, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")


def _left_over(members: DataFrame, groups: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Members (key, size, node, label, outside, n_shingles, bits) of buckets that
    have a likely partner in another component, where one of the two is
    outside the component of the bucket's smallest node."""
    of = lambda df, col: df.join(groups.select(F.col("node").alias(col), F.col("component").alias(f"{col}_in")), col, "left")
    placed = of(of(members.filter("size > 2"), "node"), "hub").select(
        "key", "size", "node", F.coalesce("node_in", "node").alias("label"), "hub", F.coalesce("hub_in", "hub").alias("hub_label"))
    placed = (placed.filter("node <> hub").withColumn("outside", F.col("label") != F.col("hub_label"))
              .select("key", "size", "node", "label", "outside").join(small, "node"))
    mixed = placed.groupBy("key").agg(F.max("outside").alias("any")).filter("any").select("key")
    placed = placed.join(mixed, "key", "left_semi")
    return placed.alias("x").join(
        placed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
        & (F.col("x.outside") | F.col("y.outside")) & _alike("x", "y", percent), "left_semi")


def _joining_links(pdf, percent: int = PERCENT):
    """Task: members of two blocks of a bucket -> links between components."""
    import pandas as pd

    pdf = pdf.sort_values("node", ignore_index=True)
    key, p, q = (int(pdf[c].iloc[0]) for c in ("key", "p", "q"))
    n, node = pdf["n_shingles"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    label, outside, part = pdf["label"].to_numpy(np.int64), pdf["outside"].to_numpy(bool), pdf["part"].to_numpy()
    bits = np.stack(pdf["bits"].to_numpy()).view(np.uint64)
    bands = np.stack(pdf["bands"].to_numpy())
    shingles = pdf["shingles"].to_numpy()  # arrays of distinct values
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    links, apart = [], bits_apart(percent)
    for i in range(len(pdf)):
        j = np.arange(i + 1, len(pdf))
        ok = (label[j] != label[i]) & (outside[j] | outside[i])
        ok &= (part[j] != part[i]) if p != q else True
        ok &= np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent
        j = j[ok]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= apart]
        j = j[bands[j, (bands[j] == bands[i]).argmax(1)] == key]  # the first common bucket is this one
        for k in j.tolist():
            a, b = find(int(label[i])), find(int(label[k]))
            if a == b:
                continue
            x, y = shingles[i], shingles[k]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * 100 >= (len(x) + len(y) - common) * percent:
                root[max(a, b)] = min(a, b)
                links.append((node[k], node[i]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _joining_links_tidy(pdf, percent: int):
    """``_joining_links``; large groups and some of the small ones give unused memory back."""
    try:
        return _joining_links(pdf, percent)
    finally:
        if len(pdf) >= SLICE_ROWS or int(pdf["key"].iloc[0]) % 64 == 0:
            release_unused()


def _left_over_links(members: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    found = staged(_left_over(members, groups, nodes.select("node", "n_shingles", "bits"), percent), "left-over")
    ids = staged(found.select("node").distinct(), "left-over-ids")
    sets = staged(_sets_of(ids, docs), "left-over-sets")
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = (found.withColumns({"parts": parts, "part": own}).withColumn("other", other)
            .withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
            .join(nodes.select("node", "bands"), "node").join(sets, "node"))
    return rows.select("key", "p", "q", "part", "node", "label", "outside", "n_shingles", "bits", "bands", "shingles").groupBy(
        "key", "p", "q").applyInPandas(lambda pdf: _joining_links_tidy(pdf, percent), "a long, b long").distinct()


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component, from a similarity of 0.85 on."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, texts linked from 0.80 on.  Rows are judged by their texts, whatever their ids: of
    each component one row stays, the one with the smallest id (null: last),
    of equal ids the least row.  Rows without words are linked with nothing and stay."""
    text_id = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1))  # one number for each text, the same wherever it is computed
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_id.alias("h"))
    found = near_duplicates(docs.select(text_id.alias("doc_id"), "text")).filter("n_shingles > 0")
    found = staged(found.groupBy(F.col("doc_id").alias("h")).agg(F.min("component_id").alias("component"), F.count("*").alias("n")), "near-duplicates")
    several = found.groupBy("component").agg(F.sum("n").alias("rows")).filter("rows > 1").select("component")
    members = staged(found.join(several, "component").select("h", "component"), "members")
    near = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    best = rows.select("id", "h").join(near, "h").groupBy("component").agg(F.min(order).alias("best"))
    best = staged(best.select("component", "best.id", "best.h"), "near-duplicates-kept")
    few = F.broadcast(best) if best.count() <= BROADCAST_IDS else best
    chosen = rows.alias("r").join(few.alias("k"), (F.col("r.h") == F.col("k.h")) & F.col("r.id").eqNullSafe(F.col("k.id")))
    # rows that agree in id and text are several still
    once = chosen.groupBy("component").agg(F.min("row").alias("row"))
    return rows.join(near, "h", "left_anti").select("row").unionByName(once.select("row")).select("row.*")
