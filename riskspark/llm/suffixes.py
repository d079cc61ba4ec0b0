"""Removal of long repeated passages by a logarithmic family of suffix indexes
(operator 5).

A match is a string of ``MATCH`` bytes.  Among the ``MATCH - GRAM + 1`` suffixes
that start inside such a string and still have ``GRAM`` bytes in it, the one whose
``GRAM`` bytes hash lowest (leftmost of equals) is its *anchor*.  Equal
strings choose the same anchor, so an index of the anchors' suffixes, a sixteenth of all,
finds every match.

Index.  A batch of documents gets a sorted suffix array: its anchors' (hash,
document) pairs in order of the hash, cut into ``buckets`` by the hash's first
bits.  ``IndexFamily.add`` merge-scans it with the arrays of the existing
levels, bucket by bucket, and returns the anchors that it shares with another
document, old or new.  Levels of equal size merge while they are scanned next, so there are as
many as the binary logarithm of the batches.  An anchor that many documents of
one task share is known to be shared at once and sends two entries, so
no bucket gathers the documents of a frequent passage.

Matches.  Only strings with a shared anchor can occur twice.  The strings
around one anchor form a block.  A block that occurs as a whole in an earlier
document is removed as a whole.  Where the blocks of an anchor differ (at the
ends of a passage), the first document of each sends the block's bytes, and the
task of the anchor compares all strings of its blocks.  An anchor with more
than ``LOCAL_BLOCKS`` different blocks sends the strings' hashes instead, which Spark
aggregates by hash and so combines before the shuffle.  Exact copies of a text
are set aside first: all of a copy is removed if it has ``MATCH`` bytes.

Hashes have 64 bits (38 and more for anchors, where a collision only costs work).

Results for odd input: a null text is an empty one; shorter texts than
``MATCH`` are never touched; rows that repeat an id are the same document,
so they never match each other; a null id counts as the largest; an empty table
gives an empty result; other columns are carried along.  A text of any length
is indexed: more than ``PIECE`` bytes are hashed in pieces that share
``MATCH - 1`` bytes, so every string lies in one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.shared import dropped, packed, release_unused, staged, table, tidy

MATCH, GRAM = 50, 20
BATCHES = 3
#: Bytes of text for each bucket of the index; 64 buckets at least.
BUCKET_BYTES = 4_000_000
#: From so many documents of one task on, an anchor is sent as known.
FREQUENT = 64
#: Up to so many different blocks of one anchor are compared in one task (70 bytes each).
LOCAL_BLOCKS = 50_000
BROADCAST_IDS = 500_000
#: Up to so many removed runs (about 40 bytes each) are sent to all tasks.
BROADCAST_RUNS = 1_000_000
NO_ID = (1 << 63) - 1
_CHUNK = 500_000
#: Strings of a long text that are hashed together; below 2^_POSITION_BITS less ``MATCH``.
PIECE = 1 << 22
#: Anchors sorted at a time in a task.
_RUN = 400_000
_POSITION_BITS = 24
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(b)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Text:
    """Hashes over several texts joined together."""

    def __init__(self, texts: list[bytes], powers: list):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        if not powers or len(powers[0]) <= n:
            powers[:] = _powers(max(n + n // 4, _CHUNK + _CHUNK // 4) + 1)
        self.inverse = powers[1]
        values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[raw] * powers[0][:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        """Of the strings that start there."""
        h = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(text, anchor's hash, first string, last string) of every block:
        neighbouring strings of ``MATCH`` bytes with one anchor."""
        n = int(self.starts[-1])
        none = np.zeros(0, np.int64)
        if n < MATCH:
            return none, none.astype(np.uint64), none, none
        h = self.sums[GRAM:] - self.sums[:-GRAM]
        h *= self.inverse[: len(h)]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        # hash first, then position: the least is the leftmost of the lowest
        rank = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, span = MATCH - GRAM + 1, 1
        while span * 2 <= width:
            rank = np.minimum(rank[:-span], rank[span:])
            span *= 2
        if span < width:
            rank = np.minimum(rank[: len(rank) - (width - span)], rank[width - span:])
        at = (rank & low).astype(np.int64)
        inside = np.zeros(len(at) + 1, bool)  # strings that stay in one text
        for s, e in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if e - s >= MATCH:
                inside[s:e - MATCH + 1] = True
        inside = inside[:-1]
        begins = inside.copy()
        begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        text = np.searchsorted(self.starts, first, side="right") - 1
        return text, h[at[first]], first, last


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts in slices of up to ``_CHUNK`` bytes; a longer text is
    a slice of its own."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate([*pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist(), None]):
            if i > start and (n is None or size + n > _CHUNK):
                part = batch.slice(start, i - start)
                yield part, _bytes(part.column(text))
                start, size = i, 0
            size += n or 0


def _windows(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """What of a slice is hashed together, with its offset: all its texts, or one
    piece after the other of a long text."""
    if len(values) > 1 or len(values[0]) < PIECE + MATCH:
        yield 0, values
        return
    for at in range(0, len(values[0]) - MATCH + 1, PIECE):
        yield at, [values[0][at:at + PIECE + MATCH - 1]]


# -- arrays of the index -------------------------------------------------------

def _planes(x: np.ndarray) -> bytes:
    """Bytes of the values, first bytes first: zero bytes lie together."""
    return np.ascontiguousarray(x[:, None].view(np.uint8).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(hashes: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    return _planes(np.diff(hashes.astype(np.uint32), prepend=np.uint32(0))), _planes(docs.astype(np.int64))


def _unpack(hashes: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_from_planes(hashes, np.uint32), dtype=np.uint32), _from_planes(docs, np.int64)


#: kind 0: suffix array of a batch; 1: of a level; 2: anchors known to be shared.
_ROWS = "kind int, level int, bucket int, hashes binary, docs binary"


def _bucket_and_rest(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h >> np.uint64(32 - bits)).astype(np.uint32)


def _suffix_arrays(bits: int):
    """Task: texts -> sorted arrays by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: list = []
        hashes, docs, held = [], [], 0
        for part, values in _slices(batches, 1):
            for _, texts in _windows(values):
                text, h, _, _ = _Text(texts, powers).anchors()
                hashes.append(h >> np.uint64(32 - bits))
                docs.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[text])
                held += len(h)
                if held >= _RUN:
                    yield from _sorted_run(np.concatenate(hashes), np.concatenate(docs))
                    hashes, docs, held = [], [], 0
        if held:
            yield from _sorted_run(np.concatenate(hashes), np.concatenate(docs))

    return run


def _sorted_run(h: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the index for some texts' anchors, by bucket."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(starts, len(h)))
    rank = np.arange(len(h)) - np.repeat(starts, count)
    frequent = np.repeat(count, count) >= FREQUENT
    rows = []
    for kind, keep in ((0, ~frequent | (rank < 2)), (2, frequent & (rank >= 2))):
        hk, dk = h[keep], d[keep]
        cuts = np.flatnonzero(np.diff((hk >> np.uint64(32)).astype(np.int64))) + 1
        for x, y in zip(np.split(hk, cuts), np.split(dk, cuts)):
            if len(x):
                rows.append((kind, -1, int(x[0] >> np.uint64(32)), *_pack(x & np.uint64(0xFFFFFFFF), y)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                     ["kind", "level", "bucket", "hashes", "docs"])


def _merge_scan(merging: list[int], target: int):
    """Task: the arrays of one bucket -> the batch's array as a level, merged
    levels, and the shared anchors."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        bucket = int(pdf["bucket"].iloc[0])

        def emit(kind: int, level: int, h: np.ndarray, d: np.ndarray) -> None:
            if len(h):
                out.append((kind, level, bucket, *_pack(h, d)))

        parts = {}
        for kind, level in sorted(set(zip(pdf["kind"], pdf["level"]))):
            rows = pdf[(pdf["kind"] == kind) & (pdf["level"] == level)]
            arrays = [_unpack(h, d) for h, d in zip(rows["hashes"], rows["docs"])]
            parts[kind, level] = tuple(np.concatenate([a[i] for a in arrays]) for i in (0, 1))
        for h, d in (parts.pop(k) for k in [k for k in parts if k[0] == 2]):
            order = np.argsort(h, kind="stable")
            emit(2, -1, h[order], d[order])
        if not parts:
            return pd.DataFrame(out, columns=["kind", "level", "bucket", "hashes", "docs"])
        h = np.concatenate([p[0] for p in parts.values()])
        d = np.concatenate([p[1] for p in parts.values()])
        fresh = np.concatenate([np.full(len(p[0]), k[0] == 0) for k, p in parts.items()])
        level = np.concatenate([np.full(len(p[0]), k[1]) for k, p in parts.items()])
        order = np.argsort(h, kind="stable")  # merges sorted runs
        h, d, fresh, level = h[order], d[order], fresh[order], level[order]
        emit(1, 0, h[fresh], d[fresh])
        merged = np.isin(level, merging)
        if len(merging):
            emit(1, target, h[merged], d[merged])
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(starts, len(h)))
        many = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) & np.logical_or.reduceat(fresh, starts)
        shared = np.repeat(many, count)
        emit(2, -1, h[shared], d[shared])
        return pd.DataFrame(out, columns=["kind", "level", "bucket", "hashes", "docs"])

    def and_release(pdf: pd.DataFrame) -> pd.DataFrame:
        # a bucket holds megabytes of arrays; the worker would keep those of the buckets before
        try:
            return run(pdf)
        finally:
            release_unused()

    return and_release


class IndexFamily:
    """Levels of sorted anchor suffixes; a level of size ``k`` holds 2^k batches.

    Levels are Parquet tables in the shared folder.  ``buckets`` is a power of
    two fixed for the family.
    """

    def __init__(self, buckets: int):
        self.bits = max(6, (buckets - 1).bit_length())
        self.levels: list[tuple[int, DataFrame]] = []  # newest last
        self.tables: list[DataFrame] = []  # what the levels are parts of

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the rows (doc, text); (doc, anchor) pairs of all anchors that
        the batch shares with another document."""
        arrays = batch.select("doc", "text").mapInArrow(tidy(_suffix_arrays(self.bits)), _ROWS)
        # two levels of one size merge now, as the scan reads them anyway
        pair = next(([i, i + 1] for i in range(len(self.levels) - 1) if self.levels[i][0] == self.levels[i + 1][0]), [])
        for i, (_, level) in enumerate(self.levels):
            arrays = arrays.unionByName(level.withColumn("level", F.lit(100 + i)))
        target = self.levels[pair[0]][0] + 1 if pair else -1
        done = staged(arrays.groupBy("bucket").applyInPandas(_merge_scan([100 + i for i in pair], target), _ROWS), "suffix-levels")
        if pair:
            self.levels[pair[0]:pair[1] + 1] = [(target, done.filter(f"kind = 1 and level = {target}"))]
        self.levels.append((0, done.filter("kind = 1 and level = 0")))
        self.tables.append(done)
        bits = self.bits

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    h, d = _unpack(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                    full = (np.int64(b.column(0)[i].as_py()) << 32) | h.astype(np.int64)
                    for at in range(0, len(h), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(d[at:at + 100_000]), pa.array(full[at:at + 100_000])], ["doc", "anchor"])

        return done.filter("kind = 2").select("bucket", "hashes", "docs").mapInArrow(tidy(spell), "doc long, anchor long")


# -- matches -----------------------------------------------------------------

def _blocks(bits: int):
    """Task: (doc, tag, text, anchors) -> blocks with one of the anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: list = []
        for part, values in _slices(batches, 2):
            docs, tags, wanted = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            for offset, texts in _windows(values):  # a block at the border of two pieces is two blocks
                t = _Text(texts, powers)
                text, h, first, last = t.anchors()
                anchor = (h >> np.uint64(32 - bits)).astype(np.int64)
                keep = np.zeros(len(text), bool)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    x, y = cuts[i], cuts[i + 1]
                    if y > x:
                        keep[x:y] = np.isin(anchor[x:y], wanted[i].values.to_numpy(zero_copy_only=False))
                text, anchor, first, last = text[keep], anchor[keep], first[keep], last[keep]
                whole = t.hashes(first, last - first + MATCH).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[text]), pa.array(tags[text]), pa.array((first - t.starts[text] + offset).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)), pa.array(anchor), pa.array(whole)],
                    ["doc", "tag", "first", "strings", "anchor", "block"])

    return run


def _spots(spots: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    s = spots[i].values
    return s.field("first").to_numpy().astype(np.int64), s.field("strings").to_numpy().astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _strings():
    """Task: (doc, tag, text, spots) -> hash of each string of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: list = []
        for part, values in _slices(batches, 2):
            docs, tags, spots = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            for offset, texts in _windows(values):
                t = _Text(texts, powers)
                at, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(len(texts)):
                    p = _spread(*_spots(spots, i)) - offset
                    p = p[(p >= 0) & (p + MATCH <= t.sizes[i])]  # in this piece
                    at.append(p + t.starts[i])
                    who.append(np.full(len(p), i, np.int64))
                at, who = np.concatenate(at), np.concatenate(who)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[who]), pa.array(tags[who]), pa.array((at - t.starts[who] + offset).astype(np.int32)),
                    pa.array(t.hashes(at, MATCH).view(np.int64))], ["doc", "tag", "first", "string"])

    return run


def _pieces():
    """Task: (doc, tag, text, spots) -> the bytes of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _slices(batches, 2):
            docs, tags, spots, rows = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3), []
            for i, v in enumerate(values):
                anchors = spots[i].values.field("anchor").to_pylist()
                rows += [(docs[i], tags[i], f, a, v[f:f + n + MATCH - 1]) for a, f, n in zip(anchors, *map(np.ndarray.tolist, _spots(spots, i)))]
            doc, tag, first, anchor, piece = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(first, pa.int32()), pa.array(anchor, pa.int64()),
                pa.array(piece, pa.binary())], ["doc", "tag", "first", "anchor", "piece"])

    return run


def _compared():
    """Task: pieces in order of their anchors -> runs of strings (first,
    strings) that a piece of a smaller document has as well."""
    def runs(rows: pa.Table, powers: list) -> pa.RecordBatch:
        t = _Text(rows.column("piece").to_pylist(), powers)
        docs, tags, base = (rows.column(c).to_numpy() for c in ("doc", "tag", "first"))
        n = t.sizes - MATCH + 1
        who = np.repeat(np.arange(len(n)), n)
        at = _spread(t.starts[:-1], n)
        h, doc = t.hashes(at, MATCH), docs[who]
        order = np.lexsort((doc, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        origin = doc[order][new][np.cumsum(new) - 1]
        gone = np.zeros(len(h), bool)
        gone[order] = origin < doc[order]
        same = np.concatenate([[False], gone[:-1] & (who[1:] == who[:-1])])
        begin = np.flatnonzero(gone & ~same)
        following = np.concatenate([same[1:] & gone[1:], [False]])
        end = np.flatnonzero(gone & ~following)
        w = who[begin]
        return pa.RecordBatch.from_arrays([
            pa.array(docs[w]), pa.array(tags[w]), pa.array((base[w] + at[begin] - t.starts[w]).astype(np.int32)),
            pa.array((end - begin + 1).astype(np.int32))], ["doc", "tag", "first", "strings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: list = []
        held = None  # pieces of the last anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table_ = pa.Table.from_batches([batch])
            held = table_ if held is None else pa.concat_tables([held, table_])
            anchors = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield runs(held.slice(0, cut), powers)
                held = held.slice(cut)
        if held is not None:
            yield runs(held, powers)

    return run


def _with_texts(reps: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Join the texts of ``reps`` to ``lists``, shuffling only those needed."""
    ids = lists.select(*keys).distinct()
    if lists.count() <= BROADCAST_IDS:
        reps = reps.join(F.broadcast(ids), keys, "left_semi")
    return reps.join(lists.hint("shuffle_hash"), keys)  # no sort of the texts


def repeated_spans(reps: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, tag, spans) of distinct texts (doc, tag, text): the strings
    (first, strings) that an earlier document has as well."""
    spark = reps.sparkSession
    size = reps.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    family = IndexFamily(max(64, -(-size // BUCKET_BYTES)))
    cuts = reps.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    hits = spark.createDataFrame([], "doc long, anchor long")
    for low, high in zip(bounds, bounds[1:]):
        batch = reps if low is None else reps.filter(F.col("doc") > low)
        batch = batch if high is None else batch.filter(F.col("doc") <= high)
        hits = hits.unionByName(family.add(batch))
    wanted = staged(hits.groupBy("doc").agg(F.collect_set("anchor").alias("anchors")), "anchors-by-doc")
    dropped(*family.tables)
    with_text = _with_texts(reps, wanted, ["doc"]).select("doc", "tag", "text", "anchors")
    blocks = staged(with_text.mapInArrow(tidy(_blocks(family.bits)), "doc long, tag int, first int, strings int, anchor long, block long"), "blocks")
    dropped(wanted)
    firsts = staged(blocks.groupBy("block").agg(F.min("doc").alias("origin"), F.first("anchor").alias("anchor"))
                    .select("block", "origin", "anchor"), "block-origins")
    differing = firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    loose = firsts.join(differing, "anchor").select("block", F.col("origin").alias("from"), (F.col("n") <= LOCAL_BLOCKS).alias("local"))
    placed = blocks.join(firsts.select("block", "origin"), "block")
    whole = placed.filter("origin < doc").select("doc", "tag", "first", "strings")
    # a loose block's first document stands for it; the others are removed as a whole
    spots = staged(blocks.join(loose, (blocks.block == loose.block) & (F.col("doc") == F.col("from")))
                   .groupBy("doc", "tag", "local").agg(F.collect_list(F.struct("first", "strings", "anchor")).alias("spots")), "loose-blocks")
    few, many = spots.filter("local").drop("local"), spots.filter("not local").drop("local")
    pieces = (_with_texts(reps, few, ["doc", "tag"]).select("doc", "tag", "text", "spots")
              .mapInArrow(tidy(_pieces()), "doc long, tag int, first int, anchor long, piece binary"))
    partial = (pieces.repartition("anchor").sortWithinPartitions("anchor")
               .mapInArrow(tidy(_compared()), "doc long, tag int, first int, strings int"))
    strings = staged(_with_texts(reps, many, ["doc", "tag"]).select("doc", "tag", "text", "spots")
                     .mapInArrow(tidy(_strings()), "doc long, tag int, first int, string long"), "strings")
    origin = strings.groupBy("string").agg(F.min("doc").alias("origin"))
    single = strings.join(origin, "string").filter("origin < doc").select("doc", "tag", "first", F.lit(1).alias("strings"))
    whole = whole.unionByName(partial)
    spans = whole.unionByName(single).groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "strings")).alias("spans"))
    out = staged(spans.mapInArrow(tidy(_merged), "doc long, tag int, spans array<struct<first:int,strings:int>>"), "spans")
    dropped(blocks, firsts, spots, strings)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: spans of a text -> its removed runs in order, apart from each other."""
    for batch in batches:
        runs = []
        for i in range(batch.num_rows):
            first, n = _spots(batch.column(2), i)
            order = np.argsort(first, kind="stable")
            first, end = first[order], np.maximum.accumulate(first[order] + n[order] + MATCH - 1)
            new = np.concatenate([[True], first[1:] > end[:-1]])
            begin = first[new]
            stop = end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
            runs.append([{"first": a, "strings": b - a - MATCH + 1} for a, b in zip(begin.tolist(), stop.tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("strings", pa.int32())])))],
            ["doc", "tag", "spans"])


def _cut(columns: list[str]):
    """Task: rows with text and spans -> rows with n_bytes, n_removed, n_spans, kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = whole.schema.get_field_index("text")
            for batch, values in _slices([whole], text):
                spans, rows = batch.column(batch.schema.get_field_index("spans")), []
                for i, v in enumerate(values):
                    gone = np.zeros(len(v) + 1, np.int32)
                    first, n = _spots(spans, i)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + n + MATCH - 1, -1)
                    out = np.cumsum(gone[:-1]) > 0
                    runs = int(np.count_nonzero(out & ~np.concatenate([[False], out[:-1]])))
                    rows.append((len(v), int(out.sum()), runs, np.frombuffer(v, np.uint8)[~out].tobytes()))
                n, removed, runs, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in columns),
                     pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    [*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans and
    ``kept``, the bytes that remain, in place of the text and of columns of
    these names."""
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in docs.columns if c != "text" and c.lower() not in made]
    return _without_repeats(packed(docs), batches).select(*[F.col("_row").getField(c).alias(c) for c in keep], *made)


def _without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The same for ``packed`` documents, with their ``_row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text", text).withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    key = F.struct(F.xxhash64("text"), F.hash("text"), F.octet_length("text"))
    keys = staged(rows.select("_doc", key.alias("_key")), "text-keys")
    texts = keys.groupBy("_key").agg(F.min("_doc").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    copies = staged(keys.join(texts, "_key").filter("_doc > _first").select("_doc", "_key").distinct(), "copies")
    hint = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    rows = rows.withColumn("_key", key)
    originals = rows.join(hint, ["_doc", "_key"], "left_anti")
    # repeated rows share id and tag; an anchor needs two different ids, so they never match
    reps = originals.filter(F.octet_length("text") >= MATCH).select(F.col("_doc").alias("doc"), F.hash("text").alias("tag"), "text")
    spans = repeated_spans(reps, batches)
    columns = docs.columns
    keep = [c for c in columns if c != "text"]
    schema = T.StructType([*(f for f in docs.schema if f.name != "text"),
                           *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary")])
    tagged = originals.withColumn("_tag", F.hash("text"))
    spots = spans.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "spans")
    marks = spots.select("_doc", "_tag")
    mark = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    runs = spots.agg(F.sum(F.size("spans"))).first()[0] or 0
    if runs <= BROADCAST_RUNS:
        cut = tagged.join(F.broadcast(spots), ["_doc", "_tag"])
    else:
        cut = tagged.join(mark, ["_doc", "_tag"], "left_semi").join(spots.hint("shuffle_hash"), ["_doc", "_tag"])
    cut = cut.select(*columns, "spans").mapInArrow(tidy(_cut(keep)), schema)
    size = F.octet_length("text").cast("long")
    same = tagged.join(mark, ["_doc", "_tag"], "left_anti").select(
        *keep, size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.to_binary("text", F.lit("utf-8")).alias("kept"))
    long_copy = F.octet_length("text") >= MATCH
    gone = rows.join(hint, ["_doc", "_key"], "left_semi").select(
        *keep, size.alias("n_bytes"), F.when(long_copy, size).otherwise(0).alias("n_removed"),
        F.when(long_copy, 1).otherwise(0).cast("long").alias("n_spans"),
        F.to_binary(F.when(long_copy, "").otherwise(F.col("text")), F.lit("utf-8")).alias("kept"))
    return cut.unionByName(same).unionByName(gone)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _as_text(kept: list[bytes]) -> list[str]:
    return [k.decode("utf-8", "ignore") for k in kept]


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose the passages that an earlier document has.

    What is left of a character that was cut goes too; a document stays even if
    nothing of its text does, and ``n_chars`` follows the text.  Other columns
    stay as given, whatever their names.
    """
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kept = batch.columns
            given = dict(zip([f.name for f in row.type], row.flatten()))
            texts = _as_text(kept.to_pylist())
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in schema.names:
                made["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
            out = pa.Table.from_arrays([made[c] if c in made else given[c] for c in schema.names], names=schema.names)
            yield from out.cast(arrow).to_batches()

    return _without_repeats(packed(docs)).select("_row", "kept").mapInArrow(tidy(run), schema)
