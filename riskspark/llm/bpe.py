"""Byte-level BPE encoding and decoding (operator 2).

A task splits each text into words by the tokenizer's pattern, and every word of
every document takes its ids by position from a table of words.  The words most
common in the corpus are in that table from the start: a first pass counts the
words of a random ``HOT_SHARE`` of the rows, and the most frequent ones, up to
``HOT_BYTES`` bytes of them, are folded on executors, a Spark ``aggregate`` that at
every step merges the leftmost pair of lowest rank that the rank map knows.  They
are sent to every task with their ids.  A task merges the other words that it meets,
those of a block together, by the same rule (``merge_words``; long ones by a heap),
and remembers up to ``KNOWN_BYTES`` of them, then starts anew.  Lowest rank first, leftmost among
equals, is one order of merges, so ids depend neither on the draw nor on which of
the two met a word.  Texts are not shuffled, and a lost executor's task is done
again from its input alone.  ``encode`` reads its rows once more, and runs the first
pass when it is called.

The rank map (pair of ids -> id of the merged token) is one constant of the
plan: an array of small maps, found by ``pair mod MAP_SLOTS``, because a lookup
in a Spark map is a scan.  It depends on the vocabulary only.

The fold takes time in the square of a word's length, so words of more than
``FOLD_BYTES`` bytes (unbroken strings) are never hot.

Decoding maps ids to the pieces' bytes and concatenates them.

Results for odd input: a null or empty text has no ids; ids outside the
vocabulary raise on decoding; repeated rows are encoded each; an empty table
gives an empty result; every other column is carried along, but for columns with
the names of results, which the results replace.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.shared import table, tidy

BLOCK_CHARS = 500_000
KNOWN_BYTES = 1_500_000
FOLD_BYTES = 200  # at most 254, see ``fold``
HOT_SHARE = 1 / 16
HOT_BYTES = 1_000_000
HOT_TASKS = 48
#: Neither a rank nor an id.
NO_RANK = 0xFFFF
#: Words of more bytes are merged one by one; so many bytes of others lie in one array.
ROW_BYTES = 64
ARRAY_BYTES = 100_000
#: A prime, so that pairs with a common left or right id spread over the slots.
MAP_SLOTS = 262_147
#: White space as Unicode lists it; Python's own class also has 1C to 1F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def exact_pattern(pattern: str) -> str:
    """The pattern with white space classes spelled out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in ("\\s", "\\S"):
            out.append(_SPACE if inside and two == "\\s" else f"[{'^' * (two == chr(92) + 'S')}{_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id for every split of a token into two tokens."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items()
            for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: lowest rank first, leftmost among equals."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two pieces has changed
        gone = end[i]
        end[i], end[gone] = stop, 0
        if stop < n:
            before[stop] = i
        for a, b in ((before[i], stop), (i, end[stop] if stop < n else 0)):
            if a >= 0 and b and word[a:b] in ranks:
                heapq.heappush(heap, (ranks[word[a:b]], a, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class Pairs:
    """Pairs of ids in order, and the ids of bytes: what ``merge_words`` looks up."""

    def __init__(self, ranks: dict[bytes, int]):
        found = merge_pairs(ranks)
        # at the end a pair that is none, so that every search ends inside
        keys = np.array([(a << 16) + b for a, b in found] + [(NO_RANK << 16) + NO_RANK], np.uint32)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([*found.values(), NO_RANK], np.uint16)[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the tokens that the pairs make, or ``NO_RANK``."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], np.uint16(NO_RANK))


def _merge_rows(words: list[bytes], sizes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids one after another, and how many each has.  A row for each
    word, a column for each byte and one without a piece at both ends; a step
    merges the leftmost pair of lowest rank of every row."""
    n, width = len(words), int(sizes.max()) + 2
    column = np.arange(width)
    ids = np.full((n, width), NO_RANK, np.uint32)
    ids[(column > 0) & (column <= sizes[:, None])] = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full((n, width), NO_RANK, np.uint16)
    rank[:, :-1] = pairs.merged(ids[:, :-1], ids[:, 1:])
    following, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
    rows = np.arange(n)
    while True:
        at = rank[rows].argmin(1)
        low = rank[rows, at]
        some = low != NO_RANK
        rows, at, low = rows[some], at[some], low[some]
        if not len(rows):
            break
        gone, left = following[rows, at], before[rows, at]
        right = following[rows, gone]
        ids[rows, at], ids[rows, gone], rank[rows, gone] = low, NO_RANK, NO_RANK
        following[rows, at], before[rows, right] = right, at
        rank[rows, at] = pairs.merged(low, ids[rows, right])
        rank[rows, left] = pairs.merged(ids[rows, left], low)
    left_over = ids != NO_RANK
    return ids[left_over].astype(np.int32), left_over.sum(1)


def merge_words(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids one after another, and how many each has: those of ``heap_merge``."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    short = int(np.searchsorted(sizes[order], ROW_BYTES, side="right"))
    flat, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < short:
        rows = order[at:min(at + max(1, ARRAY_BYTES // (int(sizes[order[at]]) + 2)), short)]
        for x, to in zip(_merge_rows([words[i] for i in rows.tolist()], sizes[rows], pairs), (flat, counts)):
            to.append(x)
        at += len(rows)
    for i in order[short:].tolist():
        flat.append(np.array(heap_merge(words[i], ranks), np.int32))
        counts.append(np.array([len(flat[-1])], np.int64))
    by_size = np.concatenate(counts)
    starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    starts[order], lengths[order] = np.cumsum(by_size) - by_size, by_size
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.concatenate(flat)[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths


class _Codes(dict):
    """word -> code: the place of a word merged here, or -1 - its place in ``HotWords``.

    ``flat`` and ``ends`` hold the ids of the words merged here, from ``settle`` on."""

    def __init__(self, ranks: dict[bytes, int], hot: dict[str, int]):
        super().__init__(hot)  # shares the words themselves
        self.ranks = ranks
        self.flat, self.ends, self.bytes = array("i"), array("q", [0]), 0
        self.fresh: list[bytes] = []

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        self.bytes += len(raw)
        if whole is not None:
            code = -1 - whole
        else:
            code = len(self.ends) - 1 + len(self.fresh)
            self.fresh.append(raw)
        self[word] = code
        return code

    def settle(self, pairs: Pairs) -> None:
        """Merge the words met since the last call."""
        ids, lengths = merge_words(self.fresh, self.ranks, pairs)
        self.ends.frombytes((np.cumsum(lengths) + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())
        self.fresh = []


class HotWords:
    """The words that every task knows: each id by itself at the place of its
    number, the hot words behind them."""

    def __init__(self, vocabulary: int, words: list[bytes], ids: list[np.ndarray]):
        self.vocabulary, self.words = vocabulary, words
        self.flat = np.concatenate([np.arange(vocabulary), *ids]).astype(np.int32)
        self.offsets = np.cumsum([0, *[1] * vocabulary, *map(len, ids)])

    def codes(self) -> dict[str, int]:
        return {w.decode("utf-8"): -1 - self.vocabulary - i for i, w in enumerate(self.words)}


def _list_words(ranks: dict[bytes, int], pattern: str):
    """A batch's words that are no token as a whole, with their counts."""
    split = regex.compile(pattern).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0):
                counts.update(split(t.as_py() or ""))
            found = [(w, n) for w, n in ((w.encode("utf-8"), n) for w, n in counts.items())
                     if w not in ranks and len(w) <= FOLD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()),
                                              pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    return run


def _one_row(ranks: dict[bytes, int]):
    """A task's words in one row, each with the ids of its bytes."""
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column(0).to_pylist()]
        if words:
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
            whole = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, pa.array(words, pa.binary())),
                                              pa.ListArray.from_arrays(whole, ids)], ["word", "pieces"])

    return run


def hot_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
              share: float = HOT_SHARE, most_bytes: int = HOT_BYTES) -> HotWords:
    """The most frequent words of a random ``share`` of the rows, folded.

    Only words above a count travel to the driver, the least count (of a fixed
    grid) whose words have ``most_bytes`` bytes in all at most."""
    vocabulary = max(ranks.values()) + 1
    if not most_bytes:
        return HotWords(vocabulary, [], [])
    counted = (docs.select(text).where(F.rand(42) < share).mapInArrow(tidy(_list_words(ranks, pattern)), "word binary, n bigint")
               .groupBy("word").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        grid = sorted({int(1.25 ** i) for i in range(150)})
        sizes = counted.agg(*[F.sum(F.when(F.col("n") >= g, F.length("word"))).alias(f"b{i}") for i, g in enumerate(grid)]).first()
        least = next((g for g, b in zip(grid, sizes) if (b or 0) <= most_bytes), None)
        if least is None or not sizes[0]:
            return HotWords(vocabulary, [], [])
        # a fixed number of tasks, as the few bytes would else be folded in one; a
        # row to each, as the constant is copied into every row
        words = counted.where(F.col("n") >= least).select("word").repartition(HOT_TASKS).mapInArrow(
            tidy(_one_row(ranks)), "word array<binary>, pieces array<array<int>>")
        rows = words.join(F.broadcast(rank_row(docs.sparkSession, ranks))).select(
            "word", F.transform("pieces", lambda w: fold(w, F.col("ranks"))).alias("ids")).toArrow()
        lists = [x for c in rows["ids"].chunks for x in c.flatten().to_numpy(zero_copy_only=False)]
        return HotWords(vocabulary, [w for r in rows["word"].to_pylist() for w in r], lists)
    finally:
        counted.unpersist()


def _to_ids(ranks: dict[bytes, int], pattern: str, text: str, block_chars: int, known_bytes: int, hot: HotWords, schema: pa.Schema):
    """Task: documents -> their other columns and ids, a block of about ``block_chars`` characters at a time."""
    split = regex.compile(pattern).findall
    hot_codes, hot_flat, hot_offsets = hot.codes(), hot.flat, hot.offsets  # not the words a second time
    pairs = Pairs(ranks)

    def close(kept: list[pa.RecordBatch], codes: _Codes, docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rest = pa.Table.from_batches(kept)
        codes.settle(pairs)
        # behind the ids of the words merged here: those of the words that every task knows
        flat, offsets = np.array(codes.flat, np.int32), np.array(codes.ends, np.int64)
        ids_table = np.concatenate([flat, hot_flat])
        all_codes = np.concatenate([*docs, np.array([], np.int32)])
        here = all_codes >= 0
        lengths, starts = np.empty(len(all_codes), np.int64), np.empty(len(all_codes), np.int64)
        lengths[here], starts[here] = np.diff(offsets)[all_codes[here]], offsets[:-1][all_codes[here]]
        places = -1 - all_codes[~here]
        lengths[~here], starts[~here] = np.diff(hot_offsets)[places], len(flat) + hot_offsets[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = ids_table[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])].astype(np.int32)
        cuts = ends[np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)]
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [
            None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
        out = pa.Table.from_arrays([*rest.columns, lists, packed], names=[*rest.column_names, "ids", "ids_le"])
        yield from out.cast(schema).to_batches(max_chunksize=2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, codes, docs, chars = [], _Codes(ranks, hot_codes), [], 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            start = 0
            for i in range(batch.num_rows):
                t = column[i].as_py() or ""
                docs.append(np.fromiter(map(codes.__getitem__, split(t)), np.int32))
                chars += len(t)
                if chars >= block_chars:
                    yield from close([*kept, batch.slice(start, i + 1 - start).drop_columns([text])], codes, docs)
                    if codes.bytes > known_bytes:
                        codes = _Codes(ranks, hot_codes)
                    kept, docs, chars, start = [], [], 0, i + 1
            if start < batch.num_rows:
                kept.append(batch.slice(start).drop_columns([text]))
        if docs:
            yield from close(kept, codes, docs)

    return run


def rank_row(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row, one constant: slot -> map of pair (left * 2^16 + right) to merged id."""
    slots: list[list] = [[] for _ in range(MAP_SLOTS)]
    for (a, b), r in merge_pairs(ranks).items():
        slots[((a << 16) + b) % MAP_SLOTS].append(((a << 16) + b, r))
    kind = pa.list_(pa.map_(pa.int64(), pa.int32()))
    return spark.createDataFrame(pa.table({"ranks": pa.array([slots], kind)}))


def fold(word: Column, ranks: Column) -> Column:
    """Ids of one word from the ids of its bytes, by ranked merges.

    The state is one array of longs, an element for each piece: the rank at which
    it merges with the piece behind it (``NO_RANK``: not at all), its position in the
    array, its id.  So the smallest element is the leftmost pair of lowest rank and
    tells where it stands.  A merge replaces three elements by two, looks up their two
    new pairs only and moves the elements behind up by one.  An element of no id
    stands in front, so that every pair has a piece before it."""
    def element(a: Column, b: Column, rest: Column) -> Column:
        pair = F.shiftleft(a, 16) + b
        rank = F.try_element_at(F.get(ranks, F.pmod(pair, F.lit(MAP_SLOTS)).cast("int")), pair)
        return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)).cast("long"), 24) + rest

    def piece(e: Column) -> Column:
        return e.bitwiseAND(F.lit(0xFFFF).cast("long"))

    def merged(s: Column, low: Column) -> Column:
        at = F.shiftright(low, 16).bitwiseAND(F.lit(0xFF).cast("long")).cast("int")
        rank = F.shiftright(low, 24)
        before = F.get(s, at - 1)
        return F.concat(
            F.slice(s, 1, at - 1),
            F.array(element(piece(before), rank, before.bitwiseAND(F.lit(0xFFFFFF).cast("long"))),
                    element(rank, piece(F.get(s, at + 2)), low.bitwiseAND(F.lit(0xFF0000).cast("long")) + rank)),
            F.transform(F.slice(s, at + 3, F.size(word)), lambda e: e - F.lit(1 << 16)))

    def step(s: Column, _: Column) -> Column:
        # a one-element array names the smallest element, so that it is sought once
        return F.element_at(F.transform(F.array(F.array_min(s)), lambda low: F.when(
            low >= F.lit(NO_RANK << 24), s).otherwise(merged(s, low))), 1)

    front = F.array(F.lit((NO_RANK << 24) + NO_RANK))
    pieces = F.transform(word, lambda a, i: element(
        a.cast("long"), F.get(word, i + 1), F.shiftleft((i + 1).cast("long"), 16) + a))
    return F.aggregate(F.slice(word, 2, F.size(word)), F.concat(front, pieces), step,
                       lambda s: F.transform(F.slice(s, 2, F.size(s)), lambda e: piece(e).cast("int")))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           block_chars: int = BLOCK_CHARS, known_bytes: int = KNOWN_BYTES,
           hot_share: float = HOT_SHARE, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` without its text, with ``ids`` (array<int>) and ``ids_le`` (the
    ids as little-endian unsigned 32-bit integers), in place of columns of these names."""
    docs = docs.drop("ids", "ids_le")
    if max(ranks.values()) >= NO_RANK or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary needs all single bytes and ids below 65,535")
    rest = T.StructType([f for f in docs.schema if f.name != text])
    exact = exact_pattern(pattern)
    hot = hot_words(docs, ranks, exact, text, hot_share, hot_bytes)
    out = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_le", T.BinaryType())])
    return docs.mapInArrow(tidy(_to_ids(ranks, exact, text, block_chars, known_bytes, hot, to_arrow_schema(out))), out)


def decode(coded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary), in place of a column of this name: the pieces of the ids, concatenated."""
    coded = coded.drop("decoded")
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    known = np.zeros(len(pieces), bool)
    known[list(ranks.values())] = True
    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    schema = T.StructType([*coded.schema, T.StructField("decoded", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(batch.schema.get_field_index(ids))
                flat = np.asarray(lists.flatten()).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(known) or not known[flat].all()):
                    raise ValueError("an id is outside the vocabulary")
                lengths = ends[flat + 1] - ends[flat]
                stops = np.concatenate([[0], np.cumsum(lengths)])
                data = joined[np.repeat(ends[flat] - stops[:-1], lengths) + np.arange(stops[-1])]
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                cuts = stops[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                decoded = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [
                    None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                out = pa.Table.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])
                yield from out.cast(arrow).to_batches()

    return coded.mapInArrow(tidy(run), schema)


def public_tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers
    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    ranks, pattern = public_tokenizer()
    coded = encode(docs.select("doc_id", "text"), ranks, pattern)
    return decode(coded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the public 50k byte-level BPE."""
    return round_trip(table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' digests, one row per row."""
    return round_trip(docs)
