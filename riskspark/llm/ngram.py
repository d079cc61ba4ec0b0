"""Quality rules with n-gram perplexity (operator 4).

Texts are read as UTF-8 bytes, each byte a symbol of its own (``every_byte``).
Spark counts all n-grams of ``ORDER`` symbols over all documents: a task adds up
its own documents, then the counts are summed by key.  From the counts Spark
derives a modified Kneser-Ney model: discounts D1, D2, D3+ of each order from its
counts of counts, continuation counts for the lower orders, and the back-off mass
of each context.  The model is held in sorted arrays (n-gram code -> log
probability; context code -> log back-off weight) of the n-grams that occur, so it
grows with what the corpus holds; it is broadcast, 12 bytes for each of them.
``alphabet`` is a folded table of 64 symbols for models of a bounded size.

A document's score is its mean negative log probability per symbol, the log of
the perplexity.  Per language and class of lengths, the median and the median
absolute deviation of the scores of documents that pass the base rules set a
lower and an upper band; scores outside are rejected: too low is repetition,
too high is noise.

Results for odd input: a null or empty text has no words and fails the base
rules; a null language is a language of its own; repeated rows count each; an
empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.shared import staged, table, tidy

ORDER = 4
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1_000_000
#: Width of a language's bands in scaled median absolute deviations.
LOWER, UPPER = 3.5, 3.5
#: Smallest scaled deviation, so that a language of one text has a band.
LEAST_SPREAD = 0.01
#: A length class with fewer documents takes its language's band.
LEAST_DOCS = 30
MIN_WORDS = 50
MAX_REPEATED = 0.5
RARE = b"#*$%&|<>"
_CHUNK = 1_000_000
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def every_byte() -> np.ndarray:
    """Byte -> symbol, each its own.  0 is the start of a text."""
    return np.arange(1, 257, dtype=np.uint16)


def alphabet() -> np.ndarray:
    """Byte -> symbol, folded to 64 classes.  0 is the start of a text."""
    to = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b).lower() if b < 128 else ""
        if "a" <= c <= "z":
            to[b] = 1 + ord(c) - ord("a")
        elif c == " ":
            to[b] = 27
        elif c == "\n":
            to[b] = 28
        elif b < 33 or b == 127:
            to[b] = 29
        elif c.isdigit():
            to[b] = 30
        elif b < 128:  # punctuation: the usual signs alone, the others together
            to[b] = {".": 31, ",": 32, "'": 33, '"': 33, "-": 34, ":": 35, ";": 35, "!": 36, "?": 36, "(": 37, ")": 37,
                     "/": 38, "@": 39}.get(c, 40 if b in RARE else 41)
        elif b < 192:  # inside of a character
            to[b] = 42 + (b & 15)
        else:  # first byte of a character
            to[b] = 58 if b < 0xC4 else 59 if b < 0xD0 else 60 if b < 0xE0 else 61 if b < 0xE4 else 62 if b < 0xF0 else 63
    return to


def _size(to: np.ndarray) -> tuple[int, int]:
    """Number of symbols, and bits of a symbol."""
    symbols = int(to.max()) + 1
    return symbols, (symbols - 1).bit_length()


def _codes(texts: list[bytes], to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram code at each byte (a text starts after ORDER - 1 start symbols)
    and the sizes of the texts."""
    pad = b"\0" * (ORDER - 1)
    raw = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = to[raw]
    starts = (ORDER - 1) + np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]).astype(np.int64)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())
    own = np.zeros(len(symbols), bool)
    own[inside] = True
    symbols = np.where(own, symbols, 0).astype(np.int64)
    bits = _size(to)[1]
    code = symbols.copy()
    for k in range(1, ORDER):
        code[k:] += symbols[:-k] << (bits * k)
    return code[inside], sizes


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows with about ``_CHUNK`` bytes of text."""
    for batch in batches:
        values = [(t or "").encode("utf-8") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        start = size = 0
        for i, v in enumerate(values):
            size += len(v)
            if size >= _CHUNK or i == len(values) - 1:
                yield batch.slice(start, i + 1 - start), values[start:i + 1]
                start, size = i + 1, 0


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several (codes, counts) and their sums."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return codes, sums


def count_ngrams(docs: DataFrame, text: str = "text", to: np.ndarray | None = None) -> DataFrame:
    """(code, n) of all n-grams of ``ORDER`` symbols in all texts."""
    to = alphabet() if to is None else to

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        codes, sums = _added(parts)
        for at in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + 100_000]), pa.array(sums[at:at + 100_000])], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, fresh = [], 0
        for _, texts in _texts(batches, text):
            parts.append(np.unique(_codes(texts, to)[0], return_counts=True))
            fresh += len(parts[-1][0])
            if fresh > HELD:
                parts = [_added(parts)]
                fresh = len(parts[0][0])
                if len(parts[0][0]) > HELD:
                    yield from rows(parts)
                    parts = []
        if parts:
            yield from rows(parts)

    return docs.select(text).mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counted: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts of one order."""
    n = counted.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


class Model:
    """Sorted arrays of a modified Kneser-Ney model.

    ``orders[k]`` has, for n-grams of k + 1 symbols, sorted codes and their
    interpolated log probabilities; ``backoff[k]`` sorted context codes of k
    symbols and their log back-off weights.
    """

    def __init__(self, orders, backoff, symbols: int, bits: int):
        self.orders, self.backoff, self.symbols, self.bits = orders, backoff, symbols, bits

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each (distinct) code."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        for k in range(ORDER - 1, -1, -1):
            keys, values = self.orders[k]
            own = codes[todo] & ((1 << self.bits * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            out[todo[hit]] += values[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            contexts, weights = self.backoff[k]
            context = own >> self.bits
            at = np.minimum(np.searchsorted(contexts, context), max(len(contexts) - 1, 0))
            hit = contexts[at] == context if len(contexts) else np.zeros(len(own), bool)
            out[todo[hit]] += weights[at[hit]]
        out[todo] -= np.log(self.symbols)  # a symbol that occurs nowhere
        return out


def train(counts: DataFrame, to: np.ndarray | None = None) -> Model:
    """Modified Kneser-Ney model of (code, n) counts.

    No derived table has more rows than ``counts``.
    """
    symbols, bits = _size(alphabet() if to is None else to)
    counted = counts.select(F.col("code").cast("long").alias("code"), "n")
    levels = {ORDER - 1: counted}
    for k in range(ORDER - 2, -1, -1):  # in how many places does the n-gram without its first symbol occur
        levels[k] = staged(levels[k + 1].groupBy(F.col("code").bitwiseAND(F.lit((1 << bits * (k + 1)) - 1).cast("long")).alias("code"))
                           .agg(F.count("*").alias("n")), f"ngrams-{k + 1}")
    lower = None
    orders, backoff = [], []
    for k in range(ORDER):
        level = levels[k]
        d = discounts(level)
        context = F.shiftright("code", bits).alias("context")
        per_context = level.groupBy(context).agg(
            F.sum("n").alias("total"),
            sum((F.count(F.when(cond, 1)) * w for cond, w in (
                (F.col("n") == 1, d[0]), (F.col("n") == 2, d[1]), (F.col("n") >= 3, d[2]))), F.lit(0.0)).alias("cut"))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        with_context = level.withColumn("context", F.shiftright("code", bits)).join(per_context, "context")
        if lower is None:
            below = F.lit(1.0 / symbols)
        else:
            with_context = with_context.join(
                lower, F.col("code").bitwiseAND(F.lit((1 << bits * k) - 1).cast("long")) == F.col("lower_code"))
            below = F.col("lower_p")
        p = (F.col("n") - cut) / F.col("total") + F.col("cut") / F.col("total") * below
        table_ = staged(with_context.select("code", p.alias("p")), f"probabilities-{k + 1}")
        lower = table_.select(F.col("code").alias("lower_code"), F.col("p").alias("lower_p"))
        orders.append(_sorted(table_.select("code", F.log("p"))))
        backoff.append(_sorted(per_context.select("context", F.log(F.col("cut") / F.col("total")))))
    return Model(orders, backoff, symbols, bits)


def _sorted(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = pairs.toArrow()
    keys, values = got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().astype(np.float32)
    order = np.argsort(keys)
    return keys[order], values[order]


def _base(texts: list[bytes], ids: dict[bytes, int]) -> list[tuple]:
    out = []
    for t in texts:
        words = t.split()
        n = len(words)
        packed = t.translate(None, b" \t\n\r\x0b\x0c")
        chars = len(packed.decode("utf-8", "ignore"))
        symbols = len(t) - len(t.translate(None, RARE))
        seen: set[bytes] = set()
        duplicates = 0
        for line in t.split(b"\n"):
            if line in seen:
                duplicates += bool(line.strip())
            else:
                seen.add(line)
        repeated = 0
        if n >= 3:
            w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
            base = len(ids)
            if base >= 1 << 21:  # too many words for one long: number them anew
                w = np.unique(w, return_inverse=True)[1]
                base = int(w.max()) + 1
                ids.clear()
            if base < 1 << 21:
                windows = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
                order = np.argsort(windows)
                same = windows[order][1:] == windows[order][:-1]
            else:
                order = np.lexsort((w[2:], w[1:-1], w[:-2]))
                rows = np.stack([w[:-2], w[1:-1], w[2:]])[:, order]
                same = (rows[:, 1:] == rows[:, :-1]).all(0)
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeated = int(covered.sum())
        failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
        out.append((n, chars, symbols, duplicates, repeated, failed))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", to: np.ndarray | None = None) -> DataFrame:
    """``docs`` without its text, with the base counts and ``log_perplexity``
    (null for a text without bytes)."""
    to = alphabet() if to is None else to
    shared = docs.sparkSession.sparkContext.broadcast((model.orders, model.backoff, model.symbols, model.bits))
    rest = [f for f in docs.schema if f.name != text]
    base = T.StructType.fromDDL(_BASE)
    schema = T.StructType([*rest, *base, T.StructField("log_perplexity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        ids: dict[bytes, int] = {}
        for part, texts in _texts(batches, text):
            codes, sizes = _codes(texts, to)
            found, at = np.unique(codes, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(held.log_probability(found)[at])])
            ends = np.cumsum(sizes)
            mean = -(sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
            cols = list(zip(*_base(texts, ids)))
            out = pa.Table.from_arrays(
                [*(part.column(i) for i, name in enumerate(part.schema.names) if name != text),
                 *(pa.array(c) for c in cols), pa.array(mean, mask=sizes == 0)],
                names=schema.names)
            yield from out.cast(arrow).to_batches()

    return docs.mapInArrow(tidy(run), schema)


def length_class(word_chars: str = "word_chars"):
    """Whole binary logarithm of the characters in words: means over short
    texts scatter more, so each class of lengths has bands of its own."""
    return F.coalesce(F.floor(F.log2(F.col(word_chars))), F.lit(0)).cast("int")


def _band(sound: DataFrame, by: list[str]) -> DataFrame:
    same = lambda: [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    middle = sound.groupBy(*by).agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    apart = sound.alias("s").join(middle.alias("m"), same()).select(
        *[F.col(f"s.{c}").alias(c) for c in by], "middle", F.abs(F.col("log_perplexity") - F.col("middle")).alias("apart"))
    spread = F.greatest(1.4826 * F.percentile_approx("apart", 0.5, 10_000), F.lit(LEAST_SPREAD))
    return apart.groupBy(*by, "middle").agg(spread.alias("spread"), F.count("*").alias("n")).select(
        *by, "n", (F.col("middle") - LOWER * F.col("spread")).alias("low"), (F.col("middle") + UPPER * F.col("spread")).alias("high"))


def with_bands(scored: DataFrame, by: str = "lang") -> DataFrame:
    """Add ``low`` and ``high``: median and scaled median absolute deviation of
    ``log_perplexity`` over the documents of the language and length class that
    pass the base rules; of the whole language where a class has few."""
    rows = scored.withColumn("_class", length_class())
    sound = rows.filter(~F.col("base_failed")).select(F.col(by).alias("l"), F.col("_class").alias("c"), "log_perplexity")
    fine, coarse = _band(sound, ["l", "c"]).filter(F.col("n") >= LEAST_DOCS).alias("f"), _band(sound, ["l"]).alias("g")
    pick = lambda x: F.coalesce(F.col(f"f.{x}"), F.col(f"g.{x}")).alias(x)
    return (rows.alias("r").join(fine, F.col(f"r.{by}").eqNullSafe(F.col("f.l")) & (F.col("r._class") == F.col("f.c")), "left")
            .join(coarse, F.col(f"r.{by}").eqNullSafe(F.col("g.l")), "left")
            .select("r.*", pick("low"), pick("high")).drop("_class"))


def quality(docs: DataFrame, text: str = "text", by: str = "lang") -> DataFrame:
    """``docs`` without its text, with base counts, ``base_failed``,
    ``log_perplexity``, the bands and ``kept``."""
    to = every_byte()
    counts = staged(count_ngrams(docs, text, to), "ngram-counts")
    scored = staged(score(docs, train(counts, to), text, to), "ngram-scores")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return with_bands(scored, by).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op4_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and its language's bands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "lang", "log_perplexity")
