"""Toxicity by a factorization machine over hashed terms (operator 8).

Terms of a text are its distinct words (runs of letters, without case) and
their first 4, 5 and 6 letters, hashed to ``SLOTS`` slots.  Every slot that at
least ``LEAST_DOCS`` training documents hold, counted by Spark over all of
them, is a feature; its size grows with the departure of its toxic count from
what its total lets expect, so that the many chance words of a long text weigh
little from the start.  A second-order factorization machine learns a weight of each
feature and of each pair of features in one text, so an insult together with a
group mention can weigh more than the sum of both.

Training takes about ``TRAIN_ROWS`` labelled rows (an even share of the hashes
of the ids); counting takes all.  Rows whose ``crc32(doc_id as text) mod
5`` is 0 are held out from both.  Labels, language, source and id are never
features.

Results for odd input: a null or empty text has no terms and gets the score of
the intercept; a document with several labels counts as toxic if one says so;
without labels of both kinds every score is 0; repeated rows are scored each;
texts may have any length; an empty table gives an empty result; other columns
are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.shared import packed, staged, table, tidy

#: Hash width: terms that share a slot share its weights.
SLOTS = 1 << 18
#: Smallest number of training documents with a feature.
LEAST_DOCS = 5
TRAIN_ROWS = 20_000
#: Up to so many labels a join with the documents may broadcast them (12 bytes each).
BROADCAST_LABELS = 500_000
#: Lengths of the word beginnings that are terms.
BEGINNINGS = (4, 5, 6)
#: Characters of texts that a task looks at together.
PART_CHARS = 1_000_000
#: Letters of a word that are hashed one by one; the rest of a longer word goes in as one number.
_LETTERS = 24
#: Deviations between a slot's toxic count and the expected one that give it half its size.
HALF_AT = 3.0
FACTORS = 4
EPOCHS = 5
RATE = 0.1
PENALTY = 1e-4
#: Rows of one step.
STEP_ROWS = 32
_WORD = r"[^\W\d_]+"


def word_slots(words: list[str]) -> np.ndarray:
    """(words, 4): slots of lower-case words and of their beginnings, -1 for none."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.array(words, f"U{_LETTERS}").view(np.uint32).reshape(len(words), _LETTERS)
    h, out = np.zeros(len(words), np.uint64), np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int32)
    for k in range(min(_LETTERS, int(sizes.max(initial=0)))):
        h = np.where(k < sizes, (h + letters[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), h)
        if k + 1 in BEGINNINGS:
            out[:, BEGINNINGS.index(k + 1)] = np.where(k < sizes, _slot(h ^ np.uint64(k + 1)), -1)
    for i in np.flatnonzero(sizes > _LETTERS):
        h[i] ^= np.uint64(zlib.crc32(words[i].encode()))
    out[:, -1] = _slot(h)
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int32)


def terms_of(texts: list[str | None], position: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, terms): how many terms each text has, and the sorted distinct
    terms of one text after the other; ``position`` renames slots, -1 drops one."""
    split, index = regex.compile(_WORD).findall, {}
    found = [[index.setdefault(w, len(index)) for w in set(split(t.lower()))] if t else [] for t in texts]
    slots = word_slots(list(index))
    if position is not None:
        slots = np.where(slots >= 0, position[slots], -1)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
    each = slots[np.fromiter(chain.from_iterable(found), np.int64, len(of))]
    both = np.unique((of[:, None] * SLOTS + each)[each >= 0])
    return np.bincount(both // SLOTS, minlength=len(texts)), (both % SLOTS).astype(np.int32)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut after about ``PART_CHARS`` characters, with their texts."""
    for batch in batches:
        texts, start, chars = [], 0, 0
        for i in range(batch.num_rows):
            texts.append(batch.column(text)[i].as_py())
            chars += len(texts[-1] or "")
            if chars >= PART_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                texts, start, chars = [], i + 1, 0


def teaching_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the ids that may teach, one row each."""
    teach = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return labels.filter(teach).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isNotNull())


def count_slots(rows: DataFrame) -> DataFrame:
    """(slot, toxic, other): documents of either kind that have the slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS), np.int64)
        for batch, texts in _parts(batches, 0):
            sizes, terms = terms_of(texts)
            bad = np.repeat(np.array(batch.column(1).to_pylist()) > 0, sizes)
            for y in (0, 1):
                seen[y] += np.bincount(terms[bad == y], minlength=SLOTS)
        found = np.flatnonzero(seen.sum(0))
        for at in range(0, len(found), 100_000):
            part = found[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[1, part]), pa.array(seen[0, part])],
                                             ["slot", "toxic", "other"])

    return (rows.select("text", "toxic").mapInArrow(tidy(run), "slot int, toxic long, other long")
            .groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


class Machine:
    """A trained factorization machine over chosen slots."""

    def __init__(self, slots: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.linear, self.factors = slots, bias, linear, factors

    def position(self) -> np.ndarray:
        """slot -> place among the machine's slots, -1 for others."""
        return _places(self.slots)

    def scores(self, sizes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        margin, full = np.full(len(sizes), self.bias), np.flatnonzero(sizes)
        if len(full):
            first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            v = self.factors[terms]
            pairs = (np.add.reduceat(v, first) ** 2).sum(1) - np.add.reduceat((v ** 2).sum(1), first)
            margin[full] += np.add.reduceat(self.linear[terms], first) + 0.5 * pairs
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _places(slots: np.ndarray) -> np.ndarray:
    out = np.full(SLOTS, -1, np.int32)
    out[slots] = np.arange(len(slots), dtype=np.int32)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    y = staged(teaching_labels(labels), "toxicity-labels")
    y = F.broadcast(y) if y.count() <= BROADCAST_LABELS else y
    kinds = docs.select("doc_id").join(y, "doc_id").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count("*").alias("n")).first()
    toxic, n = kinds["toxic"], kinds["n"]
    if not 0 < toxic < n:  # nothing to tell apart
        return Machine(np.zeros(0, np.int64), -np.inf, np.zeros(0), np.zeros((0, FACTORS)))
    rows = docs.select("doc_id", "text").join(y, "doc_id")
    # at most one row for each of the SLOTS slots
    counts = count_slots(rows).filter(F.col("toxic") + F.col("other") >= LEAST_DOCS).orderBy("slot").toPandas()
    slots = counts["slot"].to_numpy()
    if not len(slots):
        return Machine(np.zeros(0, np.int64), float(np.log(toxic / (n - toxic))), np.zeros(0), np.zeros((0, FACTORS)))
    # the share is taken before the join, so only the sample's texts move
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(min(1.0, TRAIN_ROWS / n) * (1 << 32))
    sample = docs.select("doc_id", "text").filter(drawn).join(y, "doc_id")
    expected = (counts["toxic"] + counts["other"]).to_numpy(float) * (toxic / n)
    apart = (counts["toxic"] - expected) ** 2 / (expected + 1)
    scale = (apart / (apart + HALF_AT ** 2)).to_numpy(float)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(slots)
        for batch, texts in _parts(batches, 1):
            sizes, terms = terms_of(texts, place)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["h", "toxic", "terms"])

    features = staged(sample.select(F.xxhash64("doc_id", "text").alias("h"), "text", (F.col("toxic") > 0).alias("toxic"))
                      .mapInArrow(tidy(run), "h long, toxic boolean, terms array<int>"), "toxicity-features")
    if features.select("toxic").distinct().count() < 2:
        return Machine(np.zeros(0, np.int64), float(np.log(toxic / (n - toxic))), np.zeros(0), np.zeros((0, FACTORS)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        lists = rows["terms"].combine_chunks()
        weights = fit(np.asarray(lists.flatten()), np.asarray(lists.value_lengths()), np.asarray(rows["toxic"].combine_chunks().cast(pa.int8())), scale)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in weights], ["bias", "linear", "factors"])

    # the bounded sample in one task, in an order that does not depend on how it came there
    model = features.repartition(1).sortWithinPartitions("h").select("toxic", "terms").mapInArrow(
        tidy(learn), "bias binary, linear binary, factors binary").collect()[0]
    bias, linear, factors = (np.frombuffer(x) for x in model)
    return Machine(slots, float(bias[0]), linear, factors.reshape(-1, FACTORS))


def fit(terms: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors by adaptive gradient steps over shuffled
    rows; row r holds the next ``sizes[r]`` of ``terms``, a term t has the size ``scale[t]``."""
    random = np.random.default_rng(7)
    share = toxic.mean()
    n_terms = len(scale)
    bias, linear = np.array([np.log(share / (1 - share))]), np.zeros(n_terms)
    factors = random.normal(0, 0.01, (n_terms, FACTORS))
    seen_bias, seen_linear, seen_factors = 1.0, np.ones(n_terms), np.ones((n_terms, FACTORS))
    start = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(EPOCHS):
        order = random.permutation(len(sizes))
        for at in range(0, len(order), STEP_ROWS):
            rows = order[at:at + STEP_ROWS]
            rows = rows[sizes[rows] > 0]
            if not len(rows):
                continue
            x = np.concatenate([terms[start[r]:start[r + 1]] for r in rows])
            of, first = np.repeat(np.arange(len(rows)), sizes[rows]), np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            size = scale[x]
            v = factors[x] * size[:, None]
            total = np.add.reduceat(v, first)
            margin = bias[0] + np.add.reduceat(linear[x] * size, first) + 0.5 * ((total ** 2).sum(1) - np.add.reduceat((v ** 2).sum(1), first))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic[rows]
            seen_bias += error.sum() ** 2
            bias[0] -= RATE * error.sum() / np.sqrt(seen_bias)
            touched, place = np.unique(x, return_inverse=True)
            g = np.bincount(place, error[of] * size) + PENALTY * linear[touched]
            seen_linear[touched] += g ** 2
            linear[touched] -= RATE * g / np.sqrt(seen_linear[touched])
            pull = (error[of] * size)[:, None] * (total[of] - v)
            g = np.stack([np.bincount(place, pull[:, f]) for f in range(FACTORS)], 1) + PENALTY * factors[touched]
            seen_factors[touched] += g ** 2
            factors[touched] -= RATE * g / np.sqrt(seen_factors[touched])
    return bias, linear * scale, factors * scale[:, None]


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, in place of a column of that name."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = machine.position()
        for batch, texts in _parts(batches, at):
            out = pa.Table.from_arrays([*batch.columns, pa.array(machine.scores(*terms_of(texts, place)))], names=schema.names)
            yield from out.cast(arrow).to_batches()

    return docs.mapInArrow(tidy(run), schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels.select("doc_id", "toxic")))


def op8_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; a fifth of the ids is held out from training."""
    scored = toxic_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go; the columns
    stay as given, also one named ``score``."""
    scored = toxic_scores(packed(docs), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") < 0.5).select(
        *[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
