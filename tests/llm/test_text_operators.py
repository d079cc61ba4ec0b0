"""Operators on whole texts against brute force on small tables."""
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskspark.llm import bpe, lpt, minhash, mixing, ngram, shared, suffixes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def frame(spark, texts, extra=()):
    rows = [(i, t, None if i % 7 == 3 else "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOCS)


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, odd and long texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(3, 200)) for _ in range(40)]
    passage = text(30)
    out = [None, "", "   \n ", "one", "One", "a b c d e", "x" * 700, "ab" * 400, text(9000)]
    out += base + base[:8] + [b + " tail" for b in base[:10]] + ["Head " + b for b in base[5:15]]
    out += [text(5) + " " + passage + " " + text(rng.randint(0, 20)) for _ in range(12)]
    out += [base[20].replace(" ", "\t", 3), base[20].upper(), "\n".join([base[1]] * 3), "日本語 テキスト " * 30, "\x1c\x85  end"]
    # near copies without a common centre: each drops a few words of a long text
    long = text(400).split()
    out += [" ".join(w for j, w in enumerate(long) if j not in (k, 3 * k, 5 * k)) for k in range(1, 12)]
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


@pytest.mark.parametrize("rows,want", [
    ([(None, A), (None, B), (3, B), (9, C)], [(3, B), (9, C), (None, A)]),               # a null id with a copy, one without
    ([(5, A), (5, B), (3, B), (9, C)], [(3, B), (5, A), (9, C)]),                         # an id with two texts
    ([(5, A), (5, B), (5, C), (5, C)], [(5, A), (5, B), (5, C)]),                         # one id only, a repeated row
    ([(None, A), (None, A), (None, None), (None, "")], [(None, A), (None, None), (None, "")]),
    ([(7, A), (2, A), (2, A), (8, A + " x")], [(2, A)]),
])
def test_dedup_stage_judges_rows(spark, rows, want):
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, _gone int, h string").repartition(3)
    out = minhash.dedup_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_rows_of_one_id_share_a_component(spark):
    rows = [(5, A), (5, B), (3, B), (9, C), (None, C + " x"), (None, A[::-1]), (None, B[::-1]), (1, B[::-1] + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 9), (None, 9), (None, None), (None, 1), (1, 1)], key=str)


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    got = by_id(minhash.near_duplicates(frame(spark, texts)))
    assert len(links) > 30
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), least[i], least[i] == i)


def test_stage_links_near_copies_from_080_on(spark):
    """100 words of 96 shingles, 10 or 14 of them exchanged in front: 0.811 goes in the stage only, 0.745 stays."""
    words = [f"w{i}" for i in range(100)]
    changed = lambda n: " ".join([f"x{i}" for i in range(n)] + words[n:])
    rows = [(1, " ".join(words)), (2, changed(10)), (3, changed(14).replace("x", "y"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard = [(96 - n) / (96 + n) for n in (10, 14)]
    assert 0.80 <= jaccard[0] < 0.85 and jaccard[1] < 0.80
    assert [minhash.bits_apart(p) for p in (85, 80)] == [44, 54]
    assert {r["doc_id"] for r in minhash.dedup_stage(spark, df, "").collect()} == {1, 3}
    assert all(r["kept"] for r in minhash.near_duplicates(df, 85).collect())


def test_left_over_members_are_linked():
    """Two members that are no neighbours of their bucket's smallest node are
    linked, once, in their first common bucket."""
    import pandas as pd
    shared = list(range(100))
    rows = [(3, 0, 0, 0, 7, 7, True, 100, [0, 0, 0, 0], [1, 3], shared), (3, 0, 0, 0, 9, 9, True, 100, [0, 0, 0, 1], [2, 3], shared[:95] + [200]),
            (3, 0, 0, 0, 11, 11, False, 100, [0, 0, 0, 3], [2, 3], list(range(300, 400)))]
    columns = ["key", "p", "q", "part", "node", "label", "outside", "n_shingles", "bits", "bands", "shingles"]
    import numpy as np
    pdf = pd.DataFrame(rows, columns=columns)
    for c in ("bits", "bands", "shingles"):
        pdf[c] = [np.array(x, np.int64) for x in pdf[c]]
    assert minhash._joining_links(pdf).values.tolist() == [[9, 7]]
    assert len(minhash._joining_links(pdf.assign(key=2, bands=[np.array([1, 3]), np.array([2, 3]), np.array([2, 3])]))) == 0


def test_repeated_passages_equal_brute_force(spark, texts):
    for local in (suffixes.LOCAL_BLOCKS, 1):  # both ways of comparing loose blocks
        suffixes.LOCAL_BLOCKS, kept = local, suffixes.LOCAL_BLOCKS
        try:
            got = by_id(suffixes.without_repeats(frame(spark, texts)))
        finally:
            suffixes.LOCAL_BLOCKS = kept
        seen = set()
        for i, t in enumerate(texts):
            b = (t or "").encode()
            gone = bytearray(len(b))
            own = [b[j:j + 50] for j in range(len(b) - 49)]
            for j, s in enumerate(own):
                if s in seen:
                    gone[j:j + 50] = b"\1" * 50
            seen.update(own)
            spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
            left = bytes(x for x, g in zip(b, gone) if not g)
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(gone), spans, left), i


@pytest.mark.parametrize("size", [(1 << 24) - 100, (1 << 24) + 3_000_000])
def test_long_texts_lose_their_planted_repeats(spark, size):
    """One text just below 16 MB behind smaller ones, one beyond; passages at
    borders of pieces, around 16 MB and at the end."""
    rng = random.Random(size)
    text = lambda n: rng.randbytes(n // 2 + 1).hex()[:n]
    passages, long, plan = [text(120) for _ in range(5)], bytearray(text(size).encode()), []
    spots = [7, suffixes.PIECE - 60, 3 * suffixes.PIECE - 1, min(size, 1 << 24) - 900, size - 120]
    for p, at in zip(passages, spots):
        long[at:at + 120] = p.encode()
    left = b"".join(long[a:b] for a, b in zip([0, *(s + 120 for s in spots)], spots))
    rows = [*enumerate(passages), (5, text(249_000)), (6, text(249_000)), (7, long.decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for local in (suffixes.LOCAL_BLOCKS, 1):
        suffixes.LOCAL_BLOCKS, kept = local, suffixes.LOCAL_BLOCKS
        try:
            got = by_id(suffixes.without_repeats(df, batches=1))
        finally:
            suffixes.LOCAL_BLOCKS = kept
        assert (got[7]["n_bytes"], got[7]["n_removed"], got[7]["n_spans"]) == (size, 600, 5)
        assert bytes(got[7]["kept"]) == left
        assert all(got[i]["n_removed"] == 0 for i in range(7))


def test_written_jobs_pass_few_rows_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = spark.range(2 * shared.BATCH_ROWS + 5).coalesce(1).mapInArrow(sizes, "n long")
    assert sorted(r["n"] for r in shared.staged(rows, "sizes").collect()) == [5, shared.BATCH_ROWS, shared.BATCH_ROWS]
    assert spark.conf.get(name) == given


def test_every_bucket_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(suffixes, "release_unused", lambda: calls.append(1))
    h, d = suffixes._pack(np.array([1, 1, 9], np.uint32), np.array([4, 7, 4]))
    for kind in (0, 2):  # a batch's array, and known anchors alone
        pdf = pd.DataFrame([(kind, -1, 3, h, d)], columns=["kind", "level", "bucket", "hashes", "docs"])
        assert len(suffixes._merge_scan([], -1)(pdf))
    assert len(calls) == 2


def test_index_levels_merge_geometrically(spark, texts):
    family = suffixes.IndexFamily(64)
    rows = frame(spark, texts).select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = []
    for k in range(5):
        family.add(rows.filter(F.col("doc") % 5 == k))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[0], [0, 0], [1, 0], [1, 0, 0], [1, 1, 0]]


def test_encoding_equals_the_library_and_decodes(spark, texts):
    ranks, pattern = bpe.public_tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark, texts).withColumn("ids_of_mine", F.lit("extra"))
    got = by_id(bpe.decode(bpe.encode(df, ranks, pattern), ranks))
    assert "ids_of_mine" in next(iter(got.values())).asDict()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids
        assert bytes(got[i]["ids_le"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_words_remembered_across_blocks(spark, texts):
    """One task, tiny blocks: words come back from earlier blocks, and the memory starts anew."""
    ranks, pattern = bpe.public_tokenizer()
    want = {i: r["ids"] for i, r in by_id(bpe.encode(frame(spark, texts), ranks, pattern)).items()}
    for known_bytes in (0, 200, 1 << 20):
        got = by_id(bpe.encode(frame(spark, texts).coalesce(1), ranks, pattern, block_chars=300, known_bytes=known_bytes))
        assert {i: r["ids"] for i, r in got.items()} == want


def test_words_that_every_task_knows_change_no_id(spark, texts):
    """The hot words of any share and size, none and all of them, give the same ids."""
    ranks, pattern = bpe.public_tokenizer()
    docs = frame(spark, texts).repartition(3)
    want = {i: r["ids"] for i, r in by_id(bpe.encode(docs, ranks, pattern, hot_bytes=0)).items()}
    for share, size in ((1.0, bpe.HOT_BYTES), (1.0, 40), (0.5, 1), (0.0, bpe.HOT_BYTES)):
        got = by_id(bpe.encode(docs, ranks, pattern, hot_share=share, hot_bytes=size))
        assert {i: r["ids"] for i, r in got.items()} == want
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hot = bpe.hot_words(docs, ranks, bpe.exact_pattern(pattern), share=1.0)
    assert hot.words and all(len(w) <= bpe.FOLD_BYTES and w not in ranks for w in hot.words)
    for w, a, b in zip(hot.words, hot.offsets[hot.vocabulary:], hot.offsets[hot.vocabulary + 1:]):
        assert hot.flat[a:b].tolist() == library._encode_single_piece(w)
    few = bpe.hot_words(docs, ranks, bpe.exact_pattern(pattern), share=1.0, most_bytes=40)
    assert sum(map(len, few.words)) <= 40 and set(few.words) < set(hot.words)
    assert not bpe.hot_words(docs.limit(0), ranks, bpe.exact_pattern(pattern), share=1.0).words


def test_byte_bpe_equals_the_library_on_a_whole_table(spark):
    ranks, _ = bpe.public_tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.op2_byte_bpe(spark, "/root/testdata/sf0.001"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) > 0
    for r in docs:
        ids, text = library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(text).hexdigest()


def test_heap_and_fold_agree_with_the_library(spark):
    ranks, _ = bpe.public_tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice(a) for _ in range(n)).encode() for n in (2, 3, 9, 40, bpe.FOLD_BYTES // 3) for a in ("ab", "thening", "é世x") for _ in range(12)]
    words = [w for w in words if w not in ranks]
    want = [library._encode_single_piece(w) for w in words]
    assert [bpe.heap_merge(w, ranks) for w in words] == want
    df = spark.createDataFrame([([[ranks[bytes([b])] for b in w] for w in words],)], "words array<array<int>>")
    df = df.join(F.broadcast(bpe.rank_row(spark, ranks)))
    assert df.select(F.transform("words", lambda w: bpe.fold(w, F.col("ranks")))).first()[0] == want


def test_words_merged_together_equal_words_merged_alone():
    ranks, _ = bpe.public_tokenizer()
    rng = random.Random(5)
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, n))).encode() for a in ("ab", "thening", "é世x") for n in (3, 12, 90) for _ in range(60)]
    words += [b"x" * bpe.ROW_BYTES, b"ab" * bpe.ROW_BYTES, b"\x00", b"the"]
    want = [bpe.heap_merge(w, ranks) for w in words]
    ids, lengths = bpe.merge_words(words, ranks, bpe.Pairs(ranks))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    codes = bpe._Codes(ranks, {})
    places = [codes[w] for w in ("thxening", "qzxv")]
    codes.settle(bpe.Pairs(ranks))
    places.append(codes["xxqzv"])  # met in a later block
    codes.settle(bpe.Pairs(ranks))
    assert [list(codes.flat[codes.ends[i]:codes.ends[i + 1]]) for i in places] == [
        bpe.heap_merge(w, ranks) for w in (b"thxening", b"qzxv", b"xxqzv")]


def test_words_of_all_lengths_are_merged_in_one_step(spark):
    """No word travels to another step to be merged, whatever its length."""
    ranks, pattern = bpe.public_tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    words = ["".join(rng.choice("abthening") for _ in range(n)) for n in (1, 2, 40, 199, 200, 201, 255, 600)]
    coded = bpe.encode(frame(spark, [" ".join(words), *words]), ranks, pattern, hot_bytes=0)
    assert "Join" not in coded._jdf.queryExecution().executedPlan().toString()
    got = by_id(coded)
    for i, t in enumerate([" ".join(words), *words]):
        assert got[i]["ids"] == library.encode_ordinary(t)


def test_base_counts_equal_brute_force(spark, texts):
    got = by_id(ngram.quality(frame(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = [False] * len(w)
        for j in range(len(w) - 2):
            if windows[tuple(w[j:j + 3])] > 1:
                covered[j:j + 3] = [True] * 3
        seen, duplicates = set(), 0
        for line in t.split("\n"):
            duplicates += line in seen and bool(WORD.search(line))
            seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), duplicates, sum(covered),
                len(w) < 50 or 100 * sum(covered) > 50 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])


def test_kneser_ney_sums_to_one_and_equals_a_direct_count(spark, texts):
    df = frame(spark, texts[:30])
    counts = ngram.count_ngrams(df)
    direct = Counter()
    to = ngram.alphabet()
    for t in texts[:30]:
        s = [0] * 3 + to[list((t or "").encode())].tolist()
        direct.update((a << 18) + (b << 12) + (c << 6) + d for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))
    assert {r["code"]: r["n"] for r in counts.collect()} == dict(direct)
    model = ngram.train(counts)
    import numpy as np
    for context in {c >> 6 for c in list(direct)[:5]} | {0}:
        p = np.exp(model.log_probability((context << 6) + np.arange(64)))
        seen = p[[c & 63 for c in direct if c >> 6 == context]]
        assert 0.95 < p.sum() < 1.05 and (seen > 0).all()


def test_noise_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(9)
    words = ["the", "and", "river", "stone", "quiet", "morning", "walked", "over", "under", "bright", "house", "letter"]
    clean = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(200)]
    noise = ["".join(rng.choice("qzxjkvw#$%&; 0123456789") for _ in range(700)) for _ in range(4)]
    got = by_id(ngram.quality(spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noise)], "doc_id long, text string, lang string")))
    sound = [i for i in range(200) if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in sound) >= 0.97 * len(sound)
    assert not any(got[200 + i]["kept"] for i in range(4))


def test_every_byte_is_a_symbol_of_its_own(spark, texts):
    df = frame(spark, texts[:30])
    to = ngram.every_byte()
    direct = Counter()
    for t in texts[:30]:
        x = [0] * 3 + [b + 1 for b in (t or "").encode()]
        direct.update((a << 27) + (b << 18) + (c << 9) + d for a, b, c, d in zip(x, x[1:], x[2:], x[3:]))
    counts = ngram.count_ngrams(df, to=to)
    assert {r["code"]: r["n"] for r in counts.collect()} == dict(direct)
    model = ngram.train(counts, to)
    for context in {c >> 9 for c in list(direct)[:5]} | {0}:
        p = np.exp(model.log_probability((context << 9) + np.arange(257)))
        assert 0.95 < p.sum() < 1.05 and (p[[c & 511 for c in direct if c >> 9 == context]] > 0).all()
    rng = random.Random(4)
    words = ["the", "and", "river", "stone", "quiet", "morning", "walked", "over", "under", "bright", "house", "letter"]
    clean = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(200)]
    mixed = ["".join(rng.choice((c, c.upper())) for c in t) for t in clean[:4]]  # the same letters, in either case
    got = by_id(ngram.quality(spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + mixed)], "doc_id long, text string, lang string")))
    assert not any(got[200 + i]["kept"] for i in range(4))
    assert all(got[200 + i]["log_perplexity"] > got[i]["log_perplexity"] + 0.1 for i in range(4))


def toxic_table(spark):
    """An insult is toxic only together with a group mention."""
    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(8)] + ["zzinsult"] * insult + ["yygroup"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels})


def test_machine_learns_pairs_on_held_out_rows(spark):
    docs, labels, truth = toxic_table(spark)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(truth[i]) for i in held)
    assert len(held) > 100 and right >= 0.95 * len(held)


def test_scores_ignore_held_out_labels(spark):
    docs, labels, _ = toxic_table(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxic_scores(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_mixing_weights_and_streams(spark):
    shares = [0.6, 0.3, 0.1]
    assert mixing.repetition(shares, mixing.weights_at(shares, mixing.solve_alpha(shares, repetition_limit=2.0))) == pytest.approx(2.0)
    assert mixing.entropy(mixing.weights_at(shares, mixing.solve_alpha(shares, target_entropy=1.0))) == pytest.approx(1.0)
    assert mixing.solve_alpha(shares, target_entropy=0.1) == 1.0 and mixing.solve_alpha(shares, target_entropy=5.0) == 0.0
    rng = random.Random(8)
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None, rng.randint(0, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, "n", repetition_limit=1.5).collect()
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    plan = {p[0]: p for p in mixing.mixing_plan(dict(total), repetition_limit=1.5)}
    for s in total:  # the stream by brute force
        own = sorted((d, n) for d, x, n in rows if x == s)
        want, start, epoch = [], 0, 0
        while start < plan[s][3] or epoch == 0:
            order = sorted(own, key=lambda r: hashlib.md5(f"17:{epoch}:{r[0]}".encode()).hexdigest())
            for d, n in order:
                if start < plan[s][3] or epoch == 0:
                    want.append((epoch, d, start))
                start += n
            epoch += 1
        assert sorted(want) == sorted((r["epoch"], r["doc_id"], r["mix_start"]) for r in got if r["source"] == s)
    assert {r["doc_id"] for r in got} == set(range(600))
    less = mixing.mix(df, "n", budget=3000, repetition_limit=1.5).collect()
    assert sum(r["n"] for r in less) <= 3000 + 3 * 50 and {r["block"] for r in less} == set(range(8))


def test_shards(spark, texts):
    more = texts + [f"text {i} " * (i % 40) for i in range(800)] + ["same text"] * 200
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    rows = frame(spark, more).select("doc_id", size.alias("size"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    got = lpt.with_slots(lpt.shard_groups(rows, "key", "size", 16), ["doc_id"]).collect()
    assert len(got) == len(more)
    load, slots, together = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        together[more[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 16
    heaviest = max(Counter({k: sum(r["size"] for r in got if (more[r["doc_id"]] or "") == k) for k in together}).values())
    assert max(load.values()) - min(load.values()) <= max(heaviest, 0.02 * sum(load.values()))


def test_schedule_is_longest_first():
    place = lpt.schedule([(i, s) for i, s in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1])], 3)
    load = Counter()
    for i, s in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1]):
        load[place[i]] += s
    # by hand: 9 8 7 | 6 to 7, 5 to 8, 4 to 9 | 13 13 13 | 3 2 1 to the shards in order
    assert [load[i] for i in range(3)] == [16, 15, 14]


def test_machine_scores_are_sums_over_terms_and_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(30), -0.4, rng.normal(0, 1, 30), rng.normal(0, 0.5, (30, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(30, k, replace=False)) for k in (0, 1, 2, 9, 30)]
    for row, got in zip(rows, m.scores(np.array([len(r) for r in rows]), np.concatenate(rows))):
        margin = m.bias + sum(m.linear[i] for i in row) + sum(float(m.factors[i] @ m.factors[j]) for i in row for j in row if i < j)
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12


def test_factorization_machine_learns_a_pair(spark):
    """Neither word alone is toxic, both together are: linear weights alone can't tell."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1200):
        insult, group = (rng.random(2) < 0.35).tolist()
        words = [f"filler{chr(97 + k)}" for k in rng.integers(0, 20, 12)] + ["insult"] * insult + ["crowd"] * group
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(insult and group)))
    scored = toxicity.toxic_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(r["score"] >= 0.5, bool(dict(labels)[r["doc_id"]])) for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_terms_do_not_depend_on_their_neighbours():
    texts = ["Trash talk, trash!", "", None, "trashy " + "x" * 50, "x" * 50 + "y", "Été 7 talk"]
    sizes, terms = toxicity.terms_of(texts)
    split = np.split(terms, np.cumsum(sizes)[:-1])
    for text, got in zip(texts, split):
        assert (toxicity.terms_of([text])[1] == got).all() and (np.diff(got) > 0).all()
    assert len(split[0]) == 3 + 2 and len(split[1]) == len(split[2]) == 0  # trash: 4, 5 letters and all of it; talk
    assert len(np.intersect1d(split[0], split[3])) == 2 and len(np.intersect1d(split[3], split[4])) == 3
    place = np.full(toxicity.SLOTS, -1)
    place[split[0]] = np.arange(len(split[0]))
    assert toxicity.terms_of(texts, place)[1][:5].tolist() == list(range(5))


def test_left_over_members_stay_arrays():
    """The members' shingles are compared as arrays: a Python set of them takes nine times the memory."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    n = 300
    words = [np.arange(1000, dtype=np.int64) + 1_000_000 + 20 * i for i in range(n)]
    pdf = pd.DataFrame({"key": 3, "p": 0, "q": 0, "part": 0, "node": range(n), "label": range(n), "outside": True, "n_shingles": 1000,
                        "bits": [np.zeros(4, np.int64)] * n, "bands": [np.array([3], np.int64)] * n, "shingles": words})
    tracemalloc.start()
    links = minhash._joining_links(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == n - 1
    assert peak < 4_000_000
