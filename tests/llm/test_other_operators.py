"""Chats, URLs and vectors against brute force, and all operators on empty,
null, repeated and oddly named input."""
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from riskspark.llm import bpe, chat, lpt, minhash, mixing, neighbours, ngram, suffixes, toxicity, url_rules  # noqa: E402
from riskspark.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_reply_trees_keep_the_best_branches(spark):
    rng = random.Random(6)
    rows, parent, score = [], {}, {}
    for t in range(30):
        for n in range(rng.randint(1, 25)):
            parent[t, n] = rng.randrange(n) if n and rng.random() < 0.95 else None
            score[t, n] = rng.choice([None, 0.0, 0.5, 1.0])
            rows.append((t, n, parent[t, n], rng.choice(["user", "assistant", None]), rng.choice([None, "", "a\\<[b]", "<|end|>x\n"]), score[t, n]))
    rows += [(99, 1, 2, "user", "ring", 1.0), (99, 2, 1, "user", "ring", 1.0), (98, 5, 77, "user", "orphan", 1.0)]
    parent |= {(98, 5): None}
    score |= {(98, 5): 1.0}
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = chat.format_chats(df, keep=2).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    texts = {(r[0], r[1]): (r[3] or "", r[4] or "") for r in rows}
    want = {}
    inner = {(t, p) for (t, _), p in parent.items() if p is not None}
    for t in {k[0] for k in parent}:
        paths = []
        for n in (n for u, n in parent if u == t and (t, n) not in inner):
            path = [n]
            while parent[t, path[0]] is not None:
                path.insert(0, parent[t, path[0]])
            paths.append((-sum(score[t, x] or 0 for x in path) / len(path), -len(path), n, path))
        for branch, p in enumerate(sorted(paths)[:2], 1):
            want[t, branch] = [texts[t, n] for n in p[3]]
    assert {(r["tree_id"], r["branch"]): [tuple(x) for x in r["turns"]] for r in got} == want
    for r in got:
        assert r["loss"] == "".join(x for role, x in want[r["tree_id"], r["branch"]] if role == "assistant")


def test_long_chains(spark):
    rows = [(1, i, i - 1 if i else None, "assistant", f"t{i}", 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    turns = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in turns] == [f"t{i}" for i in range(300)]


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
    ("x://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"), ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"),
    ("x://b.org", "b.org", "", None, "allow"), ("x://b.net/de/", "b.net", "/de/", None, "allow"),
    (None, "", "", None, "allow"), ("no scheme/path", "", "", None, "allow"), ("a://É.ORG/\n/q", "É.org", "/\n/q", "org/", "allow"),
])
def test_listed_rules(spark, url, host, path, rule, verdict):
    u = F.lit(url).cast("string")
    df = spark.range(1).select(url_rules.host_of(u).alias("host"), url_rules.path_of(u).alias("path"))
    r = df.select("*", url_rules.listed_rule(F.col("host"), F.col("path")).alias("r")).first()
    assert (r["host"], r["path"]) == (host, path)
    assert (r["r"]["rule"], r["r"]["verdict"]) == (rule, verdict) if rule else r["r"] is None


def test_mined_rules_find_token_combinations(spark):
    rows = []
    for i in range(400):
        a, b = i % 2, (i // 2) % 2
        rows.append((f"http://{'casino' if a else 'garden'}.example.net/{'bonus' if b else 'news'}/{i}", bool(a and b)))
    rows += [("http://long.example.net/" + "/".join(f"p{k}" for k in range(60)), True)] * 30
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine_rules(labelled).collect()
    assert ["host=casino", "path=bonus"] in [sorted(r["antecedent"]) for r in rules]
    got = {r["url"]: r["verdict"] for r in url_rules.judge_urls(labelled.select("url"), labelled).collect()}
    for url, bad in rows:
        assert got[url] == ("block" if bad else "allow")


def test_tokens_of_the_same_labelled_rows_each_count(spark):
    """host=spam and path=casino always come together among the labels; an
    unlabelled page with either of them is blocked, by one rule."""
    rows = [("http://spam.net/casino", True)] * 20 + [(f"http://good{i % 3}.net/news", False) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    want = {"http://other.net/casino": 1, "http://spam.net/x": 1, "http://spam.net/casino": 1, "http://other.net/x": 0}
    pages = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r["url"]: (r["verdict"], r["n_rules"]) for r in url_rules.judge_urls(pages, labelled).collect()}
    assert got == {u: ("block" if n else "allow", n) for u, n in want.items()}


def test_nearest_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (9005, [float("inf")] * 32)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(found) == set(range(0, 3000, 100))
    hit = 0
    for q, got_ in found.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert len(got_) == 10 and got_ == sorted(got_) and all(math.isclose(s, d[i], abs_tol=1e-12) for s, i in got_)
        d[q] = np.inf
        hit += len({i for _, i in got_} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(found)
    assert [i for _, i in found[0]] == list(range(50, 60))


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = neighbours.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    least = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in least.items() if any(n in e and e[0] != e[1] for e in edges)}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, score double, node long, spans string"
LABELS = "doc_id long, quality int, toxic int"
ROW = (None, None, None, None, None, None, None, None, None, None)


def odd(spark, rows):
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(r[0], 1, k % 2) for k, r in enumerate(rows)], LABELS)


CASES = {
    "empty": [],
    "nulls": [ROW, ROW, (1, None, *ROW[2:]), (None, "some words here", *ROW[2:])],
    "blank": [(1, "", *ROW[2:]), (2, " \n ", *ROW[2:]), (3, "", *ROW[2:])],
    "repeated": [(1, "the same words " * 30, "en", "s", 3, True, 1, 0.5, 7, "x")] * 3 + [(1, "another text", *ROW[2:])],
}


@pytest.mark.parametrize("case", CASES)
def test_defined_results_for_odd_documents(spark, case):
    rows = CASES[case]
    docs, labels = odd(spark, rows)
    n = len(rows)
    ranks, pattern = bpe.public_tokenizer()
    assert minhash.near_duplicates(docs).count() == n
    assert bpe.encode(docs.select("doc_id", "text", "lang"), ranks, pattern).count() == n
    assert ngram.quality(docs.select("doc_id", "text", "lang", "source")).count() == n
    assert suffixes.without_repeats(docs.select("doc_id", "text", "lang")).count() == n
    scored = toxicity.toxic_scores(docs.drop("score"), labels).collect()
    assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.n_tokens().alias("t")), "t", repetition_limit=1.5)
    assert mixed.filter("epoch = 0").count() == n
    size = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("key"), F.lit(1).cast("long").alias("size"))
    placed = lpt.with_slots(lpt.shard_groups(size, "key", "size", 4), ["doc_id"])
    assert placed.count() == n and placed.select("shard", "slot").distinct().count() == n


def test_repeated_rows(spark):
    docs, _ = odd(spark, CASES["repeated"])
    got = suffixes.without_repeats(docs.select("doc_id", "text"))
    assert [r["n_removed"] for r in got.collect()] == [0, 0, 0, 0]  # one document never matches itself
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1}
    assert minhash.dedup_stage(spark, docs, SF).count() == 1


def test_extra_columns_with_names_of_results(spark):
    """Operators put their results in place of columns of these names, stages return them as given."""
    extra = {"score": 0.9, "kept": True, "spans": "x", "n_bytes": 7, "ids": "y", "ids_le": "z"}
    docs = spark.createDataFrame([(i, f"some words {i} " * 12) for i in range(4)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(v) for c, v in extra.items()})
    ranks, pattern = bpe.public_tokenizer()
    coded = bpe.encode(docs, ranks, pattern)
    assert coded.columns == ["doc_id", "score", "kept", "spans", "n_bytes", "ids", "ids_le"]
    assert all(len(r["ids"]) > 9 and r["spans"] == "x" for r in coded.collect())
    back = bpe.decode(coded.withColumn("decoded", F.lit(3)), ranks)
    assert back.columns == [*coded.columns, "decoded"]
    assert all(bytes(r["decoded"]).decode() == f"some words {r['doc_id']} " * 12 for r in back.collect())
    left = suffixes.without_repeats(docs)
    assert left.columns == ["doc_id", "score", "spans", "ids", "ids_le", "n_bytes", "n_removed", "n_spans", "kept"]
    assert all(r["n_bytes"] > 100 and r["spans"] == "x" for r in left.collect())
    scored = toxicity.toxic_scores(docs, spark.createDataFrame([], LABELS))
    assert scored.columns == ["doc_id", "text", "kept", "spans", "n_bytes", "ids", "ids_le", "score"]
    assert all(r["score"] < 1e-9 for r in scored.collect())
    for stage in (toxicity.toxicity_stage, suffixes.repeats_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all({c: r[c] for c in extra} == extra for r in out.collect())


def test_empty_tables_of_other_operators(spark):
    none = spark.createDataFrame([], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    assert chat.format_chats(none).count() == 0
    assert url_rules.judge_urls(spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string, bad boolean")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == columns, name
        if name in ("repeated_passages", "mixing"):  # these lose no document
            assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_queries_are_registered():
    from __spark_entry__ import queries
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
