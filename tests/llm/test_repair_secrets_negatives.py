"""Operators 11 to 13 against brute force, on the given tables and on odd input."""
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import negatives, repair, secrets

SF = "/root/testdata/sf0.001"


# --- 11: repair -------------------------------------------------------------

def cheapest(codes):
    """Least (cost, audit) and its lines by dynamic programming over the grammar's states,
    keeping whole audits; ``codes``: (initial, fault, role, text) per row."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    role = {"u": "user", "a": "assistant"}

    def inserts(best):  # cheapest first; two in a row never lead back below an earlier one
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                for t in "ua":
                    if (q, t) in step:
                        new = (c + 5, a + "I", lines + (f"{role[t]}:",))
                        best[step[q, t]] = min(best.get(step[q, t], new), new)
        return best

    best = {"0": (0, "", ())}
    for initial, fault, r, text in codes:
        after = {}
        for q, (c, a, lines) in inserts(best).items():
            moves = [(q, (c + 2, a + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (q, initial) in step:
                    moves.append((step[q, initial], (c + more, a + "K", lines + (f"{r}:{text}",))))
                moves += [(step[q, t], (c + 1 + more, a + "R", lines + (f"{role[t]}:{text}",))) for t in "ua" if (q, t) in step]
            for to, new in moves:
                after[to] = min(after.get(to, new), new)
        best = after
    return min(v for q, v in inserts(best).items() if q in "0a")


def expected(rows):
    """conv -> result row, from (conv_id, turn, role, text) rows as they stand."""
    space = " \t\n\r\x0b\x0c"
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), []
        for _, role, text in group:
            said = text.rstrip(space)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append((role[:1], fault, role, text))
        turns = [r[0] for r in group if r[0] is not None]
        cost, audit, lines = cheapest(codes)
        count = Counter(c[1] for c in codes)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("at", "i", "edit", "audit", "fault", "cost")})
    summary, edited = repair.repair(df)
    same = F.col("s.conv_id").eqNullSafe(F.col("d.conv_id"))
    return {r[0]: tuple(r)[1:] for r in summary.alias("s").join(repair.digests(edited).alias("d"), same).select(
        "s.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_alignment_of_all_short_conversations():
    for n in range(5):
        for codes in itertools.product(["s.", "sx", "u.", "ut", "a.", "ax", "-."], repeat=n):
            faults = {".": "", "x": "blank", "t": "truncated"}
            want = cheapest([(c[0], faults[c[1]], "", "") for c in codes])
            assert repair.whole("".join(codes)) == want[:2], codes


@pytest.mark.parametrize("seed", range(6))
def test_pieces_choose_as_the_whole(seed):
    rng = random.Random(seed)
    rows = [rng.choice(["u.", "a.", "s.", "ux", "at", "ut", "-."]) for _ in range(rng.randint(2, 24))]
    cuts = sorted({0, len(rows), *rng.sample(range(len(rows)), 2)})
    pieces = [repair.between("".join(rows[a:b])) for a, b in zip(cuts, cuts[1:])]
    cost, chain = repair.chosen(pieces)
    assert (cost, "".join(a for _, a in chain)) == repair.whole("".join(rows))


def test_repair_odd_and_long_conversations(spark):
    rng = random.Random(11)
    texts = ["fine.", "cut off", "", " \n", "Really?", "no!  \t", None, "é世 界.", "x" * 300_000 + "."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "", None, "uncle", "tool"]), rng.choice(texts))
            for c in [None, *range(120)] for _ in range(rng.randint(1, 9))]
    rows += rows[:40]
    rows += [(1000, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{t % 170}{rng.choice(['.', '.', '.', ''])}") for t in range(300)]
    assert repaired(spark, rows) == expected(rows)


def test_repair_of_nothing(spark):
    assert repaired(spark, []) == {}


def test_damaged_conversations_of_the_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = []
    for conv, turn, role, text in given:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in given} | expected(rows)
    got = repair.op11_target_alignment(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_a_null_turn_is_damaged_as_a_space(spark):
    df = spark.createDataFrame([(n, None, None, None) for n in range(60)], "conv_id long, turn long, role string, text string")
    left = {r["conv_id"] for r in repair.damaged(df).collect()}
    assert left == {n for n in range(60) if zlib.crc32(f"{n}: ".encode()) % 20}


# --- 12: secrets ------------------------------------------------------------

def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


SECRET = "Zq81mX07pLw4Vt93KdRb"


def odd_secrets():
    rng = random.Random(12)
    parts = ["token=", "pass", "PassWord: '", "api_key", "apiKey = \"", "secret:", "AKIA", "AKIAAKIA", "0123456789abcdef" * 2, "é世", "\n", " ", "=", "A1B2C3D4E5F6G7H8I9",
             "deadbeef", "ſecret=", "toKen=", "x.y-z/+_", "😀", SECRET, "'", "tokentoken==", "b7db7aa4a5fcc78305"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    return texts + [None, "", "secret=" + "ab" * 300_000, "token=secret:abcdefghijklmnopqrst", " password = x" + "=" * 20] + texts[:30]


def test_base_spans_of_odd_texts(spark, tmp_path):
    texts = odd_secrets()
    df = spark.createDataFrame([(i % 320, t, f"s{i % 7}", "en", 1, 2) for i, t in enumerate(texts)],
                               "doc_id long, text string, source string, lang string, row int, hits int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op12_secret_ownership(spark, str(tmp_path)).collect()
    text = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    want = []
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        n = Counter(k for *_, k in spans)
        want.append((i % 320, n["assign"], n["access"], n["hex"], hashlib.sha256(text(spans).encode()).hexdigest()))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    for r in got:  # base spans stay, in order, among those of the method
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in secrets.BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def test_ownership_separates_examples_from_live_values(spark):
    rows = [(i, f"key {SECRET} end", f"repo{i}", f"owner{i % 3}") for i in range(9)]                      # three owners
    rows += [(20 + i, "password=hunter2hunter99xyq", f"repo{i % 2}", "owner0") for i in range(50)]          # copied within one owner
    rows += [(80, "token: zzzzzzzzzzzzzzzz1", "r", "o"), (81, "token=EXAMPLE0k3y9zq1w8", "r", "o"), (82, None, None, None)]
    rows += [(83, "api_key='q8Zr2Tn5Yw1Lm7Kc'", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    spans = secrets.secret_spans(secrets.scan(docs, F.col("repo"), F.col("owner"))).collect()
    verdicts = defaultdict(set)
    for r in spans:
        verdicts[r["doc_id"]].add((r["kind"], r["verdict"], r["n_repos"], r["n_owners"]))
    assert all(verdicts[i] == {("token", "example", 9, 3)} for i in range(9))
    assert all(verdicts[20 + i] == {("assign", "live", 2, 1)} for i in range(50))
    assert verdicts[80] == {("assign", None, 1, 1)} and verdicts[81] == {("assign", None, 1, 1)} and 82 not in verdicts
    assert verdicts[83] == {("assign", "live", 1, 1)}
    by_doc = {r["doc_id"]: r for r in spans}
    assert rows[0][1][by_doc[0]["value_start"]:by_doc[0]["end"]] == SECRET


def test_secrets_match_their_sql(spark):
    con = duckdb.connect()
    files = f"{SF}/documents.parquet/*.parquet" if os.path.isdir(f"{SF}/documents.parquet") else f"{SF}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    got = secrets.op12_secret_ownership(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(secrets.SQL).fetchall())


def test_secrets_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_spans(secrets.scan(docs, F.lit("a"), F.lit("b"))).count() == 0


# --- 13: hard negatives -----------------------------------------------------

def mined(rows, positives=5, negatives=3):
    """Rows (vec_id, label, whole numbers or None) by all pairs, in Python integers."""
    good = [(i, y, v) for i, y, v in rows if y is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, y, v in good:
        if a is None or a % 50:
            continue
        pairs = [(-dot(v, w), float("inf") if i is None else i, i, z == y) for i, z, w in good if i != a]
        for p in sorted(x for x in pairs if x[3])[:positives]:
            inside = sorted(x for x in pairs if not x[3] and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0])
            out += [(a, p[2], k, x[2], -p[0], -x[0]) for k, x in enumerate(inside[:negatives], 1)]
    return Counter(out)


def test_scores_are_inner_products():
    rng = np.random.default_rng(13)
    for low, high, dims in ((-161, 147, 64), (-(1 << 24), 1 << 24, 16), (0, 1, 8), (-1, 0, 24)):
        a, c = rng.integers(low, high + 1, (5, dims)), rng.integers(low, high + 1, (70, dims))
        bits = int(max(c.max(), -1 - c.min())).bit_length() + 1
        assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(c, bits)) == a @ c.T).all()


def test_hard_negatives_of_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), [rng.randint(-4, 9) for _ in range(10)]) for i in range(300)]
    rows += [(50, 0, [1] * 10), (100, 0, []), (400, 1, [3]), (None, 1, [2] * 10), (None, 0, [5] * 10), (401, 0, None), (402, 1, [1, None]), (403, 2, [9] * 10)]
    rows += rows[:60] + [rows[7]] * 200  # repeated rows, one of them very often
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, v array<long>, row int").repartition(5)
    got = negatives.hard_negatives(df, F.col("v"), F.col("label"), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    whole = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows]
    got = negatives.op13_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == mined(whole)


def test_hard_negatives_take_only_finite_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.6, 0.6], 2), (3, [nan, 1.0], 1), (4, [0.7, inf], 2), (5, [0.7, None], 2), (6, None, 1), (8, [0.7, 0.7], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    # vec_id 0 goes to label 2, so nothing is like it but row 2
    got = negatives.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in got] == []
    rows = [(50, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.6, 0.6], 2), *rows[3:]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 2, 131072, 2 * 256 * 153)]


def test_hard_negatives_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, 1, [1 << 40])], "vec_id long, label int, v array<long>")
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(df, F.col("v"), F.col("label"), F.lit(True))


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, v array<long>")
    assert negatives.hard_negatives(df, F.col("v"), F.col("label"), F.lit(True)).count() == 0
