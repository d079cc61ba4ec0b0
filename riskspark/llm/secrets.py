"""Secret scans by corpus-wide ownership (operator 12), DataFrame and SQL only.

Patterns find candidate values in every text; the values leave the scan only as
hashes, with their places.  Spark counts the distinct repositories and owners
of each hash over the whole corpus.  A value that many owners hold is a widely copied
``example`` (documentation, templates, license texts); a value of few owners
that looks random is a ``live`` credential of theirs.

Kinds: ``assign`` (a value given to a password, token or the like), ``access``
(access key ids) and ``hex`` (long runs of hex digits) are found whatever their
verdict; ``token`` (long runs that mix capitals, small letters and digits) is a
candidate only.  Verdict spans cover the value alone.

A text is cut at the matches of a pattern: pieces and matches in turn give all
places, as code points.  Places are summed by a window inside one document.

Results for odd input: a null or empty text has no spans; every repeated row is
reported for itself, but its value counts once for its repository and owner; a
null repository or owner counts as one of its own; texts may have any length;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

#: Fixed patterns of the base kinds; a shorter match than the least length is dropped after it was found.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: Runs end where their class ends, so a least length inside the pattern finds the same runs.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
BASE = KINDS[:3]
VERDICTS = ("live", "example")
#: A value is widely copied from so many distinct owners or repositories on.
WIDE_OWNERS, WIDE_REPOS = 3, 6
#: Distinct characters of a value that looks random, and words that placeholders hold.
LEAST_CHARACTERS = 8
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456|abcdef"


def _hits(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Array of (kind, skip, size, value): code points before the match since the one before, and in it."""
    def hit(piece: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(piece).alias("skip"), F.length(match).alias("size"), value.alias("value"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one piece more than matches: the last pair has no match
    return F.when(text.rlike(pattern), F.filter(F.zip_with(F.split(text, pattern, -1), found, hit), lambda x: x["size"].isNotNull())).otherwise(F.array())


def looks_random(value: Column) -> Column:
    """Digits and letters, enough distinct characters, no character four times in a row, no placeholder."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS)
            & ~value.rlike(r"(.)\1\1\1") & ~value.rlike(PLACEHOLDER))


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """Staged (row, doc_id, repo, owner, hits); hits hold a hash in place of the value."""
    text = F.coalesce("text", F.lit(""))

    def hidden(x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
        passes = F.when(kind == KINDS.index("assign"), F.length(value) >= ASSIGN_LEAST).when(kind == KINDS.index("token"), mixed).otherwise(True)
        return F.struct(kind.alias("kind"), x["skip"].alias("skip"), x["size"].alias("size"), F.length(value).alias("chars"),
                        F.when(passes, F.unhex(F.sha2(value, 256))).alias("hash"), looks_random(value).alias("random"))

    hits = F.array(*[F.transform(_hits(text, *x), hidden) for x in (("assign", ASSIGN, 2), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))])
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
                              F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), hits.alias("hits")), "secrets-hits")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over the whole corpus; pairs are made distinct
    before they are counted, so a value of a third of all rows is few rows."""
    return found.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def secret_spans(scanned: DataFrame) -> DataFrame:
    """One row per candidate: row, doc_id, kind, start, end, value_start, hash,
    n_repos, n_owners, verdict (``live``, ``example`` or null)."""
    each = scanned.filter(F.exists("hits", lambda x: F.size(x) > 0)).select("row", "doc_id", "repo", "owner", F.explode("hits").alias("of_kind"))
    each = each.select("row", "doc_id", "repo", "owner", F.posexplode("of_kind").alias("pos", "hit")).select("row", "doc_id", "repo", "owner", "pos", "hit.*")
    until = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("skip").cast("long") + F.col("size")).over(until)).filter("hash is not null")
    placed = staged(placed, "secrets-spans")
    wide = (F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOS)
    verdict = F.when(wide, "example").when(F.col("random"), "live")
    return placed.join(ownership(placed), "hash").select(
        "row", "doc_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end",
        (F.col("end") - F.col("chars")).alias("value_start"), "hash", "n_repos", "n_owners", verdict.alias("verdict"))


def op12_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and verdict spans of all documents.  A document's source is its
    owner, its source and language its repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scanned = scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    spans = secret_spans(scanned)
    order = F.array(*map(F.lit, BASE + VERDICTS))
    span = lambda start, kind: F.struct(start.alias("start"), F.array_position(order, kind).alias("order"), F.col("end").alias("end"), kind.alias("kind"))
    both = F.array_compact(F.array(F.when(F.col("kind") != "token", span(F.col("start"), F.col("kind"))),
                                   F.when(F.col("verdict").isNotNull(), span(F.col("value_start"), F.col("verdict")))))
    of_row = spans.select("row", F.explode(both).alias("s")).groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("all"))
    rows = scanned.select("row", "doc_id").join(of_row, "row", "left").withColumn("all", F.coalesce("all", F.array()))
    base = F.filter("all", lambda s: s["order"] <= len(BASE))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))


def _split_sql(kind: int, pattern: str, group: int) -> str:
    """Matches of one kind in DuckDB: cut at the matches, sum the lengths."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT row, doc_id, source, lang, {kind} AS kind, k.i AS pos, length(pieces[k.i]) + length(found[k.i]) AS step, length(found[k.i]) AS size,
    regexp_extract(found[k.i], '{p}', {group}) AS value
  FROM (SELECT row, doc_id, source, lang, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}', 0) AS found
        FROM docs WHERE regexp_matches(text, '{p}')) m, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i) k"""


def _sql() -> str:
    # the same words without a switch for case, which folds more than ASCII there
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = r"""(""" + either + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    parts = [(0, assign, 2), (1, ACCESS, 0), (2, HEX, 0), (3, TOKEN, 0)]
    union = "\n  UNION ALL".join(_split_sql(k, p, g) for k, p, g in parts)
    names = "['assign', 'access', 'hex', 'token']"
    passes = ("CASE kind WHEN 0 THEN length(value) >= 12 WHEN 3 THEN regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') "
              "AND regexp_matches(value, '[0-9]') ELSE true END")
    random = (f"regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {LEAST_CHARACTERS} "
              "AND NOT list_bool_or([false] || [c = value[i + 1] AND c = value[i + 2] AND c = value[i + 3] for c, i in string_split(value, '')]) "
              "AND NOT regexp_matches(lower(value), 'example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456|abcdef')")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
hits AS ({union}),
placed AS (SELECT *, sum(step) OVER (PARTITION BY row, kind ORDER BY pos) AS "end" FROM hits),
good AS (SELECT * FROM placed WHERE {passes}),
owned AS (SELECT value, count(DISTINCT source || '/' || lang) AS n_repos, count(DISTINCT source) AS n_owners FROM good GROUP BY value),
judged AS (SELECT g.*, CASE WHEN n_owners >= {WIDE_OWNERS} OR n_repos >= {WIDE_REPOS} THEN 'example' WHEN {random.replace('value', 'g.value')} THEN 'live' END AS verdict
  FROM good g JOIN owned o ON g.value = o.value),
spans AS (
  SELECT row, {names}[kind + 1] AS name, kind AS k, "end" - size AS s, "end" AS e FROM judged WHERE kind < 3
  UNION SELECT row, verdict, CASE verdict WHEN 'live' THEN 3 ELSE 4 END, "end" - length(value), "end" FROM judged WHERE verdict IS NOT NULL),
per AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
    string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row)
"""


SQL = _sql()
