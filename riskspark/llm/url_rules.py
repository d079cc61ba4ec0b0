"""URL filters by association rules (operator 7), DataFrame and SQL only.

FP-growth mines token combinations of labelled URLs together with a marker
item for bad ones.  Rules ``tokens -> bad`` that pass the support and
confidence limits are kept, less those that a shorter rule with at least the
same confidence already implies.  Tokens of the same labelled rows are one class;
an inverted index (token -> class -> rule) then finds the rules of which a URL
holds a token of every class.

Listed host and path rules come first: a listed rule fits its host and all
subdomains if the path starts with the rule's path, and the longest wins.

Results for odd input: a null URL or one without ``://`` has an empty host and
path, no tokens and the verdict allow; repeated pages keep their rows; without
labels nothing is mined and only the list decides; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

BAD = "label=bad"
#: Share of the labelled URLs that must hold a rule's tokens and be bad.
MIN_SUPPORT = 0.004
#: ... and at least so many URLs.
MIN_ROWS = 8
#: Share of the URLs with a rule's tokens that must be bad.
MIN_CONFIDENCE = 0.7
#: Host, path, verdict.
LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
          ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path parts, query keys.  Runs of digits
    become ``0`` in path parts, which are otherwise as given."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, "(?s)://[^?#]*\\?([^#]*)", 1), F.lit(""))
    parts = lambda x, by: F.filter(F.split(x, by), lambda y: y != "")
    return F.array_distinct(F.concat(
        F.transform(parts(host, "\\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(parts(path, "[/._-]"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(parts(query, "&"), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, confidence, support) from (url, bad) rows;
    the antecedent names each class of tokens by its smallest token."""
    return mine_classes(labelled, min_support, min_confidence)[0]


def mine_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT,
                 min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The rules of ``mine_rules``, and (token, class) of the tokens in them.

    Tokens below the support are no part of any rule.  Tokens that occur in
    exactly the same labelled rows have the same rules, so one of each such class
    is mined, which keeps a long URL that repeats from spanning all subsets of
    its tokens; other pages may hold only some of a class, and any of its tokens
    counts there.
    """
    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "bad", tokens_of(F.col("url")).alias("tokens")), "url-baskets")
    total = rows.count()
    least = max(min_support * total, MIN_ROWS)
    held = rows.select("row", F.explode("tokens").alias("token"))
    often = staged(held.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("rows_sum"))
                   .filter(F.col("n") >= least), "url-tokens")  # at most tokens per row / support
    least_tokens = often.groupBy("n", "rows_sum").agg(F.min("token").alias("class"))
    classes = staged(often.join(least_tokens, ["n", "rows_sum"]).select("token", "class"), "url-classes")
    names = least_tokens.select(F.col("class").alias("token"))
    baskets = staged(
        held.join(names, "token").groupBy("row").agg(F.collect_list("token").alias("found"))
        .join(rows.filter("bad").select("row", F.lit(True).alias("is_bad")), "row", "left")
        .select(F.when(F.col("is_bad"), F.array_append("found", F.lit(BAD))).otherwise(F.col("found")).alias("items")), "url-items")
    if total == 0 or baskets.isEmpty():
        found = empty
    else:
        share = min(1.0, least / baskets.count())
        model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
        found = (model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
                 .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    found = staged(found.withColumn("rule_id", F.xxhash64("antecedent")), "url-rules")
    # a rule is implied if a proper subset of its tokens is a rule as confident
    index = found.select("rule_id", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    small, large = index.alias("a"), index.alias("b")
    implied = (small.join(large, (F.col("a.token") == F.col("b.token")) & (F.col("a.n") < F.col("b.n"))
                          & (F.col("a.confidence") >= F.col("b.confidence")))
               .groupBy("a.rule_id", "a.n", F.col("b.rule_id").alias("gone")).agg(F.count("*").alias("common"))
               .filter(F.col("common") == F.col("n")).select("gone").distinct())
    return found.join(implied, found.rule_id == implied.gone, "left_anti"), classes


def matching_urls(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct ``url`` values that hold a token of every class of a rule, with
    the number of such rules, found through the inverted index."""
    index = rules.select("rule_id", F.size("antecedent").alias("n"), F.explode("antecedent").alias("class")).join(classes, "class")
    tokens = urls.select("url").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    return (tokens.join(index, "token").groupBy("url", "rule_id", "n").agg(F.size(F.collect_set("class")).alias("hits"))
            .filter(F.col("hits") == F.col("n")).groupBy("url").agg(F.count("*").alias("n_rules")))


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """The longest fitting (rule, verdict) of the list, or null."""
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append(F.struct(
            F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")))
    lists = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, "\\.")
    sites = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(sites, lambda s: F.try_element_at(lists, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))


def judge_urls(pages: DataFrame, labelled: DataFrame, listed=LISTED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and n_rules (mined rules held)."""
    hits = matching_urls(pages, *mine_classes(labelled)).withColumnRenamed("url", "_url")
    best = listed_rule(F.col("host"), F.col("path"), listed)
    return (pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
            .withColumn("_best", best)
            .join(hits, F.col("url") == F.col("_url"), "left")
            .withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
            .withColumn("rule", F.col("_best.rule"))
            .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.when(F.col("n_rules") > 0, "block").otherwise("allow")))
            .drop("_best", "_url"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page is labelled bad if the label of the
    document with its id says low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select("url", "bad")
    return judge_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "n_rules")
