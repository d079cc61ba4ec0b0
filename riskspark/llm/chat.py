"""Chat formatting from reply trees (operator 3), DataFrame and SQL only.

Messages form trees by ``parent_id``; each root-to-leaf path is a branch.
Iterative self-joins double the step of every message's ancestor pointer, and
add up scores and lengths on the way, until all pointers have passed the roots:
rounds grow with the logarithm of the depth.  Branches of a tree are ranked by
the mean score of their messages (ties: more messages, then the smaller leaf);
the first ``keep`` of each tree are spelled out by joins with the same
pointers, largest step first, and formatted as one conversation each.  Only
node ids travel through the rounds; texts join at the end.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  Inside roles and texts
a backslash becomes two, and ``<`` and ``[`` get a backslash after them, so no
control string of this or the usual bracketed templates can appear in a text;
``unescaped`` turns that back.  ``loss_spans`` holds (start, length) in code
points of the assistant texts inside ``formatted``.

Results for odd input: a null text or role is an empty one; a message whose
parent is missing is a root; messages that reply into a cycle have no root and
belong to no branch; repeated rows are turns of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Messages (tree_id, branch, pos, node_id) of the chosen branches of
    (tree_id, node_id, parent_id, score) rows; ``pos`` counts from the root."""
    links = staged(messages.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("total")), "chat-links")
    a, b = links.alias("a"), links.alias("b")
    same = lambda x, y: F.col(f"{x}.tree_id").eqNullSafe(F.col(f"{y}.tree_id"))
    known = b.select("tree_id", "node_id").alias("b")
    step = staged(a.join(known, same("a", "b") & (F.col("a.parent_id") == F.col("b.node_id")), "left").select(
        "a.tree_id", "a.node_id", F.col("b.node_id").alias("up"), "a.total", F.lit(1).alias("n")), "chat-steps")
    steps, count = [step], links.count()
    while len(steps) <= count.bit_length() and not step.filter("up is not null").isEmpty():
        x, y = step.filter("up is not null").alias("x"), step.alias("y")  # the others are at their root
        further = x.join(y, same("x", "y") & (F.col("x.up") == F.col("y.node_id"))).select(
            "x.tree_id", "x.node_id", "y.up", (F.col("x.total") + F.col("y.total")).alias("total"), (F.col("x.n") + F.col("y.n")).alias("n"))
        step = staged(further.unionByName(step.filter("up is null")), "chat-steps")
        steps.append(step)
    leaves = step.filter("up is null").alias("s").join(b, same("s", "b") & (F.col("s.node_id") == F.col("b.parent_id")), "left_anti")
    # the filter on row_number lets Spark keep the best few of a tree per task before the shuffle
    best = Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "node_id")
    chosen = staged(leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= keep)
                    .select("tree_id", "branch", (F.col("n") - 1).alias("pos"), "node_id"), "chat-branches")
    for k in range(len(steps) - 2, -1, -1):  # each message and its ancestor 2^k steps up
        c, u = chosen.alias("c"), steps[k].filter("up is not null").alias("u")
        above = c.join(u, same("c", "u") & (F.col("c.node_id") == F.col("u.node_id"))).select(
            "c.tree_id", "c.branch", (F.col("c.pos") - (1 << k)).alias("pos"), F.col("u.up").alias("node_id"))
        chosen = staged(chosen.unionByName(above), "chat-branches")
    return chosen


def format_chats(messages: DataFrame, keep: int = 1) -> DataFrame:
    """One row per chosen branch: tree_id, branch, formatted, loss_spans.

    ``messages``: tree_id, node_id (unique in its tree), parent_id (null for a
    root), role, text, score.
    """
    chosen = branches(messages, keep).alias("p")
    m = messages.select("tree_id", "node_id", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).alias("m")
    turns = chosen.join(m, F.col("p.tree_id").eqNullSafe(F.col("m.tree_id")) & (F.col("p.node_id") == F.col("m.node_id"))).select(
        "p.tree_id", "p.branch", "p.pos", (F.col("m.role") == "assistant").alias("loss"),
        F.concat(F.lit(TURN), escaped(F.col("m.role")), F.lit(TEXT)).alias("head"), escaped(F.col("m.text")).alias("body"))
    before = Window.partitionBy("tree_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int")
    turns = turns.withColumn("start", start)
    span = F.when(F.col("loss"), F.struct("start", F.length("body").alias("length")))
    text = F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("turn"))))
    return turns.groupBy("tree_id", "branch").agg(
        F.array_join(F.transform(text, lambda t: t["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.struct(
        unescaped(F.substring_index(x, TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Turns of a flat conversation as a tree of one branch: each row replies
    to the row before it in the order of (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"),
                       "role", "text").select(
        "*", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(staged(conversation_messages(rows), "chat-messages"))
    turns = read_turns(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return chats.withColumn("turns", turns).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
