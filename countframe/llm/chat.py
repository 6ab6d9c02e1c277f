"""Chat formatting of reply trees (operator 9), DataFrame functions only.

Messages (conversation, id, parent, role, text, score) form trees.  Iterated
self-joins double the ancestor pointers: after k joins each message knows its
2^k-th ancestor and the score sum and length of the way there.  Leaves (the
ends of branches) are ranked per conversation by the mean score of their
root-to-leaf path, then length, then id; the chosen paths are enumerated
by the same pointers, and each path becomes one conversation string:

    ### role:\\n<text>\\n</turn>\\n

``\\``, ``<`` and ``#`` are escaped with a backslash in texts and roles
(``:`` and newline too in roles), so no marker can occur inside a text, and
one regular expression undoes it.  ``loss`` lists the spans (start, length in
code points of the formatted string) of the assistant texts.

Cost: messages x log2(longest conversation) rows through joins on
(conversation, id); only a chosen path itself is gathered into one row.

Cases: null text or role is empty; null score counts 0; null conversation is
one conversation.  A parent that does not exist makes a root; messages on a
cycle belong to no path.  Rows that repeat an id within a conversation are
one message, the smallest by parent, role and text.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.session import cut_lineage

LEARN_ROLE = "assistant"
HEAD, MIDDLE, TAIL = "### ", ":\n", "\n</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\<#:\n])" if role else r"([\\<#])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_trees(messages: DataFrame, conv: str = "conv_id", msg: str = "msg_id", parent: str = "parent_id",
                 role: str = "role", text: str = "text", score: str | None = None, top_k: int = 1) -> DataFrame:
    """(conv, leaf, branch_rank, branch_score, n_turns, formatted, loss) for
    the ``top_k`` best branches of each conversation."""
    m = messages.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("ck"),
        F.col(msg).cast("string").alias("id"), F.col(parent).cast("string").alias("pid"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    one = F.row_number().over(Window.partitionBy("ck", "id").orderBy(F.col("pid").asc_nulls_first(), "role", "text", "score"))
    m = cut_lineage(m.withColumn("n", one).where("n = 1").drop("n"))
    nodes = m.select("ck", "id", "pid", "score")

    # pointers[k]: messages with a 2^k-th ancestor, and the score sum and length
    # of the way below it; a message leaves the joins once it knows its root
    known = nodes.select("ck", F.col("id").alias("pid"), F.col("id").alias("up"))
    step = cut_lineage(nodes.join(known, ["ck", "pid"], "left")
                       .select("ck", "id", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n")))
    longest = nodes.groupBy("ck").count().agg(F.max("count")).first()[0] or 1
    pointers, rooted = [step.where("up IS NOT NULL")], [step.where("up IS NULL")]
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        above = reduce(DataFrame.unionByName, [pointers[-1], *rooted]).select(
            "ck", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
        step = cut_lineage(pointers[-1].join(above, ["ck", "up"]).select(
            "ck", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("n") + F.col("n2")).alias("n")))
        pointers.append(step.where("up IS NOT NULL"))
        rooted.append(step.where("up IS NULL"))

    leaves = (reduce(DataFrame.unionByName, rooted)
              .join(nodes.select("ck", F.col("pid").alias("id")), ["ck", "id"], "left_anti"))
    mean = F.col("total") / F.col("n")
    best = Window.partitionBy("ck").orderBy(mean.desc(), F.col("n").desc(), F.length("id"), "id")
    keys = ["ck", "leaf", "branch_rank", "branch_score"]
    ends = cut_lineage(leaves.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= top_k)
                       .select("ck", F.col("id").alias("leaf"), "branch_rank", mean.alias("branch_score"),
                               F.col("n").alias("place"), "id"))
    # climb: round k adds the messages 2^k to 2^(k+1) - 1 steps above the leaf
    parts = [ends]
    for k, p in enumerate(pointers):
        far = reduce(DataFrame.unionByName, parts).where(F.col("place") > (1 << k))
        parts.append(cut_lineage(far.join(p.select("ck", "id", "up"), ["ck", "id"]).select(
            *keys, (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("id"))))
    path = reduce(DataFrame.unionByName, parts)

    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(MIDDLE))
    body = escape(F.col("text"))
    turns = (path.join(m.select("conv", "ck", "id", "role", head.alias("head"), body.alias("body")), ["ck", "id"])
             .withColumn("turn", F.concat("head", "body", F.lit(TAIL))))
    end = F.sum(F.length("turn")).over(Window.partitionBy("ck", "leaf").orderBy("place"))
    turns = turns.withColumn("start", end - F.length("turn") + F.length("head"))
    span = F.when(F.col("role") == LEARN_ROLE, F.struct(F.col("start"), F.length("body").alias("length")))
    return (turns.groupBy("ck", "leaf").agg(
        F.first("conv").alias("conv"), F.first("branch_rank").alias("branch_rank"),
        F.first("branch_score").alias("branch_score"), F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss"))
        .select("conv", "leaf", "branch_rank", "branch_score", "n_turns",
                F.array_join("turns.turn", "").alias("formatted"), "loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"\n</turn>\n", -1), lambda x: x != "")
    cut = lambda x: F.instr(x, MIDDLE)
    return F.transform(pieces, lambda x: F.struct(
        unescape(x.substr(F.lit(len(HEAD) + 1), cut(x) - F.lit(len(HEAD) + 1))).alias("role"),
        unescape(x.substr(cut(x) + F.lit(len(MIDDLE)), F.length(x))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
