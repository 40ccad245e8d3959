"""Reply trees to training conversations, in DataFrame functions only.

A message names the message it answers. Root-to-leaf paths are found by
iterative self-joins that double the pointer: after k joins every message
knows its 2^k-th ancestor and the score of the stretch between, so a path of
n turns takes log2(n) rounds, not n. Branches are ranked by mean score per
tree; only the chosen ones are spread out, again by doubling, and each becomes
one conversation. Ids travel through the joins, texts join once at the end.

Template, per turn: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line
feed. Control strings inside roles and texts are escaped reversibly: a
backslash is doubled, then one backslash is put after the first character of a
control string. (Single backslashes exist nowhere else, so they are told apart
when reading back.)

Defined results: null text or role counts as empty; a parent that is missing
makes a root; messages on a reply cycle, or behind one, belong to no path; of
messages with the same id in a tree the smallest (parent, role, text, score)
counts, so repeated rows collapse; ties of the score go to the smaller leaf id;
a null score counts as 0; messages without a tree id are one tree, whose id is
null in the result; rows without a message id are left out; an empty table
gives an empty result. A conversation is one string, so it must stay below Spark's limit for a value (2 GB).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings escaped inside texts: the template's marks (all begin "<|") and the
#: control strings of other common templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"
#: A tree: its id (0 where it is null) and whether it has none. Never null, so it joins.
TREE = ("tree", "unnamed")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _messages(messages: DataFrame) -> DataFrame:
    """``tree, unnamed, id, parent, role, text, score``: one row per message id."""
    row = F.struct(
        F.col("parent_id").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    known = messages.filter("msg_id IS NOT NULL")
    none = F.lit(0).cast(messages.schema["tree_id"].dataType)
    tree = F.coalesce("tree_id", none).alias("tree"), F.col("tree_id").isNull().alias("unnamed")
    one = known.groupBy(*tree, F.col("msg_id").alias("id")).agg(F.min(row).alias("m"))
    return one.select(*TREE, "id", "m.*")


def _jumps(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Table k: ``tree, unnamed, id, up, total, steps``; ``up`` is the 2^k-th ancestor
    (null above the root), ``total`` and ``steps`` cover the id and what lies
    between. The last table reaches every root."""
    here = nodes.select(*TREE, "id")
    known = here.withColumnRenamed("id", "parent").withColumn("there", F.lit(True))
    linked = nodes.join(known, [*TREE, "parent"], "left")
    up = F.when(F.col("there"), F.col("parent")).alias("up")
    now = scratch.table(linked.select(*TREE, "id", up, F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "jump0")
    largest = now.groupBy(*TREE).count().agg(F.max("count")).first()[0] or 1
    tables = [now]
    for k in range(1, math.ceil(math.log2(largest)) + 1):
        climbing = now.filter("up IS NOT NULL")
        if not climbing.limit(1).count():
            break
        on = now.select(*TREE, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"))
        far = climbing.join(on, [*TREE, "up"])
        far = far.select(*TREE, "id", F.col("up2").alias("up"), F.expr("total + t2").alias("total"), F.expr("steps + s2").alias("steps"))
        now = scratch.table(now.filter("up IS NULL").unionByName(far), f"jump{k}")
        tables.append(now)
    return tables


def _paths(leaves: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``tree, unnamed, leaf, id, dist``: every message of the chosen branches."""
    now = leaves.select(*TREE, F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(jumps):
        up = now.join(jump.filter("up IS NOT NULL").select(*TREE, "id", "up"), [*TREE, "id"])
        now = now.unionByName(up.select(*TREE, "leaf", F.col("up").alias("id"), (F.col("dist") + (1 << k)).alias("dist")))
        now = scratch.table(now, f"path{k}")
    return now


def _formatted(turns: Column) -> tuple[Column, Column]:
    """The conversation and the spans (start, length; in code points) of its
    learned texts, from an array of (role, text)."""
    part = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(f"{END}\n"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def step(acc, t):
        size = F.length(escape(t["text"])).cast("long")
        start = acc["at"] + len(START) + F.length(escape(t["role"])) + len(SEP)
        span = F.array(F.struct(start.alias("start"), size.alias("len")))
        spans = F.when(t["role"] == LEARNED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + size + len(END) + 1).alias("at"), spans.alias("spans"))

    return F.array_join(F.transform(turns, part), ""), F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def format_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths per tree, one row each:
    ``tree_id, leaf_id, branch, score, formatted, loss_spans``.

    ``messages``: ``tree_id, msg_id, parent_id, role, text, score``."""
    scratch = Scratch(prepare(messages.sparkSession), "chat")
    msgs = scratch.table(_messages(messages), "messages")
    jumps = _jumps(msgs.select(*TREE, "id", "parent", "score"), scratch)
    answered = msgs.select(*TREE, F.col("parent").alias("id")).distinct()
    leaves = jumps[-1].filter("up IS NULL").join(answered, [*TREE, "id"], "left_anti")
    leaves = leaves.select(*TREE, "id", (F.col("total") / F.col("steps")).alias("mean"))
    best = Window.partitionBy(*TREE).orderBy(F.desc("mean"), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    chosen = scratch.table(chosen, "chosen")
    path = _paths(chosen, jumps, scratch).join(msgs.select(*TREE, "id", "role", "text"), [*TREE, "id"])
    turn = F.struct((-F.col("dist")).alias("nth"), "role", "text")
    whole = path.groupBy(*TREE, "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text, spans = _formatted(F.col("turns"))
    whole = whole.select(*TREE, "leaf", text.alias("formatted"), spans.alias("loss_spans"))
    whole = whole.join(chosen.select(*TREE, F.col("id").alias("leaf"), "branch", "mean"), [*TREE, "leaf"])
    tree_id = F.when(~F.col("unnamed"), F.col("tree")).alias("tree_id")
    return whole.select(tree_id, F.col("leaf").alias("leaf_id"), "branch", F.col("mean").alias("score"), "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """An array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p):
        head = F.substring_index(p, SEP, 1)
        role = F.substr(head, F.lit(len(START) + 1))
        text = F.substr(p, F.length(head) + len(SEP) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def as_replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations (``conv_id, turn, role, text``) as reply trees:
    every row answers the row before it, by turn (ties: role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "msg_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))
