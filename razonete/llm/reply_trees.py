"""Chat formatting over reply trees. DataFrame functions only.

Messages form trees (a message names its parent). Self-joins double the reach
of every message's ancestor pointer until all pointers have passed a root, and
carry the sum of scores along; so each leaf knows the length and the mean score
of its root-to-leaf path. The leaves of a tree are ranked by that score, and
the joins of the doubling, run once more for the chosen leaves alone, list
their paths. A path is one conversation: one string of marked turns and the
spans of the text that loss is taken on.

Template: ``<s>`` and, for each turn, ``<|role|>text</s>``. In roles and texts
``& < > [`` are written as entities, so no control string (nor one of another
template, such as ``[INST]``) can stand in a text, and reading back is exact.

Defined cases: a null text or role is empty; a parent that does not exist
makes its child a root; messages on a cycle, or below one, have no path and
are left out; equal scores are ranked by longer path, then by the leaf's key; a
null conversation id is a conversation of its own; rows that share a turn
follow each other by role and text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "<|", "|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))  # in this order; undone in reverse


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees: every row answers the one before it. (tree, node, parent, role, text, score)"""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, pos, node) of the ``branches`` best paths of each tree; pos counts from the root, from 1."""
    nodes = stage(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "tree-nodes")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    step = nodes.join(known, nodes.tree.eqNullSafe(known.t) & (nodes.parent == known.p), "left").select(
        "tree", "node", F.col("p").alias("anc"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    # rows whose pointer has passed a root take no part in later rounds
    step = stage(step, "tree-jump")
    ended, jumps = [step.where("anc is null")], [step.where("anc is not null")]
    limit = max(1, nodes.count())
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= limit:
        a, every = jumps[-1], ended[-1].unionByName(jumps[-1])
        b = every.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.col("anc").alias("up"),
                         F.col("total").alias("more"), F.col("n").alias("longer"))
        step = stage(a.join(b, a.tree.eqNullSafe(b.t) & (a.anc == b.m)).select(
            "tree", "node", F.col("up").alias("anc"), (F.col("total") + F.col("more")).alias("total"),
            (F.col("n") + F.col("longer")).alias("n")), "tree-jump")
        ended.append(ended[-1].unionByName(step.where("anc is null")))
        jumps.append(step.where("anc is not null"))
    done = ended[-1]  # pointers that never pass a root belong to cycles
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = done.join(parents, done.tree.eqNullSafe(parents.t) & (done.node == parents.p), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "node"))
    paths = (leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
             .select("tree", "branch", "node", F.col("n").alias("pos")))
    for k, jump in enumerate(jumps[:-1]):  # after step k a path holds its last 2**(k+1) messages
        up = jump.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.col("anc"))
        far = paths.join(up, paths.tree.eqNullSafe(up.t) & (paths.node == up.m)).select(
            "tree", "branch", F.col("anc").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        paths = stage(paths.unionByName(far), "tree-paths")
    return paths


def format_paths(messages: DataFrame, branches: int = 1, learn_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, loss): one row per chosen path; loss: spans (start, length) in code points."""
    paths = best_paths(messages, branches).withColumnRenamed("tree", "t").withColumnRenamed("node", "m")
    rows = paths.join(messages.select("tree", "node", "role", "text"), paths.t.eqNullSafe(F.col("tree")) & (paths.m == F.col("node")))
    rows = rows.select("tree", "branch", "pos", (F.col("role") == learn_role).alias("learn"),
                       F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(len(BEGIN)) + F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    turn = F.struct("pos", "piece", "learn", start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    turns = rows.select("tree", "branch", turn.alias("turn")).groupBy("tree", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select(
        "tree", "branch", F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda x: x.piece), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda x: x.learn), lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss"))


def write_formatted(formatted: DataFrame, path: str) -> None:
    formatted.write.mode("errorifexists").parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """(tree, branch, turns, learned, formatted): the turns (role, text) and the learned text, read back from the strings."""
    table = spark.read.parquet(path)
    marked = F.split(F.expr(f"substring(formatted, {len(BEGIN) + 1})"), END)
    cut = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit(CLOSE)) + len(CLOSE))).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return table.select("tree", "branch", cut.alias("turns"), learned.alias("learned"), "formatted")
