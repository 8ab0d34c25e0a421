"""Reply trees to chat text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import cut, need
from wardline.llm.files import shared_folder

# Turn marks of the template. A text holds neither "<" nor "[" once it is escaped, so no mark can come from a text.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Reversible: ``~`` -> ``~0``, ``<`` -> ``~1``, ``[`` -> ``~2``."""
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def grown(rows: DataFrame, folder: str, round: int) -> DataFrame:
    """All rounds of a table in the shared folder, after ``rows`` were written as one more; column ``round`` tells which."""
    rows.write.parquet(f"{folder}/round={round}")
    return rows.sparkSession.read.schema(rows.schema.add("round", "integer")).parquet(folder)


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree: ``tree, branch (from 1), position (0 at the root), node``.

    ``nodes``: ``tree, node, parent, score``; a row without a parent, or whose parent is not in its tree, is a root. A
    branch scores the mean of its nodes' scores (null: 0); ties go to the smaller leaf. Paths are enumerated by
    iterative self-joins that double their reach: after k joins each node knows its ancestor 2^k steps up with the sum of
    scores between; the leaves are ranked, and only the chosen leaves walk back down the stored jumps, again doubling.
    Cost: log2(depth) joins of slim rows, whatever the depth. Nodes on a cycle hang under no root and give no branch; ids
    count within their tree; rows that repeat a node are one, with the smallest parent and the largest score; rows without a
    node id give none.
    """
    need(nodes, ["tree", "node", "parent", "score"])
    known = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).groupBy(
        "tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    folder = shared_folder(nodes.sparkSession, "branches")
    same = F.col("l.tree").eqNullSafe(F.col("r.tree"))
    # A row without a parent meets itself in the join, so such rows never share a null key.
    up = known.select("tree", F.col("node").alias("key")).where("key is not null").withColumn("there", F.lit(True))
    tied = known.withColumn("key", F.coalesce("parent", "node")).alias("l").join(
        up.alias("r"), same & (F.col("l.key") == F.col("r.key")), "left").select("l.tree", "node", "parent", "score", "there")
    level = grown(tied.select(
        "tree", "node", F.when(F.col("there") & F.col("parent").isNotNull(), F.col("parent")).alias("above"),
        F.col("score").alias("total"), F.lit(1).alias("length")), f"{folder}/level", 0)
    rows, jumps = level.count(), []
    going = level.where("above is not null")
    # Rows that reached their root rest in the table of the round in which they did, and take no part in later joins.
    while going.limit(1).count() and 2 ** len(jumps) <= 2 * max(rows, 1):
        jumps.append(going.select("tree", "node", "above"))
        k = len(jumps)
        higher = level.select("tree", F.col("node").alias("at"), F.col("above").alias("above2"), F.col("total").alias("total2"),
                              F.col("length").alias("length2"))
        made = grown(going.alias("l").join(higher.alias("r"), same & (F.col("l.above") == F.col("r.at")), "left").select(
            "l.tree", "node", F.col("above2").alias("above"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
            (F.col("length") + F.coalesce("length2", F.lit(0))).alias("length")), f"{folder}/level", k)
        level = made.where((F.col("round") == k) | F.col("above").isNull())
        going = level.where("above is not null")
    parents = known.select("tree", F.col("parent").alias("at")).where("at is not null").distinct()
    leaves = level.where("above is null and node is not null").alias("l").join(
        parents.alias("r"), same & (F.col("l.node") == F.col("r.at")), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("length")).desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)
    walk = grown(chosen.select("tree", "branch", "node", (F.col("length") - 1).alias("position")), f"{folder}/walk", len(jumps))
    for k in reversed(range(len(jumps))):
        walk = grown(walk.where(F.col("position") >= 2 ** k).alias("l").join(
            jumps[k].alias("r"), same & (F.col("l.node") == F.col("r.node"))).select(
            "l.tree", "branch", F.col("above").alias("node"), (F.col("position") - 2 ** k).alias("position")), f"{folder}/walk", k)
    return walk.drop("round")


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: every row replies to the one before it.

    Rows of a conversation are ordered by turn (nulls first), then role and text, so ties and repeated rows have one order.
    Returns ``tree, node, parent, score, role, text``; a null role or text is empty.
    """
    need(turns, [conv, turn, role, text])
    rows = turns.select(
        F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    named = lambda at: F.concat(F.coalesce(F.concat(F.lit("c"), F.col("tree").cast("string")), F.lit("n")), F.lit(":"), F.lpad(at.cast("string"), 10, "0"))
    return rows.withColumn("place", place).select(
        "tree", named(F.col("place")).alias("node"),
        F.when(F.col("place") > 1, named(F.col("place") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``tree, branch, formatted, loss``: one conversation per chosen path, and the (start, length) of its trained texts.

    Template: ``<s>role\\n`` + body + ``</s>`` per turn; the body is ``[INST] text [/INST]``, or the bare text for the
    assistant, whose texts alone bear loss. Role and text are escaped, a
    role's line breaks too. Offsets count code points of ``formatted``.
    The whole job is JVM expressions; a conversation is one row, so the longest one must fit in a row.
    """
    need(nodes, ["tree", "node", "parent", "score", "role", "text"])
    nodes = cut(nodes)
    path = branches(nodes, top)
    body = escape(F.coalesce("text", F.lit("")))
    trained = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("~3"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    whole = F.concat(head, F.when(trained, body).otherwise(F.concat(F.lit(ASK), body, F.lit(ASKED))), F.lit(CLOSE))
    told = nodes.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("said")).select("tree", "node", "said.role", "said.text")
    rows = path.alias("l").join(
        told.alias("r"), F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node"))).select(
        "l.tree", "branch", "position", whole.alias("whole"), F.length(whole).alias("width"),
        F.when(trained, F.length(head)).alias("skip"), F.when(trained, F.length(body)).alias("held"))
    rows = rows.withColumn("start", F.sum("width").over(
        Window.partitionBy("tree", "branch").orderBy("position")) - F.col("width"))
    turns = F.array_sort(F.collect_list(F.struct("position", "whole", "start", "skip", "held")))
    return rows.groupBy("tree", "branch").agg(turns.alias("turns")).select(
        "tree", "branch", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["held"].isNotNull()), lambda t: F.struct(
            (t["start"] + t["skip"]).cast("int").alias("start"), t["held"].cast("int").alias("length"))).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``role, text``."""
    parts = F.filter(F.split(formatted, OPEN), lambda p: p != F.lit(""))

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(1), F.length(part) - len(CLOSE))
        at = F.instr(inner, "\n")
        role = unescape(F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("~3"), F.lit("\n")))
        body = F.substring(inner, at + 1, F.length(inner) - at)
        asked = F.substring(body, F.lit(len(ASK) + 1), F.length(body) - len(ASK) - len(ASKED))
        return F.struct(role.alias("role"), unescape(F.when(role == LOSS_ROLE, body).otherwise(asked)).alias("text"))

    return F.transform(parts, turn)


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
