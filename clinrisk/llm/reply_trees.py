"""Chat formatting of reply trees: the best root-to-leaf branches of each tree, each as one marked-up conversation.

Messages name their parent. Branches are enumerated by self-joins that double the distance at every step, so a thread of
depth d takes about log2(d) joins upwards (depth and score of every leaf) and as many downwards (the messages of the chosen
branches); no message ever carries its whole path, and one that has reached its root takes part in no further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.llm.common import landed

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """``text`` without a control string: each backslash doubled, and one put into each ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As ``escape``; a line feed also gets a backslash, as an unescaped one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def branches(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """The messages on the ``top_k`` best root-to-leaf branches of each tree.

    ``messages``: tree, node, parent (NULL: root), score (NULL: 0). Nodes are unique in their tree and parents exist; a node
    whose parent is absent counts as a root, one that is its own ancestor belongs to no branch. Branches are ranked by their
    mean score, ties by greater length and then by the leaf's node. Returns tree, branch (1 is the best), node, depth (0 is the root).
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    nodes = (nodes.join(known, ["tree", "parent"], "left")
             .select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score"))
    # After step i, ``up`` is the ancestor 2^i above, and steps and total cover the nodes from here to just below it. Nodes
    # that have reached their root (no ``up``) are set aside and not joined again.
    level = landed(nodes.select("*", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "branches")
    most, ended, jumps = level.count(), level.where(F.col("up").isNull()), []
    level = level.where(F.col("up").isNotNull())
    while level.limit(1).count() and 2 ** len(jumps) <= most:
        jumps.append(level.select("tree", "node", "up"))
        above = ended.unionByName(level).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        further = landed(
            level.join(above, ["tree", "up"], "left").select(
                "tree", "node", "score", F.col("_up").alias("up"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total")), "branches")
        ended, level = ended.unionByName(further.where(F.col("up").isNull())), further.where(F.col("up").isNotNull())
    leaves = (ended
              .join(nodes.where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti"))
    ranked = (
        leaves.withColumn("branch", F.row_number().over(
            Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")))
        .where(F.col("branch") <= top_k))
    marked = landed(ranked.select("tree", "branch", "node", (F.col("steps") - 1).alias("depth")), "branches")
    for i in reversed(range(len(jumps))):
        higher = (marked.join(jumps[i], ["tree", "node"])
                  .select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - 2**i).alias("depth")))
        marked = landed(marked.unionByName(higher), "branches")
    return marked


def format_conversations(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One conversation per ``keys``: formatted text, and the spans of it that carry loss.

    ``turns``: ``keys``, depth, role, text (NULLs: empty). Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` with role
    and text escaped, in the order of depth. ``spans`` has per turn: loss (role is ``assistant``) and, inside the turn's markup
    after ``<|im_start|>``, the start (from 1) and length of its text.
    A conversation is one string by definition, so all its turns meet in one task; others do not share that task's memory.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head, body = F.concat(escape_role(role), F.lit("\n")), escape(text)
    turn = F.struct(
        F.col("depth"), F.concat(F.lit(START), head, body, F.lit(f"{END}\n")).alias("markup"),
        F.struct((role == "assistant").alias("loss"), (F.length(head) + 1).alias("start"), F.length(body).alias("length")).alias("span"))
    gathered = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return gathered.select(*keys, F.array_join(F.col("t.markup"), "").alias("formatted"), F.col("t.span").alias("spans"))


def read_back(formatted: Column, spans: Column) -> tuple[Column, Column]:
    """The turns in ``formatted`` as array<struct<role, text>>, and the unescaped text under the loss spans."""
    marked = F.slice(F.split(formatted, "<\\|im_start\\|>"), 2, F.greatest(F.size(spans), F.lit(1)))
    header = "(?s)^((?:[^\\\\\\n]|\\\\.)*+)\\n"

    def turn(x: Column) -> Column:
        head = F.regexp_extract(x, header, 1)
        body = x.substr(F.length(head) + 2, F.length(x) - F.length(head) - 2 - len(END))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    under = F.zip_with(marked, spans, lambda x, s: F.when(s["loss"], x.substr(s["start"], s["length"])).otherwise(""))
    return F.transform(marked, turn), unescape(F.array_join(under, ""))


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row's parent is the row before it by turn, ties by role and text.

    Columns tree (conv_id), node (1, 2, ...), parent, score, role, text. Repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select(F.col("conv_id").alias("tree"), "node",
                    F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"))


def format_trees(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """The best branches of each tree, formatted: tree, branch, formatted, spans.

    ``messages``: tree, node, parent, score, role, text. A NULL tree is a tree like others.
    """
    named = messages.withColumn("_null", F.col("tree").isNull()).withColumn("tree", F.struct("_null", "tree"))
    chosen = branches(named, top_k)
    turns = chosen.join(named.select("tree", "node", "role", "text"), ["tree", "node"])
    out = format_conversations(turns, ["tree", "branch"])
    return out.select(F.col("tree.tree").alias("tree"), "branch", "formatted", "spans")
