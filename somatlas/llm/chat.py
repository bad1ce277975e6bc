"""Reply trees to chat text, in DataFrame functions only.

Template: a turn is ``### <role>: <text></turn>`` and a line feed. Inside roles
and texts the control strings are written as two-character codes that start
with a backslash, and a backslash itself as one too, so no text can end or
open a turn and every text can be read back:

    \\  -> \\b     </turn> -> \\e     ###<space> -> \\h     :<space> (roles) -> \\c

After escaping, each backslash starts exactly one code, so plain replacement,
with the backslash last, undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.runtime import Scratch, ordered_rank

OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
END = CLOSE + "\n"
CODES = ((CLOSE, "\\e"), (OPEN, "\\h"))
ROLE_CODES = (*CODES, (SEP, "\\c"))
CHUNK = 128  # turns that are joined before a conversation's chunks meet


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, codes=CODES) -> Column:
    c = _swap(c, "\\", "\\b")
    for plain, code in codes:
        c = _swap(c, plain, code)
    return c


def unescape(c: Column, codes=CODES) -> Column:
    for plain, code in codes:
        c = _swap(c, code, plain)
    return _swap(c, "\\b", "\\")


def reply_paths(nodes: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: the ``top`` best branches of each tree.

    ``nodes`` has tree_id, node_id, parent_id (null at a root) and score; of
    several rows with one node_id the least (tree_id, parent_id, score) counts.
    Self-joins double the length of each node's known way up, so a tree of
    depth d takes log2(d) rounds; a tree whose nodes all have a root leaves the
    rounds, so what they read shrinks with the trees that go on. A branch's
    score is the sum of its nodes' scores (null counts as 0); ties go to the
    deeper branch, then to the lower leaf. The chosen leaves then walk the
    saved jumps, again in doubling steps, which writes exactly the rows of the
    chosen paths.

    Returns tree_id, leaf_id, branch_rank (from 1), branch_score, depth,
    position (0 at the root), node_id. A parent_id that no node has makes its
    node a root. Nodes whose way up is a cycle have no root and give no path.
    Every join of nodes is on node_id, which is unique by then, so no tree is
    too large for a task. An empty table gives no paths.
    """
    one = F.min(F.struct("tree_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    base = scratch.save(nodes.where("node_id is not null").groupBy("node_id").agg(one.alias("n")).select("node_id", "n.*"), "nodes")
    known = base.select(F.col("node_id").alias("parent_id"), F.col("node_id").alias("up"))
    parents = base.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.lit(False).alias("leaf")).distinct()
    first = base.join(known, "parent_id", "left").join(parents, "node_id", "left")
    active = first.select("tree_id", "node_id", "up", "score", F.lit(1).cast("long").alias("depth"), F.coalesce("leaf", F.lit(True)).alias("leaf"))
    active, total, jumps, done = scratch.save(active, "up0"), base.count(), [], []
    while True:
        # Trees with a node that is still on its way go on; the others are done.
        open_ = active.where("up is not null").select(F.col("tree_id").alias("__tree")).distinct()
        if open_.isEmpty() or 1 << len(jumps) > total:
            done.append(active)
            break
        open_ = scratch.save(open_, "open")
        goes_on = F.col("tree_id").eqNullSafe(F.col("__tree"))
        done.append(active.join(open_, goes_on, "left_anti"))
        if jumps:
            active = scratch.save(active.join(open_, goes_on, "left_semi"), f"open{len(jumps)}")
        jumps.append(active.where("up is not null").select("node_id", "up"))
        far = active.select(F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("score").alias("__score"), F.col("depth").alias("__depth"))
        longer = active.join(far, "up", "left").select(
            "tree_id", "node_id", F.col("__up").alias("up"), (F.col("score") + F.coalesce("__score", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), "leaf"
        )
        active = scratch.save(longer, f"up{len(jumps)}")
        if len(jumps) == 1:
            active = active.join(open_, goes_on, "left_semi")  # the trees that were done before this round are counted once
    order = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("depth").desc(), "node_id")
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    chosen = ended.where("leaf and up is null").withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= top)
    chosen = scratch.save(chosen.select("tree_id", F.col("node_id").alias("leaf_id"), "branch_rank", F.col("score").alias("branch_score"), "depth"), "chosen")
    path = chosen.select("leaf_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(jumps):
        further = path.join(jump, "node_id").select("leaf_id", F.col("up").alias("node_id"), (F.col("dist") + (1 << k)).alias("dist"))
        path = path.unionByName(scratch.save(further, f"path{k}"))
    return path.join(chosen, "leaf_id").select("tree_id", "leaf_id", "branch_rank", "branch_score", "depth", (F.col("depth") - 1 - F.col("dist")).alias("position"), "node_id")


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """One chat text for each path. ``turns`` has node_id, role, text (null: empty).

    Returns tree_id, leaf_id, branch_rank, branch_score, formatted and
    loss_spans: an array of (turn, start, length) in code points, start being
    counted from the turn's marker; the spans cover the assistant's texts as
    they stand in ``formatted``, escaped. Turns are joined in chunks first, so
    only chunks of a conversation meet in the row that is its text.
    """
    role = escape(F.coalesce("role", F.lit("")), ROLE_CODES)
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(SEP))
    lines = turns.select(
        "node_id",
        F.concat(head, text, F.lit(END)).alias("line"),
        F.when(F.col("role") == "assistant", F.struct(F.char_length(head).alias("start"), F.char_length(text).alias("length"))).alias("span"),
    )
    keys = ["tree_id", "leaf_id", "branch_rank", "branch_score"]
    rows = paths.join(lines, "node_id").withColumn("chunk", F.floor(F.col("position") / CHUNK))
    span = F.when(F.col("span").isNotNull(), F.struct(F.col("position").cast("int").alias("turn"), F.col("span.start").alias("start"), F.col("span.length").alias("length")))
    chunks = rows.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("position", "line"))).alias("lines"), F.array_sort(F.collect_list(span)).alias("spans")
    ).select(*keys, "chunk", F.array_join(F.col("lines.line"), "").alias("piece"), "spans")
    whole = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "piece", "spans"))).alias("c"))
    return whole.select(*keys, F.array_join(F.col("c.piece"), "").alias("formatted"), F.flatten(F.col("c.spans")).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Parse ``formatted`` and ``loss_spans``: adds turns (role, text) and loss_text, both unescaped."""
    lines = F.split("formatted", "</turn>\n")  # the string has no character that a pattern treats specially
    bodies = F.slice("__lines", 1, F.size("__lines") - 1)

    def turn(line: Column) -> Column:
        role = F.substring_index(F.substr(line, F.lit(len(OPEN) + 1)), SEP, 1)
        return F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(F.substr(line, F.char_length(role) + len(OPEN + SEP) + 1)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("__lines", s["turn"] + 1), s["start"] + 1, s["length"])))
    out = chats.withColumn("__lines", lines)
    return out.withColumns({"turns": F.transform(bodies, turn), "loss_text": F.array_join(loss, "")}).drop("__lines")


def chain_nodes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations as trees, each turn a reply to the turn before it: nodes for ``reply_paths`` and turns for ``format_paths``.

    ``rows`` has conv_id, turn, role, text. Rows of a conversation are ordered
    by turn, then role and text (nulls first); node_id is the row's place in
    the whole table, and the row before it is its parent if it has the same
    conv_id. Null conv_id is one conversation. Repeated rows are repeated turns.
    """
    ranked = ordered_rank(scratch, rows.select("conv_id", "turn", "role", "text"), [F.col(c) for c in ("conv_id", "turn", "role", "text")], "turns", rank="node_id")
    places = scratch.save(ranked.select(F.col("conv_id").alias("tree_id"), "node_id"), "places")
    before = places.select((F.col("node_id") + 1).alias("node_id"), F.col("tree_id").alias("__tree"), F.lit(True).alias("__before"))
    same = F.col("__before").isNotNull() & F.col("tree_id").eqNullSafe(F.col("__tree"))
    nodes = places.join(before, "node_id", "left").select("tree_id", "node_id", F.when(same, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))
    return scratch.save(nodes, "nodes"), ranked.select("node_id", "role", "text")


def rejected_replies(nodes: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """A second branch for every tree of two or more nodes: nodes and turns of an assistant's reply to the root with a score of -1.

    node_id of ``nodes`` is 0 or more and the root has a tree's lowest, as ``chain_nodes`` gives them.
    """
    roots = nodes.groupBy("tree_id").agg(F.min("node_id").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    replies = roots.select("tree_id", (-1 - F.col("root")).alias("node_id"), F.col("root").alias("parent_id"), F.lit(-1.0).alias("score"))
    return replies, replies.select("node_id", F.lit("assistant").alias("role"), F.lit(text).alias("text"))
