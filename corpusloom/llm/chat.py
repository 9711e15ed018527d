"""Operator 1 [native]: chat formatting of reply trees.

Messages form trees (node, parent). Root-to-leaf paths are enumerated by iterative self-joins with
pointer doubling, so a chain of n messages takes log2(n) joins. Branches are ranked by score, and
each chosen path is formatted as one conversation.

Template: ``### role: text</turn>`` and a line feed for each turn. In roles and texts, ``\\``, ``#``, ``<`` and
(in roles) ``:`` are replaced by ``\\s``, ``\\h``, ``\\l`` and ``\\c``; so no control string can occur inside
them, and undoing the codes in the order h, l, c, s gives the exact text back.

Defined cases: null text or role counts as empty; turns with equal numbers are ordered by role, then text, and
repeated rows of a plain conversation each stay a turn; of tree messages that repeat a node one stays; a message on a cycle of parents, or below one,
has no root and is left out; a null node is left out; a conversation with a null id is one conversation; very long texts stay whole; other columns
are left out; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.storage import materialize

TURN = r"### ([^:<]*): ([^<]*)</turn>\n"
END = "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = text
    for raw, code in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for raw, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\s")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def _key(conv_id: Column) -> Column:
    """Conversations as join keys: an id as text; the empty text stands for null."""
    return F.coalesce(conv_id.cast("string"), F.lit("")).alias("conv_id")


def _messages(messages: DataFrame, unique: bool) -> DataFrame:
    """conv_id (a key), node, parent, role, text, score; one message of each node, chosen by its hash."""
    rows = messages.where(F.col("node").isNotNull()).select(_key(F.col("conv_id")), "node", F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")).alias("m"))
    if not unique:
        rows = rows.groupBy("conv_id", "node").agg(F.min_by("m", F.struct(F.xxhash64("m"), "m")).alias("m"))
    return rows.select("conv_id", "node", "m.*")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn's parent is the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """The messages of each tree's best ``branches`` root-to-leaf paths: conv_id, leaf, rank, path_score, node, up (steps above the leaf).

    A path's score is the sum of its messages' scores; ties go to the smaller leaf. Each round joins the
    pointer table with itself, so that a node's pointer and path score double in reach; the table keeps one
    row for each message. The chosen leaves then gather their ancestors with the kept pointers, widest first, which
    meets each ancestor once. Messages whose parent is missing from the tree count as roots. A chain is no longer than its tree
    has messages, so what hasn't reached a root after log2 of that many rounds runs in a cycle. ``unique``: no node is repeated.
    """
    tree = _messages(messages, unique).select("conv_id", "node", "parent", "score")
    known = tree.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("has"))
    tree = materialize(tree.join(known, ["conv_id", "parent"], "left"), "chat-tree")
    reach = tree.select("conv_id", "node", F.when(F.col("has"), F.col("parent")).alias("up"), F.col("score").alias("path_score"))
    pointers = []
    longest = tree.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        reach = materialize(reach, "chat-reach")
        moving = reach.where(F.col("up").isNotNull())  # messages that have reached their root don't join again
        if 1 << len(pointers) > 2 * longest or not moving.limit(1).count():
            break
        pointers.append(moving.select("conv_id", "node", "up"))
        above = reach.select("conv_id", F.col("node").alias("up"), F.col("up").alias("next_up"), F.col("path_score").alias("add"))
        moved = moving.join(above, ["conv_id", "up"], "left").select("conv_id", "node", F.col("next_up").alias("up"), (F.col("path_score") + F.coalesce("add", F.lit(0.0))).alias("path_score"))
        reach = moved.unionByName(reach.where(F.col("up").isNull()))
    inner = tree.where(F.col("has")).select("conv_id", F.col("parent").alias("node")).distinct()
    best = Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "node")
    ranked = reach.where(F.col("up").isNull()).join(inner, ["conv_id", "node"], "left_anti").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    steps = ranked.select("conv_id", F.col("node").alias("leaf"), "rank", "path_score", "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(pointers))):
        jump = pointers[k].withColumnRenamed("up", "ancestor")
        more = steps.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", "rank", "path_score", F.col("ancestor").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        steps = materialize(steps.unionByName(more), "chat-steps")
    return steps.withColumn("conv_id", F.when(F.col("conv_id") != "", F.col("conv_id")).cast(messages.schema["conv_id"].dataType))


def format_paths(messages: DataFrame, steps: DataFrame, unique: bool = False) -> DataFrame:
    """One row for each chosen path: conv_id, leaf, formatted, loss_spans (start and end code points of each text under the loss mask)."""
    said = _messages(messages, unique).select("conv_id", "node", F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    turns = steps.select(_key(F.col("conv_id")), "leaf", "node", "up").join(said, ["conv_id", "node"])
    down = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    turns = turns.withColumn("end", F.sum(size.cast("long")).over(down) - len(END))
    turns = turns.select("conv_id", "leaf", F.struct(F.col("end"), "head", "body", "loss").alias("turn"))
    whole = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(
        F.when(F.col("conv_id") != "", F.col("conv_id")).cast(messages.schema["conv_id"].dataType).alias("conv_id"),
        "leaf",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["end"] - F.length(t["body"])).cast("int").alias("start"), t["end"].cast("int").alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations again: turns (role, text) and the text under the loss mask, both unescaped."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    return formatted.select(
        "*",
        F.arrays_zip(F.transform(roles, unescape).alias("role"), F.transform(texts, unescape).alias("text")).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("loss_text"),
    )


def digest(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
