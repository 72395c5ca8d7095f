"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer.  Self-joins by pointer doubling give
every message its root, its depth and the score of its path in as many rounds as
the depth has binary digits; the jumps of every round are kept.  Leaves are the
messages nobody answers: one root-to-leaf path each.  The paths of a root are
ranked by their mean score, and the best ones are written out.  The messages of a
chosen path are found by walking the kept jumps from its leaf, doubling the part
of the path that is known in each round.

A path becomes one text::

    ### role: text</turn>
    ### role: text</turn>

Inside roles and texts a backslash stands before every backslash, before the
slash of ``</turn>``, before the first sign of ``### ``, and in roles before every
colon; removing each backslash and keeping what follows it gives the text back.
The loss mask is a list of (start, length) spans in code points, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import cut, unused

END = "</turn>\n"
_CONTROL = r"\\|(?<=<)/(?=turn>)|#(?=## )"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_replies(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A table of numbered turns as messages: every turn answers the one before it.

    Returns id, parent, score, conv_id, role, text.  Turns of one number follow
    each other by role and text.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    # the ids are written down before anything refers to them
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()), "turns")
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "id"))
    return rows.select("id", before.alias("parent"), F.lit(1.0).alias("score"), "conv_id", "role", "text")


def chat_paths(messages: DataFrame, *, paths_per_root: int | None = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen root-to-leaf paths, their members, and the messages without a root.

    ``messages`` has id, parent, score; returns (paths: path, root, depth, score,
    branch), (members: path, id, above), ``above`` counting from the leaf, and
    (rootless: id), the messages of reply rings and all that answer them.

    Defined cases: null scores count 0; a parent that is not in the table, or null,
    makes a root; an empty table gives three empty tables; other columns are not read.
    """
    known = messages.select(F.col("id").alias("known"))
    links = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    links = cut(
        links.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("up"), "score"),
        "replies",
    )
    state = links.select("id", F.col("id").alias("top"), "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    rooted = state.where("up is null")  # what has reached its root needs no further round
    climbing = state.where("up is not null")
    jumps: list[DataFrame] = []
    rounds = links.count().bit_length()
    # a message that still has something above it after so many doublings answers itself
    while len(jumps) <= rounds and not climbing.isEmpty():
        jumps.append(climbing.select("id", "up"))
        above = rooted.unionByName(climbing).select(
            F.col("id").alias("a_id"), F.col("top").alias("a_top"), F.col("up").alias("a_up"), F.col("total").alias("a_total"), F.col("depth").alias("a_depth")
        )
        state = cut(
            climbing.join(above, F.col("up") == F.col("a_id")).select(
                "id",
                F.col("a_top").alias("top"),
                F.col("a_up").alias("up"),
                (F.col("total") + F.col("a_total")).alias("total"),
                (F.col("depth") + F.col("a_depth")).alias("depth"),
            ),
            "ancestors",
        )
        rooted = rooted.unionByName(state.where("up is null"))
        climbing = state.where("up is not null")
    leaves = rooted.join(
        links.where("up is not null").select(F.col("up").alias("answered")), F.col("id") == F.col("answered"), "left_anti"
    )
    paths = leaves.select(F.col("id").alias("path"), F.col("top").alias("root"), "depth", (F.col("total") / F.col("depth")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), F.desc("depth"), "path"))
    paths = paths.withColumn("branch", rank)
    if paths_per_root is not None:
        paths = paths.where(F.col("branch") <= paths_per_root)
    paths = cut(paths, "paths")

    members = paths.select("path", F.col("path").alias("id"), F.lit(0).cast("long").alias("above"))
    for i, jump in enumerate(jumps):
        higher = members.join(jump, "id").select("path", F.col("up").alias("id"), (F.col("above") + (1 << i)).alias("above"))
        members = cut(members.unionByName(higher), "members")
    # what still climbs after so many doublings goes round for ever
    return paths, members, climbing.select("id")


def rootless_messages(messages: DataFrame) -> DataFrame:
    """The rows of ``messages``, whole, that :func:`format_chats` leaves out.

    These are the messages of a ring (each answers the next, the last the first, or
    one itself) and all that answer them directly or further down.  Empty where
    every message has a root.
    """
    known = chat_paths(messages.select("id", "parent", F.lit(0.0).alias("score")))[2]
    lost = unused(messages, "_lost")
    return messages.join(known.select(F.col("id").alias(lost)), F.col("id") == F.col(lost), "left_semi")


def format_chats(messages: DataFrame, *, paths_per_root: int | None = 1, learned_role: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen path.

    ``messages``: id (unique), parent, score, conv_id, role, text.  Returns
    conv_id, path (id of its leaf), branch, path_score, n_turns, formatted, and
    loss (array of start, length), the spans of ``learned_role``'s texts.

    Defined cases: null roles and texts are empty, null scores 0; a parent that
    is not in the table, or null, makes a root; messages that answer themselves
    in a ring have no root and appear in no path, they and all below them are
    returned by :func:`rootless_messages`; paths of one root with equal
    scores rank the longer first, then the smaller leaf id; an empty table gives
    no rows; other columns are not read.
    """
    paths, members, _ = chat_paths(messages, paths_per_root=paths_per_root)
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), ":", r"\\:")
    body = escaped(F.coalesce("text", F.lit("")))
    turns = (
        messages.select("id", "conv_id", F.concat(F.lit("### "), role, F.lit(": ")).alias("head"), body.alias("body"), F.coalesce(F.col("role") == learned_role, F.lit(False)).alias("learned"))
        .join(members, "id")
        .join(paths.select("path", "depth", "branch", F.col("score").alias("path_score")), "path")
    )
    ordered = Window.partitionBy("path").orderBy(F.desc("above"))
    length = F.length("head") + F.length("body") + len(END)
    before = F.sum(length).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head") + 1)
    turn = F.struct(
        (-F.col("above")).alias("at"),
        F.concat("head", "body", F.lit(END)).alias("written"),
        "learned",
        F.struct(F.col("start"), F.length("body").cast("long").alias("length")).alias("span"),
    )
    return (
        turns.groupBy("path", "branch", "path_score")
        .agg(F.min(F.struct(-F.col("above"), F.col("conv_id").alias("conv_id"))).alias("first"), F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            F.col("first.conv_id").alias("conv_id"),
            "path",
            "branch",
            "path_score",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: t.written), "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t.learned), lambda t: t.span).alias("loss"),
        )
    )


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    head = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    written = F.filter(F.split(formatted, END, -1), lambda t: t != "")
    return F.transform(
        written,
        lambda t: F.struct(
            unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text")
        ),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s.start.cast("int"), s.length.cast("int")))), "")
