"""Conversations rebuilt from message rows by joining overlapping fragments.

Every message row is an export fragment of two message hashes (of id, role, kind and content): the message and the one
its line goes on with (its parent on the way up from ``current_node``, its last child on the way down from the only root).
Fragments whose suffix equals another's prefix overlap; as each message has one continuation, these paths are unambiguous
(a message met twice drops its chat) and are merged by doubling: a round joins every fragment with the one that starts where it ends, so a line of n messages is assembled
in log2(n) rounds and no task ever holds a conversation. Lines with a gap (a link to no row) or a loop are dropped.

Defined results: of each (chat_id, node_id) the row ingested last counts (NULL times first, ties by the greatest
values); rows with a NULL id take no part; a chat without rows, without a start, with NULL or several roots and no
usable ``current_node`` is dropped; of a repeated session the row updated last counts. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.plans.blocks import latest, rank_in_groups
from quillspan.session import cut, stored

HUMAN, ASSISTANT = ("user", "human"), ("assistant", "ai")
TURN_TYPES = ("text", "multimodal_text", "code")


def fragments(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, node_id, h, nxt, gap, is_start, up, speaker): the latest rows with their link along the chat's line;
    ``speaker`` is 'h' or 'a' for a turn, NULL for any other row."""
    rows = messages.where("chat_id IS NOT NULL AND node_id IS NOT NULL").select(
        "chat_id", "node_id", "ingested_at",
        F.when(F.col("parent") != "", F.col("parent")).alias("parent"),
        (F.size("children") > 0).alias("has_child"),
        F.coalesce(F.element_at(F.when(F.size("children") > 0, F.col("children")), -1), F.lit("")).alias("child"),
        F.when(
            (~F.coalesce("is_hidden", F.lit(False))) & F.col("content_type").isin(*TURN_TYPES) & F.col("content").rlike(r"(?U)\S"),
            F.when(F.lower(F.trim("role")).isin(*HUMAN), "h").when(F.lower(F.trim("role")).isin(*ASSISTANT), "a"),
        ).alias("speaker"),
        F.xxhash64("node_id", "role", "content_type", "content").alias("h"),
    )
    rows = latest(rows, ["chat_id", "node_id"], F.col("ingested_at"), ["parent", "has_child", "child", "speaker", "h"])
    chats = latest(sessions.where("chat_id IS NOT NULL"), ["chat_id"], F.col("updated_at"), ["current_node"])
    rows = cut(rows.join(chats.select("chat_id"), "chat_id", "left_semi"))

    from_node = chats.join(rows.select("chat_id", F.col("node_id").alias("current_node")), ["chat_id", "current_node"], "left_semi")
    from_node = from_node.select("chat_id", F.col("current_node").alias("start"), F.lit(True).alias("up"))
    roots = rows.where("parent IS NULL").groupBy("chat_id").agg(F.count("*").alias("n"), F.min("node_id").alias("start"))
    from_root = roots.where("n = 1").join(from_node, "chat_id", "left_anti").select("chat_id", "start", F.lit(False).alias("up"))
    starts = from_node.unionByName(from_root)

    linked = rows.join(starts, "chat_id").select(
        "chat_id", "node_id", "speaker", "up", (F.col("node_id") == F.col("start")).alias("is_start"), "h",
        F.when(F.col("up"), F.col("parent")).when(F.col("has_child"), F.col("child")).alias("target"),
    )
    there = rows.select("chat_id", F.col("node_id").alias("target"), F.col("h").alias("there"))
    out = linked.join(there, ["chat_id", "target"], "left").select(
        "chat_id", "node_id", "h", "is_start", "up", "speaker",
        F.col("there").alias("nxt"),
        (F.col("target").isNotNull() & F.col("there").isNull()).alias("gap"),
    )
    return cut(out)


def assemble(frags: DataFrame) -> DataFrame:
    """(chat_id, h, pos): the messages of each chat's line, the start at 0; chats whose line meets a message twice
    are left out."""
    line = frags.where("is_start").select("chat_id", "h", F.lit(0).cast("bigint").alias("pos"))
    jump = frags.where("nxt IS NOT NULL").select("chat_id", "h", "nxt")
    reach, whole = 1, []
    while True:
        ahead = line.join(jump, ["chat_id", "h"]).select("chat_id", F.col("nxt").alias("h"), (F.col("pos") + reach).alias("pos"))
        grown = line.unionByName(ahead)
        counted = grown.groupBy("chat_id", "h").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
        loops = counted.where("n > 1").select("chat_id").distinct()
        grown = cut(counted.join(loops, "chat_id", "left_anti").select("chat_id", "h", "pos"))
        growing = stored(grown.where(F.col("pos") >= reach).select("chat_id").distinct(), "threads-growing")
        if not growing.take(1):
            return reduce(DataFrame.unionByName, whole, grown)
        # lines that did not grow are whole and take no part in later rounds
        whole.append(grown.join(growing, "chat_id", "left_anti"))
        line, jump = grown.join(growing, "chat_id", "left_semi"), jump.join(growing, "chat_id", "left_semi")
        then = jump.select("chat_id", F.col("h").alias("nxt"), F.col("nxt").alias("far"))
        jump = cut(jump.join(then, ["chat_id", "nxt"]).select("chat_id", "h", F.col("far").alias("nxt")))
        reach *= 2


def _judged(sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (chat_id, turn_pos, node_id, speaker) and one verdict per chat that has a whole line."""
    frags = fragments(sessions, messages)
    line = assemble(frags).join(frags, ["chat_id", "h"])
    broken = line.where("gap").select("chat_id").distinct()
    whole = line.join(broken, "chat_id", "left_anti").withColumn("ord", F.when(F.col("up"), -F.col("pos")).otherwise(F.col("pos")))
    turns = whole.where("speaker IS NOT NULL").select("chat_id", "ord", "node_id", "speaker")
    turns = cut(rank_in_groups(turns, ["chat_id"], "ord", "turn_pos"))
    answers = turns.where("speaker = 'a'").select("chat_id", (F.col("turn_pos") - 1).alias("turn_pos"), F.lit(1).alias("answered"))
    asked = turns.where("speaker = 'h'").join(answers, ["chat_id", "turn_pos"], "left")
    replies = asked.groupBy("chat_id").agg(F.count("*").alias("n_human"), F.count("answered").alias("n_answered"))
    sizes = turns.groupBy("chat_id").agg(F.count("*").alias("n_turns"))
    judged = whole.select("chat_id").distinct().join(sizes, "chat_id", "left").join(replies, "chat_id", "left")
    verdict = (
        F.when(F.coalesce("n_turns", F.lit(0)) == 0, "empty").when(F.coalesce("n_human", F.lit(0)) == 0, "no human turn")
        .when(F.col("n_human") > F.col("n_answered"), "missing reply").otherwise("kept")
    )
    return turns, judged.select("chat_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), verdict.alias("verdict"))


def conversations(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, turn_pos, node_id, role) of the kept chats, ``turn_pos`` from 1."""
    turns, judged = _judged(sessions, messages)
    kept = judged.where("verdict = 'kept'").select("chat_id")
    role = F.when(F.col("speaker") == "h", "human").otherwise("assistant").alias("role")
    return turns.join(kept, "chat_id", "left_semi").select("chat_id", F.col("turn_pos").cast("int").alias("turn_pos"), "node_id", role)


def verdicts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, n_turns, verdict) of every chat: kept, broken, empty, no human turn or missing reply."""
    _, judged = _judged(sessions, messages)
    chats = sessions.where("chat_id IS NOT NULL").select("chat_id").distinct()
    return chats.join(judged, "chat_id", "left").select(
        "chat_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("verdict", F.lit("broken")).alias("verdict")
    )
