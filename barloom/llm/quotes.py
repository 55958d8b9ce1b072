"""Conversations in reply order, by linking quotations to the messages they quote.

Lines marked by ``>`` are quotations, one level for each mark. Runs of lines of one level are passages. A passage
is normalised and hashed and joined to the latest earlier message of the conversation that has it: as its
whole text, as one of its paragraphs, or as consecutive lines of it; if none has, as consecutive words of it, so
that a part of a line or a rewrapped part is found too. Lines are asked for by their first line, words by their first
words, so only places where a passage may begin are compared. Conversations are put in reply order: each message is
followed by its replies, each with its own replies behind it. All of it is SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, text_or_empty

#: Turns of one conversation that a window takes together; the blocks before are summed up first.
SPAN = 4096
#: First words of a passage that a place in a message must have before the whole passage is compared there.
LEAD = 4
_WHITE = r"[\x20\x09-\x0D]+"
_MARKS = r"^(?:[\x20\x09]*>)+"


def normalised(text: Column) -> Column:
    """White space as single spaces, trimmed, A-Z lowered."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, _WHITE, " "))


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _runs(lines: Column, same: callable) -> Column:
    """Starts and ends of the runs of an array's elements that are ``same`` as the one before."""
    last = F.size(lines) - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | ~same(F.get(lines, i), F.get(lines, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def _joined(lines: Column) -> Column:
    return normalised(F.array_join(F.transform(lines, lambda x: x["body"]), " "))


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``own`` (the text without quotations), ``own_lines`` (normalised, none empty),
    ``units`` (the text's and its paragraphs' hashes), ``passages`` (``level``, ``hash``, ``n_lines``, ``n_words``, ``lead``).

    The line that introduces a quotation (ending in ``wrote:``, with a line of a higher level next) goes with it, at any level.
    """
    raw = F.split(F.regexp_replace(text_or_empty(text), "\r\n?", "\n"), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    line = lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))
    lines = messages.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.transform(raw, line).alias("lines")
    )
    introduces = lambda x, i: F.rtrim(x["body"]).endswith("wrote:") & (F.get("lines", i + 1)["level"] > x["level"])
    lines = lines.withColumn("lines", F.filter("lines", lambda x, i: ~F.coalesce(introduces(x, i), F.lit(False))))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: x["level"] == 0)
    blank = lambda x: F.trim(F.regexp_replace(x["body"], _WHITE, " ")) == ""
    runs = lines.select("*", own.alias("mine")).select(
        "*",
        F.when(quoted, _runs(F.col("lines"), lambda a, b: a["level"] == b["level"])).alias("runs"),
        F.when(F.size("mine") > 0, _runs(F.col("mine"), lambda a, b: blank(a) == blank(b))).alias("paragraphs"),
    )
    part = lambda col, r: F.slice(col, r["start"] + 1, r["end"] - r["start"])
    passage = lambda r: F.struct(
        F.get("lines", r["start"])["level"].alias("level"),
        _joined(part(F.col("lines"), r)).alias("text"),
        F.size(F.filter(part(F.col("lines"), r), lambda x: ~blank(x))).alias("n_lines"),
        normalised(F.get(F.filter(part(F.col("lines"), r), lambda x: ~blank(x)), F.lit(0))["body"]).alias("first"),
    )
    hashed = lambda p: F.struct(
        p["level"].alias("level"), _hash(p["text"]).alias("hash"), p["n_lines"].alias("n_lines"), F.xxhash64(p["first"]).alias("first_line"),
        F.size(F.split(p["text"], " ")).alias("n_words"), F.xxhash64(F.substring_index(p["text"], " ", LEAD)).alias("lead"),
    )
    passages = F.filter(F.transform(F.filter("runs", lambda r: F.get("lines", r["start"])["level"] > 0), passage), lambda p: p["text"] != "")
    units = F.concat(
        F.array(_joined(F.col("mine"))), F.coalesce(F.transform("paragraphs", lambda r: _joined(part(F.col("mine"), r))), F.array().cast("array<string>"))
    )
    trim = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
    return runs.select(
        "conv", "turn", "role",
        F.regexp_replace(F.array_join(F.transform("mine", lambda x: x["body"]), "\n"), trim, "").alias("own"),
        F.transform(F.filter("mine", lambda x: ~blank(x)), lambda x: normalised(x["body"])).alias("own_lines"),
        F.transform(F.filter(F.array_distinct(units), lambda u: u != ""), _hash).alias("units"),
        F.coalesce(F.transform(passages, hashed), F.array().cast("array<struct<level:int,hash:string,n_lines:int,first_line:bigint,n_words:int,lead:bigint>>")).alias("passages"),
    )


def latest_before(asks: DataFrame, origins: DataFrame, by: list[str]) -> DataFrame:
    """``asks`` (``by``, ``turn``, distinct) with ``found``, the latest turn of ``origins`` (same columns) before it.

    Turns are taken in blocks of ``SPAN``; each block starts from the latest turn of the blocks before,
    so that a window holds no more than a block, and the blocks of a key.
    """
    block = F.floor(F.col("turn") / SPAN).alias("block")
    events = asks.select(*by, "turn", block, F.lit(1).alias("asks"), F.lit(0).alias("has")).unionAll(
        origins.select(*by, "turn", block, F.lit(0), F.lit(1))
    )
    events = events.groupBy(*by, "block", "turn").agg(F.max("asks").alias("asks"), F.max("has").alias("has"))
    last = events.groupBy(*by, "block").agg(F.max(F.when(F.col("has") == 1, F.col("turn"))).alias("last"))
    before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*by, "block", F.max("last").over(before).alias("carried"))
    inside = W.partitionBy(*by, "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    here = events.withColumn("here", F.max(F.when(F.col("has") == 1, F.col("turn"))).over(inside)).where("asks = 1")
    return here.join(carried, [*by, "block"]).select(*by, "turn", F.coalesce("here", "carried").alias("found"))


def _origins(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Hashes of what messages can be quoted by: ``conv``, ``hash``, ``turn``.

    That is their text, their paragraphs, and their lines from each that some passage of ``asked`` (``conv``, ``first_line``,
    ``n_lines``, distinct) begins with, as many as the passage has.
    """
    units = rows.join(asked.select("conv").distinct(), "conv", "left_semi").select("conv", F.explode("units").alias("hash"), "turn")
    said = rows.where(F.size("own_lines") > 0).select("conv", "turn", "own_lines").distinct()
    starts = said.select("conv", "turn", F.xxhash64("own_lines").alias("mark"), F.size("own_lines").alias("size"), F.posexplode(F.transform("own_lines", lambda x: F.xxhash64(x))).alias("at", "first_line"))
    places = starts.join(asked, ["conv", "first_line"]).where("at + n_lines <= size").select("conv", "turn", "mark", "at", "n_lines")
    lines = F.array_join(F.slice("own_lines", F.col("at") + 1, F.col("n_lines")), " ")
    found = places.join(said.withColumn("mark", F.xxhash64("own_lines")), ["conv", "turn", "mark"])
    return units.unionAll(found.select("conv", _hash(lines).alias("hash"), "turn")).distinct()


def _places(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Hashes of the word runs of messages that have the first words (``lead``) and number of words of a passage of
    ``asked`` (``conv``, ``lead``, ``n_words``, distinct): ``conv``, ``hash``, ``turn``."""
    per_conv = asked.groupBy("conv").agg(F.collect_set(F.least("n_words", F.lit(LEAD))).alias("leads"))
    said = F.array_join("own_lines", " ")
    said = rows.where(F.size("own_lines") > 0).select("conv", "turn", said.alias("said")).distinct().join(per_conv, "conv")
    said = checkpoint(said.select("conv", "turn", F.xxhash64("said").alias("mark"), F.split("said", " ").alias("words"), "leads"))
    n = F.size("words")
    starts = (
        said.withColumn("n_lead", F.explode(F.filter("leads", lambda k: k <= n)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("n_lead") + 1)))
        .select("conv", "turn", "mark", "at", n.alias("size"), F.xxhash64(F.array_join(F.slice("words", F.col("at"), F.col("n_lead")), " ")).alias("lead"))
    )
    found = starts.join(asked, ["conv", "lead"]).where("at + n_words - 1 <= size").select("conv", "turn", "mark", "at", "n_words").distinct()
    run = F.array_join(F.slice("words", F.col("at"), F.col("n_words")), " ")
    return found.join(said, ["conv", "turn", "mark"]).select("conv", _hash(run).alias("hash"), "turn").distinct()


def linked(rows: DataFrame) -> DataFrame:
    """Passages of ``rows`` (of :func:`parsed`) with their origin: ``conv``, ``turn``, ``level``, ``hash``, ``origin``."""
    passages = rows.select("conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.*").distinct()
    asks = passages.select("conv", "hash", "turn").distinct()
    origins = _origins(rows, checkpoint(passages.select("conv", "first_line", "n_lines").distinct()))
    origins = origins.join(asks.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    found = checkpoint(latest_before(asks, origins, ["conv", "hash"]))
    missing = found.where("found IS NULL").select("conv", "hash", "turn")
    asked = passages.join(missing, ["conv", "hash", "turn"], "left_semi").select("conv", "lead", "n_words").distinct()
    places = _places(rows, checkpoint(asked)).join(missing.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    inside = latest_before(missing, places, ["conv", "hash"]).withColumnRenamed("found", "inside")
    found = found.join(inside, ["conv", "hash", "turn"], "left")
    return passages.groupBy("conv", "turn", "level", "hash").count().drop("count").join(found, ["conv", "hash", "turn"]).select(
        "conv", "turn", "level", "hash", F.coalesce("found", "inside").alias("origin")
    )


def _paths(parents: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``thread_turn`` and ``depth`` from ``conv``, ``turn``, ``reply_to``, by pointer doubling."""
    done = parents.where("reply_to IS NULL").select("conv", "turn", F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("ended"))
    rest = parents.where("reply_to IS NOT NULL").select("conv", "turn", F.col("reply_to").alias("thread_turn"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("ended"))
    paths = checkpoint(done.unionAll(rest))
    while not paths.where("NOT ended").isEmpty():
        up = paths.select("conv", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("up"), F.col("depth").alias("more"), F.col("ended").alias("end"))
        moved = paths.where("NOT ended").join(up, ["conv", "thread_turn"]).select("conv", "turn", F.col("up").alias("thread_turn"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("ended"))
        paths = checkpoint(paths.where("ended").unionAll(moved))
    return paths.drop("ended")


def _places_in_order(parents: DataFrame) -> DataFrame:
    """``conv``, ``turn`` and ``place``, from 0: each turn is followed by its replies in order of turns, each with its own behind it.

    A walk enters each turn, goes through its replies and leaves it: every step's next one is known from a turn and its
    siblings alone. How many turns are entered from a step to the end of the walk is told by pointer doubling.
    """
    among = W.partitionBy("conv", "reply_to").orderBy("turn")
    rows = parents.select("conv", "turn", "reply_to", F.lead("turn").over(among).alias("after"))
    first = parents.where("reply_to IS NOT NULL").groupBy("conv", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("first"))
    rows = checkpoint(rows.join(first, ["conv", "turn"], "left"))
    step = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    enters = F.when(F.col("first").isNotNull(), step(F.col("first"), False)).otherwise(step(F.col("turn"), True))
    leaves = F.when(F.col("after").isNotNull(), step(F.col("after"), False)).when(F.col("reply_to").isNotNull(), step(F.col("reply_to"), True))
    walk = rows.select("conv", step(F.col("turn"), False).alias("step"), enters.alias("next"), F.lit(1).cast("long").alias("n"))
    walk = walk.unionAll(rows.select("conv", step(F.col("turn"), True).alias("step"), leaves.alias("next"), F.lit(0).cast("long").alias("n")))
    walk = checkpoint(walk)
    while not walk.where("next IS NOT NULL").isEmpty():
        ahead = walk.select("conv", F.col("step").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("more"))
        moved = walk.where("next IS NOT NULL").join(ahead, ["conv", "next"]).select("conv", "step", F.col("beyond").alias("next"), (F.col("n") + F.col("more")).alias("n"))
        walk = checkpoint(walk.where("next IS NULL").unionAll(moved))
    total = walk.groupBy("conv").agg(F.max("n").alias("total"))
    return walk.where("NOT step.leaves").join(total, "conv").select("conv", F.col("step.turn").alias("turn"), (F.col("total") - F.col("n")).alias("place"))


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of ``messages``: ``conv``, ``turn``, ``role``, ``text`` without quotations, ``n_quoted`` (passages),
    ``n_linked``, ``reply_to``, ``thread_turn``, ``depth`` and ``place``. A conversation in reply order is its rows by ``place``.

    A message replies to the latest origin among its linked passages of the lowest level; without one, to the
    turn before it in its conversation. ``thread_turn`` is the turn its chain of replies begins with and ``depth`` the
    length of the chain; ``place`` counts the turns of the conversation from 0 so that each is followed by its replies.
    Messages that share a turn are one message to others, reply as one and share a place. Null texts are
    empty, and so is the text of a message that only quotes. A row with a null conversation or turn replies to
    nothing, its thread is its own turn and its place null. Texts of any length are parsed whole. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    rows = checkpoint(parsed(messages, conv, turn, role, text))
    placed = rows.where("conv IS NOT NULL AND turn IS NOT NULL")
    links = checkpoint(linked(placed.select("conv", "turn", "own_lines", "units", "passages")))
    turns = placed.select("conv", "turn").distinct()
    previous = latest_before(turns, turns, ["conv"]).withColumnRenamed("found", "previous")
    per_turn = links.groupBy("conv", "turn").agg(
        F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), "origin")))["origin"].alias("quoted"),
        F.count("origin").alias("n_linked"),
    )
    parents = checkpoint(
        previous.join(per_turn, ["conv", "turn"], "left").select(
            "conv", "turn", F.coalesce("quoted", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
        )
    )
    placing = parents.join(_paths(parents), ["conv", "turn"]).join(_places_in_order(parents), ["conv", "turn"])
    out = rows.select("conv", "turn", "role", "own", F.size("passages").cast("long").alias("n_quoted")).join(placing, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias(text), "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread_turn", F.col("turn")).alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "place",
    )
