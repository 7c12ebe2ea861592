"""Chat formatting by quotation linking, all in Spark expressions.

The marks ('>' with blanks between them) at the start of a line give its quote level. Lines of level 0
are a message's own words; an attribution line just above a quote ("On ... wrote:") is dropped with it.
Neighbouring lines of one level make a passage; blanks are collapsed and letters put in lower case,
so re-wrapped quotes are alike, and the hashes of its sentences are joined to those of the own words of earlier messages
of the conversation, the latest one winning; sentences of any length count. A message replies to the one that most of its
sentences of the shallowest linked level come from (ties: the latest turn). Following replies up gives each
message its thread root and depth.

The reply order of a conversation is (block of the root turn, block of the turn, root, turn), with
``BLOCK`` turns in a block: threads stay together and a message comes after what it replies to.
``conversations`` puts out one row for each pair of blocks, or more where repeated turns fill it beyond BLOCK messages, so no row gathers
more than BLOCK messages however long the conversation is or however often a turn is repeated.

Hot groups: the latest earlier holder of a sentence is looked up within a block of turns, and over blocks by
one row for each block, so a sentence or conversation with very many turns is dealt over tasks.

Nulls: a null text is empty; a message with a null conv_id or turn links with nothing and is its own root.
Repeated rows of a turn pool their sentences and get the same reply, each keeping its own content. Empty
tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import placed
from . import base

BLOCK = 256
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: Attribution lines of four languages, fixed values.
_ATTRIBUTION = r"(?i)^\s*(?:(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió).*:|-+ ?original message ?-+)\s*$"


def _parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role and lines: (level, body, lead) of each line; lead: an attribution above a quote."""
    raw = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = F.transform(
        raw,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, _MARKS, "").alias("body"),
        ),
    )
    plain = F.transform(raw, lambda x: F.struct(F.lit(0).alias("level"), x.alias("body")))
    step = messages.select("conv_id", "turn", "role", F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(">")), lines).otherwise(plain).alias("lines"))
    lead = lambda x, i: (x["level"] == 0) & x["body"].rlike(_ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)
    return step.withColumn("lines", F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), lead(x, i).alias("lead"))))


def _own(lines: str = "lines") -> Column:
    """The message without quotes and their attributions."""
    kept = F.transform(F.filter(lines, lambda x: (x["level"] == 0) & ~x["lead"]), lambda x: x["body"])
    return F.btrim(F.array_join(kept, "\n"), F.lit(base.BLANKS))


def _sentences(text: Column) -> Column:
    """Hashes of the sentences of a passage in normal form."""
    normal = F.btrim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.transform(F.filter(F.split(normal, r"(?<=[.!?:]) "), lambda s: F.length(s) > 0), lambda s: F.xxhash64(s))


def _passages() -> tuple[Column, Column]:
    """Where the runs of lines of one level start, and (level, text) of each quoted run, to be made of a column starts; a run is cut out of the lines by its ends, so the work is linear in them."""
    n = F.size("lines")
    level = lambda i: F.get("lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), n)
        body = F.transform(F.slice("lines", start + 1, end - start), lambda x: x["body"])
        return F.when(level(start) > 0, F.struct(level(start).alias("level"), F.array_join(body, " ").alias("text")))

    return starts, F.filter(F.transform("starts", run), lambda r: r.isNotNull())


def links(parsed: DataFrame, work: base.Scratch) -> DataFrame:
    """conv_id, turn, parent_turn, n_quoted and n_linked of each message that quotes."""
    keyed = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    starts, runs = _passages()
    quoting = keyed.filter(F.exists("lines", lambda x: x["level"] > 0)).withColumn("starts", starts).select("conv_id", "turn", F.explode_outer(runs).alias("p"))
    quotes = quoting.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode_outer(_sentences(F.col("p.text"))).alias("h")).filter("h IS NOT NULL").distinct()
    quotes = work.keep(quotes, "quotes")
    if quotes.isEmpty():
        return quotes.select("conv_id", "turn", F.col("turn").alias("parent_turn"), F.lit(0).cast("long").alias("n_quoted"), F.lit(0).cast("long").alias("n_linked"))
    own = keyed.select("conv_id", "turn", F.explode_outer(_sentences(_own())).alias("h")).filter("h IS NOT NULL")
    own = own.join(quotes.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct()
    both = quotes.select("conv_id", "h", "turn", "level").unionByName(own.withColumn("level", F.lit(0))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    both = work.keep(both, "both")
    # The latest earlier holder: inside the block, else the last one of the blocks before.
    inside = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("level") == 0, F.col("turn"))
    over = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("conv_id", "h", "block").agg(F.max(held).alias("last")).withColumn("carried", F.max("last").over(over)).drop("last")
    found = (
        both.withColumn("near", F.max(held).over(inside)).filter("level > 0").join(blocks, ["conv_id", "h", "block"])
        .select("conv_id", "turn", "level", F.coalesce("near", "carried").alias("source"))
    )
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("source").isNotNull(), F.struct(F.col("level"), (-F.col("n")).alias("n"), (-F.col("source")).alias("source")))).alias("best"),
        F.sum("n").alias("n_quoted"),
        F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
    )
    return work.keep(best.select("conv_id", "turn", (-F.col("best.source")).alias("parent_turn"), "n_quoted", "n_linked"), "links")


def threads(replies: DataFrame, work: base.Scratch) -> DataFrame:
    """conv_id, turn, thread_root and depth of each message that replies, by pointer doubling."""
    at = work.keep(replies.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("thread_root"), F.lit(1).alias("depth")), "up-0")
    turn = 0
    while not at.isEmpty():
        turn += 1
        up = at.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("higher"), F.col("depth").alias("more"))
        at_next = work.keep(
            at.join(up, ["conv_id", "thread_root"], "left").select("conv_id", "turn", F.coalesce("higher", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")),
            f"up-{turn}",
        )
        at = at_next.drop("moved")
        if at_next.filter("moved").isEmpty():
            break
    return at


def replies(messages: DataFrame) -> DataFrame:
    """Each message without its quotes: content, parent_turn, thread_root, depth, n_quoted, n_linked."""
    work = base.Scratch(messages.sparkSession, "chat")
    parsed = _parsed(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    linked = links(parsed, work)
    rooted = threads(linked, work)
    mine = linked.join(rooted, ["conv_id", "turn"], "left")
    return parsed.select("conv_id", "turn", "role", _own().alias("content")).join(mine, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "content", "parent_turn",
        F.coalesce("thread_root", "turn").alias("thread_root"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, part and messages: (role, content) in reply order, in parts of at most BLOCK messages; parts sort by part. A message without conv_id or turn is a part of its own."""
    work = base.Scratch(messages.sparkSession, "conversations")
    rows = work.keep(replies(messages), "replies")
    part = F.struct(F.floor(F.col("thread_root") / BLOCK).alias("root"), F.floor(F.col("turn") / BLOCK).alias("turn"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    keyed = rows.filter(known).withColumn("part", part)
    # Repeated turns can fill a pair of blocks beyond BLOCK; those are sorted by ranges and cut by their places.
    large = work.keep(keyed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).drop("n"), "large")
    cut = keyed.join(large, ["conv_id", "part"], "left_anti").withColumn("sub", F.lit(0).cast("long"))
    if not large.isEmpty():
        order = ["conv_id", "part", "thread_root", "turn", "role", "content", "tie"]
        sorted_ = placed(keyed.join(large, ["conv_id", "part"], "left_semi").withColumn("tie", F.uuid()), *order).drop("tie")
        first = sorted_.groupBy("conv_id", "part").agg(F.min("place").alias("first"))
        cut = cut.unionByName(sorted_.join(first, ["conv_id", "part"]).withColumn("sub", F.floor((F.col("place") - F.col("first")) / BLOCK)).drop("place", "first"))
    each = F.struct("thread_root", "turn", "role", "content")
    said = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    whole = lambda root, turn, sub: F.struct(root.alias("root"), turn.alias("turn"), sub.alias("sub")).alias("part")
    none = F.lit(None).cast("long")
    gathered = cut.groupBy("conv_id", "part", "sub").agg(F.sort_array(F.collect_list(each)).alias("all"))
    return gathered.select("conv_id", whole(F.col("part.root"), F.col("part.turn"), F.col("sub")), F.transform("all", said).alias("messages")).unionByName(
        rows.filter(~known).select("conv_id", whole(none, none, none), F.array(F.struct("role", "content")).alias("messages"))
    )
