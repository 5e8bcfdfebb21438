"""Quotation linking: messages joined to what they quote, as reply-ordered conversations.

Quotations of every level are cut into passages, paragraphs, sentences and lines, and joined by
hash to the earlier messages whose own text has them. Replies are ordered by ranking the list
of a tour through each tree by doubling, so that no message holds more than two ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.indexing import global_index
from ..operators.skew import join_skewed
from ..session import stored

#: Lines before a quotation that name its author; they are neither text nor quotation.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*a écrit|el\b.*escribió)\s*:\s*$"
MARKS = r"^(\s*>)*"
SENTENCE_END = r"(?<=[.!?])\s+"
RESULTS = ("parent", "root", "depth", "position", "text")


def parsed(messages: DataFrame) -> DataFrame:
    """(ord, lines array<struct<pos, level, line>>) of rows (ord, text).

    The level of a line is the number of ``>`` before its text; blanks may stand between
    them. Attribution lines are left out.
    """
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"),
        lambda x, i: F.struct(
            i.alias("pos"),
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"\s", "")).alias("level"),
            F.regexp_replace(x, MARKS + r"\s?", "").alias("line"),
            x.alias("raw"),
        ),
    )
    named = F.filter(lines, lambda s: ~((s["level"] == 0) & s["raw"].rlike(ATTRIBUTION)))
    return messages.select("ord", F.transform(named, lambda s: F.struct(
        s["pos"].alias("pos"), s["level"].alias("level"), F.when(s["level"] == 0, s["raw"]).otherwise(s["line"]).alias("line"))).alias("lines"))


def own_text(lines: Column) -> Column:
    """The lines without quotation marks, without white space around them."""
    own = F.transform(F.filter(lines, lambda s: s["level"] == 0), lambda s: s["line"])
    return F.regexp_replace(F.concat_ws("\n", own), r"^\s+|\s+$", "")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _pieces(text: Column) -> Column:
    """Arrays of pieces of a text: itself, its paragraphs, their sentences and its lines, in order,
    in lower case with white space as single blanks. A sentence may go over several lines, not
    over paragraphs."""
    text = F.lower(text)
    some = lambda parts: F.filter(F.transform(parts, _plain), lambda p: p != "")
    paragraphs = some(F.split(text, r"\n\s*\n"))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE_END)))
    return F.array(some(F.array(text)), paragraphs, sentences, some(F.split(text, r"\n")))


def _own_hashes(text: Column) -> Column:
    return F.transform(F.array_distinct(F.flatten(_pieces(text))), F.md5)


def _quoted(rows: DataFrame) -> DataFrame:
    """(ord, level, passage, kind, i, chars, hash): the pieces of the quotations of every level.

    Lines of a level that follow each other are one passage; another level ends it.
    """
    lines = rows.select("ord", F.filter("lines", lambda s: s["level"] > 0).alias("q"))
    starts = F.transform("q", lambda s, i: F.struct(s["level"].alias("level"), s["line"].alias("line"), (
        (i == 0) | (s["pos"] - F.get("q", i - 1)["pos"] > 1) | (s["level"] != F.get("q", i - 1)["level"])).alias("first")))
    # a mark that no line holds goes before each passage, then its level
    marked = F.transform(starts, lambda s: F.concat(
        F.when(s["first"], F.concat(F.lit("\u0000"), s["level"].cast("string"), F.lit("\u0001"))).otherwise(F.lit("\n")), F.regexp_replace(s["line"], "[\u0000\u0001]", "")))
    passages = F.slice(F.split(F.concat_ws("", marked), "\u0000"), 2, 1 << 30)
    passage = lines.where(F.size("q") > 0).select("ord", F.col("q")).select("ord", F.posexplode(passages).alias("passage", "p"))
    text = F.regexp_replace(F.substring_index("p", "\u0001", -1), r"^\s+|\s+$", "")
    passage = passage.select("ord", "passage", F.substring_index("p", "\u0001", 1).cast("int").alias("level"), F.posexplode(_pieces(text)).alias("kind", "pieces"))
    each = passage.select("ord", "level", "passage", "kind", F.posexplode("pieces").alias("i", "piece"))
    return each.select("ord", "level", "passage", "kind", "i", F.length("piece").alias("chars"), F.md5("piece").alias("hash"))


QUOTE = ("level", "passage", "kind", "i", "chars")


def _latest_before(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quoted pieces with ``parent``, the latest earlier message with that piece.

    Originals and quotes are sorted together and the last original is carried down, inside
    range partitions and from one to the next, so a piece that a third of all messages have
    neither multiplies rows nor meets in one task.
    """
    mixed = originals.select("hash", "ord", F.col("ord").alias("source"), *[F.lit(None).cast("int").alias(c) for c in QUOTE])
    mixed = stored(mixed.unionByName(quotes.select("hash", "ord", F.lit(None).cast("long").alias("source"), *QUOTE)), "hashes")  # read twice to be dealt out
    # a message does not quote itself: its quotes come before its own pieces
    order = ["hash", "ord", F.col("source").isNotNull()]
    placed = stored(mixed.repartitionByRange("hash", "ord").withColumn("part", F.spark_partition_id()), "pieces")
    down = Window.partitionBy("part", "hash").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("near", F.last("source", ignorenulls=True).over(down))
    # the last original of each partition's last piece, for the partitions that go on with it
    tail = placed.where("source is not null").groupBy("part").agg(F.max(F.struct("hash", "source")).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.select("part").distinct().join(tail, "part", "left").coalesce(1)
    carried = parts.select("part", F.max("end").over(before).alias("end"))
    found = seen.where("source is null").join(carried, "part", "left")
    far = F.when(F.col("end.hash") == F.col("hash"), F.col("end.source"))
    return found.select("ord", *QUOTE, F.coalesce("near", far).alias("parent")).where("parent is not null")


def _parents(links: DataFrame) -> DataFrame:
    """(ord, parent) of linked pieces: of the nearest level that has links, the message with the
    most characters in pieces of one kind that follow each other; of equals the latest."""
    run = Window.partitionBy("ord", "level", "passage", "kind", "parent").orderBy("i")
    joined = links.withColumn("run", F.col("i") - F.row_number().over(run))
    sums = joined.groupBy("ord", "level", "passage", "kind", "parent", "run").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "chars", "parent"))
    return sums.groupBy("ord").agg(best.alias("best")).select("ord", F.col("best.parent").alias("parent"))


def ranked(nodes: DataFrame) -> DataFrame:
    """(ord, root, depth, position) of (ord, parent), parents being earlier messages.

    A tour enters each message, goes through its replies in order and leaves it again. Each
    of these steps knows the one before it and what lies between: so many messages entered and
    left. A round replaces the step known by the one that it knows, until all know the tour's
    start. No two steps that still go on know the same one, whatever the shape of the trees.
    """
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    replies = global_index(nodes.where("parent is not null").select("parent", "ord"), ["parent", "ord"], "at")
    before = replies.select((F.col("at") + 1).alias("at"), F.col("ord").alias("left"), F.col("parent").alias("of"))
    sibling = replies.join(before, "at").where("of = parent").select("ord", "left")
    last = replies.groupBy("parent").agg(F.max("ord").alias("last")).select(F.col("parent").alias("ord"), "last")
    rows = nodes.select("ord", "parent").join(sibling, "ord", "left").join(last, "ord", "left")
    known = F.coalesce(leave("left"), enter("parent"))
    entered = rows.select(enter("ord").alias("step"), known.alias("known"), F.col("left").isNull().cast("long").alias("entered"), F.col("left").isNotNull().cast("long").alias("left"))
    inner = F.coalesce(leave("last"), enter("ord"))
    left = rows.select(leave("ord").alias("step"), inner.alias("known"), F.col("last").isNull().cast("long").alias("entered"), F.col("last").isNotNull().cast("long").alias("left"))
    steps = entered.unionByName(left)
    start = F.col("known").isNull()  # entering a root: nothing lies before it
    steps = stored(steps.select(
        "step", F.coalesce("known", "step").alias("known"), F.when(start, 0).otherwise(F.col("entered")).cast("long").alias("entered"),
        F.when(start, 0).otherwise(F.col("left")).cast("long").alias("left"), start.alias("done")), "steps")
    while True:
        going = steps.where("not done")
        if not going.take(1):
            break
        further = steps.select(F.col("step").alias("known"), F.col("known").alias("next"), F.col("entered").alias("e"), F.col("left").alias("l"), F.col("done").alias("d"))
        moved = going.join(further, "known").select(
            "step", F.col("next").alias("known"), (F.col("entered") + F.col("e")).alias("entered"), (F.col("left") + F.col("l")).alias("left"), F.col("d").alias("done")
        )
        steps = stored(steps.where("done").unionByName(moved), "steps")
    return steps.where("step % 2 = 0").select(
        F.expr("step div 2").alias("ord"), F.expr("known div 2").alias("root"), (F.col("entered") - F.col("left")).cast("int").alias("depth"),
        F.col("entered").alias("position"),
    )


def conversations(messages: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """(order..., parent, root, depth, position, text), one row per message.

    ``order`` names the columns that tell messages apart and sort them by time; they are
    also what ``parent`` and ``root`` hold, as structs (null parent: nothing found). A column of
    ``order`` that is named like a result comes back as ``<name>_key``; other columns are not
    looked at. Level by level, quotation marks are stripped; the quoted passages, their
    paragraphs, sentences and lines are hashed, in lower case with blanks for white space, and
    joined to the earlier messages whose own text has them as one of these. Of the lowest
    level with links, pieces that follow each other and come from one message are taken
    together; the longest of these decides, then the latest message. So a message that quotes
    only what its parent had quoted, or whose first level was changed, is linked to the
    ancestor. A conversation is a tree of replies; ``position`` numbers it from 0, each message
    followed by its replies in order. ``text`` is the message without quotations and attribution
    lines. A null text has neither text nor parent. Rows equal in the order columns are one
    message, the one with the least text (nulls last).
    """
    keys = [f"_k{i}" for i in range(len(order))]
    named = messages.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], F.col(text_col).alias("_text"))
    least = F.min(F.struct(F.col("_text").isNull().alias("missing"), F.col("_text").alias("text")))
    unique = named.groupBy(*keys).agg(least.alias("least")).select(*keys, F.col("least.text").alias("text"))
    placed = global_index(unique, keys, "ord")
    rows = stored(parsed(placed).withColumn("own", own_text(F.col("lines"))), "messages")
    originals = rows.select("ord", F.explode(_own_hashes(F.col("own"))).alias("hash"))
    parent = _parents(_latest_before(originals, _quoted(rows)))
    nodes = stored(rows.select("ord", "own").join(parent, "ord", "left"), "nodes")
    tree = ranked(nodes.select("ord", "parent"))
    names = lambda c: placed.select(F.col("ord").alias(c), F.struct(*[F.col(k).alias(n) for k, n in zip(keys, order)]).alias(f"{c}_key"))
    full = stored(nodes.join(tree, "ord"), "tree")
    for c in ("parent", "root"):  # a message may have any number of replies
        full = join_skewed(full, names(c), [c], "left", row_id=["ord"])
    back = [F.col(k).alias(f"{n}_key" if n in RESULTS else n) for k, n in zip(keys, order)]
    return full.join(placed.select("ord", *keys), "ord").select(
        *back, F.col("parent_key").alias("parent"), F.col("root_key").alias("root"), "depth", "position", F.col("own").alias("text")
    )


def as_mail(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, text) as mails that quote the turns before them, in five ways.

    By ``(conv_id + 3 * turn) % 5``: the turn before whole with the one before it nested, its
    first line that is not blank, its last sentence, the turn two before nested and nothing else,
    or that turn at the first level, which makes a branch. Where there is no turn two before,
    the first way takes the place of the last two.
    """
    before = Window.partitionBy("conv_id").orderBy("turn")
    quoted = lambda c, mark: F.regexp_replace(c, r"(?m)^", mark)
    df = turns.select("conv_id", "turn", "text", F.lag("text", 1).over(before).alias("last"), F.lag("text", 2).over(before).alias("earlier"))
    way = F.pmod(F.col("conv_id") + 3 * F.col("turn"), F.lit(5))
    line = F.regexp_extract("last", r"[^\n]*[^\s][^\n]*", 0)
    sentence = F.element_at(F.split(F.regexp_replace("last", r"^\s+|\s+$", ""), SENTENCE_END), -1)
    whole = F.concat_ws("\n", quoted(F.col("last"), "> "), F.when(F.col("earlier").isNotNull(), quoted(F.col("earlier"), "> > ")))
    quotation = (
        F.when(way == 1, quoted(line, "> ")).when(way == 2, quoted(sentence, "> "))
        .when((way == 3) & F.col("earlier").isNotNull(), quoted(F.col("earlier"), "> > "))
        .when((way == 4) & F.col("earlier").isNotNull(), quoted(F.col("earlier"), "> ")).otherwise(whole)
    )
    mail = F.concat_ws("\n\n", "text", F.when(F.col("last").isNotNull(), F.concat_ws("\n", F.lit("On that day, someone wrote:"), quotation)))
    return df.select("conv_id", "turn", mail.alias("text"))
