"""Benchmark decontamination: a prefix-filtered set join of documents and item windows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .documents import ascii_lower, one_per_id

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4
#: Shingles that one pass over the documents broadcasts; more take more passes.
PASS_SHINGLES = 1_000_000


def words(text: str | Column) -> Column:
    """Words of letters a-z, digits and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAKS), "")


def _joined(first: str | Column, count: str | Column, of: str = "words") -> Column:
    return F.concat_ws(" ", F.slice(of, first, count))


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Different windows (wid, words, len), and the items (wid, item) that hold each."""
    n = F.size("words")
    each = (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(text_col).alias("words"))
        .where(n > 0)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))))
        .select("item", F.slice("words", F.col("i") + 1, F.least(n, F.lit(window))).alias("words"))
        .distinct()
    )
    windows = stored(
        each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("len")),
        "windows",
    )
    return windows, each.join(windows, "words").select("wid", "item")


def _shingles(windows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Different shingles (sid, n, phrase), and the windows' (wid, j, sid)."""
    n = F.least("len", F.lit(size))
    each = (
        windows.withColumn("n", n)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("len") - n)))
        .select("wid", "j", "n", _joined(F.col("j") + 1, F.col("n")).alias("phrase"), _key(F.col("j"), size, F.col("n")).alias("key"))
    )
    phrases = stored(
        each.select("n", "phrase", "key").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles"
    )
    return phrases, each.join(phrases.select("phrase", "n", "sid"), ["phrase", "n"]).select("wid", "j", "sid")


def _key(first: Column, most: int, count: Column | int) -> Column:
    """Hash of ``count`` words from position ``first`` on; null ones leave it as it is."""
    picked = [F.get("words", first + i) for i in range(most)]
    if not isinstance(count, int):
        picked = [F.when(count > i, w) for i, w in enumerate(picked)]
    return F.xxhash64(*picked)


def _matches(docs: DataFrame, phrases: DataFrame, sizes: list[int], passes: int) -> DataFrame:
    """(doc_id, n_words, pos, n, sid) of every benchmark shingle in a document.

    One scan of the texts: word positions stream through a broadcast join, and only
    matches, compared word by word, leave it. The position after the last word always
    matches (sid -1), which carries the word count of every document.
    """
    end = docs.sparkSession.createDataFrame([(0, "", 0, -1)], "n int, phrase string, key long, sid long")
    split = docs.select(F.col("doc_id"), words("text").alias("words")).withColumn("n_words", F.size("words"))
    at = split.select("doc_id", "words", "n_words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    at = at.withColumn("fits", F.col("pos") < F.col("n_words"))
    keys = [F.when(F.col("pos") + n <= F.col("n_words"), _key(F.col("pos"), n, n)) for n in sizes]
    if len(keys) == 1:
        at = at.withColumn("at_n", F.lit(sizes[0])).withColumn("at_key", F.when(F.col("fits"), keys[0]).otherwise(F.lit(0)))
    else:
        pairs = [F.struct(F.lit(n).alias("n"), F.when(F.col("fits"), k).otherwise(F.lit(0)).alias("k")) for n, k in zip(sizes, keys)]
        own = F.when(F.col("fits"), F.array(*pairs)).otherwise(F.array(pairs[0]))
        at = at.withColumn("of", F.explode(own)).withColumn("at_n", F.col("of.n")).withColumn("at_key", F.col("of.k"))
    found = []
    for i in range(passes):
        block = phrases.where(F.pmod("key", F.lit(passes)) == i).select("n", "phrase", "key", "sid")
        block = F.broadcast(block.unionByName(end) if i == 0 else block)
        same = F.when(F.col("sid") < 0, ~F.col("fits")).otherwise(
            F.col("fits") & (F.col("at_n") == F.col("n")) & (_joined(F.col("pos") + 1, F.col("n")) == F.col("phrase"))
        )
        found.append(at.join(block, (F.col("at_key") == F.col("key")) & same).select("doc_id", "n_words", "pos", "n", "sid"))
    return reduce(DataFrame.unionByName, found)


def occurrences(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    item_col: str = "item_id", item_text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every occurrence of an item window in a document.

    ``docs`` has (doc_id, text) with unique ids. Gives the word counts (doc_id, n_words),
    the occurrences (doc_id, wid, start, len) and the items of each window (wid, item).

    Windows are sets of shingles that must be contained whole, so one shingle is the
    necessary prefix of a window: the one that is rarest in all documents. Only its
    matches become candidates; a candidate has to start and end inside the document
    (positional and length bounds), and then all of the window's shingles must follow each
    other from its start. Shingles were compared as text, so this is exact.
    """
    windows, items = item_windows(benchmark, window, item_col, item_text)
    phrases, of_window = _shingles(windows, shingle)
    counted = phrases.groupBy("n").count().collect()  # one row per shingle length, `shingle` at most
    sizes = sorted(r["n"] for r in counted) or [shingle]
    passes = max(1, math.ceil(sum(r["count"] for r in counted) / PASS_SHINGLES))
    matches = stored(_matches(docs, phrases, sizes, passes), "matches")
    lengths = matches.where("sid < 0").select("doc_id", "n_words")
    matches = matches.where("sid >= 0")

    rarity = matches.groupBy("sid").agg(F.count(F.lit(1)).alias("freq"))
    ranked = of_window.join(rarity, "sid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = (
        ranked.groupBy("wid")
        .agg(F.min(F.struct("freq", "sid", "j")).alias("least"), F.array_sort(F.collect_list(F.struct("j", "sid"))).alias("chain"))
        .where("least.freq > 0")
        .join(windows.select("wid", "len"), "wid")
        .select("wid", "len", F.col("least.sid").alias("sid"), F.col("least.j").alias("j"), F.col("chain.sid").alias("chain"))
    )
    start = F.col("pos") - F.col("j")
    candidates = (
        matches.join(prefix, "sid")
        .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .select("doc_id", start.alias("start"), "wid", "len", F.least("len", F.lit(shingle)).alias("n"), "chain")
    )
    ahead = Window.partitionBy("doc_id", "n").orderBy("pos").rowsBetween(0, max(window - shingle, 0))
    runs = matches.select(
        "doc_id", "n", F.col("pos").alias("start"), F.collect_list(F.struct("pos", "sid")).over(ahead).alias("run")
    )
    m = F.size("chain")
    contained = (F.slice(F.col("run.sid"), 1, m) == F.col("chain")) & (F.get(F.col("run.pos"), m - 1) == F.col("start") + m - 1)
    found = candidates.join(runs, ["doc_id", "n", "start"]).where(contained).select("doc_id", "wid", "start", "len")
    return lengths, stored(found, "occurrences"), items


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A
    document word inside any occurrence of a window is hit, and a document is contaminated
    when one word in ``share`` or more is hit. A null or empty text has no words and is
    clean; so are all documents beside an empty benchmark. Items without an id count under
    the empty id; repeated items and windows that items share count for each item once.
    For null and repeated document ids see ``one_per_id``.
    """
    kept = one_per_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    lengths, found, items = occurrences(kept, benchmark, window, shingle, item_col, item_text)
    before = F.coalesce(
        F.max(F.col("start") + F.col("len")).over(
            Window.partitionBy("doc_id").orderBy("start", "len", "wid").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    new = F.greatest(F.col("start") + F.col("len") - F.greatest("start", "before"), F.lit(0))
    hits = found.withColumn("before", before).groupBy("doc_id").agg(F.sum(new).alias("n_hit"))
    held = found.select("doc_id", "wid").distinct().join(items, "wid").groupBy("doc_id").agg(F.collect_set("item").alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        lengths.join(hits, "doc_id", "left").join(held, "doc_id", "left")
        .select(
            F.col("doc_id").alias(id_col),
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.array_sort(ids)), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )
