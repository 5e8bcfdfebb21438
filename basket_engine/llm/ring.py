"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.indexing import global_index
from ..session import stored
from .documents import one_per_id

SHARDS = 24
VIRTUAL_NODES = 64
#: Blocks of ring places that the final lookup joins on.
BLOCKS = 4096


def _nodes(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(at, shard): the place on the ring of every virtual node."""
    each = spark.range(shards * virtual, numPartitions=1)
    shard, copy = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    return each.select(F.xxhash64(F.lit("node"), shard, copy).alias("at"), shard.alias("shard"))


def _arcs(nodes: DataFrame) -> DataFrame:
    """Stretches of ring places (lo, n) that begin their walk at node ``k``; what lies behind
    the last node begins at the first."""
    before = F.lag("place", 1, -1).over(Window.orderBy("place"))
    return nodes.select("k", "shard", (before + 1).alias("lo"), (F.col("place") - before - 1).alias("n"))


def _walk(nodes: DataFrame, tail: tuple[int, int], rows: int, shards: int) -> DataFrame:
    """(lo, n, shard, base): which stretch of the ring goes to which shard.

    All stretches ask the shard of their next node at once. A shard with ``rows / shards``
    places (the first ones have one more where this is no whole number) takes them in ring
    order until it is full; the rest continues clockwise to the next node of a shard with
    room, round after round. The tables are of the size of the ring, not of the data.
    """
    spark = nodes.sparkSession
    capacity = F.lit(rows // shards) + (F.col("shard") < rows % shards).cast("long")
    first = nodes.where("k = 0").select("k", "shard", F.lit(tail[0]).cast("long").alias("lo"), F.lit(tail[1]).cast("long").alias("n"))
    asking = _arcs(nodes).unionByName(first).where("n > 0").coalesce(1)
    room = spark.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("shard")).withColumn("free", capacity)
    in_ring_order = Window.partitionBy("shard").orderBy("k", "lo").rowsBetween(Window.unboundedPreceding, -1)
    taken: list[DataFrame] = []
    while True:
        asked = asking.join(room, "shard").coalesce(1)
        ahead = F.coalesce(F.sum("n").over(in_ring_order), F.lit(0))
        asked = asked.withColumn("take", F.greatest(F.least(F.col("n"), F.col("free") - ahead), F.lit(0)))
        asked = stored(asked, "ring-round")
        taken.append(asked.where("take > 0").select("k", "lo", F.col("take").alias("n"), "shard", F.lit(len(taken)).alias("round")))
        rest = asked.where("n > take").select("k", (F.col("lo") + F.col("take")).alias("lo"), (F.col("n") - F.col("take")).alias("n"))
        if not rest.take(1):
            break
        used = asked.groupBy("shard").agg(F.sum("take").alias("used"))
        room = stored(
            room.join(used, "shard", "left").select("shard", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free")).coalesce(1), "ring-room"
        )
        with_room = nodes.join(room.where("free > 0").select("shard"), "shard", "left_semi").coalesce(1)
        onward = F.min("open").over(Window.orderBy("k").rowsBetween(1, Window.unboundedFollowing))
        least = with_room.agg(F.min("k")).first()[0]
        open_at = nodes.join(with_room.select("k", F.col("k").alias("open")), "k", "left").coalesce(1)
        following = open_at.select("k", F.coalesce(onward, F.lit(least)).alias("next"))
        asking = (
            rest.join(following, "k").select(F.col("next").alias("k"), "lo", "n").join(nodes.select("k", "shard"), "k").coalesce(1)
        )
    every = reduce(DataFrame.unionByName, taken).coalesce(1)
    filled = Window.partitionBy("shard").orderBy("round", "k", "lo").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("lo", "n", "shard", F.coalesce(F.sum("n").over(filled), F.lit(0)).alias("base"))


def placed(
    docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    A document's id is hashed to a place on the ring and walks clockwise to the first
    virtual node whose shard has room, so shards differ by one row at most (law ``rows``).
    Rows that walk past a full shard are the only ones that a change of the others can move.
    ``slot`` numbers the rows of a shard from 0. The size is the UTF-8 bytes of the text
    plus 8; a null text has no bytes and the checksum of the empty text. Equal texts are
    placed one by one. For null and repeated ids see ``one_per_id``.
    """
    spark = docs.sparkSession
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    text = F.coalesce("text", F.lit(""))
    rows = kept.select(
        F.xxhash64("id").alias("at"), F.lit(None).cast("int").alias("shard"), "id",
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    nodes = _nodes(spark, shards, virtual_nodes)
    ring = global_index(rows.unionByName(nodes, allowMissingColumns=True), ["at", F.col("id").isNull(), "id", "shard"], "place")
    n_nodes = shards * virtual_nodes
    nodes = ring.where("shard is not null").select("shard", "place").coalesce(1)
    nodes = stored(nodes.select("shard", "place", (F.row_number().over(Window.orderBy("place")) - 1).alias("k")), "ring-nodes")
    last = nodes.agg(F.max("place")).first()[0]
    total = ring.count()
    stretches = _walk(nodes, (last + 1, total - last - 1), total - n_nodes, shards)

    width = max(1, total // BLOCKS)
    block = lambda c: F.floor(c / width).cast("long")
    end = F.col("lo") + F.col("n")
    stretches = stretches.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(end - 1))))
    stretches = F.broadcast(stored(stretches, "ring-stretches"))  # of the size of the ring and its blocks
    docs_at = ring.where("shard is null").select("id", "size", "text_crc32", "place").withColumn("block", block(F.col("place")))
    inside = (F.col("place") >= F.col("lo")) & (F.col("place") < end)
    return docs_at.join(stretches, "block").where(inside).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("place") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
