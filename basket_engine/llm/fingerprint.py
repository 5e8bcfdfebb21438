"""Document fingerprints by consistent weighted sampling of term frequencies.

For register j, a term of weight w draws r and c from Gamma(2, 1) and b from (0, 1), all
fixed by the term and j, and gets

    t = floor(ln w / r + b),   ln a = ln c - r * (t + 1 - b).

The term with the least a, with its t, is the register. Two documents agree in a register
with a probability of sum(min(w, w')) / sum(max(w, w')), the generalised Jaccard similarity
of their term frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.indexing import global_index
from ..session import stored
from .documents import ascii_lower, one_per_id

REGISTERS = 32
BREAKS = r"[\x20\x09-\x0D]+"
_LOW = 0xFFFFFFFF


def _sample(term: Column, log_weight: Column, j: int) -> Column:
    """Rank and identity of a term's sample in one number: the least number wins.

    A Gamma(2, 1) variable is minus the logarithm of two uniform ones' product.
    """
    bits = F.xxhash64(term, F.lit(j))
    uniform = lambda shift: (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)) + 0.5) / 65536.0
    r, c = -F.log(uniform(0) * uniform(16)), -F.log(uniform(32) * uniform(48))
    b = (F.shiftrightunsigned(F.xxhash64(bits), 32) + 0.5) / float(1 << 32)
    t = F.floor(log_weight / r + b)
    rank = ((F.log(c) - r * (t + 1 - b) + 64) * float(1 << 24)).cast("long")  # ln a lies in (-64, 4)
    return F.shiftleft(rank, 32).bitwiseOR(term.bitwiseXOR(t).bitwiseAND(F.lit(_LOW)))


def registers(texts: DataFrame, keys: list[str], n: int = REGISTERS) -> DataFrame:
    """(keys..., regs array<long>) of rows (keys..., text); an empty text has only -1.

    Terms are words between white space, A-Z as a-z. They are sorted and counted inside the
    row, so no term is ever shuffled.
    """
    words = F.array_remove(F.split(ascii_lower("text"), BREAKS), "")
    rows = texts.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("terms"))
    rows = rows.select(*keys, F.sort_array("terms").alias("terms"))
    last = F.transform("terms", lambda x, i: F.when(F.get(F.col("terms"), i + 1) == x, F.lit(None)).otherwise(i))
    rows = rows.select(*keys, "terms", F.filter(last, lambda i: i.isNotNull()).alias("ends"))
    rows = rows.select(*keys, "terms", "ends", F.posexplode_outer("ends").alias("i", "end"))
    rows = rows.select(
        *keys, F.get("terms", "end").alias("term"),
        F.log((F.col("end") - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(-1))).cast("double")).alias("log_weight"),
    )
    least = [F.min(_sample(F.col("term"), F.col("log_weight"), j)).alias(f"r{j}") for j in range(n)]
    found = rows.groupBy(*keys).agg(*least)
    empty = F.lit(-1).cast("long")
    return found.select(*keys, F.array(*[F.coalesce(F.col(f"r{j}").bitwiseAND(F.lit(_LOW)), empty) for j in range(n)]).alias("regs"))


def likeness(a: str, b: str, n: int = REGISTERS) -> Column:
    """Share of equal registers."""
    return sum((F.when(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), 1.0).otherwise(0.0) for j in range(n)), F.lit(0.0)) / n


def as_text(regs: str, n: int = REGISTERS) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(regs, F.lit(j)).bitwiseAND(F.lit(_LOW)))), 8, "0") for j in range(n)])


def fingerprints(docs: DataFrame, n: int = REGISTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), one row per document; equal texts have equal fingerprints. A null
    text is an empty one. For null and repeated ids see ``one_per_id``."""
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    regs = registers(kept.select("id", F.coalesce("text", F.lit("")).alias("text")), ["id"], n)
    return regs.select(F.col("id").alias(id_col), as_text("regs", n).alias("fingerprint"))


def _neighbours(sized: DataFrame) -> DataFrame:
    """(id, n_chars, before, quarter): the document before each one, in a circle by id, and
    how many characters this one takes over. Ids and sizes only."""
    ring = global_index(sized, ["id"], "place")
    count = ring.count()
    before = ring.select(F.col("id").alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"),
                         F.pmod(F.col("place") + 1, F.lit(max(count, 1))).alias("place"))
    return stored(ring.join(before, "place").select("id", "n_chars", "before", "quarter"), "neighbours")


def edited_likeness(docs: DataFrame, n: int = REGISTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by as many of the
    first ones of the next document by id (all, if that is shorter; after the last comes
    the first). A null text is an empty one; two empty texts have likeness 1, an empty one
    and another have 0. For null and repeated ids see ``one_per_id``.
    """
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kept = kept.select("id", F.coalesce("text", F.lit("")).alias("text"))
    order = _neighbours(kept.select("id", F.char_length("text").alias("n_chars")))
    placed = kept.join(order, "id")
    lent = placed.select(F.col("before").alias("id"), F.expr("substring(text, 1, quarter)").alias("lent"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), "lent")
    both = placed.join(lent, "id").select("id", "n_chars", "text", edited.alias("edited"))
    both = both.select(
        "id", "n_chars", F.sha2("edited", 256).alias("sha"),
        F.explode(F.array(F.struct(F.lit(False).alias("changed"), F.col("text")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))).alias("of"),
    ).select("id", "n_chars", "sha", "of.changed", "of.text")
    regs = stored(registers(both, ["id", "n_chars", "sha", "changed"], n), "registers")
    own = regs.where(~F.col("changed")).select("id", "n_chars", "sha", F.col("regs").alias("own"))
    changed = regs.where("changed").select("id", F.col("regs").alias("changed"))
    following = own.join(order.select("id", "before"), "id").select(F.col("before").alias("id"), F.col("own").alias("following"))
    return own.join(changed, "id").join(following, "id").select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        as_text("own", n).alias("fingerprint"), as_text("changed", n).alias("edited_fingerprint"),
        likeness("own", "changed", n).alias("near_edited"), likeness("own", "following", n).alias("near_next"),
    )
