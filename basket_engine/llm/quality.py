"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney bigram model of all trusted documents but
those that set the thresholds. Its pairs are counted in shards and lie in files as sorted
arrays, which the tasks that score texts map (see ``ngram_lm``). So neither the documents nor
the model are moved for a score, and nothing of the model passes through the driver.

A few words vanish in the mean of a long text, so passages are judged too: by their own loss,
by the words that repeat the one before, and by the log-ratio of the trusted model mixed with
a Kneser-Ney model of toxic documents, whose lower order is the trusted one, to the former.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stored
from ..sources.files import qualified
from .documents import one_per_id
from .kneser_ney import discounts  # noqa: F401
from .ngram_lm import MANY, SLICE, MappedTable, Numbers, PairCounts, PairKeys, count_pairs, interpolated, pair_keys, written_table
from .wordhash import slices

BREAKS = r"[\x20\x09-\x0D]+"
#: Marks before and after a text. Words hold no white space, so these are no words.
START, END = " start", " end"
#: One in so many trusted documents, by hashed id, only sets thresholds and is never fitted on.
CALIBRATION = 4
#: A document is rejected above this quantile of its language's trusted documents.
QUANTILE = 0.998
#: A language's own quantile and deviation weigh as much as those drawn from all languages'
#: spread around their own means when it has so many documents to calibrate.
SHRINK = 50
#: Rows of the table of words that one file holds, about.
SHARD_ROWS = 2_000_000
#: What documents are judged by; more is worse.
MEASURES = ("loss", "worst", "runs", "toxic")
#: A text is cut into as many equal passages as fit of so many words, at least one.
PASSAGE = 16
#: Share of a toxic passage's words that are drawn from the toxic model, the others from the trusted.
MIX = 0.05
#: Repeats are counts, so a quantile of them tells no more than one word in a passage.
SLACK = {"runs": 1 / PASSAGE}


WORD_COLUMNS = ["<f8", "<f8", "<f8", "<f8"]  # log10 of the lower order, log10 ratio, how often before others, weight of the lower order


@dataclass
class Model:
    """The counted pairs of the trusted texts, the table of their words (key, low, ratio, seen,
    gamma), and the constants of an unknown word."""

    folder: str
    keys: PairKeys
    files: dict[str, list[tuple[int, int, str]]]
    discount: tuple[float, float, float]
    words: DataFrame
    unknown: float
    ratio: float


def fit(docs: DataFrame) -> Model | None:
    """The model of the texts; none without any."""
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "quality-model"))
    keys = pair_keys(docs, fold=False)
    counted = count_pairs(docs, folder, keys, fold=False)
    if not counted.pairs:
        return None
    # lower order: in how many contexts a word was seen
    unknown = counted.held / counted.pairs / (counted.types + 1)
    low = F.greatest(F.col("follows") - counted.cut, F.lit(0.0)) / counted.pairs + unknown
    words = counted.words.select(
        F.col("g").alias("key"), F.log10(low).alias("low"), F.lit(0.0).alias("ratio"),
        F.col("a").cast("double").alias("seen"), counted.gamma.alias("gamma"),
    )
    return Model(folder, keys, counted.files, counted.discount, words, math.log10(unknown), 0.0)


def against(model: Model, docs: DataFrame) -> Model:
    """The model with the ratio of a second one, of the texts ``docs``: Kneser-Ney unigrams (a
    word's contexts, discounted) over the words of the first. So a word that the second has
    not seen has the same constant ratio, however rare it is. Mixed with the first by MIX, so
    that other words in a passage do not outweigh the few that are the second's."""
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "quality-other"))
    counted = count_pairs(docs, folder, pair_keys(docs, fold=False), fold=False)
    if not counted.pairs:
        return model
    unseen = 1 - MIX + MIX * counted.held / counted.pairs
    others = counted.words.where("follows > 0").select(
        F.col("g").alias("key"), (F.greatest(F.col("follows") - counted.cut, F.lit(0.0)) / counted.pairs).alias("q")
    )
    both = model.words.drop("ratio").join(others, "key", "full").withColumn("low", F.coalesce("low", F.lit(model.unknown)))
    words = both.select(
        "key", "low", F.log10(1 + MIX * F.coalesce("q", F.lit(0.0)) / F.pow(F.lit(10.0), "low") / unseen).alias("ratio"),
        F.coalesce("seen", F.lit(0.0)).alias("seen"), F.coalesce("gamma", F.lit(0.0)).alias("gamma"),
    )
    return replace(model, words=stored(words, "word-table"), ratio=math.log10(unseen))


def log_probability(docs: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, log10_prob) of (id, text) with unique ids; n_tokens counts the end."""
    return _summed(passages(docs, model)).select("id", "n_tokens", "log10_prob")


def _passages(folder: str, words: list[tuple[int, int, str]], pairs: dict, keys: PairKeys, discount: tuple, unknown: float, unlike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table, counts = Numbers(fold=False), MappedTable(folder, words, WORD_COLUMNS), PairCounts(folder, pairs, MANY)
        for whole in batches:
            for batch in slices(whole, 1, most_bytes=SLICE):
                v, w, doc = numbers.read(batch.column(1))
                token, which = np.unique(w, return_inverse=True)
                known, (low, ratio, _, _) = table.find(token)
                low = 10.0 ** np.where(known, low, unknown)
                first, of = np.unique(v, return_inverse=True)
                _, (_, _, seen, gamma) = table.find(first)
                p = interpolated(counts.find(keys.key(v, w)), discount, seen[of], gamma[of], low[which])
                n = np.bincount(doc, minlength=batch.num_rows)
                many = np.maximum(n // PASSAGE, 1)
                before = np.cumsum(many) - many
                passage = (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * many[doc] // n[doc]
                at, size = before[doc] + passage, int(many.sum())
                row = np.repeat(np.arange(batch.num_rows), many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(np.arange(size) - before[row]), pa.array(np.bincount(at, minlength=size)),
                     pa.array(np.bincount(at, np.log10(p), size)), pa.array(np.bincount(at, v == w, size).astype(np.int64)),
                     pa.array(np.bincount(at, ratio[which] + unlike, size))],
                    ["id", "passage", "n", "log10_prob", "repeats", "ratio"],
                )

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(id, passage, n, log10_prob, repeats, ratio) of (id, text) with unique ids.

    Documents stay where they are, and tasks look their words and pairs up in the model's files.
    """
    spark = docs.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(model.words.count() / SHARD_ROWS))
    table = model.words.select("key", "low", "ratio", "seen", "gamma")
    words = written_table(table, model.folder, scratch_path(spark, "words").rsplit("/", 1)[1], WORD_COLUMNS, files)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, passage long, n long, log10_prob double, repeats long, ratio double"
    run = _passages(model.folder, words, model.files, model.keys, model.discount, model.unknown, model.ratio)
    return docs.select("id", "text").mapInArrow(run, schema)


def _summed(parts: DataFrame) -> DataFrame:
    """(id, n_tokens, log10_prob, worst, runs, toxic) of passages: the most of loss,
    of repeats and of the ratio."""
    loss = -F.col("log10_prob") / F.col("n")
    return parts.groupBy("id").agg(
        F.sum("n").alias("n_tokens"), F.sum("log10_prob").alias("log10_prob"), F.max(loss).alias("worst"),
        F.max(F.col("repeats") / F.greatest("n", F.lit(PASSAGE))).alias("runs"), F.max("ratio").alias("toxic"),
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids with a label of good quality and none of poor quality or toxicity."""
    good = F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(good.alias("good")).where("good").select("id")


def toxic_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids with a label of toxicity."""
    return labels.where(F.col(id_col).isNotNull() & (F.col("toxic") == 1)).select(F.col(id_col).alias("id")).distinct()


def _least(ids: DataFrame, n: int | None) -> DataFrame:
    """The n ids of the least hashes, all without n."""
    return ids if n is None else ids.orderBy(F.xxhash64("id"), "id").limit(n)


def judge(
    docs: DataFrame, labels: DataFrame, trusted: int | None = None, quantile: float = QUANTILE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(id, lang, n_tokens, log10_prob, perplexity, threshold, kept), one row per document.

    The model is fitted on all trusted documents but a quarter, by hashed id, which is kept back
    (with ``trusted``, on so many at most). A language's threshold is the quantile of the
    perplexity of those trusted documents of it that the model has not seen. Where they are few, see ``_with_thresholds``;
    where there are none, the threshold is null and texts with words are kept. A null language
    counts as ``und``. So are the highest values over a document's passages: the
    loss, the share of words that repeat the one before, and the log-ratio of a model of all labelled
    toxic documents (with ``trusted``, so many at most). A text without words is rejected. Without any trusted document there is
    no model and perplexity is null too. For null and repeated ids see ``one_per_id``.
    """
    kept = one_per_id(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", ("text", "lang")
    ).withColumn("lang", F.coalesce("lang", F.lit("und")))
    good = trusted_ids(labels, id_col).join(kept.select("id"), "id", "left_semi")
    good = stored(good, "trusted")
    unseen = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    sample = stored(_least(good.where(~unseen), trusted), "sample")
    bad = stored(_least(toxic_ids(labels, id_col).join(kept.select("id"), "id", "left_semi"), trusted), "toxic")
    marks = sample.select("id", F.lit(True).alias("fitted")).join(bad.select("id", F.lit(True).alias("toxic")), "id", "full")
    labelled = stored(kept.select("id", "text").join(marks, "id").select("text", "fitted", "toxic"), "labelled")
    model = fit(labelled.where("fitted").select("text"))
    if model:
        model = against(model, labelled.where("toxic").select("text"))
        scored = _summed(passages(kept.select("id", "text"), model))
    else:
        words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAKS), ""))
        scored = kept.select("id", (words + 1).cast("long").alias("n_tokens"), *[F.lit(None).cast("double").alias(c) for c in ("log10_prob", *MEASURES[1:])])
    scored = scored.join(kept.select("id", "lang"), "id")
    scored = stored(scored.withColumn("loss", -F.col("log10_prob") / F.col("n_tokens")), "scored")
    fine = [F.coalesce(F.col(m) <= F.col(f"t_{m}") + SLACK.get(m, 0.0), F.lit(True)) for m in MEASURES]
    power = lambda c: F.pow(F.lit(10.0), F.col(c))
    return _with_thresholds(scored, good, sample, quantile).select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_tokens", "log10_prob",
        power("loss").alias("perplexity"), power("t_loss").alias("threshold"),
        reduce(lambda a, b: a & b, fine, F.col("n_tokens") > 1).alias("kept"),
    )


def _with_thresholds(scored: DataFrame, good: DataFrame, sample: DataFrame, quantile: float) -> DataFrame:
    """With ``t_<measure>`` for each of MEASURES, from trusted documents outside the sample.

    The level is always the language's own mean. With n documents its own quantile has the
    weight n / (n + SHRINK); the rest is the mean plus deviations, whose size and number are
    shrunk to those within all languages, and grow by 1 / sqrt(n) for what n cannot tell.
    Null for a language without such documents, or if nothing tells a deviation.
    """
    measured = scored.where("n_tokens > 1").join(good, "id", "left_semi").join(sample, "id", "left_anti").select("id", "lang", *MEASURES)
    measured = stored(measured, "calibration")
    of = measured.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[
        each for m in MEASURES for each in
        (F.avg(m).alias(f"mean_{m}"), F.var_pop(m).alias(f"var_{m}"), F.percentile_approx(m, quantile, 10_000).alias(f"own_{m}"))
    ])
    of = stored(of, "languages")
    pooled = of.agg(*[(F.sum(F.col("n") * F.col(f"var_{m}")) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))).alias(m) for m in MEASURES]).first()
    shrunk = {m: F.sqrt((F.col("n") * F.col(f"var_{m}") + SHRINK * F.lit(pooled[m]).cast("double")) / (F.col("n") - 1 + SHRINK)) for m in MEASURES}
    of = of.select("*", *[shrunk[m].alias(f"sd_{m}") for m in MEASURES])
    steps = [F.percentile_approx((F.col(m) - F.col(f"mean_{m}")) / F.nullif(F.col(f"sd_{m}"), F.lit(0.0)), quantile, 10_000).alias(m) for m in MEASURES]
    far = measured.join(F.broadcast(of), "lang").agg(*steps).first()
    least = NormalDist().inv_cdf(quantile) if 0 < quantile < 1 else 0.0
    weight, rest = F.col("n") / (F.col("n") + SHRINK), SHRINK / (F.col("n") + SHRINK)
    spread = {m: max(far[m] or 0.0, least) * F.col(f"sd_{m}") * (1 + 1 / F.sqrt("n")) for m in MEASURES}
    limits = of.select("lang", *[
        (weight * F.col(f"own_{m}") + rest * (F.col(f"mean_{m}") + spread[m])).alias(f"t_{m}") for m in MEASURES
    ])
    return scored.join(F.broadcast(limits), "lang", "left")
