"""The registered queries of the document operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, fingerprint, language, neardup, ngram_lm, packing, phrases, pii, quality, quotes, ring, runs, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer(name: str) -> str:
    """Path of a public vocabulary; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS len, list_slice(w, i + 1, i + least(len(w), 13)) AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len FROM item_windows),
doc_windows AS (
  SELECT doc_id, len, i, list_slice(w, i + 1, i + len) AS phrase
  FROM (SELECT doc_id, w, len, unnest(range(len(w) - len + 1)) AS i FROM d, lengths WHERE len(w) >= len)
),
found AS (SELECT doc_id, i, o.len, item_id FROM doc_windows o JOIN item_windows USING (len, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM found) GROUP BY ALL),
held AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_neardup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i + 1, i + least(len(w), 4)) AS phrase
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0) + 1)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keyed AS MATERIALIZED (SELECT doc_id, hash(phrase) AS phrase FROM s),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM keyed x JOIN keyed y ON x.phrase = y.phrase AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)
),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
""")
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_pseudonyms")
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.placed(table(spark, sf_dir, "documents"))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    learned = docs.where(~held_out & F.col("lang").isNotNull())
    ids = language.sample_ids(learned.select(F.col("doc_id").alias("id"), "lang"))
    sample = learned.join(F.broadcast(ids), learned["doc_id"] == ids["id"], "left_semi").select("lang", "text")
    model = language.fit(sample, language.read_pieces(tokenizer("byte_bpe_multi_50k.tiktoken")))
    found = language.identified(docs, model)
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return ngram_lm.language_model_scores(table(spark, sf_dir, "documents"), held_out)


@query("op4_quotes", r"""
WITH RECURSIVE t AS (
  SELECT *, lag(turn) OVER w AS before, lag(text) OVER w AS last, lag(turn, 2) OVER w AS further, lag(text, 2) OVER w AS earlier,
    ((conv_id + 3 * turn) % 5 + 5) % 5 AS way
  FROM (SELECT conv_id, turn, text, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS plain FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pieces AS (
  SELECT conv_id, turn, [lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) for p in
    [text] || string_split(text, chr(10)) || regexp_split_to_array(text, '\n\s*\n')
    || string_split(regexp_replace(array_to_string(regexp_split_to_array(text, '\n\s*\n'), chr(1)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] AS pieces FROM conversations
),
linked AS (
  SELECT t.conv_id, t.turn, t.text, CASE
      WHEN t.way < 3 OR t.further IS NULL THEN CASE WHEN trim(regexp_replace(t.last, '\s+', ' ', 'g')) <> '' THEN t.before END
      WHEN e.plain = '' THEN NULL
      WHEN list_contains(p.pieces, e.plain) THEN t.before ELSE t.further END AS parent
  FROM t LEFT JOIN pieces p ON p.conv_id = t.conv_id AND p.turn = t.before LEFT JOIN t e ON e.conv_id = t.conv_id AND e.turn = t.further
),
tree AS (
  SELECT conv_id, turn, parent, text, [turn] AS path FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, l.parent, l.text, list_append(path, l.turn) FROM linked l JOIN tree ON tree.conv_id = l.conv_id AND tree.turn = l.parent
)
SELECT conv_id, turn, CASE WHEN parent IS NOT NULL THEN conv_id END AS parent_conv, parent AS parent_turn,
  conv_id AS root_conv, path[1] AS root_turn, (len(path) - 1)::INTEGER AS depth,
  row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS position, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text
FROM tree
""")
def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails with nested quotations; the operator sees these alone and has to
    give back the turns, without quotations and in order."""
    mails = quotes.as_mail(table(spark, sf_dir, "conversations"))
    linked = quotes.conversations(mails, ["conv_id", "turn"])
    return linked.select(
        "conv_id", "turn", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth", "position", "text",
    )


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which end in a planted one."""
    docs = runs.with_planted_runs(table(spark, sf_dir, "documents"))
    found = runs.periodic_runs(docs).withColumn("longest", runs.longest("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_warc", """
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, (
    SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1), '' ORDER BY i)
    FROM range(32) AS places(i)
  ) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (
  SELECT page_id, html, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first_id
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
)
""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through whole gzip streams, one member a record, and the offset index."""
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_phrases", r"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, k, list_slice(w, i + 1, i + k) AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM words, range(1, 5) AS sizes(k) WHERE len(w) >= k) GROUP BY ALL
),
candidates AS MATERIALIZED (SELECT * FROM grams WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.p, c.f, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, j) JOIN grams y ON y.lang = c.lang AND y.p = list_slice(c.p, j + 1, c.k)
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, f, list_slice(p, i + 1, i + m) AS part
  FROM (SELECT *, unnest(range(k - m + 1)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
),
covered AS (SELECT DISTINCT c.lang, c.p FROM candidates c JOIN inner_parts o ON o.lang = c.lang AND o.part = c.p WHERE 100 * o.f >= 80 * c.f),
ranked AS (
  SELECT lang, list_aggregate(p, 'string_agg', ' ') AS phrase, f AS a, l, r, score::BIGINT AS score
  FROM lowest ANTI JOIN covered USING (lang, p)
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
FROM ranked JOIN sizes USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY rank <= 2000
""".replace("{lower}", _LOWER))
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language in all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
