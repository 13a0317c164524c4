"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrace.llm import align, chat_format, decontaminate, lexical, minhash, packing, pii, ppm, quality, sharding, token_count, toxicity, vector_dedup
from figtrace.llm.texts import fold, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LIMIT = 1024
END = 2
SHARDS = 24


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    pairs = chat_format.preferences(chat_format.echo_pairs(read(spark, sf, "conversations")))
    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_common", "prompt",
        *[chat_format.text_of(F.col(s)).alias(s) for s in ("chosen", "rejected")],
        *[chat_format.trained_length(F.col(s)).alias(f"{s}_trained") for s in ("chosen", "rejected")],
    )


ORACLES["op1_chat_format"] = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
said AS (SELECT c.*, l.last FROM conversations c JOIN last l USING (conv_id)),
sides AS (
  SELECT conv_id, 'a' AS side, turn, role, text FROM said WHERE turn <= last
  UNION ALL SELECT conv_id, 'b', turn, role, text FROM said WHERE turn < last
  UNION ALL SELECT conv_id, 'b', last, 'assistant', text FROM said WHERE turn = last - 1),
placed AS (
  SELECT conv_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS i FROM sides),
met AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS i,
    coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'a') a FULL JOIN (SELECT * FROM placed WHERE side = 'b') b
    ON a.conv_id = b.conv_id AND a.i = b.i),
cut AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n FROM met GROUP BY conv_id),
r AS (
  SELECT p.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole,
    CASE WHEN role = 'assistant' THEN length(text) + 8 ELSE 0 END AS trained
  FROM placed p JOIN cut USING (conv_id))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_common,
  coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 'a' AND i <= n), '') AS prompt,
  coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 'a' AND i > n), '') AS chosen,
  coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 'b' AND i > n), '') AS rejected,
  CAST(coalesce(sum(trained) FILTER (side = 'a' AND i > n), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(trained) FILTER (side = 'b' AND i > n), 0) AS BIGINT) AS rejected_trained
FROM r GROUP BY conv_id
"""


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.linked(read(spark, sf, "embeddings"), threshold=0.95, keep=["vec_id"])


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    scored = quality.score(
        docs, labels.where(fold(F.col("doc_id"), 5) != 0),
        host=F.col("source"), path=F.concat_ws("/", "source", "lang"), keep=["doc_id"],
    )
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


@query
def op5_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.groups(read(spark, sf, "documents"), size=2, percent=80, keep=["doc_id"])


@query
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    marked = decontaminate.mark(read(spark, sf, "documents"), read(spark, sf, "benchmark"), window=10, keep=["doc_id"])
    n_hit = decontaminate.covered(F.col("spans"))
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(read(spark, sf, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    return found.select(
        "doc_id", *[pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf, "documents"), vocabulary(), size=LIMIT, end=END)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit(digests, size=LIMIT, order=["doc_id", "piece"])


@query
def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = ppm.score(read(spark, sf, "documents"), ~held_out, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_count.count_tokens(read(spark, sf, "documents"), vocabulary(), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


@query
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.align(read(spark, sf, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"), keep=["doc_id"], digest=True)


@query
def op12_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """By the law ``rows``: a uniform shuffle deals out rows one by one, so equal texts are not kept together."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, sf, "documents").select(
        "doc_id", (F.octet_length(content).cast("long") + 8).alias("size"), F.crc32(content).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return sharding.shuffled(docs, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"), k=10)


ORACLES["op13_lexical_search"] = r"""
WITH cut AS (
  SELECT 'd' AS side, row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), CAST(item_id AS VARCHAR), text FROM benchmark),
said AS (
  SELECT side, r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM cut),
counted AS (SELECT side, r, id, term, count(*) AS times FROM said GROUP BY ALL),
docs AS (SELECT r, sum(times)::BIGINT AS n FROM counted WHERE side = 'd' GROUP BY r),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM docs),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, whole WHERE side = 'd' GROUP BY term),
scored AS (
  SELECT i.r AS item, CAST(i.id AS BIGINT) AS item_id, d.r AS doc, CAST(d.id AS BIGINT) AS doc_id,
    CAST(sum(i.times * w * ((1000000000 * d.times) // (1000 * d.times + 8 * (25 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM counted i JOIN counted d ON i.term = d.term AND i.side = 'i' AND d.side = 'd' JOIN weights ON weights.term = d.term
    JOIN docs ON docs.r = d.r, whole
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
