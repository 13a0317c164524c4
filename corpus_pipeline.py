"""From documents to packed training sequences: toxic documents go, one of each group of near copies stays,
benchmark passages and personal data go from the texts, and what is left is packed.

Every stage takes and gives all columns of documents, whatever they are called; where a stage changes a text,
n_chars follows it. The last stage gives one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrace.llm import decontaminate, minhash, packing, pii, toxicity
from figtrace.llm.queries import END, LIMIT, vocabulary
from figtrace.llm.texts import fold, read, release, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and all else in one column that no operator's new columns can clash with."""
    return docs.select(F.struct("doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_else"), "text")


def _back(changed: DataFrame, docs: DataFrame, *, length: bool = False) -> DataFrame:
    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars" and length:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("_else").getField(c).alias(c)

    return changed.select(*[column(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; rows are scored one by one, null and empty texts too, repeated ones alike."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return _back(toxicity.score(_whole(docs), model).where("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in their five-word shingles one row, with the least id or, without ids, any.

    Of repeated rows one stays. Texts without words are alike with nothing and all stay, as do null ones. Texts stay
    where they are while groups are found; a document is known again by its id and text.
    """
    key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]
    found = minhash.groups(docs.select(*key, "text"), doc_id="_id", keep=["_id", "_hash"])
    # Equal ids and texts are one key; where it has words and a row of it is chosen, one row stays.
    some = found.groupBy("_id", "_hash").agg(
        F.max("n_shingles").alias("_n"), F.count_if("chosen").alias("_chosen"), F.count(F.lit(1)).alias("_rows")
    )
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *key)
    gone = some.where("_n > 0 AND _chosen = 0").select("_id", "_hash")
    same = marked["_id"].eqNullSafe(gone["_id"]) & (marked["_hash"] == gone["_hash"])
    held = marked.join(gone, same, "left_anti")
    # Keys of several rows: the rows are few, as they are repeated ones.
    again = some.where("_n > 0 AND _chosen > 0 AND _rows > 1").select("_id", "_hash")
    same = held["_id"].eqNullSafe(again["_id"]) & (held["_hash"] == again["_hash"])
    repeated = held.join(again, same, "left_semi").dropDuplicates(["_id", "_hash"])
    return held.join(again, same, "left_anti").unionByName(repeated).select("_row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ten words or more, or of whole shorter items, that stand in the benchmark.

    Every row stays, null and empty texts as they are, repeated rows alike.
    """
    return _back(decontaminate.remove(_whole(docs), read(spark, sf_dir, "benchmark")), docs, length=True)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and words that disclose it, generalised or removed.

    Every row stays, null and empty texts as they are, repeated rows alike.
    """
    return _back(pii.clean(_whole(docs)), docs, length=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their sequence and place in it.

    A null or empty text is one piece of the end token; repeated rows are packed one by one.
    """
    pieces = packing.token_pieces(docs, vocabulary(), size=LIMIT, end=END)
    return packing.best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), size=LIMIT, order=["doc_id", "piece"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

# Scores, signatures and tokens have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        release(before)  # a stage stands on its own once it is written
    return STAGES[-1][1](spark, docs, sf_dir)
