"""A pipeline over the documents: toxicity, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all but the last
return the columns of ``docs``. ``run`` applies them in order, each written as Parquet in the shared
checkpoint folder and read again. Documents are rows; repeated rows are handled as the operators
state. No SQL expresses the stages' models and tokenizer, so ORACLE_SQL is None and tests/llm holds
the brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm import jaccard, mixing, pii, sentencepiece_viterbi, toxicity
from tabloom.llm.common import saved

ORACLE_SQL = None


def _aside(docs: DataFrame) -> DataFrame:
    """All columns under names of their own, with which no working name clashes, whatever ``docs`` has."""
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict 1."""
    scored = toxicity.add_toxicity(_aside(docs), toxicity.trained(spark, docs, sf_dir), text_col="in_text")
    return _back(scored.where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (of one id, one row); texts without words stay."""
    groups = saved(jaccard.near_groups(docs.select("doc_id", "text"), marks=True))
    linked = groups.where("key is not null")
    first = linked.groupBy("key").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark")
    stay = first.unionByName(groups.where("key is null").select("doc_id", "mark")).distinct()
    again = saved(linked.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"))

    def of(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(keys, rows["in_doc_id"].eqNullSafe(keys["doc_id"]) & (rows["m"] == keys["mark"]), how)

    kept = of(stay, "left_semi", _aside(docs).withColumn("m", F.xxhash64(F.coalesce("in_text", F.lit("")))))
    if not again.isEmpty():  # rows that are repeated whole: one of each
        kept = of(again, "left_anti", kept).unionByName(of(again, "left_semi", kept).dropDuplicates(["in_doc_id", "m"]))
    return _back(kept, docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all spans of personal data replaced by their kind; n_chars follows."""
    found = pii.redact(pii.find_spans(_aside(docs), text_col="in_text"), text_col="in_text")
    return _back(found.withColumn("in_n_chars", F.char_length("in_text").cast("long")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    taken = mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0 and size > 0")
    taken = saved(taken.select("doc_id", "source", "digest", "copy", F.col("copies").cast("int").alias("copies")))
    rows = _aside(docs).withColumn("m", F.md5(F.coalesce("in_text", F.lit(""))))
    same = F.col("in_doc_id").eqNullSafe(F.col("doc_id")) & F.col("in_source").eqNullSafe(F.col("source")) & (F.col("m") == F.col("digest"))
    if not taken.where("copy > 0").isEmpty():  # repeated rows: the k-th of equal rows has the k-th draw
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("in_doc_id", "in_source", "m").orderBy(F.lit(1))) - 1)
        same = same & (F.col("k") == F.col("copy"))
    joined = rows.join(taken, same)
    return _back(joined.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and whether they decode to its text."""
    coded = sentencepiece_viterbi.round_trip(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")))
    return coded.select("doc_id", "source", sentencepiece_viterbi.packed_length(F.col("ids")).alias("n_ids"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("sentencepiece", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
