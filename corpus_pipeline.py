"""Corpus pipeline: STAGES applied to ``documents`` one after another.

Each stage takes all that its predecessor kept, and returns the columns of
documents; the last one returns the encoded texts.  Between stages the rows
are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, pieces, ppm, simhash, surrogates
from tessera.llm.common import read
from tessera.session import scratch_dir

#: A document stays if its language's posterior probability is at least this,
#: and it takes at most so many bits a byte under that language's statistics:
#: ordinary text takes 2 to 3, one full of digits up to 9.4, random letters or
#: a script that was never learned 11.5 and more.
LEAST_SCORE, MOST_BITS = 0.5, 11.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them), those
    of no sure language, and those that no learned language's statistics fit.

    Rows are judged by their text alone, so repeated rows and ids share a
    verdict; of languages that tie the first by name counts.
    """
    model = ppm.train(docs.where(~ppm.held_out()))
    found = docs.withColumn("__lang", ppm.predict(docs, model))
    sure = (F.col("__lang.lang_pred") != ppm.UNDETERMINED) & (F.col("__lang.score") >= LEAST_SCORE) \
        & (F.col("__lang.bits_per_byte") <= MOST_BITS)
    return found.where(sure).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the row whose id is the group's
    smallest; of several such rows the one with the smallest fingerprint, then
    the smallest text.  A row with a null id stays where its group has no id
    at all, one for each fingerprint.  Texts without words are one group."""
    found = simhash.near_duplicates(docs)
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("fingerprint").alias("__print"))
    named = docs.where("doc_id is not null")
    print_of = F.lpad(F.lower(F.hex(simhash.fingerprint(F.col("text")))), 16, "0")
    again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    out = named.join(kept, "doc_id", "left_semi").select(*docs.columns)
    if not again.isEmpty():  # rows of an id are told apart by fingerprint, then by their columns, the text first
        rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
        one = named.join(again, "doc_id", "left_semi").withColumn("__print", print_of) \
            .join(kept, ["doc_id", "__print"], "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("__row"))
        out = out.join(again, "doc_id", "left_anti").unionByName(one.select("doc_id", "__row.*").select(*docs.columns))
    alone = found.where("doc_id is null and component_id is null").limit(1)
    if alone.isEmpty():
        return out
    taken = found.where("component_id is not null").select(F.col("fingerprint").alias("__taken")).distinct()
    nameless = docs.where("doc_id is null").withColumn("__print", print_of) \
        .join(taken, F.col("__print") == F.col("__taken"), "left_anti").dropDuplicates(["__print"])
    return out.unionByName(nameless.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item; null and wordless texts
    overlap none and stay, and every row of a repeated id is judged by its own
    text.  An empty benchmark drops nothing."""
    return docs.where(~decontam.contaminated(docs, read(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text.
    All rows stay; a null text stays null (and n_chars null), equal rows are
    changed alike, since surrogates depend on what they replace only."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = surrogates.replace_pii(docs, carry=rest)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked to decode to it: one row for each
    document, repeated ones too, with no pieces for a null or empty text."""
    return pieces.encode_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii", pii), ("encoding", encoding)]
#: Byte-context models, fingerprints and searches are beyond SQL; the tests
#: hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
