"""A corpus pipeline: five of the corpus operators in turn, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursuit.llm import decontaminate, langid, mixing, secrets, simhash
from pursuit.llm.common import cut, table, without_texts


def _held(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns inside one (``row``), so that no operator's column clashes with them."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects go."""
    return langid.identify(_held(docs), langid.fit(docs), "row.text").where(~F.col("language.rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id, stays.

    Candidates are the texts whose SimHash fingerprints of five-word shingles differ by at most
    ``simhash.SEARCHED`` bits, found by partitions and probes as in op3, and then those further apart
    that share a MinHash band, which that search can't reach. Candidates whose shingle sets have a Jaccard
    similarity of 0.8 are linked. Ids may repeat: rows go by id and text. Null ids come last in their group; of rows
    with equal id and text one stays. Null and blank texts are one group.
    """
    found = cut(simhash.simhash_groups(docs, words=5, max_bits=None, min_similarity=0.8).select("doc_id", "same", "first"), "groups")
    kept = without_texts(docs, found.where(~F.col("first")).select("doc_id", "same"), "doc_id", "text")
    again = cut(found.where("first").groupBy("doc_id", "same").count().where("count > 1").select("doc_id", "same"), "again")
    if again.isEmpty():
        return kept
    hot = _held(kept).withColumn("same", F.xxhash64("row.text")).join(again.withColumnRenamed("same", "hot_text"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("same") == F.col("hot_text")), "left_semi")
    one = hot.groupBy(F.col("row.doc_id").alias("id"), "same").agg(F.first("row").alias("row"))
    return without_texts(kept, again, "doc_id", "text").unionByName(one.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), any_case=True)
    return decontaminate.without_leaks(docs, cut(found.select("doc_id", "same"), "leaks")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, and n_chars follows."""
    out = secrets.scan(_held(docs), "row.text").withColumn("clean", secrets.redact(F.col("row.text"), F.col("secret_spans")))
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("secret_spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources meet their targets."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("secret scans", without_secrets), ("mixing sources to target weights", mixed)]

#: Language ID, fingerprint groups and the randomness battery can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
