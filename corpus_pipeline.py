"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's input.  All but the last
return the columns they are given, whatever other columns there are.  Empty
tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import broadcast_if_small, discard, materialize, materialize_only, table
from flowloom.llm.decontaminate import find_leaks
from flowloom.llm.linededup import drop_repeated_lines
from flowloom.llm.minhash import near_duplicates
from flowloom.llm.mixing import mix
from flowloom.llm.toxicity import score_toxicity

#: ids of copies are broadcast up to this many, else joined
MAX_BROADCAST_IDS = 1_000_000


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier predicts toxic.

    Null and empty texts score as empty ones; rows that repeat an id, or have
    none, are judged each.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), extra_columns=True)
    return scored.where("predicted = 0").select("row.*")


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out of texts that repeat a line of another document, or an earlier line of their own.

    Proven near copies of each other (80 % of five-word shingles) count as one
    document here, so that a group loses the same lines in all its members and
    the next stage still finds it.  Null and empty texts stay as they are;
    documents without an id are not compared; all rows stay, and a text of
    repeated lines only becomes empty.
    """
    near = lambda: near_duplicates(docs, shingle=5, percent=80).where("doc_id <> component_id")
    copies = materialize_only(lambda: near().selectExpr("doc_id", "component_id AS group").distinct(), spark, "copies")
    out = drop_repeated_lines(docs, broadcast_if_small(copies, MAX_BROADCAST_IDS))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (80 % of five-word shingles), and one row of it.

    Of rows that repeat an id the one with the smallest text stays (null last).  Null and
    empty texts are copies of nothing; rows without an id stay.
    """
    found = materialize_only(lambda: near_duplicates(docs, shingle=5, percent=80).select("doc_id", "kept"), spark, "near")
    gone = found.where("NOT kept").select("doc_id").distinct()
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(broadcast_if_small(gone, MAX_BROADCAST_IDS), "doc_id", "left_anti")
    repeated = materialize(repeated, "repeatedids")
    if not repeated.limit(1).count():
        discard(repeated)
        return kept.select(*docs.columns)
    repeated = broadcast_if_small(repeated, MAX_BROADCAST_IDS)
    once = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(F.col("text").alias("first"), F.struct("*").alias("row")).alias("r"))
    once = once.groupBy("doc_id").agg(F.min_by("r.row", F.struct(F.col("r.first").isNull(), "r.first", F.xxhash64("r.row"))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once.select("row.*").select(*docs.columns))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), extra_columns=True).where("size(hits) = 0").select("row.*")


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens, domain posteriors and sampling rate; null texts have no tokens."""
    return mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: the stages learn models and follow links, which SQL can't express
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
