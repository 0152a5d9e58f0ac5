"""Queries that apply the operators to their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from .chat import ORACLE, chat_digests, conversations, format_chat
from .chroma import fingerprints, match_recordings, melody_reader
from .common import shared_dir, table
from .decontaminate import find_leaks
from .linededup import line_classes
from .maxent import score_texts
from .minhash import near_duplicates
from .mixing import mix_tables
from .quality import score_quality
from .rollup import count_documents
from .toxicity import score_toxicity


def op1_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op3_chroma(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return match_recordings(fingerprints(vectors, melody_reader)).withColumnRenamed("id", "vec_id")


def op4_token_rollup(spark, sf_dir):
    return count_documents(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


def op5_mixing(spark, sf_dir):
    return mix_tables(spark, sf_dir)


def op6_decontaminate(spark, sf_dir):
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.selectExpr(
        "doc_id", "size(hits) > 0 AS contaminated", "transform(hits, x -> x.item_id) AS items",
        "transform(hits, x -> x.distance) AS distances",
    )


def op7_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_line_dedup(spark, sf_dir):
    return line_classes(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    return chat_digests(format_chat(conversations(spark, sf_dir)))


ALL = (
    op1_toxicity, op2_lm_score, op3_chroma, op4_token_rollup, op5_mixing,
    op6_decontaminate, op7_quality, op8_minhash, op9_line_dedup, op10_chat_format,
)


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql():
    return {"op10_chat_format": ORACLE}
