"""A pipeline that prepares a corpus: drops toxic documents, drops documents of
poor quality, keeps one of each group of near copies, and packs what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers as tokens
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import bag_minhash, packing, quality_rules, toxic_crf
from souk.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 go; the rest keep their columns."""
    model = toxic_crf.train(docs, table(spark, sf_dir, "labels"))
    return toxic_crf.tag(docs, model, whole=True).filter("score < 0.3").select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go; the rest keep their columns."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model, keep=_whole(docs)).filter("score >= 0.5").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least id;
    documents without an id stay."""
    found = bag_minhash.classes(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count_if("kept").alias("rows"))
    found = written(found, "kept")
    dropped = found.filter("not kept").select("doc_id")
    if dropped.count() <= bag_minhash.BROADCAST:  # so the texts stay where they are
        dropped = F.broadcast(dropped)
    out = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("rows > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    again = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokens.path("word_bpe_49k.json"))


def _whole(docs: DataFrame) -> dict[str, Column]:
    return {"_row": F.struct(*(F.col(c) for c in docs.columns))}


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("packing", pack)]
#: SQL can't learn the classifiers or pack; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
