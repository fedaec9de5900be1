"""From raw documents to packed training sequences: ``STAGES`` in order, each on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Rows
are told apart by id and text, null ids included; further columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import best_fit_packing, minhash_dedup, quality_rules, source_mixing, substring_dedup
from graticule.session import small_side, written


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """Ids and text hashes as a written table, broadcast while their number is bounded."""
    keys = written(rows.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct(), name)
    return small_side(keys, keys.count())


def _match(docs: DataFrame, keys: DataFrame):
    return docs["doc_id"].cast("long").eqNullSafe(keys["k_id"]) & (F.xxhash64(docs["text"]) == keys["k_hash"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, certified together, reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = _keys(quality_rules.judge(docs, labels, joint=True).where("not kept"), "rejected")
    return docs.join(rejected, _match(docs, rejected), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; texts without words stay."""
    rows = written(minhash_dedup.near_duplicates(docs).select("doc_id", "text_hash", "group").where("group is not null"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stays = rows.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("m")).where("m > 1")
    grouped = written(
        rows.join(stays, "group").select(
            "doc_id", "text_hash", rank.eqNullSafe(F.col("first")).alias("stays")
        ), "group-members",
    )
    gone = _keys(grouped.where("not stays"), "gone")
    left = docs.join(gone, _match(docs, gone), "left_anti")
    # Equal rows have one key: of those that stay, one row stays.
    again = _keys(grouped.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated")
    single = left.join(again, _match(left, again), "left_anti")
    return single.unionByName(left.join(again, _match(left, again), "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a changed text is its remaining words joined by spaces, one without any goes."""
    found = written(
        substring_dedup.repeated_passages(docs, whole_text=True).where("n_removed > 0").select("doc_id", "text_hash", "stripped"), "stripped"
    )
    changed = _keys(found, "changed")
    same = docs.join(changed, _match(docs, changed), "left_anti")
    light = docs.join(changed, _match(docs, changed), "left_semi").withColumn("text", F.xxhash64("text"))
    texts = found.where("stripped != ''").dropDuplicates(["doc_id", "text_hash"]).toDF("s_id", "s_hash", "s_text")
    new = light.join(texts, light["doc_id"].cast("long").eqNullSafe(texts["s_id"]) & (light["text"] == texts["s_hash"]))
    values = {"text": texts["s_text"], "n_chars": F.length(texts["s_text"]).cast("long")}
    return same.unionByName(new.select(*(values[c].alias(c) if c in values else light[c] for c in docs.columns)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the target weights, each once at most."""
    drawn = _keys(source_mixing.mix(docs, epochs=1), "drawn")
    return docs.join(drawn, _match(docs, drawn), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixture", mixture),
    ("packing", packing),
]

#: Component search, passage removal over all texts, tokenizer ids and packing are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
