"""Corpus pipeline: from raw documents to a weighted training mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and calls one operator of ``opslens.llm`` on all rows that its predecessor
kept. All stages but the last return the columns of ``documents``; the last
returns the mix: one row per document that is taken, with the words taken.

``run`` applies the stages to ``documents``, each result checkpointed in the
shared folder before the next stage reads it. The first stage is a fitted
model, which SQL cannot express, so there is no oracle; the tests compare
with a brute-force version.

Rows without an id: scored, grouped and searched like any other; near
duplicates are not looked for among them. Columns beyond those of
``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.exact_dedup import exact_dedup, lower_ascii
from opslens.llm.minhash_dedup import near_duplicates
from opslens.llm.quality_gam import fit_quality, quality_column
from opslens.llm.queries import held_out, table
from opslens.llm.source_mixing import mix_sources
from opslens.llm.stored import stored
from opslens.llm.template_decontam import leaked_items


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``dropped`` (id, key)."""
    own = _own(docs, "__row")
    gone = dropped.select(F.struct(F.col("id"), F.col("key")).alias(own)).distinct()
    keyed = docs.withColumn(own, F.struct(F.col("doc_id").alias("id"), key.alias("key")))
    return keyed.join(gone, own, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), allowed=lambda key: ~held_out(key))
    return docs.where(quality_column(model, F.col("text")) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of texts equal but for the case of A-Z, one stays."""
    verdict = exact_dedup(docs, keep="largest", normalise=lower_ascii)
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    return _without(docs, digest, verdict.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near duplicates stays (five
    words a shingle, similarity 0.8). Texts that share an id are judged one
    by one: all but one of them get a key of their own."""
    text, shared_id, key, gone = F.xxhash64("text"), _own(docs, "__shared"), _own(docs, "__key"), _own(docs, "__gone")
    lo = _own(docs, "__lo")
    shared = stored(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(shared_id))
                    .agg(F.min(text).alias(lo), F.max(text).alias("hi")).where(F.col(lo) < F.col("hi")).select(shared_id, lo))
    keyed = docs.withColumn(key, F.col("doc_id"))
    if not shared.isEmpty():
        own = F.shiftrightunsigned(F.xxhash64("doc_id", text), 1)
        keyed = docs.join(shared, docs["doc_id"] == shared[shared_id], "left") \
            .withColumn(key, F.when(text != F.col(lo), own).otherwise(F.col("doc_id")))
    dropped = near_duplicates(keyed, shingle=5, percent=80, id_col=key).where(~F.col("kept")).select(F.col(key).alias(gone)).distinct()
    return keyed.join(dropped, F.col(key) == F.col(gone), "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    leaked = leaked_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, F.xxhash64("text"), leaked.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("key")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: words taken from each document for the target mix."""
    return mix_sources(docs, weights=(5, 2, 1), max_repeat=3).where(F.col("taken") > 0)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("mixed", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
