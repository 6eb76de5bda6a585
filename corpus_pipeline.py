"""A cleaning pipeline over ``documents``: toxicity, quality rules, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again before the next.  All but the last return the columns
of ``documents``, and further ones with whatever names if there are such.

Defined cases, in every stage: a null text counts as empty; an empty table
gives no row; a null in another column changes nothing; rows that repeat a
doc_id, or have none, are judged each by itself (the stages that compare texts
then tell rows apart by a number of their own), so no row goes for another's
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmsieve.llm import jaccard, packing, quality, suffix, toxicity
from ohmsieve.llm.store import Workspace, columns_of, free_names, read

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5; the model is fitted on the whole ``documents``.

    Equal texts have equal scores, so they go or stay together; empty texts
    have the score of a text without windows.
    """
    model = toxicity.learn_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "toxic_score")
    return toxicity.score_column(docs, model, score).filter(F.col(score) < 0.5).select(*columns_of(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; empty texts fail them."""
    model = quality.learn_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    names = free_names(docs.columns, *quality.NAMES)
    return quality.judge(docs, model, names=names).filter(F.col(names[-1])).select(*columns_of(docs))


def keyed(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name: doc_id where it does, else a number in a written copy."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    (key,) = free_names(docs.columns, "row")
    return ws.table("keyed", docs.withColumn(key, F.monotonically_increasing_id())), key


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; texts without links all stay.

    Where doc_ids repeat, the first row among those with the group's smallest
    doc_id stays, so of equal rows one stays; a row without doc_id stays only
    where the group has no other.
    """
    rows, key = keyed(docs, Workspace(spark, "stage"))
    alike = jaccard.similar(rows.select(F.col(key).alias("doc_id"), "text"))
    if key == "doc_id":
        gone = alike.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    else:
        alike = rows.select(F.col(key), F.col("doc_id").alias("id")).join(alike.withColumnRenamed("doc_id", key), key)
        order = F.struct(F.col("id").isNull(), "id", key)
        best = alike.groupBy("component_id").agg(F.min(order)[key].alias("best"))
        gone = alike.join(best, "component_id").filter(F.col(key) != F.col("best")).select(key)
    return rows.join(gone, key, "left_anti").select(*columns_of(docs))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one (by doc_id, or by row where doc_ids repeat) has; what is left empty by that goes."""
    rows, key = keyed(docs, Workspace(spark, "stage"))
    spans = suffix.repeated_spans(rows.select(F.col(key).alias("doc_id"), "text"))
    return suffix.without_repeats(rows, spans, key).select(*columns_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences; equal rows are packed each."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(f"{k}-{name}", stage(spark, docs, sf_dir))
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
