"""A corpus pipeline of the llm operators, stage by stage.

language id -> n-gram Jaccard join -> benchmark decontamination -> mixing ->
token ids.  All stages but the last return the columns of documents.

A stage carries a row's other columns beside the operator's, as one struct, so no
name of a column can clash, and a decision falls on the row that it was made
for.  Rows that repeat a doc_id, or have none, are documents of their own in
every stage: `numbered` gives them numbers in the order of doc_id (nulls last)
where doc_id does not tell rows apart.  Each stage takes null, empty and very
long texts as its operator does, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, exchange, jaccard_join, language_id, mixing, queries, token_output

#: the likeliest language's share, at least
LEAST_SHARE = 0.4


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row: a struct of all columns but the text."""
    return docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from text and row."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def numbered(docs: DataFrame, ws: exchange.Workspace) -> DataFrame:
    """bundled(docs) with lang and source, and a doc_id that is unique and not null."""
    own = bundled(docs)
    own = own.select("doc_id", "text", "row", *(F.col("row")[c].alias(c) for c in ("lang", "source")))
    n, known, ids = own.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == ids:
        return own
    order = own.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return ws.write("numbered", order.withColumn("doc_id", F.monotonically_increasing_id()))


def kept(ws: exchange.Workspace, rows: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs for the numbered rows whose number is in ids."""
    ws.write("kept", ids)
    return restored(exchange.attach(ws, rows, "kept", how="leftsemi"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or whose likeliest has a share under LEAST_SHARE, go; a missing lang is filled in.

    A text in two languages has one with about half, and stays.  A null or empty
    text has none, and goes; equal rows get equal decisions.
    """
    found = language_id.identify(bundled(docs), language_id.train(docs), carry=("text", "row"))
    found = found.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SHARE))
    return restored(found.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred"))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of five-word shingle sets at similarity 0.8 stays: its smallest doc_id's.

    Rows given twice are a class; a text without words links with nothing, and stays.
    """
    ws = exchange.Workspace(spark, "near")
    rows = numbered(docs, ws)
    groups = jaccard_join.jaccard_join(rows, n=5, num=80, den=100)
    return kept(ws, rows, groups.filter("doc_id = component_id").select("doc_id"), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go; null and empty texts hold none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return restored(decontaminate.decontaminate(bundled(docs), items, window=10, carry=("text", "row")).filter(F.size("starts") == 0), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows outside the weighted mix of 0.8 of the tokens go; a null source or lang is a branch of its own."""
    ws = exchange.Workspace(spark, "mix")
    rows = numbered(docs, ws)
    mix = mixing.mix(rows, mixing.tree(), mixing.DOMAIN_WEIGHTS, share=0.8, epochs=1, seed=7)
    return kept(ws, rows, mix.filter("copies > 0").select("doc_id"), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place, length and checksum in the written id files; a null text has its end id alone."""
    return token_output.token_table(docs, queries.default_tokenizer())


STAGES = [("language id", language), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture), ("token ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not token_ids:
            ws = exchange.Workspace(spark, "stage")
            docs = ws.write(name.replace(" ", "-"), docs)
            if last:
                last.close()
            last = ws
    return docs
