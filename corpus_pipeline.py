"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, sources are mixed to
their targets, the mix is packed into sequences. Each stage takes (spark, docs, sf_dir) and works on all rows of docs;
all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cut
from pagewright.llm.mixing import mix, repeated
from pagewright.llm.ngram_join import one_of_each
from pagewright.llm.packing import op2_packing
from pagewright.llm.toxicity import fit, held_out, reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from labels of those of docs that aren't held out.

    Null and empty texts score as no words; repeated rows are judged alike. Without labels of both kinds nothing goes.
    No documents: no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    return reject(docs, fit(docs.select("doc_id", "text"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group linked by 5-word shingles with Jaccard 0.8 or more.

    Ties of repeated doc_ids go by a hash of the text; of equal rows one stays. Rows without words stay, once for each
    doc_id and text; rows without doc_id all stay. No documents: no rows."""
    return one_of_each(docs, 5, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents as often as the mix does (up to three times), in training order.

    Documents without words take no part in the mix; a null source is a source. Places within a source go by a hash of
    doc_id, ties by size and a hash of the text. No documents: no rows."""
    slim = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return repeated(mix(slim, whole=True)).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 2048 ids, a row a piece.

    A null or empty text is an end id alone; repeated documents are packed as often as they occur. No documents: no rows."""
    return op2_packing(spark, sf_dir, docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Scores of a trained classifier and ids of a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
