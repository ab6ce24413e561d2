"""Small helpers that the text operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, text and `copy_key`, 64 bits of the text.

    (doc_id, copy_key) names a document: rows that repeat both are the same document, rows that repeat only
    the id are different ones, ordered by the key. All other columns are left behind, whatever their names.
    """
    return docs.select(F.col(id).alias("doc_id"), whole(text).alias("text")).withColumn("copy_key", F.xxhash64("text"))



def beside(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row of `docs` as one column `row`, and the given columns: no name of `docs` can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def without(docs: DataFrame, gone: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` whose document is not in `gone` (doc_id, copy_key)."""
    drop = gone.select(F.col("doc_id").alias("_gone_id"), F.col("copy_key").alias("_gone_key")).distinct()
    rows = beside(docs, _id=F.col(id), _key=F.xxhash64(whole(text)))
    return rows.join(drop, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left_anti").select("row.*")
