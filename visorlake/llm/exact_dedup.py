"""Exact duplicates with a heavy-hitter split, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import WHITE, beside, whole
from visorlake.session import settle

#: Digests that may be broadcast, and counters of the Misra-Gries sketch. Both bound what a task or the driver
#: holds; they decide the way a digest travels, never the result.
HEAVY = 1_000
COUNTERS = 4_096
SALTS = 64


def text_digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, code points of the original text and SHA-256 of the text without white space."""
    t = whole(text)
    return docs.select(F.col(id).alias("doc_id"), F.char_length(t).cast("long").alias("n_points"),
                       F.sha2(F.regexp_replace(t, WHITE, ""), 256).alias("text_sha256"))


def frequent_digests(digests: DataFrame) -> DataFrame:
    """At most `HEAVY` digests that a Misra-Gries sketch takes for frequent.

    Every digest with more than about rows / COUNTERS occurrences is among them. Sketches are built per task, merged
    within `SALTS` groups and then once more, so one task meets `SALTS` sketches of bounded size.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    parts = digests.groupBy(salt.alias("_salt")).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {COUNTERS})").alias("_s"))
    top = parts.groupBy(F.lit(0).alias("_one")).agg(F.expr(f"approx_top_k_combine(_s, {COUNTERS})").alias("_s"))   # no sketch of no rows
    return (top.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {HEAVY})")).alias("_e"))
            .select(F.col("_e.item").alias("text_sha256")).where(F.col("_e.count") > 1))


def _winners(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.isnull("doc_id").alias("z"), "doc_id", "row_no")).alias("_first")
    return (rows.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size"))
            .select("text_sha256", F.col("_first.doc_id").alias("keep_id"), F.col("_first.row_no").alias("_keep_row"), "group_size"))


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of texts that are equal without white space, and the row of each that stays.

    Digests are settled first: 64 hex digits a row, whatever the length of the texts. Frequent digests are found
    by Misra-Gries, their winners and sizes verified by a map-side combined aggregate of at most `HEAVY` rows a task, and
    broadcast, so their rows never move. All other rows meet in an ordinary shuffle on the digest.

    A null text counts as empty, all empty texts are one group. A null id comes after all others. Rows that repeat an
    id and a text tie; one of them stays. An empty table gives none. Other columns of `docs` are ignored.
    Returns doc_id, keep_id, group_size, kept, text_sha256, n_points: a row per input row.
    """
    rows = settle(text_digests(docs, id, text).withColumn("row_no", F.monotonically_increasing_id()))
    heavy = settle(frequent_digests(rows))
    verified = settle(_winners(rows.join(F.broadcast(heavy), "text_sha256", "left_semi")))
    still = rows.join(F.broadcast(verified), "text_sha256")
    rest = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    moved = rest.join(_winners(rest), "text_sha256")
    return still.unionByName(moved).select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("_keep_row")).alias("kept"),
                                           "text_sha256", "n_points")


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with their columns."""
    found = settle(exact_duplicates(docs, id, text))
    name = lambda kept: found.where(F.col("kept") == kept).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"),
                                                                   F.col("n_points").alias("_n")).distinct()
    stays, t = name(True), whole(text)
    rows = beside(docs, id_=F.col(id), sha_=F.sha2(F.regexp_replace(t, WHITE, ""), 256), n_=F.char_length(t).cast("long"))
    out = rows.join(stays, F.col("id_").eqNullSafe(F.col("_id")) & (F.col("sha_") == F.col("_sha")) & (F.col("n_") == F.col("_n")), "left_semi")
    if not name(False).intersect(stays).isEmpty():                             # rows that repeat an id and a text
        out = out.groupBy("id_", "sha_", "n_").agg(F.first("row").alias("row"))
    return out.select("row.*")


EXACT_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER w = 1 AS kept
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256, n AS n_points FROM g
"""
