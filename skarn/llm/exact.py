"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import cut

#: Share of all rows from which a digest surely counts as frequent; the summary keeps at most 1 / SUPPORT digests.
SUPPORT = 1 / 500


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row with the row that stays of its group of equal texts.

    Misra-Gries (Spark's freqItems) finds the digests that may hold ``support``
    of all rows. Their counts and winners (largest id) are verified by a
    grouped aggregate over those at most 1/support digests, and broadcast: rows
    with such a digest get their winner on the map side and are never
    shuffled. All other digests are counted with a partial aggregate before the
    shuffle and joined with their rows; none of them has more than ``support``
    of the rows.

    Returns id, keep_id, group_size, kept, text_sha256. Texts are compared as
    they are, by SHA-256 of their UTF-8 bytes. A null text counts as empty.
    Rows with the same text and the same largest id are all marked kept (they
    cannot be told apart by id); a null id is never a winner unless all ids of
    the group are null. An empty table gives no rows. Other columns are ignored.
    """
    digests = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")))
    frequent = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256")).where("text_sha256 is not null")
    # at most 1/support rows, by construction of the summary
    winners = cut(
        digests.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    sizes = light.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = light.join(sizes, "text_sha256")
    return heavy.unionByName(rest).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
