"""Exact deduplication with a heavy-hitter split.

Misra-Gries finds digests that many rows share. Their exact sizes and winners are counted, and these few rows are
broadcast, so copies of a hot text are marked map-side. All other digests go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, row_numbered, text_or_empty, without
from .heavy import frequent


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical without [\\x20\\x09-\\x0D]. Of equal texts the row with the most code points in
    its original text, then the smallest id, stays. A null text is an empty one, and empty or blank texts are one
    group. A null id loses every tie. Of repeated rows (same id, same text) one stays. An empty table gives no rows.
    Other columns of docs are ignored; row_col names a column that tells rows apart, where there is one.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.length(text).cast("long").alias("n"),
        F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE}+", "").cast("binary"), 256)).alias("digest"),
    )
    rows = cut(rows, "digests")
    total = rows.count()

    # A digest is heavy if it would be much of a task's rows; the list of heavy ones is bounded either way.
    share = 1 / min(20_000, max(1_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    least = max(2, int(total * share))
    best = F.max(F.struct("n", (-F.col("doc_id")).alias("id"), "row")).alias("best")
    maybe = F.broadcast(frequent(rows, "digest", total, share))
    hot = rows.join(maybe, "digest").groupBy("digest").agg(best, F.count("*").alias("group_size"))
    hot = cut(hot.filter(F.col("group_size") >= least), "hot-digests")

    marked = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    # Winners combine map-side; a join of them with the rows is one that Spark can split.
    rest = rest.join(rest.groupBy("digest").agg(best, F.count("*").alias("group_size")), "digest")
    return marked.unionByName(rest).select(
        "doc_id",
        (-F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that mark_copies drops, with all its columns, whatever they are called.

    Null, empty and repeated rows count as they do there, so one empty text stays; an empty table gives an empty one.
    """
    base, row = row_numbered(docs)
    return without(base, mark_copies(base, id_col, text_col, row).filter("not kept").select("row"), row)
