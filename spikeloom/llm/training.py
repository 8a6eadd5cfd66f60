"""Splits and bounded, reproducible training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(parts: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo parts: fixes who is held out from learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def balanced(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label (all, of a rarer one), chosen by a hash of doc_id.

    The only statistic gathered is the count of each label, and the choice is a
    filter on the scan: no shuffle of texts. Rows without a label are left out.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
        keep = keep | ((F.col(label) == value) & (place < F.lit(min(1_000_000, int(1_000_000 * per_label / n) + 1))))
    return rows.where(keep)


def within(docs: DataFrame, chosen: DataFrame, label: str, most: int) -> DataFrame:
    """Of chosen (doc_id, label), by the same hash, the rows of each label whose texts take at most `most` bytes in all.

    A text that doesn't fit into what is left is passed over and smaller ones
    after it still count, so a long text never keeps the others out. Only sizes
    of the chosen rows come to the driver.
    """
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.sum("size").alias("size"))
    left: dict = {}
    kept = []
    for r in sizes.orderBy(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)), "doc_id", label).collect():
        if r.size <= left.setdefault(r[label], most):
            left[r[label]] -= r.size
            kept.append((r.doc_id, r[label]))
    return docs.sparkSession.createDataFrame(kept, sizes.select("doc_id", label).schema)
