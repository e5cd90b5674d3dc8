"""Bounded samples of labelled rows, and the split that keeps rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def stratified(ids: DataFrame, label: str, key: str, per_label: int, max_labels: int = 1000) -> list:
    """(key, label) of about ``per_label`` rows of each label, drawn by a hash of the key.

    Only counts and the drawn keys reach the driver: about ``per_label`` for each of at most
    ``max_labels`` labels; more labels are an error. Null keys and labels are left out.
    """
    rows = ids.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])[F.col(label)]
    unit = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) / F.lit(float(1 << 53))
    return rows.where(unit < rate).orderBy(F.xxhash64(key), key, label).limit(2 * per_label * len(counts)).collect()
