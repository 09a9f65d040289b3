"""The held-out fold of labelled data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str) -> Column:
    """True where the CRC-32 of the id's text leaves 2 when divided by 4; false for a null id, which is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(doc_id: str) -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)
