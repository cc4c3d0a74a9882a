"""Fingerprints of rows and values: what is shuffled instead of the cells themselves."""

from pyspark.sql import Column, functions as F

from .text import quoted


def null_bits(columns) -> list[Column]:
    """Which cells are null, 63 columns a long. Spark's hashes pass over nulls, so these bits keep ('a', null) and (null, 'a') apart."""
    cells = [quoted(c) for c in columns]
    return [sum((F.shiftleft(c.isNull().cast("long"), i) for i, c in enumerate(cells[at:at + 63])), F.lit(0).cast("long"))
            for at in range(0, len(cells), 63)]


def row_hash(columns, salt: int = 0) -> Column:
    """64 bits of all cells, their order and their nulls. Hashes with other salts are independent enough to be used together."""
    cells = [quoted(c) for c in columns]
    return F.xxhash64(F.lit(salt), *null_bits(columns), *(cells if salt % 2 == 0 else reversed(cells)))
