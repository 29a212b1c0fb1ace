"""Every block of one table with every block of another, the shape of searches that put a stated set of queries to all rows.

Rows are packed into blocks (binary columns of bounded size) before anything is joined, so a search moves blocks and
not pairs of rows, and a task holds one pair of blocks at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the smaller side are broadcast up to this size, as written; beyond it they are dealt by (part, salt).
BROADCAST_BYTES = 8 << 20
#: Blocks of the larger side that share a copy of the smaller side's part, where nothing is broadcast.
BLOCKS_PER_SALT = 8


def all_blocks(large: DataFrame, small: DataFrame, parts: int, small_bytes: Column) -> DataFrame:
    """The blocks of ``large`` beside those of ``small(part, ...)``, whose parts are numbered from 0; both are written
    tables and ``small_bytes`` is the size of a row of ``small``.

    A join on the part's number. Where ``small`` is not broadcast, each part is copied once for a few blocks of
    ``large`` (the salt), so that no task gets all blocks of a part."""
    size = small.agg(F.sum(small_bytes)).first()[0] or 0
    numbered = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    if size <= BROADCAST_BYTES:
        return numbered.join(F.broadcast(small), "part")
    salts = -(-large.count() // BLOCKS_PER_SALT)
    salted = numbered.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), ["part", "salt"])
