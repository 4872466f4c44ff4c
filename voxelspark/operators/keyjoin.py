"""Joins on a key that may hold any share of the rows.

Keys with more than one row in ``MOST`` of the total are at most ``MOST`` in number, whatever the data: their
rows of the table are broadcast, and the rows that met one are dealt at random in the shuffle that joins the
others. So no task gathers a hot key, and what is broadcast has a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast; keys of at most ``LEAST`` rows never are.
MOST, LEAST = 20_000, 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], total: int, count: str = "m") -> DataFrame:
    """``rows`` with the other columns of ``table``, inner. table: one row a key, ``count`` its number of rows, all of which are at most ``total`` together."""
    bound = max(LEAST, total // MOST)
    more = [c for c in table.columns if c not in on]
    hot = table.where(F.col(count) > bound).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in more])
    met = rows.join(F.broadcast(hot), on, "left")
    spread = F.when(F.col(f"_hot_{count}").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int"))
    # 0 for every row, but not a literal: that would be folded away, and the join dealt by the key alone
    zero = F.when(F.col(count) < 0, 1).otherwise(0)
    cold = table.where(F.col(count) <= bound).select(*on, zero.alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in more])
    met = met.withColumn("_spread", spread).join(cold, [*on, "_spread"], "left")
    both = [F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in more]
    return met.where(F.col(f"_hot_{count}").isNotNull() | F.col(f"_cold_{count}").isNotNull()).select(*rows.columns, *both)
