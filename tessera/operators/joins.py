"""Join strategies that hold at scale.

* :func:`checked_broadcast` broadcasts a side only after counting it; beyond the bound
  the plain (shuffled) join is used.
* :func:`skew_join` splits hot keys of the large side over several salted partitions
  and replicates only the matching rows of the other side.  Hot keys are found by an
  exact count (partial aggregation, small shuffle); their number is bounded, so the
  hot-key table is safe to broadcast.  Keys that are not hot take the ordinary join on
  the key alone, so sides that are bucketed by it aren't shuffled, and no row is ever
  dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows per key above which a key is split; at cluster scale one task should see a few
# million rows at most.  Tests lower it to exercise the salted path.
DEFAULT_HOT_ROWS = 2_000_000
# At most this many keys are treated as hot (the rest still join exactly, unsalted).
DEFAULT_MAX_HOT_KEYS = 10_000
# At most this many salts per hot key (copies of the small-side row).
DEFAULT_MAX_SALTS = 512


def checked_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Return ``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def hot_keys(
    df: DataFrame,
    on: Sequence[str],
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_hot: int = DEFAULT_MAX_HOT_KEYS,
    max_salts: int = DEFAULT_MAX_SALTS,
) -> DataFrame:
    """Keys of ``df`` with at least ``hot_rows`` rows and their salt count (bounded table)."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    top = counts.orderBy(F.col("_n").desc(), *on).limit(max_hot)
    return top.select(
        *on, F.least(F.ceil(F.col("_n") / F.lit(hot_rows)), F.lit(max_salts)).cast("int").alias("_salts")
    )


def hot_keys_from_counts(
    counts: DataFrame,
    on: Sequence[str] | str,
    n: str = "n",
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_hot: int = DEFAULT_MAX_HOT_KEYS,
    max_salts: int = DEFAULT_MAX_SALTS,
) -> DataFrame:
    """Hot keys from a table that already holds per-key counts (e.g. a vocabulary's ``n``).

    The counts only choose the salt numbers: any over- or under-estimate changes the
    balance, never the join result.
    """
    on = [on] if isinstance(on, str) else list(on)
    top = counts.where(F.col(n) >= hot_rows).orderBy(F.col(n).desc(), *on).limit(max_hot)
    return top.select(*on, F.least(F.ceil(F.col(n) / F.lit(hot_rows)), F.lit(max_salts)).cast("int").alias("_salts"))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_hot: int = DEFAULT_MAX_HOT_KEYS,
    max_salts: int = DEFAULT_MAX_SALTS,
    hot: DataFrame | None = None,
    large: bool = False,
) -> DataFrame:
    """Equi-join ``big`` with ``small`` on ``on``, salting the hot keys of ``big``.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti`` (``big`` is the
    preserved side; every salt of a hot key meets a copy of its small-side rows, so all
    four stay exact).  The salt of a big-side row is a hash of its columns and its partition, so
    equal rows of different tasks spread, and a recomputed task assigns the same salt.  Rows with
    a NULL key, which match nothing, are added after the join (left, left_anti).  ``hot``
    (``*on, _salts``) skips the counting pass when the key counts are already known.

    The hot keys are counted when the join is called.  Without any, the plan is the plain join; else
    ``big`` is read for the cold and for the hot rows, so one that is costly to make is better a table.

    ``large`` says that ``small`` may be far larger than Spark thinks: it takes rows that are generated or gathered
    to be as large as the files that they come from, and would send them all through the driver.  Both sides are then sorted
    and merged, never broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("skew_join supports inner, left, left_semi and left_anti joins")
    # rows with a NULL key never match: they skip the shuffle, so they can't meet in one task
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    loose = big.where(~keyed)
    big = big.where(keyed)
    hot = hot if hot is not None else hot_keys(big, on, hot_rows, max_hot, max_salts)
    found = hot.limit(max_hot).collect()  # a bounded table
    side = (lambda df: df.hint("merge")) if large else (lambda df: df)
    if not found:
        out = big.join(side(small), on, how)
    else:
        table = F.broadcast(big.sparkSession.createDataFrame(found, hot.schema))
        # broadcast joins keep a side's partitioning: cold rows meet on the key alone
        cold = big.join(table.select(*on), on, "left_anti").join(side(small), on, how)
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns], F.spark_partition_id()), F.col("_salts")).cast("int")
        hot_big = big.join(table, on).withColumn("_salt", salt).drop("_salts")
        copies = small.join(table, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
        out = cold.unionByName(hot_big.join(side(copies), [*on, "_salt"], how).drop("_salt"))
    if how == "left":
        return out.unionByName(loose, allowMissingColumns=True)
    return out.unionByName(loose) if how == "left_anti" else out


def ensure_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error when two rows share ``key`` (a NULL key counts as one key).  Only keys are shuffled, in a job of its own."""
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key).limit(1).collect()
    if again:
        raise ValueError(f"duplicate {key}: {'NULL' if again[0][0] is None else again[0][0]}")
    return df
