"""Exact per-group ranks without putting a whole group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sorts each group inside a
single task; a group holding a third of the rows would become one giant task.
``group_rank`` range-partitions on ``(g, o)`` instead, so a hot group is cut
into many contiguous blocks across partitions. The sorted data is
checkpointed (lineage cut, partition contents fixed), each row gets its
position in its partition, and the small table of blocks -- at most
#partitions + #groups rows -- gives every block its offset inside its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
               out: str = "rank", size_out: str = "group_size",
               partitions: int | None = None, method: str = "range") -> DataFrame:
    """Add the 0-based rank of each row within its ``by`` group under ``order``
    (ties must be broken by ``order``; make the last key unique) and the group size.

    ``method``: ``range`` (default, the blocks above; runs the checkpoint) or
    ``window`` (``row_number``: one task sorts a whole group; for groups that
    the caller knows to be small).
    """
    spark = df.sparkSession
    by = list(by)
    okeys = [F.col(o) if isinstance(o, str) else o for o in order]
    if method == "window":
        w = Window.partitionBy(*by).orderBy(*okeys)
        return (df.withColumn(out, F.row_number().over(w) - 1)
                .withColumn(size_out, F.count(F.lit(1)).over(Window.partitionBy(*by))))
    ensure_checkpoint_dir(spark)
    tmp = [f"_o{i}" for i in range(len(okeys))]
    x = df.withColumns({t: k for t, k in zip(tmp, okeys)})
    keys = [F.col(c).asc_nulls_first() for c in by + tmp]
    # Without an explicit count AQE may coalesce adjacent range partitions;
    # a coalesced partition is still one contiguous key range, in order.
    ranged = x.repartitionByRange(partitions, *keys) if partitions else x.repartitionByRange(*keys)
    srt = (ranged
           .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by + tmp])
           .checkpoint(eager=True))
    s = srt.withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
    blocks = s.groupBy("_pid", *by).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_pid").alias("_bpid"), *[F.col(c).alias(f"_b_{c}") for c in by], "_first",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("__off"),
        F.sum("_cnt").over(Window.partitionBy(*by)).alias("__n"))
    b = blocks
    cond = [s["_pid"] == b["_bpid"]] + [s[c].eqNullSafe(b[f"_b_{c}"]) for c in by]
    j = s.join(b, cond, "inner")
    j = j.withColumn(out, F.col("__off") + F.col("_mid") - F.col("_first"))
    j = j.withColumn(size_out, F.col("__n"))
    return j.drop("_mid", "_pid", "_bpid", "_first", "__off", "__n", *tmp, *[f"_b_{c}" for c in by])
