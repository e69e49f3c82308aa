"""Per-group quantiles that stay exact at any group size.

``q(p)`` is the linear interpolation between the order statistics at
``floor((n-1)p)`` and ``ceil((n-1)p)``. The method is chosen by the caller or the
session option ``pricelens.quantile.method``, never by the size of the data.

``exact`` (default) is Spark's own ``percentile``: one partial aggregation, whose
final buffer holds the distinct values of a group (prices in cents: bounded by
the price range, not by the rows).

``select`` has no such buffer, for columns of unbounded distinct values (ratios
and other computed columns: E20 and D7 use it). It takes two passes and no sort:

1. one aggregate per group gives n, the extremes and, from a mergeable sketch
   of fixed size, two values that are sure to enclose each wanted rank: those at
   the rank less and more the sketch's error and two ranks;
2. rows below a bracket are only counted; rows inside it are counted per
   distinct value, and running counts over these few values give the exact
   order statistics.

Both are partial aggregations, so a group that holds a third of the rows, or one
value that a third of the rows have, is spread over all tasks; a task keeps a
sketch or a few thousand distinct values, whatever the size of the group.

``approx`` returns the sketch's values. ``exact`` and ``select`` give the same bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.core import lit_d, quantiles, reuse, with_global
from pricelens.session import conf

ACCURACY = 10_000  # the sketch's rank error is at most n / ACCURACY
REACHES = [2.0 / ACCURACY * 2 ** j for j in range(15)]  # half widths of the brackets, as shares of the rows


def _selected(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Wide result ``keys + one array per spec`` by bracketed selection.

    Specs on the same column share their brackets (their probabilities are merged).
    """
    by_col: dict[str, list[float]] = {}
    for c, probs in specs.values():
        by_col[c] = sorted(set(by_col.get(c, [])) | {float(p) for p in probs})
    names = {c: f"_c{i}" for i, c in enumerate(by_col)}
    wanted = sorted({p for probs in by_col.values() for p in probs})
    values = F.explode(F.array(*[F.struct(F.lit(names[c]).alias("q"), F.col(c).cast("double").alias("v")) for c in by_col])).alias("_e")
    long = df.select(*keys, values).select(*keys, F.col("_e.q").alias("_q"), F.col("_e.v").alias("_v")).where(F.col("_v").isNotNull())
    # the sketch's error and two ranks more, as a share of the rows: one of the reaches covers it at any number of rows
    around = [lit_d(min(1.0, max(0.0, p + d * r))) for p in wanted for r in REACHES for d in (-1, 1)]
    group = (long.groupBy(*keys, "_q").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                           F.percentile_approx("_v", F.array(*around), ACCURACY).alias("_s")))
    j = F.greatest(F.lit(0), F.ceil(F.log2((1 / ACCURACY + 2 / F.col("_n")) / REACHES[0])).cast("int"))
    wide = F.element_at(F.array(*[lit_d(r) for r in REACHES]), j + 1)
    brackets = []
    for i, p in enumerate(wanted):
        pos = (F.col("_n") - 1).cast("double") * p
        at = F.lit(2 * len(REACHES) * i) + 2 * j
        brackets.append(F.struct(F.lit(i).alias("i"), pos.alias("pos"), F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"),
                                 F.when(p - wide <= 0, F.col("_min")).otherwise(F.element_at("_s", at + 1)).alias("a"),
                                 F.when(p + wide >= 1, F.col("_max")).otherwise(F.element_at("_s", at + 2)).alias("b")))
    own = F.array(*[F.array(*[F.lit(wanted.index(p)) for p in probs]) for probs in by_col.values()])
    nth = F.substring("_q", 3, 10).cast("int")
    group = group.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_q").alias("_gq"),
                         F.filter(F.array(*brackets), lambda b: F.array_contains(F.element_at(own, nth + 1), b["i"])).alias("_b"))
    same = [long[k].eqNullSafe(group[f"_k_{k}"]) for k in keys]
    met = long.join(group, [*same, long["_q"] == group["_gq"]])
    # a row below a bracket adds to its count; one inside stands for its value; rows above are left out
    below = F.col("_x.a") > F.col("_v")
    at = (met.select(*keys, "_q", "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["b"])).alias("_x"))
          .groupBy(*keys, "_q", "_x", F.when(~below, F.col("_v")).alias("_val")).agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_q", "_x").orderBy(F.col("_val").asc_nulls_first())
                            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = at.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda r: F.when((F.col("_from") <= F.col(r)) & (F.col("_to") > F.col(r)), F.col("_val"))
    g = ranked.groupBy(*keys, "_q", "_x").agg(F.max(holds("_x.lo")).alias("_lv"), F.max(holds("_x.hi")).alias("_hv"))
    lv, hv = F.col("_lv"), F.col("_hv")
    lo, hi, pos = F.col("_x.lo").cast("double"), F.col("_x.hi").cast("double"), F.col("_x.pos")
    val = F.when((F.col("_x.lo") == F.col("_x.hi")) | (lv == hv), lv).otherwise((hi - pos) * lv + (pos - lo) * hv)
    picked = g.groupBy(*keys).agg(*[F.max(F.when((F.col("_q") == names[c]) & (F.col("_x.i") == wanted.index(p)), val)).alias(f"{names[c]}_{wanted.index(p)}")
                                    for c, probs in by_col.items() for p in probs])
    out = []
    for alias, (c, probs) in specs.items():
        cols = [F.col(f"{names[c]}_{wanted.index(float(p))}") for p in probs]
        # a group whose column is all NULL has no array: keep it NULL
        out.append(F.when(cols[0].isNotNull(), F.array(*cols)).alias(alias))
    return picked.select(*keys, *out)


def agg_with_quantiles(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Sequence[float]]],
                       others: Sequence[Column] = (), method: str | None = None) -> DataFrame:
    """``df.groupBy(keys).agg(others..., <alias>: array of quantiles ...)``.

    ``specs`` maps an output name to ``(column, probabilities)``. ``method``:
    ``exact`` (default), ``select`` or ``approx``, see above; the session option
    ``pricelens.quantile.method`` sets the default.
    """
    keys = list(keys)
    m = method or conf(df.sparkSession, "pricelens.quantile.method", "exact")
    if m in ("exact", "approx"):
        qs = [quantiles(c, probs, m).alias(a) for a, (c, probs) in specs.items()]
        return df.groupBy(*keys).agg(*others, *qs) if keys else df.agg(*others, *qs)
    # the rows are read for the brackets and again inside them: keep what is read, derived once
    df = reuse(df if others else df.select(*keys, *dict.fromkeys(c for c, _ in specs.values())))
    q = _selected(df, keys, specs)
    if not others:
        base = df.select(*keys).distinct() if keys else None
        if base is None:
            return q
        others_df = base
    else:
        others_df = df.groupBy(*keys).agg(*others) if keys else df.agg(*others)
    if not keys:
        return with_global(others_df, q)
    q = q.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return others_df.join(q, [others_df[k].eqNullSafe(q[f"_k_{k}"]) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
