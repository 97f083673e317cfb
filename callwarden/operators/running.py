"""Running aggregates that survive one key holding a large share of all rows.

A plain window gives every key to one task, which is right for all keys of ordinary size. Keys with more than ``DEPTH`` rows are cut into
chunks of about equal depth: their rows are range-partitioned over (key, order), so the borders are quantiles of a sample of the rows
themselves and lie inside one instant or one value if that is where the rows are. The chunk of a row is stored with it before use, so a
retried task cannot move a border. A window over the few chunk totals of a key gives the value carried into each chunk, and only the
rows of one chunk are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from callwarden.session import cut_lineage

#: Rows of one key that one task sorts.
DEPTH = 1_000_000

_TOTAL = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def time_chunk(ts: str, seconds: int) -> Column:
    """Number of the fixed-length time chunk that holds a timestamp (either timestamp type)."""
    return F.expr(f"unix_micros(cast({ts} AS timestamp)) div {int(seconds) * 1_000_000}")


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def equi_depth(rows: DataFrame, by: list[str], order: list[str], n_rows: int, depth: int) -> DataFrame:
    """Stored rows with ``_chunk``: consecutive parts, in (key, order), of about two thirds of ``depth`` rows."""
    parts = max(2, -(-3 * n_rows // (2 * depth)))
    return cut_lineage(rows.repartitionByRange(parts, *by, *order).withColumn("_chunk", F.spark_partition_id()))


def _equal(names: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) == F.col(n + suffix) for n in names])


def _by_chunks(work: DataFrame, by: list[str], order: list[str], measures: dict, n_rows: int, depth: int, inclusive: bool, reverse: bool) -> DataFrame:
    def direction(name: str) -> Column:
        return F.col(name).desc() if reverse else F.col(name).asc()

    cut = equi_depth(work, by, order, n_rows, depth)
    totals = cut.groupBy(*by, "_chunk").agg(*[_TOTAL[kind](F.col(f"_m_{name}")).alias(f"_m_{name}") for name, (kind, _) in measures.items()])
    before = Window.partitionBy(*by).orderBy(direction("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"{k}_c") for k in [*by, "_chunk"]],
        *[_TOTAL[kind](F.col(f"_m_{name}")).over(before).alias(f"_c_{name}") for name, (kind, _) in measures.items()],
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(*[direction(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.select("*", *[_TOTAL[kind](F.col(f"_m_{name}")).over(inside).alias(f"_l_{name}") for name, (kind, _) in measures.items()])
    joined = local.join(carried, _equal([*by, "_chunk"], "_c"), "left")
    return joined.select(*work.columns, *[_combine(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(f"_r_{name}") for name, (kind, _) in measures.items()])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
    depth: int | None = None,
) -> DataFrame:
    """Add a running ``sum``, ``count``, ``max`` or ``min`` per key, in the given order.

    ``order`` must be unique within a key. ``inclusive`` counts the row itself; ``reverse`` runs from the end. Min and max also work on
    structs and ignore nulls. The size of the largest key is looked up first: one aggregation over the key columns.
    """
    depth = DEPTH if depth is None else depth
    # text that is never null groups as it is, so rows that already lie by such a key are not shuffled again
    ready = {f.name for f in df.schema if f.dataType == StringType() and not f.nullable}
    by = [k if k in ready else f"_k{i}" for i, k in enumerate(keys)] or ["_k0"]
    work = df.select(
        "*",
        *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(g) for k, g in zip(keys, by) if k != g] if keys else [F.lit("").alias("_k0")],
        *[value.alias(f"_m_{name}") for name, (_, value) in measures.items()],
    )
    sizes = work.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > depth)
    n_rows = sizes.agg(F.sum("_n")).first()[0]

    def plain(rows: DataFrame) -> DataFrame:
        ordered = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
        w = Window.partitionBy(*by).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return rows.select("*", *[
            (F.coalesce(_TOTAL[kind](F.col(f"_m_{name}")).over(w), F.lit(0)) if kind in ("sum", "count") else _TOTAL[kind](F.col(f"_m_{name}")).over(w)).alias(f"_r_{name}")
            for name, (kind, _) in measures.items()])

    if n_rows is None:
        out = plain(work)
    else:
        large = sizes.select(*[F.col(k).alias(f"{k}_h") for k in by])
        chunked = _by_chunks(work.join(large, _equal(by, "_h"), "left_semi"), by, order, measures, n_rows, depth, inclusive, reverse)
        out = plain(work.join(large, _equal(by, "_h"), "left_anti")).unionByName(chunked)
    return out.select(*df.columns, *[F.col(f"_r_{name}").alias(name) for name in measures])


def _ranked_values(df: DataFrame, by: list[str], value: str, depth: int | None) -> DataFrame:
    """Distinct values with their count ``_n``, running count ``_to`` and the size ``n`` of the group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running(counted, by, ["_v"], {"_to": ("sum", F.col("_n"))}, depth=depth)
    if by:
        return ranked.join(counted.groupBy(*by).agg(F.sum("_n").alias("n")), by)
    one_row = counted.agg(F.sum("_n").alias("n")).withColumn("_all", F.lit(1))
    return ranked.withColumn("_all", F.lit(1)).join(F.broadcast(one_row), "_all").drop("_all")


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], depth: int | None = None) -> DataFrame:
    """Exact interpolated percentiles per group, without gathering a group.

    Equal values collapse to one counted row first. Ranks are running counts over ranges of equal depth,
    so even one huge group of different values is spread. Each quantile then reads at most two rows.
    """
    joined = _ranked_values(df, by, value, depth)
    first, last = F.col("_to") - F.col("_n"), F.col("_to") - 1
    out = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        for part, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            out.append(F.max(F.when(at.between(first, last), F.col("_v"))).alias(f"{name}_{part}"))
    picked = joined.groupBy(*by, "n").agg(*out)
    return picked.select(
        *by, "n",
        *[
            (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
             * (F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1)))).alias(name)
            for name, q in quantiles.items()
        ],
    )


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], depth: int | None = None) -> DataFrame:
    """The value at sorted position ``round(q * (n - 1))``, halves to the even position."""
    joined = _ranked_values(df, by, value, depth)
    first, last = F.col("_to") - F.col("_n"), F.col("_to") - 1
    at = {name: F.bround(F.lit(float(q)) * (F.col("n") - 1)) for name, q in quantiles.items()}
    return joined.groupBy(*by, "n").agg(
        *[F.max(F.when(pos.between(first, last), F.col("_v"))).alias(name) for name, pos in at.items()]
    )
