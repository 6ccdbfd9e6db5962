"""Building blocks that keep ordered and ranked work distributed when one key holds much of the data.

* `running`    running sums and carried-forward values along a dense row number, two-level: inside fixed-size chunks,
               then over one row per chunk.
* `numbered`   exact row numbers per key from one range-partitioned sort; no task ever holds a whole key.
* `quantiles`  exact continuous quantiles per key from value counts and the same sort.
* `top_per_key` best k rows per key; Spark's partial window limit drops all but k rows per key before the shuffle.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import cut

CHUNK = 65_536
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per key to a table so that NULL keys meet too; without keys, the one row of `right`."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, cond, how).drop(*[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], pos: str, sums: Mapping[str, Column] | None = None,
            carries: Mapping[str, Column] | None = None, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Add inclusive running sums and last-non-null carries along the integer column `pos` within `keys`; chunks are dealt to
    `parts` tasks, if given."""
    sums, carries, keys = dict(sums or {}), dict(carries or {}), list(keys)
    raw = {f"_v_{n}": e for n, e in {**sums, **carries}.items()}
    src = df.withColumns({**raw, "_chunk": F.floor(F.col(pos) / F.lit(chunk))})
    part = [*keys, "_chunk"]
    local = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    totals = src.groupBy(*part).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_t_{n}") for n in carries])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in part],
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_t_{n}", True).over(before).alias(f"_o_{n}") for n in carries])
    here = (src.repartition(parts, *part) if parts else src).withColumns({**{f"_l_{n}": F.sum(f"_v_{n}").over(local) for n in sums},
                            **{f"_l_{n}": F.last(f"_v_{n}", True).over(local) for n in carries}})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in part]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = here.join(offsets.hint("shuffle_hash") if parts else offsets, cond, "left")  # a few rows a key: nothing is sorted for them
    out = joined.withColumns({
        **{n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums},
        **{n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in carries}})
    return out.select(*df.columns, *sums, *carries)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, tuple[Column, int]],
               chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Add the value of a row at a nearby position (offset -1 = previous row, +1 = next) along a dense `pos`.
    Rows at a chunk's edge are copied into the neighbouring chunk, so windows stay chunk-sized; chunks are dealt to `parts`
    tasks, if given."""
    keys = list(keys)
    reach = max(abs(o) for _, o in values.values())
    exprs = {f"_v_{n}": e for n, (e, _) in values.items()}
    src = df.withColumns({**exprs, "_chunk": F.floor(F.col(pos) / F.lit(chunk))})
    inside = F.col(pos) - F.col("_chunk") * chunk
    homes = F.array_compact(F.array(
        F.col("_chunk"), F.when(inside < reach, F.col("_chunk") - 1), F.when(inside >= chunk - reach, F.col("_chunk") + 1)))
    spread = src.withColumn("_home", F.explode(homes))
    spread = spread.repartition(parts, *keys, "_home") if parts else spread
    w = Window.partitionBy(*keys, "_home").orderBy(pos)
    out = spread.withColumns({n: F.lag(f"_v_{n}", -o).over(w) if o < 0 else F.lead(f"_v_{n}", o).over(w)
                              for n, (_, o) in values.items()})
    return out.filter(F.col("_home") == F.col("_chunk")).select(*df.columns, *values)


def sorted_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Global order: adds `_g`, the 0-based position. One range-partitioned sort, cut by a checkpoint so that the
    partition bounds stay fixed, then per-partition offsets (one row per partition)."""
    done = cut(df.orderBy(*order)).withColumn("_mid", F.monotonically_increasing_id())
    done = done.withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
    sizes = done.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (done.join(F.broadcast(offsets), "_pid")  # bounded by the number of partitions
            .withColumn("_g", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
            .drop("_pid", "_mid", "_off"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Row number (1-based) within `keys` by `order`, exact, without a per-key window."""
    keys = list(keys)
    placed = sorted_positions(df, [*[F.col(k).asc_nulls_first() for k in keys], *order])
    if not keys:
        return placed.withColumn(name, F.col("_g") + 1).drop("_g")
    starts = placed.groupBy(*keys).agg(F.min("_g").alias("_s"))
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_s")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, cond).withColumn(name, F.col("_g") - F.col("_s") + 1).select(*df.columns, name)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact continuous quantiles (linear between neighbours, as SQL's quantile_cont) per key.
    Equal values are counted before the sort, so a constant column costs one row. A key without any value has no row."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = cut(counts.orderBy(*keys, value)).withColumn("_pid", F.spark_partition_id())
    part_key = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = placed.groupBy("_pid", *keys).agg(F.sum("_c").alias("_n"))
    all_parts = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = all_parts.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition and key
    offs = sizes.select("_pid", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                        F.sum("_n").over(all_parts).alias("_tot"))
    pos = attach(placed.withColumn("_cum", F.sum("_c").over(part_key)), offs, ["_pid", *keys])
    hi = F.col("_off") + F.col("_cum")  # this value covers 0-based positions [hi - _c, hi)
    aggs = []
    for n, q in points.items():
        at = (F.col("_tot") - 1) * F.lit(q)
        lo_pos, hi_pos = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((lo_pos >= hi - F.col("_c")) & (lo_pos < hi), F.col(value))).alias(f"_lo_{n}"),
                 F.max(F.when((hi_pos >= hi - F.col("_c")) & (hi_pos < hi), F.col(value))).alias(f"_hi_{n}"),
                 F.max(at - lo_pos).alias(f"_fr_{n}")]
    got = pos.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
                               for n in points])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """Best k rows per key. Spark plans a partial WindowGroupLimit before the shuffle, so a hot key sends k rows
    per map task; with no key the same limit runs globally."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def mode_by(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[Column]) -> DataFrame:
    """Most frequent value per key; ties by `tie` (larger struct wins). Two aggregates, both with map-side combine."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", *tie)).alias(value))
