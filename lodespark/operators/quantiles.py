"""Exact quantiles that no hot group can break.

``percentile`` and ``median`` hold every distinct value of a group in one aggregation buffer. Here the values of
a group are spread over order-preserving buckets instead: count, find the buckets in which the wanted ranks fall,
and sort only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.functions.formula import name

# Buckets per factor of two. A group has at most this many per octave of its values, which bounds what one task
# scans for ranks; values spread over an octave leave a 2^-18 share of the group to sort in one bucket.
BUCKETS_PER_OCTAVE = 2**18
_SHIFT = 1100 * BUCKETS_PER_OCTAVE


def value_bucket(value: str) -> str:
    """SQL for a bucket number that never decreases as the value grows (signed logarithmic bins).

    Infinite values have the outermost bucket of their sign.
    """
    finite = f"floor(log2(abs({value})) * {BUCKETS_PER_OCTAVE}) + {_SHIFT}L"
    size = f"if(abs({value}) = double('infinity'), {2 * _SHIFT}L, {finite})"
    return f"if({value} = 0, 0L, cast(signum({value}) as bigint) * ({size}))"


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per key with counts; nulls and NaN are left out. Combined before the shuffle."""
    amount = f"sum({name(weight)})" if weight else "count(1)"
    return (
        df.where(f"{name(value)} is not null and not isnan({name(value)})")
        .selectExpr("*", f"{value_bucket(name(value))} as _bucket")
        .groupBy(*keys, "_bucket", value)
        .agg(F.expr(f"cast({amount} as bigint) as _count"))
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column for each entry of ``probs``; also ``n``."""
    counts = value_counts(df, keys, value, weight)
    names = [name(k) for k in keys]
    group = f"partition by {', '.join(names)}" if names else ""
    slots = [
        f"named_struct('slot', '{label}|{side}', 'rank', cast({side}({p}D * (_n - 1)) as bigint))"
        for label, p in probs.items()
        for side in ("floor", "ceil")
    ]
    # The few buckets that hold a wanted rank, each with its ranks counted from the bucket's own start.
    picks = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.expr("sum(_count) as _size"))
        .selectExpr(
            *names,
            "_bucket",
            "_size",
            f"sum(_size) over ({group} order by _bucket rows unbounded preceding) - _size as _before",
            f"sum(_size) over ({group}) as _n",
        )
        .selectExpr(
            *names,
            "_bucket",
            "_n",
            f"""transform(filter(array({', '.join(slots)}), s -> s.rank >= _before and s.rank < _before + _size),
                s -> named_struct('slot', s.slot, 'rank', s.rank - _before)) as _want""",
        )
        .where("size(_want) > 0")
    )
    inside = f"partition by {', '.join([*names, '_bucket'])} order by {name(value)} rows unbounded preceding"
    found = (
        _join(counts, picks, [*keys, "_bucket"])
        .selectExpr("*", f"sum(_count) over ({inside}) as _upto")
        .selectExpr(
            *names,
            "_n",
            f"{name(value)} as _value",
            "explode(filter(_want, s -> s.rank < _upto and s.rank >= _upto - _count).slot) as _slot",
        )
    )
    at = lambda label, side: f"max(_value) filter (where _slot = '{label}|{side}')"

    def interpolated(label: str, p: float) -> str:
        lo, hi, share = at(label, "floor"), at(label, "ceil"), f"({p}D * (max(_n) - 1)) % 1"
        return f"if({lo} = {hi}, {lo}, {lo} * (1D - {share}) + {hi} * ({share})) as {name(label)}"

    return found.groupBy(*keys).agg(
        *[F.expr(interpolated(label, p)) for label, p in probs.items()], F.expr("max(_n) as n")
    )


def _join(counts: DataFrame, picks: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe equi-join, as a null key is a group of its own."""
    match = " and ".join(f"l.{name(c)} <=> r.{name(c)}" for c in on)
    return counts.alias("l").join(picks.alias("r"), F.expr(match)).selectExpr("l.*", "r._n", "r._want")
