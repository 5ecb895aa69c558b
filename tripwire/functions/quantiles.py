"""Exact linear-interpolation percentiles with bounded memory.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group
in one buffer, which does not hold for billions of distinct doubles.  Here each
target rank is bracketed by two values and the bracket narrowed:

1. one aggregation over all columns: count, least, largest, and a mergeable
   quantile sketch that gives two values around every target rank;
2. one wide aggregation over all brackets counts the rows below, at and between
   the two values exactly.  A rank that falls on either value is settled, however
   often the value occurs; otherwise the rank lies strictly between.  If so few
   rows can lie there that they may be fetched, the same pass fetches them, else
   it sketches them and step 2 is repeated inside.

Every pass is one scan with map-side combine and no row is multiplied; the
driver sees counts, brackets and at most ``collect_limit`` values per bracket.  A
sketch narrows a bracket some ``ACCURACY``-fold, so two passes do for 10^7 rows
and four for 10^13.  The result equals ``percentile`` / DuckDB ``quantile_cont``:
``v[k] + (p - k) * (v[k+1] - v[k])`` with ``p = q * (n - 1)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 2000             # a sketch's ranks are off by at most 1/ACCURACY of its rows
COLLECT_LIMIT = 50_000


@dataclass
class Bracket:
    """Ranks (0-based) that lie between two values of a column, ends included."""

    group: str
    col: str
    lo: float
    hi: float
    most: int                 # rows that can lie strictly between
    ranks: list[int] = field(default_factory=list)


def _grouped(df: DataFrame, cols: Sequence[str], group_col: str | None) -> DataFrame:
    """Group as text and the columns as doubles, NaN as null."""
    g = F.col(group_col).cast("string") if group_col else F.lit("")
    if group_col:
        df = df.where(F.col(group_col).isNotNull())
    return df.select(g.alias("_g"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}")
                                      for i, c in enumerate(cols)])


def _sketch(v: Column, shares: Sequence[float]) -> Column:
    return F.percentile_approx(v, F.array(*[F.lit(float(s)) for s in shares]), F.lit(ACCURACY))


def exact_percentiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                      group_col: str | None = None, collect_limit: int = COLLECT_LIMIT) -> dict:
    """Return ``{(group, col, q): value}`` (group is ``''`` when ungrouped).

    Nulls and NaN are ignored, rows without a group too; a (group, column) without
    values is absent.
    """
    cols, qs = list(dict.fromkeys(cols)), list(qs)
    if not cols or not qs:
        return {}
    rows = _grouped(df, cols, group_col)
    shares = [x for q in qs for x in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    first = rows.groupBy("_g").agg(*[a for i in range(len(cols)) for v in [F.col(f"_v{i}")] for a in (
        F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), _sketch(v, shares).alias(f"s{i}"))]).collect()
    wanted: dict = {}
    values: dict = {}
    open_: list[Bracket] = []
    ends: dict = {}
    for r in first:
        for i, c in enumerate(cols):
            n = r[f"n{i}"]
            if not n:
                continue
            ends[r["_g"], c] = (r[f"min{i}"], r[f"max{i}"])
            for j, q in enumerate(qs):
                pos = q * (n - 1)
                k = math.floor(pos)
                ranks = {k, min(k + 1, n - 1)}
                wanted[r["_g"], c, q] = (k, min(k + 1, n - 1), pos - k)
                # the sketch's values at the ends are not relied upon
                lo = r[f"s{i}"][2 * j] if q > 4 / ACCURACY else r[f"min{i}"]
                hi = r[f"s{i}"][2 * j + 1] if q < 1 - 4 / ACCURACY else r[f"max{i}"]
                open_.append(Bracket(r["_g"], c, lo, hi, _most(n), sorted(ranks)))
    while open_:
        open_ = _narrow(rows, cols, open_, ends, values, collect_limit, group_col is not None)
    result: dict = {}
    for (g, c, q), (k0, k1, frac) in wanted.items():
        lo_v, hi_v = values[g, c, k0], values[g, c, k1]
        result[g, c, q] = lo_v if frac == 0 or lo_v == hi_v else lo_v + (hi_v - lo_v) * frac
    return result


def _most(n: int) -> int:
    """Rows that can lie strictly between the two values of a sketch of ``n`` rows."""
    return min(n, 8 * n // ACCURACY + 8)


def _narrow(rows: DataFrame, cols: Sequence[str], brackets: list[Bracket], ends: dict, values: dict,
            collect_limit: int, grouped: bool) -> list[Bracket]:
    """One wide pass over all brackets: settles ranks into ``values``, returns what stays open."""
    place = {c: i for i, c in enumerate(cols)}
    by_group: dict[str, list[Bracket]] = {}
    for b in brackets:
        by_group.setdefault(b.group, []).append(b)
    slots = max(map(len, by_group.values()))
    if grouped:  # every group has brackets of its own: one small row of them per group
        bounds = rows.sparkSession.createDataFrame(
            [(g, [place[b.col] for b in own], [b.lo for b in own], [b.hi for b in own], [b.most <= collect_limit for b in own])
             for g, own in by_group.items()], "_g string, _c array<int>, _lo array<double>, _hi array<double>, _few array<boolean>")
        joined = rows.join(F.broadcast(bounds), "_g")
        every = F.array(*[F.col(f"_v{i}") for i in range(len(cols))])
        parts = [(F.get(every, F.get("_c", F.lit(k))), F.get("_lo", F.lit(k)), F.get("_hi", F.lit(k)), F.get("_few", F.lit(k)))
                 for k in range(slots)]
    else:
        joined = rows
        parts = [(F.col(f"_v{place[b.col]}"), F.lit(b.lo), F.lit(b.hi), F.lit(b.most <= collect_limit)) for b in brackets]
    aggs = []
    for k, (v, lo, hi, few) in enumerate(parts):
        inside = (v > lo) & (v < hi)
        aggs += [F.count(F.when(v < lo, 1)).alias(f"below{k}"), F.count(F.when(v <= lo, 1)).alias(f"upto{k}"),
                 F.count(F.when(v < hi, 1)).alias(f"under{k}"), F.count(F.when(v <= hi, 1)).alias(f"all{k}"),
                 F.min(F.when(inside, v)).alias(f"least{k}"), F.max(F.when(inside, v)).alias(f"most{k}"),
                 F.collect_list(F.when(few & inside, v)).alias(f"got{k}"),
                 _sketch(F.when(~few & inside, v), [j / 256 for j in range(257)]).alias(f"s{k}")]
    found = {r["_g"]: r for r in joined.groupBy("_g").agg(*aggs).collect()}
    left = []
    for g, own in by_group.items():
        r = found[g]
        for k, b in enumerate(own):
            below, upto, under, all_ = (r[f"{x}{k}"] for x in ("below", "upto", "under", "all"))
            got = sorted(r[f"got{k}"]) if b.most <= collect_limit else None
            lower, between, upper = [], [], []
            for rank in b.ranks:
                if rank < below:                     # a sketch that missed: search outside
                    lower.append(rank)
                elif rank >= all_:
                    upper.append(rank)
                elif rank < upto:
                    values[g, b.col, rank] = b.lo
                elif rank >= under:
                    values[g, b.col, rank] = b.hi
                elif got is not None and len(got) == under - upto:
                    values[g, b.col, rank] = got[rank - upto]
                else:
                    between.append(rank)
            least, most = ends[g, b.col]
            if lower:
                left.append(Bracket(g, b.col, least, b.lo, below, lower))
            if upper:
                left.append(Bracket(g, b.col, b.hi, most, all_, upper))
            for rank in between:
                n, marks = under - upto, r[f"s{k}"]
                lo, hi = r[f"least{k}"], r[f"most{k}"]
                if marks and n > collect_limit:
                    at = (rank - upto) / max(n - 1, 1) * 256
                    j = math.floor(at)
                    lo = marks[j - 1] if j >= 2 else lo
                    hi = marks[j + 2] if j + 2 <= 255 else hi
                    n = min(n, 4 * n // 256 + 8 * n // ACCURACY + 8)
                left.append(Bracket(g, b.col, lo, hi, n, [rank]))
    return left
