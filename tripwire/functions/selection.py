"""Exact k-th smallest md5 key per group, without sorting the table.

"The first k rows in md5 order" (exact sample, stratified split quotas,
per-class caps) is the set of rows whose key is below the k-th smallest
key.  That cut-off is found by narrowing on the key's 60-bit hex prefix:
each pass counts rows per (group, prefix bucket) — a scan with map-side
combine and at most ``groups × 2^bits`` result rows — and keeps the bucket
holding rank k; once a bucket holds at most ``collect_limit`` rows its full
keys are fetched and the cut-off read off directly.  Then the selection is
a narrow filter ``key < cutoff`` that keeps the table's partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BITS = 60            # 15 hex digits of the md5
BITS = 12                   # 4096 buckets per pass
COLLECT_LIMIT = 50_000


def key_prefix(key: str) -> Column:
    return F.conv(F.substring(F.col(key), 1, 15), 16, 10).cast("long")


def kth_keys(df: DataFrame, key: str, ks: dict, group: str | None = None,
             sizes: dict | None = None, bits: int = BITS,
             collect_limit: int = COLLECT_LIMIT) -> dict:
    """``{group_value: cutoff}`` with exactly ``ks[g]`` rows of group g having
    ``key < cutoff``; ``None`` when ``ks[g]`` is at least the group size.
    Keys must be unique inside a group and, beyond ``collect_limit`` rows,
    hex strings (md5 row keys are both)."""
    spark = df.sparkSession
    g = F.col(group) if group else F.lit(0)
    pfx = F.col("row_pfx") if "row_pfx" in df.columns else key_prefix(key)
    base = df.select(g.alias("g"), F.col(key).alias("k"), pfx.alias("p"))
    # state per group: prefix interval [lo, lo + 2^width), rows below it
    state = {gv: {"lo": 0, "width": PREFIX_BITS, "below": 0, "k": k} for gv, k in ks.items()}
    out: dict = {}
    for gv, n in (sizes or {}).items():
        if gv in state:
            if state[gv]["k"] >= n:
                out[gv] = None              # the whole group qualifies
                del state[gv]
            else:
                state[gv]["count"] = n      # small groups are fetched at once
    while state:
        spec = spark.createDataFrame(
            [(gv, st["lo"], st["width"], st.get("count", -1)) for gv, st in state.items()],
            f"g {base.schema['g'].dataType.simpleString()}, lo long, width int, cnt long")
        # the first round covers the whole key space: no prefix test needed
        inside = base.join(F.broadcast(spec), on="g").filter(
            (F.col("width") == PREFIX_BITS) | (
                (F.col("p") >= F.col("lo")) &
                (F.col("p") < F.col("lo") + F.expr("shiftleft(CAST(1 AS BIGINT), width)"))))
        small = [gv for gv, st in state.items() if 0 <= st.get("count", -1) <= collect_limit]
        nxt: dict = {}
        if small:
            rows = (inside.filter(F.col("g").isin(small)).groupBy("g")
                    .agg(F.sort_array(F.collect_list("k")).alias("keys")).collect())
            got = {r.g: r.keys for r in rows}
            for gv in small:
                st = state[gv]
                keys = got.get(gv, [])
                idx = st["k"] - st["below"]
                out[gv] = keys[idx] if idx < len(keys) else None
        big = [gv for gv in state if gv not in small]
        if big:
            bucket = F.expr(f"shiftright(p - lo, greatest(width - {bits}, 0))")
            hist = (inside.filter(F.col("g").isin(big)).groupBy("g", bucket.alias("b"))
                    .agg(F.count(F.lit(1)).alias("n")).collect())
            by_g: dict = {}
            for r in hist:
                by_g.setdefault(r.g, []).append((r.b, r.n))
            for gv in big:
                st = state[gv]
                total = sum(n for _, n in by_g.get(gv, []))
                if st["k"] - st["below"] >= total:
                    out[gv] = None          # k reaches past the group: everything qualifies
                    continue
                step = max(st["width"] - bits, 0)
                below = st["below"]
                for b, n in sorted(by_g.get(gv, [])):
                    if below + n > st["k"]:
                        # width 0 = one prefix value: fetch it whatever its size
                        nxt[gv] = {"lo": st["lo"] + (b << step), "width": step, "below": below,
                                   "k": st["k"], "count": n if step else min(n, collect_limit)}
                        break
                    below += n
        state = nxt
    return out


def below_cutoff(key: str, cutoffs: dict, group: str | None = None) -> Column:
    """Predicate ``key < cutoff`` of the row's group (``None`` → all rows)."""
    if group is None:
        c = cutoffs.get(0)
        return F.lit(True) if c is None else (F.col(key) < F.lit(c))
    expr = None
    for gv, c in cutoffs.items():
        cond = F.lit(True) if c is None else (F.col(key) < F.lit(c))
        expr = (F.when(F.col(group) == F.lit(gv), cond) if expr is None
                else expr.when(F.col(group) == F.lit(gv), cond))
    return F.coalesce(expr.otherwise(F.lit(False)), F.lit(False)) if expr is not None else F.lit(False)
