"""Exact quantiles by distributed selection, with a state of fixed size.

A round counts the values of each bracket in BUCKETS equal parts, with each part's least and greatest value; tasks combine
their counts before the shuffle, and the driver gets at most BUCKETS rows a bracket. A part that holds a wanted rank becomes the next bracket, until its
values are all equal. A bracket's ends fall into different parts, so each round leaves fewer different values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def quantiles(df: DataFrame, columns: Mapping[str, Column], at: Sequence[float]) -> dict[str, list[float | None]]:
    """For each named expression its quantiles at shares of 0 to 1, interpolated between neighbours; None without values.

    Values are doubles; nulls and NaN don't count, an infinite value raises. df is read once a round, narrow and unsorted: save what is costly first.
    """
    names = list(columns)
    values = df.select(*[F.nanvl(e.cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, e in enumerate(columns.values())])
    first = values.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    position = {(c, p): p * (first[f"n{i}"] - 1) for i, c in enumerate(names) for p in at if first[f"n{i}"]}
    wanted = sorted({(names.index(c), k) for (c, _), x in position.items() for k in (math.floor(x), math.ceil(x))})
    if any(math.isinf(first[f"{n}{i}"]) for i, _ in wanted for n in ("low", "high")):
        raise ValueError("quantiles of infinite values")
    found: dict[tuple[int, int], float] = {}
    # each wanted (column, rank) has a bracket (column, low, high) and the number of values below it
    open_ = {(i, k): ((i, first[f"low{i}"], first[f"high{i}"]), 0) for i, k in wanted}
    while open_:
        for t, ((_, low, high), _) in list(open_.items()):
            if low == high:
                found[t] = low
                del open_[t]
        brackets = sorted({b for b, _ in open_.values()})
        if not brackets:
            break
        counts = _count(values, brackets)
        for t, (b, below) in list(open_.items()):
            for n, low, high in counts[brackets.index(b)]:
                if below + n > t[1]:
                    open_[t] = ((b[0], low, high), below)
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for p in at:
            x = position.get((c, p))
            if x is None:
                out[c].append(None)
                continue
            low, high = found[i, math.floor(x)], found[i, math.ceil(x)]
            out[c].append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out


def _count(values: DataFrame, brackets: list[tuple[int, float, float]]) -> list[list[tuple[int, float, float]]]:
    """For each bracket (n, least, greatest) of its parts in order, without the empty ones."""
    parts = []
    for j, (i, low, high) in enumerate(brackets):
        x = F.col(f"x{i}")
        share = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)  # halves, so that no difference overflows
        part = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS).cast("int"))
        parts.append(F.when((x >= low) & (x <= high), F.struct(F.lit(j).alias("j"), part.alias("part"), x.alias("x"))))
    each = values.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).select("s.*")
    rows = each.groupBy("j", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out: list[list[tuple[int, float, float]]] = [[] for _ in brackets]
    for r in sorted(rows, key=lambda r: (r["j"], r["part"])):
        out[r["j"]].append((r["n"], r["low"], r["high"]))
    return out
