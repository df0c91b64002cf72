"""Pairs that two rankings order differently, counted through a grid of ranks; lists are keys of one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most strips on a side of a list's grid, so that its counts (8 MB) fit a task; longer lists get wider strips.
STRIPS = 1024


def inversions(values: np.ndarray) -> int:
    """Pairs in which the earlier value is greater, bit by bit from the top: ones before zeros among values alike so far."""
    m = len(values)
    r = np.empty(m, np.int64)
    r[np.argsort(values, kind="stable")] = np.arange(m)
    total = 0
    for bit in reversed(range(m.bit_length())):
        one = (r >> bit) & 1
        seen = np.cumsum(one)
        start = np.flatnonzero(np.diff(r >> (bit + 1), prepend=-1))
        base = np.repeat((seen - one)[start], np.diff(start, append=m))
        total += int((seen - base)[one == 0].sum())
        r = r[np.argsort(r >> bit, kind="stable")]
    return total


def discordant_pairs(both: DataFrame, by: list[str], block: int = 20_000) -> DataFrame:
    """by..., n, discordant: of both(by..., ra, rb), each list's ranks from 1 without ties, though not every rank need be there.

    Strips of ranks in a and in b cut a list into cells. Two rows that share no strip are in the order of their cells, so
    those pairs come from counts of cells and their sums above and to the left. The rest share a strip: one that both have in a is
    sorted as a group, and so is one that both have in b, where pairs of one cell are counted once. So each row is read three
    times, whatever the list's length, and a group is a strip of about `block` ranks, or the length / STRIPS.
    """
    kinds = "".join(f"{c} {both.schema[c].dataType.simpleString()}, " for c in by)
    longest = F.max(F.greatest("ra", "rb"))
    size = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.ceil(longest / F.least(F.lit(STRIPS), F.ceil(longest / F.lit(block)))).cast("long").alias("_width"))
    rows = both.select(*by, F.col("ra").cast("long").alias("ra"), F.col("rb").cast("long").alias("rb"))
    rows = rows.join(size, by) if by else rows.join(F.broadcast(size))  # one row
    at = lambda c: F.floor((F.col(c) - 1) / F.col("_width")).cast("int")
    rows = rows.select(*by, "ra", "rb", at("ra").alias("_i"), at("rb").alias("_j"))
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("_side"), F.col(strip).alias("_strip")) for side, strip in (("a", "_i"), ("b", "_j"))]))
    strips = rows.select(*by, "ra", "rb", "_j", sides.alias("_x")).select(*by, "_x._side", "_x._strip", "ra", "rb", "_j")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ra")
        found = inversions(group["rb"].to_numpy())
        if group["_side"].iloc[0] == "a":  # less those of one cell: by cells, then by rank in a, only they are out of order
            found -= inversions(group.sort_values(["_j", "ra"])["rb"].to_numpy())
        return pd.DataFrame({**{c: group[c].iloc[:1] for c in by}, "_s": [found]})

    def across(cells: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((cells["_i"].max() + 2, cells["_j"].max() + 1), np.int64)
        grid[cells["_i"], cells["_j"]] = cells["_c"]
        below = grid[::-1].cumsum(0)[::-1]  # rows i and on
        left = below.cumsum(1) - below  # columns before j
        return pd.DataFrame({**{c: cells[c].iloc[:1] for c in by}, "_s": [int((grid[:-1] * left[1:]).sum())]})

    inside = strips.groupBy(*by, "_side", "_strip").applyInPandas(within, f"{kinds}_s long")
    cells = rows.groupBy(*by, "_i", "_j").agg(F.count(F.lit(1)).alias("_c"))
    outside = cells.groupBy(*by).applyInPandas(across, f"{kinds}_s long")
    found = inside.unionByName(outside).groupBy(*by).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("discordant"))
    size = size.select(*by, "n")
    return size.join(found, by) if by else size.join(F.broadcast(found))


def tau(n, discordant):
    """Kendall's tau of n ranks without ties; null below two."""
    pairs = n.cast("double") * (n - 1) / 2
    return F.when(n > 1, 1 - 2 * discordant / pairs)
