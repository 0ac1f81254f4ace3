"""Selections, splits, bootstrap replicates and summaries of evaluations."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.sources.storage import written


def validation(key: Column, share: float, seed: int = 0) -> Column:
    """True for about this share of keys, the same ones in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) < int(share * (1 << 53))


def as_table(summary: DataFrame) -> DataFrame:
    """One line of a Markdown table per row of a summary, as column `line`."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in summary.columns]
    return summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def as_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct("*")).alias("line"))


def select_in_order(candidates: DataFrame, rules: list[tuple[str, Column, int]]) -> DataFrame:
    """The first `count` candidates (uid, patient) by hash for each (name, condition, count), one a patient: (rule, uid, patient, id).

    Rules choose one after another and none takes what an earlier one took. Picks
    are as many as the counts say; each rule's are written, so that the next
    reads them and doesn't choose anew.
    """
    chosen = None
    for name, condition, count in rules:
        own = candidates.where(condition)
        if chosen is not None:
            own = own.join(chosen, "uid", "left_anti")
        best = own.groupBy("patient").agg(F.min(F.struct(F.sha2("uid", 256).alias("h"), "uid")).alias("x")).orderBy("x").limit(count)
        picked = written(best.select(F.lit(name).alias("rule"), "x.uid", "patient", F.concat(F.lit(f"{name}-"), F.left("x.h", F.lit(8))).alias("id")), "picks")
        chosen = picked if chosen is None else chosen.union(picked)
    return chosen


#: Cumulative probabilities of a Poisson(1) count; what lies beyond is below 1e-16.
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(18)])


#: Rows and replicates counted at a time, so that the counts stay in a core's cache.
_ROWS, _REPS = 256, 250
#: The count for the upper 16 bits of a draw, or _UNSURE where the lower ones decide.
_UNSURE = 255
_EDGES = np.searchsorted(_POISSON, np.arange((1 << 16) + 1) / (1 << 16), side="right")
_BY_TOP = np.where((_EDGES[:-1] == _EDGES[1:]) & (np.arange(1 << 16) < (1 << 16) - 1), _EDGES[:-1], _UNSURE).astype(np.uint8)


def _counts(ids: np.ndarray, reps: int | np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts (ids, reps), each a function of its id, replicate and the seed; reps is their number or the replicates."""
    own = np.arange(reps, dtype=np.uint64) if isinstance(reps, int) else reps
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + ((own + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0xD1B54A32D192ED03))[None, :]
    y = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    np.right_shift(x, np.uint64(48), out=y)  # the last step of the mixer leaves the upper 33 bits as they are
    out = _BY_TOP[y.view(np.int64)]
    some = np.flatnonzero(out.reshape(-1) == _UNSURE)
    z = x.reshape(-1)[some]
    out.reshape(-1)[some] = np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
    return out


def replicate_means(rows: DataFrame, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Means of bootstrap replicates of rows (id, group, value): (group, rep, mean).

    Poisson resampling: a row counts Poisson(1) times in a replicate, so tasks fold
    sums of their own and no sample is gathered. Null values are left out.
    """

    every = np.arange(reps, dtype=np.uint64)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for group, own in batch.groupby("group"):
                total = sums.setdefault(group, np.zeros((2, reps)))
                ids, values = own["id"].to_numpy(), np.stack([own["value"].to_numpy(), np.ones(len(own))])
                for at in range(0, len(own), _ROWS):
                    part = slice(at, at + _ROWS)
                    for r in range(0, reps, _REPS):
                        total[:, r : r + _REPS] += values[:, part] @ _counts(ids[part], every[r : r + _REPS], seed).astype(np.float64)
        for group, t in sums.items():
            yield pd.DataFrame({"group": group, "rep": np.arange(reps), "total": t[0], "n": t[1]})

    parts = rows.where("value IS NOT NULL").select("id", "group", "value").mapInPandas(fold, "group string, rep int, total double, n double")
    return parts.groupBy("group", "rep").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean"))
