"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. A source's target is met by whole rounds of all its documents plus a rest; the
rest is a subset-sum problem over the counts, whose best sum (the largest that doesn't exceed it) is found by dynamic programming.
So that the taken documents are spread over the sizes as the source's are, a proportional share of each size is fixed first and the
programme works on what remains; where that doesn't reach the budget exactly, the share is revised: ever more of it is given back,
at last all of it, so that the sum is the best one reachable. Which documents of a size are taken follows a seeded hash, so reruns agree.

Nothing gathers a source's documents in one place: a task that fits a source sees one row per size, and the choice among
documents of one size is made in pieces of about ``PIECE`` documents, cut by the same hash. The driver sees one row per source, as
targets depend on all sources; their number is not bounded, but each is a name and a number. Where a source of many documents
can't reach its budget, which needs sizes that leave gaps (a common divisor is taken out first), the last programme takes 8 bytes for
each word of the budget.

Cases: a null text has size 0; a null source is a source of its own, the last; sizes 0 take nothing; repeated rows are rows of
their own, chosen as by ties of the hash (then by id, then by ``row_col``); very long texts are a size of their own; an empty table
gives an empty result; a null doc_id hashes like any value; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import word_count, written

WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, 7
PIECE = 2048
#: Words that the first programme leaves to itself; each further one takes so many times more.
FIRST, MORE = 1 << 15, 16


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """The sum of sizes shared by weight; none above ``most`` times its size, the excess shared again by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def best_sum(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each size (all positive) to take for the largest sum that doesn't exceed the budget, by dynamic programming."""
    # For each sum the step by which it was first reached; counts are split in powers of two, largest sizes first.
    reached, steps = np.full(budget + 1, -1, np.int64), [(-1, 0)]
    reached[0] = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left, n = min(counts[i], budget // sizes[i]), 1
        while left and reached[budget] < 0:
            n = min(n, left)
            by = n * sizes[i]
            new = np.flatnonzero((reached[:-by] >= 0) & (reached[by:] < 0)) if by <= budget else np.empty(0, np.int64)
            reached[new + by] = len(steps)
            steps.append((i, n))
            left, n = left - n, 2 * n
    take, at = [0] * len(sizes), int(np.flatnonzero(reached >= 0)[-1])
    while at:
        i, n = steps[reached[at]]
        take[i] += n
        at -= n * sizes[i]
    return take


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that they sum to the budget, or to the largest sum below it that can be reached."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    some = [i for i, s in enumerate(sizes) if s and counts[i]]
    part = math.gcd(*[sizes[i] for i in some])
    size, count = [sizes[i] // part for i in some], [counts[i] for i in some]
    budget, total, free = budget // part, total // part, FIRST
    while True:
        take = [c * max(0, budget - free) // total for c in count]
        rest = budget - sum(s * t for s, t in zip(size, take, strict=True))
        if free < budget:  # the largest sizes take what is above
            for i in sorted(range(len(size)), key=lambda i: -size[i]):
                n = max(0, min(count[i] - take[i], (rest - free // 2) // size[i]))
                take[i] += n
                rest -= n * size[i]
        more = best_sum(size, [c - t for c, t in zip(count, take, strict=True)], rest)
        rest -= sum(s * m for s, m in zip(size, more, strict=True))
        if not rest or free >= budget:
            out = [0] * len(sizes)
            for i, t, m in zip(some, take, more, strict=True):
                out[i] = t + m
            return out
        free *= MORE


def _pick(g: pd.DataFrame, most: int) -> pd.DataFrame:
    g = g.sort_values("size").reset_index(drop=True)
    source_size, budget = int((g["size"] * g["n"]).sum()), int(round(g["target"][0]))
    rounds, rest = (min(budget // source_size, most), 0) if source_size else (0, 0)
    if source_size and rounds < most:
        rest = budget - rounds * source_size
    return g.assign(rounds=rounds, extra=fit(g["size"].tolist(), g["n"].tolist(), rest) if rest else 0, source_size=source_size)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, size: Column | None = None, row_col: str | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, copies (how often the mix takes it), taken (copies * size).

    The columns are named ``id_col`` and as above, whatever else docs holds. ``size``: another measure than words.
    ``row_col``: a column that tells rows of one id apart; it is carried along and settles ties of equal ids.
    """
    row = [] if row_col is None else ["row"]
    sized = written(docs.select(*[F.col(row_col).alias(r) for r in row], F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (word_count(F.col(text_col)) if size is None else size).cast("long").alias("size")), "mix-sizes")
    spark = docs.sparkSession
    cells = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    # One row per source.
    totals = sorted(((r["source"], int(r["total"])) for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([t for _, t in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    goal = spark.createDataFrame([(s, x) for (s, _), x in zip(totals, wanted, strict=True)], "source string, target double")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    fit_in = cells.join(goal, same(cells, goal, "source")).select(cells["source"], "size", "n", "target")
    plan = fit_in.groupBy("source").applyInPandas(lambda g: _pick(g, most), "source string, size long, n long, target double, rounds int, extra long, source_size long")
    plan = written(plan.withColumn("pieces", F.ceil(F.col("n") / PIECE)), "mix-plan")
    h = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = sized.join(plan, same(sized, plan, "source", "size")).select("id", *row, sized["source"], sized["size"], "n", "target", "source_size", "rounds", "extra", h.alias("h"), F.pmod(F.shiftright(h, 20), F.col("pieces")).alias("piece"))
    # Sizes whose documents are all taken, or none, need no choice.
    open_ = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    choice = keyed.where(open_)
    per = choice.groupBy("source", "size", "piece", "extra").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("piece").alias("p_piece"), F.greatest(F.lit(0), F.col("extra") - before).alias("quota"))
    ranked = choice.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "piece").orderBy("h", "id", *row)))
    chosen = ranked.join(per, [F.col("source").eqNullSafe(F.col("p_source")), F.col("size") == F.col("p_size"), F.col("piece") == F.col("p_piece")]).withColumn("more", (F.col("rank") <= F.col("quota")).cast("int"))
    cols = ["id", *row, "source", "size", "source_size", "target", "rounds", "more"]
    whole = keyed.where(~open_).withColumn("more", (F.col("extra") > 0).cast("int"))
    copies = (F.col("rounds") + F.col("more")).cast("int")
    return whole.select(*cols).unionByName(chosen.select(*cols)).select(F.col("id").alias(id_col), *[F.col(r).alias(row_col) for r in row], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
