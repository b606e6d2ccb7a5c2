"""Mixing sources to target weights by entropy balancing (operator 12).

Of all ways to take documents at rates between 0 and ``cap`` that give each source its target of words,
entropy balancing takes the one nearest to taking every document once: the sum of r ln r - r is least.
Its dual is convex with one multiplier for each source, and the rates are exponentially tilted,

    r = min(cap, exp(tilt * size / mean size of the source)).

Newton's iterations run for all sources at once over the histogram of (source, size): one aggregation
gives the gradient (words taken less target) and the curvature; a step that leaves the bracket known to
hold the root is replaced by halving it. Sums are exact decimals, so that reruns give the same bits.

Targets: sources, by code point and null last, weigh 5, 2, 1, repeating, and share all words; what is
above ``cap`` times a source's size is shared again by weight until none is above.

Rounding: from the largest size down, a source's cell of equal sizes takes the whole number of copies
nearest to its words and what was left over above, so a source misses its target by at most half of its
least documents (or by what whole copies cannot give). A cell's copies are dealt evenly, and the odd ones
go to the documents of least hash, found by salts first, so that no cell is ranked in one task.

Bounds: one source's cells are settled in one task; k different sizes need at least k*k/2 words, so
10**13 words have at most 4.5 million cells. Targets need two sums a round on the driver.

Defined results: a null or empty text has size 0 and takes 0 words; the null source is a source like
others; documents of null or equal id are told apart by their text, and equal rows by nothing, so one of
them may get more copies than the other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Parts of a word to which sums are rounded, salts of a cell, and Newton's steps at most.
PARTS, SALTS, STEPS = 1 << 16, 64, 200


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; no array of words is made."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def exact_sum(x: Column) -> Column:
    """A sum of doubles that does not depend on their order."""
    return (F.sum(F.round(x * PARTS).cast("decimal(38,0)")) / F.lit(PARTS)).cast("double")


def with_targets(sources: DataFrame, cap: int) -> DataFrame:
    """Adds target to (total, weight): weight times a level, or cap times total where that is less."""
    limit = F.col("total") * F.lit(cap)
    words, weights = sources.agg(F.sum("total"), F.sum("weight")).first()
    level, capped = (words or 0) / (weights or 1), -1
    while True:
        above = F.col("weight") * F.lit(level) > limit
        now = sources.agg(F.count_if(above), F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if now[0] == capped or not now[0] or not now[2]:
            return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))
        capped, level = now[0], (words - now[1]) / now[2]


def rate_of(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))


def tilts(cells: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """The dual's solution (tree, mean, tilt) of each source with words; cells: (tree, size, n)."""
    mean = F.col("total") / F.col("filled")
    full = F.col("target") >= F.col("total") * F.lit(cap)
    low = F.least(mean * F.log(F.col("target") / F.col("total")), F.lit(0.0))  # no size is under 1, so there the rates give too little,
    high = mean * F.lit(float(np.log(cap)))  # and here all rates are at the cap
    state = sources.where("total > 0").select("tree", "target", mean.alias("mean"), F.when(full, high).otherwise(F.lit(0.0)).alias("tilt"), low.alias("low"), high.alias("high"), full.alias("done"))
    state = written(state, "tilts")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        words, rate = F.col("n") * F.col("size"), rate_of(cap)
        bends = F.when(rate < cap, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = cells.join(state.where("not done").select("tree", "mean", "tilt"), "tree").groupBy("tree").agg(exact_sum(words * rate).alias("taken"), exact_sum(bends).alias("bend"))
        state = written(newton_step(state.join(sums, "tree", "left")), "tilts")
    return state.select("tree", "mean", "tilt")


def newton_step(found: DataFrame) -> DataFrame:
    over = F.col("taken") - F.col("target")
    low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
    step = F.col("tilt") - over / F.nullif(F.col("bend"), F.lit(0.0))
    inside = (step > low) & (step < high)
    near = F.abs(over) <= F.greatest(F.lit(0.02), F.col("target") * 1e-9)
    moved = F.when(inside, step).otherwise((low + high) / 2)
    done = F.col("done") | near | (moved == F.col("tilt"))
    return found.select("tree", "target", "mean", F.when(done, F.col("tilt")).otherwise(moved).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done"))


def rounded(cap: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        left, copies = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            if not size:
                copies.append(n)
                continue
            want = n * size * rate + left
            copies.append(min(max(int(np.floor(want / size + 0.5)), 0), cap * n))
            left = want - copies[-1] * size
        return cells.assign(copies=np.array(copies, np.int64))[["tree", "size", "n", "rate", "copies"]]

    return run


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (id, size, source_size, target, taken, copies, rate): words of the document, of its source, those wanted of the source, and those the mix takes of the document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("mark"))
    rows = written(rows.withColumn("salt", F.pmod("mark", F.lit(SALTS))), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count_if(F.col("size") > 0).alias("filled"))
    sources = numbered(sources.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "sources").withColumnRenamed("number", "tree")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("tree") % len(weights) + 1).cast("int"))
    sources = written(with_targets(written(sources.drop("missing").withColumn("weight", weight), "weights"), cap), "targets")

    own = sources.select(F.col("source").alias("own"), "tree")
    salted = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")).join(own, F.col("source").eqNullSafe(F.col("own"))).select("tree", "size", "salt", "n")
    salted = written(salted, "salted")
    cells = written(salted.groupBy("tree", "size").agg(F.sum("n").alias("n")), "cells")
    tilt = tilts(cells.where("size > 0"), sources, cap)
    rated = cells.join(tilt, "tree", "left").select("tree", "size", "n", F.coalesce(rate_of(cap), F.lit(1.0)).alias("rate"))
    cells = rated.groupBy("tree").applyInPandas(rounded(cap), "tree long, size long, n long, rate double, copies long")

    base, odd = F.floor(F.col("copies") / F.col("total_n")), F.col("copies") % F.col("total_n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = salted.join(cells.withColumnRenamed("n", "total_n"), ["tree", "size"]).select("tree", "size", "salt", "rate", base.alias("base"), F.greatest(odd - before, F.lit(0)).alias("more"))
    placed = rows.join(own.withColumnRenamed("own", "name"), F.col("source").eqNullSafe(F.col("name"))).select("id", "tree", "size", "salt", "mark")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("tree", "size", "salt").orderBy("mark")))
    copies = F.col("base") + (F.col("place") <= F.col("more")).cast("long")
    out = placed.join(shares, ["tree", "size", "salt"]).join(sources.select("tree", "total", "target"), "tree")
    return out.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate")
