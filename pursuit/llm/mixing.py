"""Mixing sources to target weights by entropy balancing.

Among all document rates r_i in [0, 2] that meet sum(r_i size_i) = target in each source, those
nearest to 1 in relative entropy are r_i = min(2, exp(l size_i)): exponential tilts with one dual
variable l a source. The dual is convex; Newton steps on it need two sums a source, which Spark
aggregates over a (source, size) table. Rates are then rounded to copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, remove

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
STEPS = 60
TOLERANCE = 1e-7
#: Documents of one source and size are dealt copies in parts of about so many.
PART = 4096
#: The table of sources and sizes is broadcast up to so many rows (counted first), else joined by key.
BROADCAST_ROWS = 200_000
_EXACT = "decimal(38,9)"


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    In order of code points, null last, sources get the weights in turn. They split ``share`` of all
    sizes by weight; targets stop at cap x size and the excess is shared again by weight: target =
    min(cap x size, weight x level), where the level comes from the running sums of the sources in
    order of cap x size / weight. The windows run over one row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("all", share * F.sum("source_size").over(Window.partitionBy()).cast("double"))
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(ratio))
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("final", final).select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("final")), F.col("most")).alias("target"))


def solve(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, tilt): the dual variable of each source, per word, by safeguarded Newton steps.

    ``sizes``: (source, size, n); ``goals``: (source, source_size, target). Each step aggregates
    over ``sizes`` and keeps (tilt, low, high) of each source in a table; sums are exact decimals, so
    reruns agree whatever the order of the rows. A source whose target is cap x size is saturated.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    unit = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    base = goals.join(unit.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = base.where("source_size > 0").withColumn("full", F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = cut(base.select("source", "target", "mean", F.col("full").alias("done"), F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")), "tilts")
    for _ in range(STEPS):
        at = state.where("not done").select("source", "tilt", "mean")
        rows = sizes.withColumnRenamed("source", "s").join(at, F.col("s").eqNullSafe(F.col("source")))
        scaled = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * scaled, F.lit(50.0))))
        weighed = rate * F.col("size") * F.col("n")
        sums = rows.groupBy("source").agg(F.sum(weighed.cast(_EXACT)).cast("double").alias("got"), F.sum(F.when(rate < cap, weighed * scaled).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"))
        moved = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("got") - F.col("target")
        close = F.col("done") | (F.abs(over) <= TOLERANCE * F.col("target"))
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = moved.withColumn("close", close).withColumn("lo", low).withColumn("hi", high)
        newton = F.col("tilt") - over / F.greatest(F.col("slope"), F.lit(1e-300))
        bounded = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("tilt")) <= 2 + F.abs(F.col("tilt")))
        step = F.when(inside, newton).when(bounded, (F.col("lo") + F.col("hi")) / 2).when(over > 0, F.col("tilt") - 1 - F.abs(F.col("tilt"))).otherwise(F.col("tilt") + 1 + F.abs(F.col("tilt")))
        done = F.col("close") | (bounded & (F.col("hi") - F.col("lo") <= 1e-13 * (1 + F.abs(F.col("tilt")))))
        last = state
        state = cut(moved.select("source", "target", "mean", done.alias("done"), F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), F.col("lo").alias("low"), F.col("hi").alias("high")), "tilts")
        remove(state.sparkSession, last)
        if state.where("not done").isEmpty():
            break
    return state.select("source", (F.col("tilt") / F.col("mean")).alias("tilt"))


def deal(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies for each size of one source: rates rounded with the error carried to the next smaller size.

    A source of W words has at most sqrt(2 W) sizes, so one source's sizes fit one task.
    """
    rows = rows.sort_values("size", ascending=False)
    copies, owed = [], 0.0
    for size, n, tilt in zip(rows["size"], rows["n"], rows["tilt"]):
        if size == 0:
            copies.append(int(n))
            continue
        want = min(float(cap), float(np.exp(min(tilt * size, 50.0)))) * n * size + owed
        k = int(min(cap * n, max(0, np.floor(want / size + 0.5))))
        owed = want - k * size
        copies.append(k)
    return rows[["source", "size", "n"]].assign(copies=np.array(copies, np.int64))


def copies_by_size(sizes: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies): how many copies the documents of a source and size get together."""
    rows = sizes.withColumnRenamed("source", "s").join(tilts, F.col("s").eqNullSafe(F.col("source")), "left")
    rows = rows.select(F.col("s").alias("source"), "size", "n", F.coalesce("tilt", F.lit(0.0)).alias("tilt"))
    return rows.groupBy("source").applyInPandas(lambda x: deal(x, cap), "source string, size long, n long, copies long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``.

    size counts words (null text: 0). Documents of a source and size share one total of copies; it
    is dealt out evenly, in hash order of the ids, in parts of bounded size, so that one source or
    one size with most of the rows is no hot task. Documents without words get one copy of nothing.
    Null sources are a source, the last one; null ids and repeated rows are rows like any other (equal
    rows may trade copies). Sources without words have target 0. Extra columns are not read; an empty
    table gives no rows. Sums are exact and orders total, so reruns agree.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = cut(rows, "sizes")
    sizes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    goals = cut(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "targets")
    dealt = cut(copies_by_size(sizes, solve(sizes, goals, cap), cap), "copies")
    facts = goals.withColumnRenamed("source", "g").join(dealt, F.col("g").eqNullSafe(F.col("source"))).drop("g")
    key = lambda a: [F.col("source").isNull().alias(f"{a}_none"), F.coalesce("source", F.lit("")).alias(f"{a}_source"), F.col("size").alias(f"{a}_size")]
    facts = facts.select(*key("f"), "source_size", "target", "n", "copies")
    rows = rows.select("doc_id", *key("d"))
    order: Column = F.xxhash64("doc_id")
    small = dealt.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(facts) if small else facts, (F.col("d_none") == F.col("f_none")) & (F.col("d_source") == F.col("f_source")) & (F.col("d_size") == F.col("f_size")))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("n") / PART))
    out = out.withColumn("part", part).drop("f_none", "f_source", "f_size")
    own = ["d_none", "d_source", "d_size", "part"]
    if not small:  # else the parts of one size would stay in the join's one task
        out = out.repartition(*own)
    extra = out.groupBy(*own).agg(F.count("*").alias("m"), (F.first("copies") % F.first("n")).alias("rest"), F.first("n").alias("all"))
    upto = F.sum("m").over(Window.partitionBy("d_none", "d_source", "d_size").orderBy("part"))
    floor = lambda c: F.floor(c * F.col("rest") / F.col("all"))
    extra = extra.withColumn("upto", upto).withColumn("more", floor(F.col("upto")) - floor(F.col("upto") - F.col("m"))).select(*own, "more")
    out = out.join(extra, own)
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(order, "doc_id"))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    out = out.withColumn("rank", rank).withColumn("copies", copies.cast("long"))
    return out.select("doc_id", F.col("d_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("d_size")).alias("taken"), "copies")
