"""Mixing sources to target weights by subset sums over document lengths.

Per source, documents are counted by exact length. A pass takes whole lengths in
proportion, a bounded-knapsack dynamic programme fits what is left of the budget, and
documents are picked by seeded hash until each length has its count. Only histograms
reach one task; documents of one length are split by hash buckets.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ship_package

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)   # by the order of sources, repeating
SHARE = 1.5           # of all sizes that the mix takes
MOST = 2              # times its source's size at most
BUCKETS = 1024


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row; size counts words, null has none."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source",
                       word_count().alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: the budget by weight, stopped at ``MOST`` sizes, the excess reshared.

    With sources in order of size by weight, those below the water line take all they may;
    the line is what is left of the budget over the weights above. One row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    rows = by_source.withColumn("_weight", weight.cast("double")) \
        .withColumn("_most", F.col("source_size") * float(MOST))
    rising = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("_most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_line", (F.sum("source_size").over(everything) * SHARE - before) / above) \
        .withColumn("_stopped", F.col("_most") <= F.col("_line") * F.col("_weight"))
    line = F.max("_line").over(everything)  # it rises up to the first source that isn't stopped, then falls
    return rows.select("source", "source_size",
                       F.when(F.col("_stopped"), F.col("_most")).otherwise(line * F.col("_weight")).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest below ``budget``.

    Every length gives its share first. The largest spare documents then fill the rest
    while it is wider than the programme's table, and the programme (reachable sums as
    bits of one number, counts split into powers of two) closes it.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total or total == 0:
        return np.where(lengths > 0, counts if budget > 0 else 0, 0) if budget < total else counts.copy()
    take = np.array([int(c) * max(budget, 0) // total for c in counts.tolist()], np.int64)
    rest = max(budget, 0) - int((lengths * take).sum())
    table = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= table:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    items, reach, states = [], 1, []
    mask = (1 << (rest + 1)) - 1
    for i in np.flatnonzero(lengths > 0):
        spare, part = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while spare > 0 and not (reach >> rest) & 1:
            part = min(part, spare)
            grown = (reach | (reach << (part * int(lengths[i])))) & mask
            if grown != reach:
                items.append((i, part))
                states.append(reach)
                reach = grown
            spare -= part
            part *= 2
    at = reach.bit_length() - 1
    for (i, part), state in zip(reversed(items), reversed(states), strict=True):
        if not (state >> at) & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times of every row of ``docs``.

    ``taken`` is 0, 1 or 2 times the size. A source whose target passes its size is taken
    once as a whole and then fills the rest from a second pass. Null texts and texts
    without words have size 0; null sources are one source, the last; repeated rows count
    each. A pick depends on seed, id and length only, so reruns agree. Empty table: empty.
    """
    return _mixed(sizes(docs), seed)


def take_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns.

    Null ids and null sources match themselves, repeated rows count each. Null texts have
    size 0 and are taken where their source is taken as a whole. Empty table: empty.
    """
    keys = ["doc_id", "source", "size"]
    times = _mixed(sizes(docs), seed).filter("times > 0")
    times = times.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("times"))))
    copies = Window.partitionBy(F.col("doc_id"), F.col("source"), F.col("_size")).orderBy(F.xxhash64("text"))
    rows = docs.withColumn("_size", word_count()).withColumn("_copy", F.row_number().over(copies))
    met = rows.alias("d").join(times.alias("t"), F.expr(
        "d.doc_id <=> t.doc_id AND d.source <=> t.source AND d._size = t.size AND d._copy = t._copy"))
    return met.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("t.times").cast("int")))) \
        .select(*[F.col("d." + c) for c in docs.columns])


def _mixed(sized: DataFrame, seed: int) -> DataFrame:
    goal = targets(sized)
    pick = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    counted = pick.groupBy("source", "size", "_bucket").agg(F.count("*").alias("_n"))
    histogram = counted.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    joined = histogram.alias("h").join(goal.alias("g"), F.expr("h.source <=> g.source")) \
        .selectExpr("h.source", "size", "_n", "source_size", "target")

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        whole, target = int(part.source_size.iloc[0]), float(part.target.iloc[0])
        passes, budget = (1, round(target) - whole) if target >= whole else (0, round(target))
        part["_take"] = fit_counts(part["size"].to_numpy(), part["_n"].to_numpy(), int(budget))
        part["_passes"] = passes
        return part

    ship_package(sized.sparkSession)
    planned = joined.groupBy("source").applyInPandas(
        plan, "source string, size bigint, _n bigint, source_size bigint, target double, _take bigint, _passes bigint")
    before = F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_bucket")) - F.col("_n")
    buckets = counted.select("source", "size", "_bucket", before.alias("_before")).alias("b").join(
        planned.alias("p"), F.expr("b.source <=> p.source AND b.size = p.size")
    ).selectExpr("b.source", "b.size", "b._bucket", "p.source_size", "p.target", "p._passes", "p._take - b._before AS _left")
    rows = pick.alias("d").join(
        buckets.alias("b"), F.expr("d.source <=> b.source AND d.size = b.size AND d._bucket = b._bucket")
    ).selectExpr("d.doc_id", "d.size", "d.source", "d._bucket", "source_size", "target", "_passes", "_left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_bucket")
                               .orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    times = F.col("_passes") + (F.col("_rank") <= F.col("_left")).cast("long")
    return rows.withColumn("_rank", rank).select(
        "doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))
