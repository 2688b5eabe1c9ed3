"""Hard negatives by Kronecker-packed products.

Components become integers. Those of several candidates are biased to be non-negative
and laid into separated fields of one wide integer, so that one multiplication per
anchor component advances the scores of all of them. Sums are kept modulo 2^64 (fields
are as wide as the final scores need, by the Cauchy-Schwarz bound of the tile); where a
score doesn't fit 32 bits, Python's unbounded integers take the place of 64-bit words.

All rows are dealt into blocks of bounded size; every block of anchors meets every block
of rows in one task, which hands on only its best few per anchor. Two such passes: the
positives of every anchor, then the best rows inside each positive's band.
"""

from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ship_package
from riskloom.session import staged

SCALE = 256
N_CLASSES = 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95            # band of a negative's score, in percent of the positive's
ANCHOR_BLOCK, ROW_BLOCK = 2048, 8192
TILE = 64                     # anchors multiplied at a time
MOST = (1 << 62) // 100       # scores beyond are cut to this bound

_PAIRS = ("anchor_id bigint, anchor_copy bigint, row_id bigint, row_copy bigint, positive_id bigint, "
          "positive_copy bigint, positive_score bigint, score bigint")
_NAMES = [c.split()[0] for c in _PAIRS.split(", ")]


def field_bits(left: np.ndarray, right: np.ndarray) -> int:
    """Bits of a field that holds every inner product of the rows of both sides, sign included."""
    def longest(x):
        return max((isqrt(sum(v * v for v in row)) + 1 for row in x.tolist()), default=1)

    if left.dtype != object and right.dtype != object:
        norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) * (1 + 1e-9) + 1
        return int(norm(left) * norm(right)).bit_length() + 1
    return (longest(left) * longest(right)).bit_length() + 1


class Packed:
    """Candidates packed for products with any number of anchors."""

    def __init__(self, rows: np.ndarray, bits: int):
        self.n, self.bits = len(rows), bits
        self.wide = bits > 32 or rows.dtype == object
        self.fields = 16 if self.wide else 64 // bits
        self.bias = int(-rows.min(initial=0))
        groups = ceil(max(self.n, 1) / self.fields)
        kind = object if self.wide else np.uint64
        biased = np.zeros((groups * self.fields, rows.shape[1]), kind)
        biased[: self.n] = (rows.astype(kind) if self.wide else rows) + self.bias
        parts = biased.reshape(groups, self.fields, rows.shape[1])
        self.words = np.zeros((rows.shape[1], groups), kind)
        for f in range(self.fields):
            self.words += self._shift(parts[:, f].T, f)

    def _shift(self, x, field: int):
        return x << (self.bits * field if self.wide else np.uint64(self.bits * field))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by candidates."""
        kind = object if self.wide else np.uint64
        half = 1 << (self.bits - 1)
        # a field starts at half its range, less what the bias of its candidate will add
        own = anchors.astype(object).sum(1) if self.wide else anchors.sum(1)
        begin = half - own * self.bias
        total = np.zeros((len(anchors), self.words.shape[1]), kind)
        first = begin if self.wide else begin.astype(np.int64).view(np.uint64)
        for f in range(self.fields):
            total += self._shift(first, f)[:, None]
        left = anchors.astype(object) if self.wide else anchors.astype(np.int64).view(np.uint64)
        for d in range(anchors.shape[1]):
            total += left[:, d, None] * self.words[d]
        mask = (1 << self.bits) - 1
        out = np.empty((len(anchors), self.words.shape[1], self.fields), np.int64)
        for f in range(self.fields):
            if self.wide:
                cut = ((total >> (self.bits * f)) & mask) - half
                out[:, :, f] = np.clip(cut, -MOST, MOST).astype(np.int64)
            else:
                out[:, :, f] = ((total >> np.uint64(self.bits * f)) & np.uint64(mask)).astype(np.int64) - half
        return out.reshape(len(anchors), -1)[:, : self.n]


def _integers(vectors: pd.Series) -> np.ndarray:
    """Rows of whole components; 64-bit where they fit, else Python integers."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    if not x.size or np.abs(x).max() < 1 << 30:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


def _first(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column) of the ``k`` best wanted columns; among equals the first column."""
    lowest = np.iinfo(np.int64).min
    masked = np.where(wanted, scores, lowest)
    if masked.shape[1] > k:
        edge = -np.partition(-masked, k - 1, axis=1)[:, k - 1: k]  # the k-th best score of each anchor
    else:
        edge = np.full((len(masked), 1), lowest)
    above, at_edge = wanted & (masked > edge), wanted & (masked == edge)
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | (at_edge & (np.cumsum(at_edge, axis=1) <= room)))


def _meet(select):
    """Task over one block of anchors and one block of rows; ``select`` picks of a tile of scores."""
    def work(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or rows.empty:
            return pd.DataFrame(columns=_NAMES)
        rows = rows.sort_values(["vec_id", "copy"], kind="stable")
        left, right = _integers(anchors["comps"]), _integers(rows["comps"])
        packed = Packed(right, field_bits(left, right))
        ids, copies, labels = (rows[c].to_numpy() for c in ("vec_id", "copy", "label"))
        parts = []
        for start in range(0, len(anchors), TILE):
            part = anchors.iloc[start: start + TILE]
            scores = packed.scores(left[start: start + TILE])
            same = part["label"].to_numpy()[:, None] == labels[None, :]
            other = part["vec_id"].to_numpy()[:, None] != ids[None, :]
            for at, column, positive in select(part, scores, same, other):
                parts.append(pd.DataFrame({
                    "anchor_id": part["vec_id"].to_numpy()[at], "anchor_copy": part["copy"].to_numpy()[at],
                    "row_id": ids[column], "row_copy": copies[column],
                    "positive_id": positive[0][at], "positive_copy": positive[1][at],
                    "positive_score": positive[2][at], "score": scores[at, column]}))
        return pd.concat(parts)[_NAMES] if parts else pd.DataFrame(columns=_NAMES)
    return work


def _positives(part, scores, same, other):
    nothing = [np.zeros(len(part), np.int64)] * 3
    at, column = _first(scores, same & other, POSITIVES)
    yield at, column, nothing


def _negatives(part, scores, same, other):
    lists = part["positives"].tolist()
    for k in range(max(map(len, lists), default=0)):
        have = np.array([len(p) > k for p in lists])
        known = [np.array([p[k][name] if len(p) > k else 0 for p in lists], np.int64)
                 for name in ("row_id", "row_copy", "score")]
        goal = known[2][:, None]
        fits = have[:, None] & ~same & (LOW * goal <= 100 * scores) & (100 * scores <= HIGH * goal)
        at, column = _first(scores, fits, NEGATIVES)
        if len(at):
            yield at, column, known


def usable_rows(vectors: DataFrame, relabel: int = 7, classes: int = N_CLASSES) -> DataFrame:
    """(vec_id, copy, label, comps, dims): rows that take part, whole components, exact repeats once."""
    scaled = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    raw = F.transform("embedding", lambda x: SCALE * x.cast("double"))
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("bigint")
    # floor() of a double is a long in Spark and would be cut at its bounds: those few stay as they are
    whole = F.transform(F.arrays_zip(raw.alias("x"), scaled.alias("f")), lambda p: F.when(
        F.abs(p["x"]) < float(1 << 53), p["f"]).otherwise(p["x"]))
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.pmod("vec_id", F.lit(relabel)) == 0, (label + 1) % classes).otherwise(label).alias("label"),
        F.when(F.coalesce(finite, F.lit(False)), whole).alias("comps"),
    ).filter("vec_id is not null and label is not null and comps is not null") \
        .withColumn("copy", F.xxhash64("label", "comps")).withColumn("dims", F.size("comps")) \
        .dropDuplicates(["vec_id", "copy"])


def mine_negatives(vectors: DataFrame, anchors_every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without id, label or vector, or with a component that is null or not finite
    once scaled, take no part. Exactly repeated rows count once; rows that share an id
    but differ are rows of their own, never each other's positives, ties between them
    by a hash of their content. Vectors are compared with those of equal length; scores
    beyond 4.6e16 are cut to that. Extra columns are ignored; no anchors, or an empty
    table: empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = staged(usable_rows(vectors), "mining-rows")
    is_anchor = F.col("vec_id") % anchors_every == 0
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    chunks = max(1, ceil(n_anchors / ANCHOR_BLOCK))
    blocks = max(1, ceil(n_rows / ROW_BLOCK), ceil(min(spark.sparkContext.defaultParallelism, n_rows / 512) / chunks))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "copy"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, beside the anchors'
    right = fresh.withColumn("block", place(blocks)).withColumn("chunk", copies(chunks)).groupBy("dims", "chunk", "block")

    def met(anchors: DataFrame, select) -> DataFrame:
        left = anchors.withColumn("chunk", place(chunks)).withColumn("block", copies(blocks))
        return left.groupBy("dims", "chunk", "block").cogroup(right).applyInPandas(_meet(select), _PAIRS)

    def best(found: DataFrame, group: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), "row_id", "row_copy")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = rows.filter(is_anchor)
    positives = best(met(anchors, _positives), ["anchor_id", "anchor_copy"], POSITIVES) \
        .groupBy("anchor_id", "anchor_copy").agg(F.sort_array(F.collect_list(F.struct(
            "rank", "row_id", "row_copy", "score"))).alias("positives"))
    ready = staged(anchors.join(positives, (anchors.vec_id == positives.anchor_id) & (anchors.copy == positives.anchor_copy))
                   .select("vec_id", "copy", "label", "comps", "dims", "positives"), "mining-positives")
    found = best(met(ready, _negatives), ["anchor_id", "anchor_copy", "positive_id", "positive_copy"], NEGATIVES)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                        F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
