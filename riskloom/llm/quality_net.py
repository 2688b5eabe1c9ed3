"""Quality score of whole texts by a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the document;
each chunk keeps the largest value of every filter, a hidden layer judges the chunk,
and the largest hidden values of all chunks are combined into one probability.

Filters are stored as byte tables: the convolution is a sum of table rows. For scoring,
tables of neighbouring bytes are folded into one table of byte pairs.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import held_out, row_map, training_rows
from riskloom.llm.flat import slices

WIDTH = 6        # bytes that a filter sees
STRIDE = 2       # bytes between its places
FILTERS = 16
HALF = 64        # places in half a chunk; a chunk is two neighbouring halves
HIDDEN = 12
PER_CLASS = 1200  # labelled rows of each class that the network is fitted on
_LEAST = -8.0    # value of a filter where a chunk has no place for it


@dataclass
class Network:
    byte: np.ndarray      # [WIDTH, 256, FILTERS]
    bias: np.ndarray      # [FILTERS]
    inner: np.ndarray     # [FILTERS, HIDDEN]
    inner_bias: np.ndarray
    outer: np.ndarray     # [HIDDEN]
    outer_bias: float = 0.0


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every place, first place of every half, first half of every text."""
    sizes = np.diff(offsets)
    places = np.maximum((sizes - WIDTH) // STRIDE + 1, 0)
    places[(places > 0) & ((sizes - WIDTH) % STRIDE > 0)] += 1  # the last bytes are seen as well
    first = np.concatenate([[0], np.cumsum(places)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], places)
    begin = np.repeat(offsets[:-1], places) + np.minimum(number * STRIDE, np.repeat(np.maximum(sizes - WIDTH, 0), places))
    halves = -(-places // HALF)
    half_first = np.concatenate([[0], np.cumsum(halves)])
    half_number = np.arange(half_first[-1]) - np.repeat(half_first[:-1], halves)
    return begin, np.repeat(first[:-1], halves) + half_number * HALF, half_first


def chunk_maxima(half: np.ndarray, half_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of each half with its successor of the same text, and first chunk of every text."""
    joined = half.copy()
    if len(half) > 1:
        inside = np.ones(len(half) - 1, bool)
        borders = half_first[1:-1]
        inside[borders[(borders > 0) & (borders < len(half))] - 1] = False
        joined[:-1][inside] = np.maximum(half[:-1], half[1:])[inside]
    return joined, half_first


def largest(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """Column-wise maxima of each text's rows."""
    out = np.full((len(first) - 1, values.shape[1]), empty, values.dtype)
    filled = first[1:] > first[:-1]
    if filled.any():
        out[filled] = np.maximum.reduceat(values, first[:-1][filled], axis=0)
    return out


class Scorer:
    """A fitted network, ready to score slices of texts."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs = [(net.byte[j][:, None] + net.byte[j + 1][None]).reshape(65536, FILTERS).astype(np.float32)
                      for j in range(0, WIDTH, 2)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        net = self.net
        begin, half_at, half_first = layout(offsets)
        if len(begin):
            pair = (data[:-1].astype(np.int32) << 8) | data[1:]
            total = self.pairs[0][pair[begin]]
            for j, rows in enumerate(self.pairs[1:], 1):
                total += rows[pair[begin + 2 * j]]
            half = np.maximum.reduceat(total, half_at, axis=0) + net.bias.astype(np.float32)
        else:
            half = np.empty((0, FILTERS), np.float32)
        joined, first = chunk_maxima(np.maximum(half, _LEAST), half_first)
        hidden = np.maximum(joined @ net.inner + net.inner_bias, 0)
        top = largest(hidden, first, 0.0)
        return 1 / (1 + np.exp(-np.clip(top @ net.outer + net.outer_bias, -30, 30)))


def fit(texts: list[str], target: list[int], rounds: int = 14, seed: int = 7) -> Network:
    """Adam on single texts in batches; only the places that gave a maximum get a gradient."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS),
                  rng.normal(0, 0.4, (FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN))
    raws = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    y = np.array(target, float)
    share = np.array([max((y == k).mean(), 1e-9) for k in (0, 1)]) if len(y) else np.ones(2)
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0]) if len(y) else y
    names = ("byte", "bias", "inner", "inner_bias", "outer", "outer_bias")
    slow = {n: np.zeros_like(np.asarray(getattr(net, n), float)) for n in names}
    square = {n: np.zeros_like(slow[n]) for n in names}
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(raws))
        for start in range(0, len(order), 32):
            picks = order[start: start + 32]
            offsets = np.concatenate([[0], np.cumsum([len(raws[i]) for i in picks])]).astype(np.int64)
            data = np.concatenate([raws[i] for i in picks])
            begin, half_at, half_first = layout(offsets)
            grads = {n: np.zeros_like(slow[n]) for n in names}
            if len(begin):
                view = data[begin[:, None] + np.arange(WIDTH)]
                total = sum(net.byte[j][view[:, j]] for j in range(WIDTH))
                ends = np.append(half_at[1:], len(begin))
                half = np.maximum.reduceat(total, half_at, axis=0)
                # the place of each maximum, first of equals
                owner = np.repeat(np.arange(len(half_at)), ends - half_at)
                hits, columns = np.nonzero(total == half[owner])
                place = np.full(half.shape, len(begin))
                np.minimum.at(place, (owner[hits], columns), hits)
            else:
                half, place = np.empty((0, FILTERS)), np.empty((0, FILTERS), int)
            half = half + net.bias
            joined, first = chunk_maxima(half, half_first)
            successor = np.concatenate([joined[:-1] > half[:-1], np.zeros((min(len(half), 1), FILTERS), bool)])
            clipped = np.maximum(joined, _LEAST)
            raw_hidden = clipped @ net.inner + net.inner_bias
            hidden = np.maximum(raw_hidden, 0)
            top = largest(hidden, first, 0.0)
            p = 1 / (1 + np.exp(-np.clip(top @ net.outer + net.outer_bias, -30, 30)))
            error = (p - y[picks]) * weight[picks] / len(picks)
            grads["outer"], grads["outer_bias"] = top.T @ error, np.array(error.sum())
            if len(half):
                text = np.repeat(np.arange(len(picks)), np.diff(first))
                winner = (hidden == top[text]) & (hidden > 0)
                count = np.zeros_like(top)
                np.add.at(count, text, winner)
                back = winner / np.maximum(count[text], 1) * (error[:, None] * net.outer)[text]
                grads["inner"], grads["inner_bias"] = clipped.T @ back, back.sum(0)
                down = (back @ net.inner.T) * (joined > _LEAST)
                rows, columns = np.nonzero(down)
                source = rows + successor[rows, columns]
                amount, at = down[rows, columns], place[source, columns]
                np.add.at(grads["bias"], columns, amount)
                for j in range(WIDTH):
                    np.add.at(grads["byte"][j], (data[begin[at] + j], columns), amount)
            step += 1
            rate = 0.02 * (1 - turn / rounds) + 0.002
            for n in names:
                slow[n] += 0.1 * (grads[n] - slow[n])
                square[n] += 0.01 * (grads[n] ** 2 - square[n])
                change = rate * (slow[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.99 ** step)) + 1e-7)
                setattr(net, n, getattr(net, n) - change)
    net.outer_bias = float(net.outer_bias)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    The network is fitted on at most ``per_class`` labelled rows of each class outside
    the held-out third, and scores every row from its text alone. Null counts as empty;
    empty texts, and texts shorter than a filter, get the network's value for a text
    without chunks. Without labelled rows the score is that of an unfitted network.
    Repeated rows stay; further columns are not read; a null id counts as held out.
    """
    net = fit(*training_rows(docs, labels, "quality", per_class))
    made = docs.sparkSession.sparkContext.broadcast(net)
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in state:
            state["scorer"] = Scorer(made.value)
        scores = [state["scorer"](data, offsets) for _, data, offsets in slices(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores).astype(float))],
                                          ["doc_id", "score"])

    scored = row_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work,
                     "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
