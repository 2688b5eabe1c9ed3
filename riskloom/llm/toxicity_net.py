"""Toxicity of whole texts by a convolutional word network in numpy.

A word is the sum of hashed embedding rows for itself and for its first letters; filters of one, two and three words slide
over the text; the largest value of each filter goes to a logistic output. Thresholds
are calibrated by language, which is guessed from function words of the text itself.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import held_out, row_map, training_rows
from riskloom.llm.flat import NO_LETTER, lowered, slices, word_hashes, words

BUCKETS = 1 << 14
SIZE = 10               # of an embedding
WIDTHS = (1, 2, 3)      # words that a filter sees
FILTERS = 6             # of each width
THRESHOLD = 0.7
STEMS = (4, 6)          # bytes of a word's beginnings that have rows of their own
PER_CLASS = 3000        # labelled rows of each class that the network is fitted on
LEAST_CALIBRATION = 15  # rows of each class below which a language takes the common threshold

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this"],
    "fr": ["le", "la", "les", "des", "et", "dans", "que", "une", "un", "du", "pour", "qui", "est"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist"],
    "es": ["el", "los", "las", "del", "y", "en", "que", "una", "por", "con", "para", "se", "su"],
}


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes [words, 1 + stems] of each word and its beginnings in lower case, and each text's first word."""
    small = lowered(data)
    starts, ends, first = words(small, offsets, NO_LETTER)
    found = [word_hashes(small, starts, ends)]
    for size in STEMS:
        found.append(word_hashes(small, starts, np.minimum(ends, starts + size)) + np.uint64(size))
    return np.stack(found, 1), first


def buckets(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(BUCKETS)).astype(np.int64)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    known: dict[int, list[float]] = {}
    for number, listed in enumerate(FUNCTION_WORDS.values()):
        for word in listed:
            raw = np.frombuffer(word.encode(), np.uint8)
            value = int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
            known.setdefault(value, [0.0] * len(FUNCTION_WORDS))[number] += 1
    keys = np.array(sorted(known), np.uint64)
    return keys, np.array([known[int(k)] for k in keys])


_LANGUAGE_KEYS, _LANGUAGE_VOTES = _language_table()


def languages(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the language with most function words in each text; 0 where none occurs."""
    found = found[:, 0]
    at = np.minimum(np.searchsorted(_LANGUAGE_KEYS, found), len(_LANGUAGE_KEYS) - 1)
    seen = np.flatnonzero(_LANGUAGE_KEYS[at] == found)
    text = np.searchsorted(first, seen, "right") - 1
    votes = np.stack([np.bincount(text, _LANGUAGE_VOTES[at[seen], k], len(first) - 1)
                      for k in range(len(FUNCTION_WORDS))], 1)
    return votes.argmax(1)


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]          # per width [width, SIZE, FILTERS]
    bias: np.ndarray                   # [widths * FILTERS]
    outer: np.ndarray
    outer_bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS)))


def _maxima(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each text's places with its place; places across borders don't count."""
    sizes = np.diff(first)
    out = np.zeros((len(sizes), values.shape[1]), values.dtype)
    place = np.full(out.shape, -1)
    for k in np.flatnonzero(sizes >= width):
        part = values[first[k]: first[k + 1] - width + 1]
        best = part.argmax(0)
        out[k], place[k] = part[best, np.arange(part.shape[1])], best + first[k]
    return out, place


class Scorer:
    """Filters folded into one table row for each hash bucket: all widths and places side by side."""

    def __init__(self, net: Network):
        self.net = net
        self.table = np.concatenate([net.embedding @ f[j] for f in net.filters for j in range(len(f))],
                                    1).astype(np.float32)

    def logits(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        bucket = buckets(found)
        values = self.table[bucket[:, 0]]
        for k in range(1, bucket.shape[1]):
            values += self.table[bucket[:, k]]
        sizes, pooled, column = np.diff(first), [], 0
        for f in self.net.filters:
            width = len(f)
            top = np.zeros((len(sizes), FILTERS), np.float32)
            filled = np.flatnonzero(sizes >= width)
            if len(filled):
                n = len(bucket) - width + 1
                total = sum(values[j: n + j, column + j * FILTERS: column + (j + 1) * FILTERS] for j in range(width))
                # alternating borders: a text's own places, then those that reach into the next
                borders = np.stack([first[:-1][filled], first[1:][filled] - width + 1], 1).ravel()
                top[filled] = np.maximum.reduceat(np.append(total, total[-1:], 0), borders, axis=0)[::2]
            column += width * FILTERS
            pooled.append(top)
        hidden = np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0)
        return hidden @ self.net.outer + self.net.outer_bias

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, first = hashes(data, offsets)
        shift = np.log(THRESHOLD / (1 - THRESHOLD)) - self.net.thresholds[languages(found, first)]
        return 1 / (1 + np.exp(-np.clip(self.logits(found, first) + shift, -30, 30)))


def fit(texts: list[str], target: list[int], rounds: int = 12, seed: int = 11) -> Network:
    """Adam on batches of texts; every fifth row is kept for the thresholds.

    Empty texts join the fitting rows as harmless ones, so that short texts start from there.
    """
    rng = np.random.default_rng(seed)
    blank = max(len(texts) // 25, 1)
    texts, target = [*texts, *[""] * blank], [*target, *[0] * blank]
    total = len(WIDTHS) * FILTERS
    net = Network(rng.normal(0, 0.1, (BUCKETS, SIZE)),
                  [rng.normal(0, 0.4 / w, (w, SIZE, FILTERS)) for w in WIDTHS],
                  np.zeros(total), np.abs(rng.normal(0, 0.5, total)), -1.0)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        found, _ = hashes(raw, np.array([0, len(raw)]))
        rows.append(buckets(found))
    y = np.array(target, float)
    kept = np.arange(len(rows)) % 5 == 0
    learn = np.flatnonzero(~kept)
    share = [max((y[learn] == k).mean(), 1e-9) if len(learn) else 1 for k in (0, 1)]
    names = ["embedding", *range(len(WIDTHS)), "bias", "outer", "outer_bias"]
    read = lambda n: net.filters[n] if isinstance(n, int) else np.asarray(getattr(net, n))
    slow, square = ({n: np.zeros_like(read(n), float) for n in names} for _ in range(2))
    step = 0
    for turn in range(rounds):
        order = rng.permutation(learn)
        for start in range(0, len(order), 64):
            picks = order[start: start + 64]
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in picks])])
            bucket = np.concatenate([rows[i] for i in picks])
            seen = net.embedding[bucket].sum(1)
            tops, places = [], []
            for f in net.filters:
                width, n = len(f), max(len(bucket) - len(f) + 1, 0)
                value = sum(seen[j: n + j] @ f[j] for j in range(width)) if n else np.zeros((0, FILTERS))
                top, place = _maxima(value, first, width)
                tops.append(top)
                places.append(place)
            raw = np.concatenate(tops, 1) + net.bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.outer + net.outer_bias, -30, 30)))
            error = (p - y[picks]) * np.where(y[picks] == 1, 0.5 / share[1], 0.5 / share[0]) / len(picks)
            grads = {n: np.zeros_like(slow[n]) for n in names}
            grads["outer"], grads["outer_bias"] = hidden.T @ error + 1e-4 * net.outer, np.array(error.sum())
            back = error[:, None] * net.outer * (raw > 0)
            grads["bias"] = back.sum(0)
            for k, (f, place) in enumerate(zip(net.filters, places, strict=True)):
                own = back[:, k * FILTERS: (k + 1) * FILTERS]
                text, column = np.nonzero((own != 0) & (place >= 0))
                amount, at = own[text, column], place[text, column]
                for j in range(len(f)):
                    np.add.at(grads[k][j].T, column, amount[:, None] * seen[at + j])
                    np.add.at(grads["embedding"], bucket[at + j], (amount[:, None] * f[j][:, column].T)[:, None])
            step += 1
            rate = 0.02 * (1 - turn / rounds) + 0.002
            for n in names:
                slow[n] += 0.1 * (grads[n] - slow[n])
                square[n] += 0.01 * (grads[n] ** 2 - square[n])
                change = rate * (slow[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.99 ** step)) + 1e-6)
                if isinstance(n, int):
                    net.filters[n] = net.filters[n] - change
                else:
                    setattr(net, n, getattr(net, n) - change)
    net.outer_bias = float(net.outer_bias)
    net.thresholds = calibrated(net, [texts[i] for i in np.flatnonzero(kept)], y[kept])
    return net


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap with the best balanced accuracy, the widest of equals."""
    order = np.argsort(logits)
    values, marks = logits[order], y[order]
    caught = 1 - np.concatenate([[0], np.cumsum(marks == 1)]) / max((marks == 1).sum(), 1)
    spared = np.concatenate([[0], np.cumsum(marks == 0)]) / max((marks == 0).sum(), 1)
    edges = np.concatenate([[values[0] - 2], values, [values[-1] + 2]])
    quality = np.round(caught + spared, 9)
    best = max(range(len(quality)), key=lambda k: (quality[k], edges[k + 1] - edges[k]))
    return float((edges[best] + edges[best + 1]) / 2)


def calibrated(net: Network, texts: list[str], y: np.ndarray) -> np.ndarray:
    """A threshold on the logit for each language; few rows or one class: the common one."""
    scorer, logits, tongues = Scorer(net), [], []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        found, first = hashes(raw, np.array([0, len(raw)]))
        logits.append(float(scorer.logits(found, first)[0]))
        tongues.append(int(languages(found, first)[0]))
    logits, tongues = np.array(logits), np.array(tongues)
    common = _threshold(logits, y) if len(set(y)) == 2 else 0.0
    out = np.full(len(FUNCTION_WORDS), common)
    for k in range(len(out)):
        own = tongues == k
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LEAST_CALIBRATION:
            out[k] = _threshold(logits[own], y[own])
    nothing = np.maximum(net.bias, 0) @ net.outer + net.outer_bias
    return np.maximum(out, nothing + 0.1)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; predicted is score >= 0.7.

    The network and its thresholds are fitted on at most ``per_class`` labelled rows of
    each class outside the held-out third; a score depends on the text alone. Null counts
    as empty; texts without words get the network's value for no filter. Without labelled
    rows the score is that of an unfitted network. Repeated rows stay; further columns are
    not read; a null id counts as held out.
    """
    net = fit(*training_rows(docs, labels, "toxic", per_class))
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
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
