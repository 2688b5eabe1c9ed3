"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order`` bytes, learned from all training
texts. A symbol unseen in a context escapes to the next shorter one with probability
q / (T + q), T occurrences of q distinct symbols, those seen in the longer context
excluded; below order 0 the rest of the 256 symbols is equally likely. Texts follow a
run of zero bytes and close with the byte 255, which UTF-8 never holds.

Texts are worked off in chunks of bounded size. A chunk counts its distinct grams (a
context and its symbol) and words once, so what is shuffled, summed up and looked up are
the grams and words of chunks, never single places of a text. All grams of the contexts
that end in the same two bytes meet in one bucket and build their part of the trie there;
only the orders 0 and 1, at most 65,536 counts, reach every task.
"""

from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship_package
from riskloom.session import staged

ORDER = 4                    # context bytes, 2 to 6
END = 255
CHUNK_BYTES = 32 << 20       # text bytes a chunk holds; only a single longer text exceeds it
SLICE_BYTES = 2 << 20        # bytes whose grams are in memory at a time
SLICE_ROWS = 512             # rows whose texts are Python strings at a time
BUCKET_GRAMS = 250_000
SMOOTH = 0.1                 # of the word counts behind base_score

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def grams_of(raw: bytes, order: int) -> np.ndarray:
    """For every byte and the closing one: the ``order`` bytes before it and itself as one number."""
    padded = np.frombuffer(b"\0" * order + raw + bytes([END]), np.uint8)
    out = np.zeros(len(raw) + 1, np.int64)
    for k in range(order + 1):
        out <<= 8
        out |= padded[k: k + len(out)]
    return out


def slices_of(text: bytes, order: int) -> Iterator[np.ndarray]:
    """Grams of a text in slices of bounded size."""
    if len(text) <= SLICE_BYTES:
        yield grams_of(text, order)
        return
    for start in range(0, len(text), SLICE_BYTES):
        before = text[max(0, start - order): start]
        own = grams_of(before + text[start: start + SLICE_BYTES], order)[len(before):]
        yield own if start + SLICE_BYTES >= len(text) else own[:-1]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, place, np.concatenate([n for _, n in parts]))
    return grams, counts


class Places:
    """Places of numbers in a sorted array of distinct ones, by a table of multiplied hashes.

    Numbers of large weight come last into the table, so that they win a slot that several want;
    the others are found by binary search.
    """

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, numbers: np.ndarray, weights: np.ndarray):
        bits = max(8, int(len(numbers)).bit_length() + 1)
        self.numbers, self.shift = numbers, np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        order = np.argsort(weights, kind="stable").astype(np.int32)
        self.slots[self._hash(numbers[order])] = order

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * self._FACTOR) >> self.shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = self.slots[self._hash(x)]
        wrong = np.flatnonzero(self.numbers[at] != x)
        at[wrong] = np.searchsorted(self.numbers, x[wrong])
        return at


def _counted(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts with their counts, slice by slice."""
    parts, waiting, size = [], [], 0
    for text in texts:
        for own in slices_of(text, order):
            waiting.append(own)
            size += len(own)
            if size >= SLICE_BYTES:
                parts.append(np.unique(np.concatenate(waiting), return_counts=True))
                waiting, size = [], 0
    parts.append(np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True))
    return _merged(parts)


class _Chunk:
    """Texts until the chunk is full; then one row with its distinct grams and words."""

    NAMES = ["chunk", "doc_id", "held_out", "sizes", "content", "grams", "gram_n", "words", "word_n"]

    def __init__(self, order: int):
        self.order, self.size, self.ids, self.held, self.texts = order, 0, [], [], []

    def add(self, doc_id, held: bool, text: bytes) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(text)
        self.size += len(text) + 16

    def row(self, name: int) -> pa.RecordBatch:
        learned = [t for t, h in zip(self.texts, self.held, strict=True) if not h]
        asked = [t for t, h in zip(self.texts, self.held, strict=True) if h]
        words = Counter()
        for text in learned:
            words.update(text.split())
        for text in asked:   # looked up, but not learned
            words.update(dict.fromkeys(text.split(), 0))
        grams, gram_n = _counted(learned, self.order)
        others, _ = _counted(asked, self.order)
        grams, gram_n = _merged([(grams, gram_n), (others, np.zeros_like(others))])
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), pa.array([self.ids], lists), pa.array([self.held], pa.list_(pa.bool_())),
            pa.array([[len(t) for t in self.texts]], lists), pa.array([zstandard.compress(b"".join(self.texts))], pa.binary()),
            pa.array([grams], lists), pa.array([gram_n], lists),
            pa.array([list(words)], pa.list_(pa.binary())), pa.array([list(words.values())], lists)], self.NAMES)


_CHUNKS = ("chunk bigint, doc_id array<bigint>, held_out array<boolean>, sizes array<bigint>, content binary, "
           "grams array<bigint>, gram_n array<bigint>, words array<binary>, word_n array<bigint>")


def _chunks(order: int, limit: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chunk = TaskContext.get().partitionId() << 32, _Chunk(order)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                for doc_id, held, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "held_out", "text")),
                                              strict=True):
                    chunk.add(doc_id, held, (text or "").encode().translate(_LOWER))
                    if chunk.size >= limit:
                        yield chunk.row(name)
                        name, chunk = name + 1, _Chunk(order)
        if chunk.ids:
            yield chunk.row(name)
    return work


def short_contexts(counts: np.ndarray) -> dict:
    """Orders 0 and 1 from the 256 x 256 counts of a byte after a byte."""
    zero, one = counts.sum(0), counts
    return {"one": one, "zero": zero, "total1": one.sum(1), "kinds1": (one > 0).sum(1),
            "total0": int(zero.sum()), "kinds0": int((zero > 0).sum()),
            "excluded0": ((one > 0) * zero).sum(1)}


def code_lengths(grams: np.ndarray, counts: np.ndarray, order: int, short: dict) -> np.ndarray:
    """log10 probability of every gram's symbol after its context.

    ``grams`` are distinct and hold every gram of the contexts whose last two bytes occur;
    ``counts`` are those of the training texts, 0 for grams that are only asked for.
    """
    levels = []   # from the longest context to order 2: per gram count, total, kinds, and what the longer one excludes
    above = None
    for k in range(order, 1, -1):
        keys, place = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(place, counts, len(keys)).astype(np.int64)
        nodes, node = np.unique(keys >> 8, return_inverse=True)
        total = np.bincount(node, n, len(nodes)).astype(np.int64)
        kinds = np.bincount(node, n > 0, len(nodes)).astype(np.int64)
        excluded = np.zeros(len(grams), np.int64)
        if above is not None:   # counts here of the symbols that the longer contexts know
            longer_keys, longer_n, longer_node, longer_place = above
            here = n[np.searchsorted(keys, longer_keys & ((1 << 8 * (k + 1)) - 1))]
            excluded = np.bincount(longer_node, here * (longer_n > 0)).astype(np.int64)[longer_node][longer_place]
        levels.append((n[place], total[node][place], kinds[node][place], excluded))
        above = keys, n, node, place
    symbol, last = grams & 255, (grams >> 8) & 255
    keys, n, node, place = above
    one = short["one"][last, symbol]
    here = short["one"][(keys >> 8) & 255, keys & 255]
    levels.append((one, short["total1"][last], short["kinds1"][last],
                   np.bincount(node, here * (n > 0)).astype(np.int64)[node][place]))
    levels.append((short["zero"][symbol], np.full(len(grams), short["total0"]), np.full(len(grams), short["kinds0"]),
                   short["excluded0"][last]))
    cost, found, kinds_above = np.zeros(len(grams)), np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
    for n, total, kinds, excluded in levels:
        total, fresh = total - excluded, kinds - kinds_above
        room = (total + fresh).astype(float)
        hit, miss = ~found & (n > 0), ~found & (n == 0) & (fresh > 0)
        cost[hit] += np.log10(n[hit] / room[hit])
        cost[miss] += np.log10(fresh[miss] / room[miss])
        found |= hit
        kinds_above = kinds
    cost[~found] -= np.log10(256 - kinds_above[~found])
    return cost


def _bucket(order: int, short: dict) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        grams = table.column("gram").to_numpy()
        cost = code_lengths(grams, table.column("n").to_numpy(), order, short)
        return pa.table({"gram": grams, "value": cost})
    return work


def trie_costs(counts: DataFrame, order: int = ORDER, grams_a_bucket: int = BUCKET_GRAMS) -> DataFrame:
    """(gram, value): log10 probability of every row (gram, n) of the distinct grams."""
    pairs = counts.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    table = np.zeros((256, 256), np.int64)
    rows = 0
    for r in pairs.toLocalIterator():   # at most 65,536 rows, whatever the input
        table[r["pair"] >> 8, r["pair"] & 255] = r["n"]
        rows += r["rows"]
    buckets = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(0xFFFF)), F.lit(max(1, ceil(rows / grams_a_bucket))))
    return counts.withColumn("bucket", buckets).groupBy("bucket") \
        .applyInArrow(_bucket(order, short_contexts(table)), "gram bigint, value double")


def _scored(order: int, train_tokens: int, train_words: int, ends: int) -> Callable:
    def work(_key, chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: chunk.column(c)[0].as_py() for c in ("doc_id", "held_out", "sizes", "content")}
        of_gram = found.filter(pc.is_valid(found.column("gram")))
        grams, cost = of_gram.column("gram").to_numpy(), of_gram.column("value").to_numpy()
        order_ = np.argsort(grams)
        grams, cost = grams[order_], cost[order_]
        places = Places(grams, cost)
        of_word = found.filter(pc.is_null(found.column("gram")))
        counts = of_word.column("value").to_numpy()
        place = dict(zip(of_word.column("word").to_pylist(), range(len(counts)), strict=True))
        below = np.log10(train_tokens + SMOOTH * (train_words + 1))
        logs, known = np.log10(counts + SMOOTH) - below, counts > 0
        content = zstandard.decompress(row["content"])
        end_log = float(np.log10(ends + SMOOTH) - below)
        base, score, n_tokens, n_known, start = [], [], [], [], 0
        for size in row["sizes"]:
            text = content[start: start + size]
            start += size
            score.append(float(sum(cost[places(own)].sum() for own in slices_of(text, order))))
            words = text.split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            base.append(float(logs[at].sum()) + end_log)
            n_tokens.append(len(words) + 1)
            n_known.append(int(known[at].sum()) + (ends > 0))
        n = len(row["sizes"])
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([train_tokens] * n, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})
    return work


def score_documents(docs: DataFrame, order: int = ORDER, fold: int = 10, limit: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32 of the id as text is not divisible by ``fold`` are learned from, rows
    without id never. A-Z count as a-z in both scores. Null texts are empty: one token, the
    end. Repeated rows are texts of their own and are learned as often. Without training
    rows the base score takes all counts as 0 and the model every byte as equally likely.
    Only doc_id and text are read. An empty table gives an empty result.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    ship_package(docs.sparkSession)
    key = F.col("doc_id").cast("bigint")
    chunks = staged(docs.select(
        key.alias("doc_id"), F.coalesce(F.crc32(key.cast("string")) % fold == 0, F.lit(True)).alias("held_out"),
        F.col("text").cast("string").alias("text")).mapInArrow(_chunks(order, limit), _CHUNKS), "model-chunks")

    def summed(items: str, counts: str, name: str) -> DataFrame:
        return staged(chunks.select(F.explode(F.arrays_zip(items, counts)).alias("_i")).groupBy(
            F.col(f"_i.{items}").alias(name)).agg(F.sum(f"_i.{counts}").alias("n")), f"model-{items}")

    grams, words = summed("grams", "gram_n", "gram"), summed("words", "word_n", "word")
    learned = F.size(F.filter("held_out", lambda h: ~h))
    ends = chunks.agg(F.coalesce(F.sum(learned), F.lit(0))).first()[0]
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    costs = staged(trie_costs(grams, order), "model-costs")
    of_chunk, value = F.col("chunk").alias("of_chunk"), F.col("n").cast("double").alias("value")
    found = chunks.select(of_chunk, F.explode("grams").alias("gram")).join(costs, "gram") \
        .select("of_chunk", "gram", F.lit(None).cast("binary").alias("word"), "value").unionByName(
            chunks.select(of_chunk, F.explode("words").alias("word")).join(words, "word").select(
                "of_chunk", F.lit(None).cast("bigint").alias("gram"), "word", value))
    return chunks.select("chunk", "doc_id", "held_out", "sizes", "content").groupBy("chunk") \
        .cogroup(found.groupBy("of_chunk")).applyInArrow(
            _scored(order, n_words + ends, kinds + (ends > 0), ends),
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double")
