"""Alignment of two tokenizers' tokens by the byte offsets where both end one.

Cumulative ends of each side go into a dictionary from end to index; the keys that both
dictionaries hold, sorted, slice the two id lists into groups, and every slice is
expanded into its links. Texts are worked off in chunks: a chunk carries its distinct id
pairs once, so corpus-wide counts and the look-up of them shuffle pairs of chunks, not
of documents or occurrences.
"""

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship_package
from riskloom.session import staged

CHUNK_CHARS = 4 << 20   # characters a chunk holds; only a single longer text exceeds it
SLICE_ROWS = 512         # rows whose texts are Python strings at a time
_B = 1 << 32
_NUMBERS = list(range(1, 1 << 12))   # made once, as dictionaries hold whole numbers as objects
_NO_IDS = np.empty(0, np.int64)
# Fixed value: the split pattern of the byte-level vocabulary.
_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_of_letter() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the byte length and the digits of every id."""

    def __init__(self, byte_level: str, pieces: str):
        with open(byte_level, encoding="utf-8") as source:
            raw = json.load(source)
        letters, special = _byte_of_letter(), {t["content"] for t in raw.get("added_tokens", [])}
        ids = raw["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        made = [ids[x + y] for x, y in merges]
        if raw.get("normalizer") or any(x >= y for x, y in pairwise(made)):
            raise ValueError("a byte-level vocabulary without normalizer, its ids in the order of the merges, is expected")
        ranks = {bytes(letters[c] for c in token): i for token, i in ids.items() if token not in special}
        # without special tokens: their strings in a text are plain text
        self.a = tiktoken.Encoding("aligned", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.zeros((n_ids, len(str(n_ids)) + 1), np.uint8)
        for i in range(n_ids):
            self.digits[i, : len(str(i))] = list(str(i).encode())
        self.n_digits = (self.digits > 0).sum(1)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side's bytes are not space and text."""
        spaced = " " + text
        b = self.b.encode(text) if text else []
        if not b or b"".join(map(self.b_bytes.__getitem__, b)) != spaced.encode():
            return _NO_IDS, _NO_IDS
        # A's merges keep every byte
        return self.a.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """Groups as text, their number, and every linked id pair as one number."""
        if not len(a):
            return b"", 0, _NO_IDS
        a_sizes, b_sizes = self.a_sizes[a], self.b_sizes[b]
        a_cuts, b_cuts = groups_of(np.cumsum(a_sizes).tolist(), np.cumsum(b_sizes).tolist())
        n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        a_from, b_from = a_cuts - n_a, b_cuts - n_b
        # in slices with one token on a side, that one is linked with all of the other side
        plain = (n_a == 1) | (n_b == 1)
        n = np.maximum(n_a, n_b)[plain]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = a[np.repeat(a_from[plain], n) + step * np.repeat(n_a[plain] > 1, n)]
        right = b[np.repeat(b_from[plain], n) + step * np.repeat(n_b[plain] > 1, n)]
        links = [left << 32 | right]
        for i, k, j, m in zip(*(x[~plain].tolist() for x in (a_from, a_cuts, b_from, b_cuts)), strict=True):
            links.append(links_of(a[i:k].tolist(), b[j:m].tolist(), a_sizes[i:k].tolist(), b_sizes[j:m].tolist()))
        return self.written(a, b, a_cuts, b_cuts, n_a, n_b), len(a_cuts), np.concatenate(links)

    def written(self, a, b, a_cuts, b_cuts, n_a, n_b) -> bytes:
        """``a1,a2|b1;a3|b2``: both sides' ids, group by group."""
        ids = np.empty(len(a) + len(b), np.int64)
        marks = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(b_cuts - n_b, n_a)] = a
        ids[np.arange(len(b)) + np.repeat(a_cuts, n_b)] = b
        marks[a_cuts + b_cuts - n_b - 1] = ord("|")
        marks[a_cuts + b_cuts - 1] = ord(";")
        cells = self.digits[ids]
        cells[np.arange(len(ids)), self.n_digits[ids]] = marks
        return cells[cells > 0].tobytes()[:-1]


@lru_cache(maxsize=2)
def tokenizers_of(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def groups_of(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """End indices, in both id lists, of the groups between the ends that both sides have."""
    while len(_NUMBERS) < max(len(a_ends), len(b_ends)):
        _NUMBERS.extend(range(len(_NUMBERS) + 1, 2 * len(_NUMBERS) + 1))
    a_at, b_at = dict(zip(a_ends, _NUMBERS)), dict(zip(b_ends, _NUMBERS))  # noqa: B905
    both = sorted(a_at.keys() & b_at.keys())
    return tuple(np.fromiter(map(at.__getitem__, both), np.int64, len(both)) for at in (a_at, b_at))


def links_of(a_ids: list[int], b_ids: list[int], a_sizes: list[int], b_sizes: list[int]) -> list[int]:
    """Pairs of tokens of one group whose byte ranges overlap, each as one number."""
    found, i, j, a_end, b_end = [], 0, 0, a_sizes[0], b_sizes[0]
    while True:
        found.append(a_ids[i] << 32 | b_ids[j])
        step_a, step_b = a_end <= b_end, b_end <= a_end
        if step_a:
            i += 1
            if i == len(a_ids):
                return found
            a_end += a_sizes[i]
        if step_b:
            j += 1
            b_end += b_sizes[j]


class _Chunk:
    """Documents until the chunk is full; then one row with its distinct pairs."""

    NAMES = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "pairs", "pair_n", "first", "links", "times"]

    def __init__(self, with_groups: bool):
        self.with_groups, self.size, self.rows, self.links = with_groups, 0, [], []

    def add(self, doc_id, a, b, coder: Pair, size: int) -> None:
        text, n_groups, links = coder.align(a, b)
        self.rows.append((doc_id, len(a), len(b), n_groups, hashlib.sha256(text).hexdigest() if text else "",
                          text.decode() if self.with_groups else None))
        self.links.append(np.unique(links, return_counts=True))
        self.size += size

    def row(self, name: str) -> pa.RecordBatch:
        flat, times = (np.concatenate(x) for x in zip(*self.links, strict=True))
        place, pairs = pd.factorize(flat)
        first = np.cumsum([0, *(len(x) for x, _ in self.links)])
        total = np.bincount(place, times, len(pairs)).astype(np.int64)
        lists = [list(x) for x in zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([lists[0]], pa.list_(pa.int64())),
            *(pa.array([x], pa.list_(pa.int64())) for x in lists[1:4]),
            *(pa.array([x], pa.list_(pa.string())) for x in lists[4:6]),
            pa.array([pairs], pa.list_(pa.int64())),
            pa.array([total], pa.list_(pa.int64())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (first, place.astype(np.int32), times.astype(np.int32)))], self.NAMES)


_CHUNKS = ("chunk string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
           "groups_sha256 array<string>, groups array<string>, pairs array<bigint>, pair_n array<bigint>, "
           "first binary, links binary, times binary")


def _chunks(byte_level: str, pieces: str, with_groups: bool, limit: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk(with_groups)
        coder = tokenizers_of(byte_level, pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    chunk.add(doc_id, *coder.encode(text or ""), coder, 100 + len(text or ""))
                    if chunk.size >= limit:
                        yield chunk.row(f"{part}-{number}")
                        number, chunk = number + 1, _Chunk(with_groups)
        if chunk.rows:
            yield chunk.row(f"{part}-{number}")
    return work


def _rated(_key, chunk: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one chunk with the counts of their links."""
    row = chunk.to_pylist()[0]
    order = np.argsort(pairs.column("at").to_numpy())
    count = pairs.column("n").to_numpy()[order]
    best = pairs.column("is_best").to_numpy(zero_copy_only=False)[order]
    first, own = np.frombuffer(row["first"], np.int64), np.frombuffer(row["links"], np.int32)
    times = np.frombuffer(row["times"], np.int32).astype(np.int64)

    def summed(x):
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]

    links = [summed(times), summed(times * best[own]), summed(times * count[own])]
    return pa.table({c: pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")}
                    | dict(zip(("n_links", "n_best", "count_sum"), map(pa.array, links), strict=True))
                    | {c: pa.array(row[c], pa.string()) for c in ("groups_sha256", "groups")})


def align_documents(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False,
                    limit: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``with_groups`` adds the groups as text. Null and empty texts, and texts that a side
    does not give back byte for byte, have zeros and an empty digest; null ids stay,
    repeated rows are texts of their own and count as often. Only doc_id and text are
    read. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    chunks = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
                    .mapInArrow(_chunks(byte_level, pieces, with_groups, limit), _CHUNKS), "alignment")
    pairs = staged(link_counts(chunks), "alignment-pairs")
    placed = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(pairs, "pair")
    # one row stands for a chunk without any link, so that its documents are not lost
    alone = chunks.filter(F.size("pairs") == 0).select("chunk")
    rated = placed.select(F.col("chunk").alias("of_chunk"), "at", "n", "is_best").unionByName(
        alone.select(F.col("chunk").alias("of_chunk"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("is_best")))
    schema = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
              "count_sum bigint, groups_sha256 string, groups string")
    out = chunks.drop("pairs", "pair_n").groupBy("chunk").cogroup(rated.groupBy("of_chunk")).applyInArrow(_rated, schema)
    return out if with_groups else out.drop("groups")


def link_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many links corpus-wide hold an id pair, and whether its B id has none above."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("_p")) \
        .groupBy(F.col("_p.pairs").alias("pair")).agg(F.sum("_p.pair_n").alias("n")) \
        .withColumn("b", F.col("pair").bitwiseAND(_B - 1))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
