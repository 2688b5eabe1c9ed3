"""Byte-pair encoding and decoding in batched numpy merge rounds.

All distinct words of a slice lie in one flat symbol array. A round looks up every
neighbouring pair by binary search over sorted pair keys, finds the lowest rank of
each word and merges its places from left to right; rounds end when no pair merges.
Words already encoded are kept per worker in a bounded table.
"""

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_map

# Fixed value: the split pattern of the byte-level vocabulary.
_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_KNOWN_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file of the byte-level kind as sorted numpy tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            raw = json.load(source)
        ids, letters = raw["model"]["vocab"], _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        self.content = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        keys, ranks = (left << 32) | right, np.arange(len(merges))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.lexsort((-ranks, keys))  # of a pair listed twice the later rank holds
        keys, ranks, made = keys[order], ranks[order], made[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.made = keys[first], ranks[first], made[first]
        self.words = regex.compile(_SPLIT, regex.V1)
        self.specials = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
                         if self.special else None)
        self.known: dict[str | int, bytes] = {}
        self.forget()

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the flat ``symbols``; ``word`` numbers each symbol's word."""
        done_symbols, done_words = [], []
        while len(symbols) > 1 and len(self.keys):
            keys = (symbols[:-1] << 32) | symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank = np.where(hit, self.ranks[at], _NONE)
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, _NONE), edge)
            sizes = np.diff(np.append(edge, len(symbols)))
            live = lowest < _NONE
            still = np.repeat(live, sizes)
            if not live.all():  # finished words leave the array
                done_symbols.append(symbols[~still])
                done_words.append(word[~still])
                if not live.any():
                    symbols, word = symbols[:0], word[:0]
                    break
            chosen = np.append(hit & (rank == np.repeat(lowest, sizes)[:-1]), False)
            # in a run of overlapping places every second one merges, from the left
            starts = np.flatnonzero(chosen & ~np.concatenate([[False], chosen[:-1]]))
            spots = np.flatnonzero(chosen)
            run = starts[np.searchsorted(starts, spots, "right") - 1]
            spots = spots[(spots - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[spots] = self.made[at[spots]]
            stays = still
            stays[spots + 1] = False
            symbols, word = symbols[stays], word[stays]
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def learn(self, fresh: list[str]) -> None:
        raw = [w.encode() for w in fresh]
        word = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
        symbols, word = self.merge(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], word)
        ends = np.cumsum(np.bincount(word, minlength=len(raw)))
        packed, end = symbols.astype("<u4").tobytes(), (4 * ends).tolist()
        self.known.update(zip(fresh, (packed[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list] = []
        fresh: dict[str, None] = {}
        if len(self.known) > _KNOWN_WORDS:
            self.forget()
        for text in texts:
            parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
            found: list = []
            for i, part in enumerate(parts):
                if i % 2:
                    found.append(self.special[part])
                else:
                    found.extend(self.words.findall(part))
            cut.append(found)
        for found in cut:
            fresh.update(dict.fromkeys(w for w in set(found) if w not in self.known))
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [b"".join(map(known, found)) for found in cut]

    def forget(self) -> None:
        """Known words from now on: only the special tokens, which stand in by their ids."""
        self.known = {i: i.to_bytes(4, "little") for i in self.special.values()}

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces in order; broken UTF-8 becomes replacement characters."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        begin = np.repeat(self.places[ids] - (np.cumsum(lengths) - lengths), lengths)
        raw = self.content[begin + np.arange(total)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of every whole text (null: empty).

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.
    One row per row of ``docs``; only doc_id and text are read, so further columns
    of any name do not matter. An empty table gives an empty result.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<bigint>" if with_ids else "")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = vocabulary(path)
        texts = batch.column("text").to_pylist()
        texts = [t or "" for t in texts]
        rows, start = [], 0
        while start < len(texts):  # slices of about a million characters
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= 1_000_000):
                size += len(texts[end])
                end += 1
            for raw in coder.encode(texts[start:end]):
                ids = np.frombuffer(raw, "<u4")
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(),
                             hashlib.sha256(coder.decode(ids)).hexdigest(), ids if with_ids else None))
            start = end
        columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                   pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array([r[3].astype(np.int64) for r in rows], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return row_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, schema)


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """Texts (doc_id, text) of rows (doc_id, ids), one for each row.

    Null or no ids give the empty text; null doc_ids and repeated rows stay; other columns
    are ignored. An empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = vocabulary(path)
        texts = [coder.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return row_map(tokens.select("doc_id", "ids"), work, "doc_id bigint, text string")
