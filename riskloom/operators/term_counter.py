"""Counts of known terms in batches of texts, by the numbers of their words; nothing of the package is imported here.

A run of words is numbered by the run without its last word and that word, so that it is looked at
only where a known term begins.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

WORDS = 1 << 20   # words that are looked at together


def _parts(lists):
    """Slices of a list array with at most ``WORDS`` words, or one text."""
    if not len(lists):
        yield lists
    ends, start = lists.offsets.to_numpy().astype(np.int64), 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS, "right")) - 1)
        yield lists.slice(start, stop - start)
        start = stop


def _text_of(lists) -> np.ndarray:
    """Number of the text that every word stands in."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())[:len(lists)])


def _numbers(found) -> np.ndarray:
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Terms:
    """Known terms, by their place in the list; a term's words are separated by single blanks."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.size = len(terms)
        self.words = sorted({w for t in split for w in t})
        place = {w: i for i, w in enumerate(self.words)}
        most = max((len(t) for t in split), default=1)
        ids = {(w,): i for w, i in place.items()}
        self.codes, self.known = [], []   # by length: codes of all beginnings of terms, sorted; which are terms
        for n in range(1, most + 1):
            begun = {tuple(t[:n]) for t in split if len(t) >= n} if n > 1 else set(ids)
            code = {t: place[t[0]] if n == 1 else ids[t[:-1]] * len(place) + place[t[-1]] for t in begun}
            order = sorted(begun, key=code.get)
            ids = {t: i for i, t in enumerate(order)}
            known = np.full(len(order), -1, np.int64)
            for at, t in enumerate(split):
                if len(t) == n:
                    known[ids[tuple(t)]] = at
            self.codes.append(np.array([code[t] for t in order], np.int64))
            self.known.append(known)

    def runs(self, lists, most: int):
        """For every length up to ``most``: the known term that begins at each word, -1 for none."""
        flat, text = lists.flatten(), _text_of(lists)
        words = _numbers(pc.index_in(flat, pa.array(self.words, flat.type))) if self.words else np.full(len(flat), -1)
        begun = words
        for n in range(1, most + 1):
            if n > len(self.codes) or not len(self.codes[n - 1]):
                yield n, words, text, np.full(len(words), -1, np.int64)
                continue
            if n > 1:
                at = np.flatnonzero(begun[:len(words) - n + 1] >= 0)
                at = at[(words[at + n - 1] >= 0) & (text[at] == text[at + n - 1])]
                code, codes = begun[at] * len(self.words) + words[at + n - 1], self.codes[n - 1]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                begun = np.full(len(words), -1, np.int64)
                begun[at] = np.where(codes[place] == code, place, -1)
            yield n, words, text, np.where(begun >= 0, self.known[n - 1][begun], -1)

    def counted(self, lists, least: int, most: int):
        """``(ids, counts)`` of the terms of every text, sorted by id."""
        out = []
        for part in _parts(lists):
            keys = []
            for n, _, text, term in self.runs(part, most):
                if n >= least:
                    at = np.flatnonzero(term >= 0)
                    keys.append(text[at] * self.size + term[at])
            keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            text, term = np.divmod(keys, max(self.size, 1))
            ends = pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32())
            out.append(pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64()))], names=["ids", "counts"]))
        return pa.concat_arrays(out)


# Task functions travel by value: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
