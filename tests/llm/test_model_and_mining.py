"""Language-model scores, hard negatives and token alignment against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import alignment, byte_model, hard_negatives, oracles

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "x " * 3000),
       (6, "é漢字 😀 end ▁ <s> <|endoftext|> <0x0A>"), (7, "Ab\x00\x1c\x85\x0b")]


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk", F.lit("x")) \
        .withColumn("n", F.lit(1)).withColumn("held_out", F.lit("y")).withColumn("grams", F.lit(0))


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


# ---- language model

class Trie:
    """Plain prediction by partial matching, one dictionary of symbol counts a context."""

    def __init__(self, texts, order):
        self.order, self.nodes = order, collections.defaultdict(collections.Counter)
        for text in texts:
            data = b"\0" * order + text + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.nodes[data[i - k:i]][data[i]] += 1

    def log_probability(self, context, symbol):
        cost, out = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: n for s, n in self.nodes.get(context[len(context) - k:], {}).items() if s not in out}
            if not seen:
                continue
            room = sum(seen.values()) + len(seen)
            if symbol in seen:
                return cost + math.log10(seen[symbol] / room)
            cost += math.log10(len(seen) / room)
            out |= seen.keys()
        return cost - math.log10(256 - len(out))

    def score(self, text):
        data = b"\0" * self.order + text + b"\xff"
        return sum(self.log_probability(data[i - self.order:i], data[i]) for i in range(self.order, len(data)))


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


@pytest.mark.parametrize("order", [2, 4])
def test_model_equals_a_plain_trie(spark, order, monkeypatch):
    monkeypatch.setattr(byte_model, "SLICE_BYTES", 700)
    random.seed(order)
    vocabulary = ["the", "Theme", "ab", "b", "é", "漢字", "x1", "\n", "\t", "\0"]
    rows = ODD + [(10 + i, " ".join(random.choices(vocabulary, k=random.randint(0, 60)))) for i in range(150)]
    rows += [(900, "abc" * 2000)]
    trained = [lowered(t) for i, t in rows if not held(i)]
    trie = Trie(trained, order)
    tokens = collections.Counter(w for t in trained for w in [*t.split(), b"\xff"])
    n, v = sum(tokens.values()), len(tokens)
    expected = collections.Counter()
    for i, t in rows:
        words = [*lowered(t).split(), b"\xff"]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected[(i, held(i), len(words), sum(tokens[w] > 0 for w in words), n, round(base, 6),
                  round(trie.score(lowered(t)), 6))] += 1
    out = byte_model.score_documents(frame(spark, rows).repartition(3), order, limit=4000).collect()
    assert collections.Counter((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in out) == expected


def test_model_probabilities_sum_to_one():
    texts = [b"abracadabra", b"abc", b"", b"banana bandana"]
    grams = np.concatenate([byte_model.grams_of(t, 3) for t in texts])
    keys, n = np.unique(grams, return_counts=True)
    for context in (b"bra", b"xan", b"\0\0\0", b"zzz"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        every = np.union1d(keys, asked)
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, keys)] = n
        table = np.zeros((256, 256), np.int64)
        np.add.at(table, ((every >> 8) & 255, every & 255), counts)
        cost = byte_model.code_lengths(every, counts, 3, byte_model.short_contexts(table))
        assert abs(sum(10 ** cost[np.searchsorted(every, asked)]) - 1) < 1e-9


def test_model_prefers_texts_like_its_own_and_grows(spark):
    random.seed(2)
    words = ["river", "house", "green", "walks", "slowly", "under"]
    rows = [(i, " ".join(random.choices(words, k=40))) for i in range(300)]
    strange = next(i for i in range(1000, 2000) if held(i))
    rows.append((strange, "".join(random.choices("qxzjkvw ", k=240))))
    out = {r.doc_id: r.score / max(len(dict(rows)[r.doc_id]), 1) for r in
           byte_model.score_documents(frame(spark, rows)).collect()}
    assert min(s for i, s in out.items() if i != strange) > out[strange]
    assert byte_model.score_documents(frame(spark, rows).limit(0)).collect() == []
    untrained = byte_model.score_documents(frame(spark, [(strange, "ab")])).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.base_score == pytest.approx(0)
    assert untrained.score == pytest.approx(-3 * math.log10(256))


def test_model_holds_a_long_text(spark):
    text = "lorem ipsum dolor " * 60_000
    row = byte_model.score_documents(frame(spark, [(1, text), (2, "short")])).filter("doc_id = 1").first()
    assert row.n_tokens == 180_001 and -row.score < len(text) * 0.05


# ---- hard negatives

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int") \
        .withColumn("copy", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("comps", F.lit(1))


def plain(rows):
    """The contract, row by row, in whole numbers."""
    use = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(256 * x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        use.setdefault((i, label, tuple(math.floor(256 * x) for x in e)), None)
    cut = lambda x: max(-hard_negatives.MOST, min(hard_negatives.MOST, x))
    out = []
    for i, label, e in use:
        if i % 50:
            continue
        scored = sorted((-cut(sum(x * y for x, y in zip(e, f, strict=True))), j, other) for j, other, f in use
                        if len(f) == len(e) and j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 3000.0, 2e5, 1e7])
def test_negatives_equal_plain_search(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 97)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(int(size))
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in size * (centres[rng.integers(4)] + rng.choice([0, 0.3]) * rng.normal(size=6))],
             int(rng.integers(3))) for i in range(400)]
    rows += [(500 + i, rows[50][1], 1) for i in range(40)]                       # ties
    rows += [rows[50], rows[100], (50, rows[60][1], rows[50][2])]                # repeated rows, a shared id
    rows += [(1000, None, 1), (1050, rows[0][1], None), (1100, [float("nan")] * 6, 1), (1150, [None] + [1.0] * 5, 1),
             (1200, [1e308] * 6, 1), (None, rows[0][1], 1), (1250, [0.0] * 6, 1), (1300, [size, 1.0], 1),
             (1301, [size, 1.0], 1), (1302, [0.7 * size, 1.0], 2)]
    out = hard_negatives.mine_negatives(vectors(spark, rows)).collect()
    found, expected = sorted(tuple(r) for r in out), plain(rows)
    assert len(expected) > 15 and found == expected


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine_negatives(vectors(spark, [(1, [1.0], 1)])).collect() == []
    assert hard_negatives.mine_negatives(vectors(spark, [(50, [1.0], 1)]).limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 200, 2 ** 20, 2 ** 40])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(3)
    left, right = (rng.integers(-300 * size, 300 * size, (n, 17)) for n in (9, 50))
    exact = left.astype(object) @ right.T.astype(object)
    if size == 2 ** 40:
        left, right = left.astype(object), right.astype(object)
    packed = hard_negatives.Packed(right, hard_negatives.field_bits(left, right))
    assert packed.fields == {1: 3, 200: 16, 2 ** 20: 16, 2 ** 40: 16}[size]
    assert (packed.scores(left) == np.clip(exact, -hard_negatives.MOST, hard_negatives.MOST)).all()


def test_negatives_equal_their_sql(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], int(rng.integers(4))) for i in range(600)]
    rows += [(700, None, 1), (750, rows[0][1], None)]
    out = hard_negatives.mine_negatives(vectors(spark, rows)).toPandas()
    base = duckdb.connect()
    base.register("embeddings", vectors(spark, rows).select("vec_id", "embedding", "label").toArrow())
    twin = base.execute(oracles.SQL["op12_hard_negatives"]).df()
    key = ["anchor_id", "positive_id", "rank"]
    assert out.sort_values(key)[list(out)].astype(int).to_numpy().tolist() == \
        twin.sort_values(key)[list(out)].astype(int).to_numpy().tolist()


# ---- alignment

def aligned(rows):
    """The contract by byte ranges, every pair of tokens compared."""
    a_coder = Tokenizer.from_file(A_PATH)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = alignment._byte_of_letter()
    a_of = {i: bytes(letters[c] for c in t) for t, i in json.load(open(A_PATH, encoding="utf-8"))["model"]["vocab"].items()
            if t != "<|endoftext|>"}

    def piece(i):
        text = b_coder.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b_coder.is_byte(i) else text.replace("▁", " ").encode()

    found = []
    for i, text in rows:
        a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_coder.encode(text or "")
        a_bytes, b_bytes = [a_of[x] for x in a], [piece(x) for x in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append((i, 0, 0, [], []))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        a_start, b_start = a_end - [len(x) for x in a_bytes], b_end - [len(x) for x in b_bytes]
        met = (a_start[:, None] < b_end) & (b_start < a_end[:, None])
        groups, at = [], 0
        for end in sorted(set(a_end.tolist()) & set(b_end.tolist())):
            own = [",".join(str(x) for x, s, e in zip(ids, starts, ends, strict=True) if s >= at and e <= end)
                   for ids, starts, ends in ((a, a_start, a_end), (b, b_start, b_end))]
            groups.append("|".join(own))
            at = end
        found.append((i, len(a), len(b), groups, [(a[x], b[y]) for x, y in np.argwhere(met)]))
    counts = collections.Counter(p for *_, links in found for p in links)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return collections.Counter(
        (i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found)


@pytest.mark.parametrize("limit", [300, 1 << 20])
def test_alignment_equals_byte_ranges(spark, limit):
    random.seed(5)
    parts = list("ab 's't\n\r\t  ,.!123é漢字 ᰀ\x1c\x85²½Ⅷ 👍🏽_▁") + ["<|endoftext|>", "'ll", " the", "Zz", "　", "<s>", "unhappily"]
    rows = ODD + [(100 + i, "".join(random.choices(parts, k=random.randint(0, 60)))) for i in range(200)]
    rows += [(None, None), (9000, "the house by the river")]
    out = alignment.align_documents(frame(spark, rows).repartition(3), A_PATH, B_PATH, limit=limit).collect()
    assert collections.Counter(tuple(r) for r in out) == aligned(rows)


def test_alignment_of_nothing_and_of_a_long_run(spark):
    assert alignment.align_documents(frame(spark, ODD).limit(0), A_PATH, B_PATH).collect() == []
    random.seed(6)
    text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    row = alignment.align_documents(frame(spark, [(1, text), (2, None)]), A_PATH, B_PATH, with_groups=True) \
        .filter("doc_id = 1").first()
    groups = [g.split("|") for g in row.groups.split(";")]
    assert len(groups) == row.n_groups and sum(len(a.split(",")) for a, _ in groups) == row.n_a
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


def test_links_of_a_slice():
    assert alignment.links_of([1, 2, 3], [7, 8], [2, 2, 2], [3, 3]) == [
        a << 32 | b for a, b in ((1, 7), (2, 7), (2, 8), (3, 8))]
    assert [x.tolist() for x in alignment.groups_of([1, 3, 6], [3, 4, 6])] == [[2, 3], [1, 3]]
