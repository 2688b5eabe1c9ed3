"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every text becomes its set of shingle hashes; equal sets form a class, and the
   smallest id stands for it. A sketch keeps the smallest hashes of the set.
2. Documents that agree on a few small hashes are measured against the first of them
   only: links found so connect large groups of near copies in linear work.
3. Inverted lists of retained values give the overlaps of sketches. A list matters
   only if it joins documents that are not connected yet, and a document only if a
   good part of its retained values are in such lists; few documents are left.
4. For those the full sets are joined under a global order, rarest value first: prefix,
   length and position bounds leave the pairs that may reach the threshold. Values of
   one document alone stand first, so copies with many changes of their own drop out.
   In a list, pairs inside the largest connected group are never formed.
5. The estimate from the union sketch filters, exact Jaccard over full sets verifies.
6. Connected components of the verified links.

Filters by sketches are set six standard deviations below the threshold.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import row_map
from riskloom.llm.flat import lowered, mix, slices, word_hashes, words
from riskloom.llm.graph import components
from riskloom.session import staged

SKETCH = 64       # smallest hashes kept for the estimate
RETAINED = 32     # of them in inverted lists
MOST_SENT = 2_000_000  # ids, about 32 MB, that are sent to every executor
BANDS = 6         # keys of four small hashes each by which close copies meet
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size``: the whole as one."""
    for _, data, offsets in slices(texts):
        data = lowered(data)
        starts, ends, first = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        total = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
        for j in range(size):
            total = mix(total * _A + hashes[j: j + len(total)] + _B)
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if end - begin >= size:
                yield np.unique(total[begin: end - size + 1])
            elif end > begin:
                value = np.array([end - begin], np.uint64)
                for h in hashes[begin:end]:
                    value = mix(value * _C + h)
                yield value
            else:
                yield np.empty(0, np.uint64)


def _figures(found: np.ndarray) -> tuple:
    """Size, two fingerprints, two words of sign bits, sketch and band keys of one set."""
    if not len(found):
        return 0, 0, 0, 0, 0, [], []
    signed = found.view(np.int64)
    prints = [int(mix(found * m + _C).sum(dtype=np.uint64).view(np.int64)) for m in (_A, _B)]
    bits = np.zeros(128, bool)
    bits[(found[::-1] & np.uint64(127)).astype(np.int64)] = (found[::-1] >> np.uint64(7)) & np.uint64(1)
    signs = np.packbits(bits).view(np.int64)
    few = found[: 4 * BANDS * 6]
    band = (few >> np.uint64(8)) % np.uint64(BANDS)
    keys = []
    for k in range(BANDS):
        own = few[band == k][:4]
        if len(own):
            value = np.uint64(k + 1)
            for h in own:
                value = mix(np.array([value * _B + h]))[0]
            keys.append(int(value.view(np.int64)))
    return len(found), *prints, int(signs[0]), int(signs[1]), signed[:SKETCH].tolist(), keys


_FIGURES = ("doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sign1 bigint, sign2 bigint, "
            "sketch array<bigint>, bands array<bigint>")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """One row of figures for every row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            rows = [_figures(s) for s in shingle_sets(batch.column("text"), size)]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_shingles", "fp1", "fp2", "sign1", "sign2", "sketch", "bands"])

    return row_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, _FIGURES)


def of_documents(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the documents of ``ids`` (doc_id and more), which is written and small beside ``docs``.

    Up to ``MOST_SENT`` rows, counted, go to every executor and spare the shuffle of all
    texts; beyond that both sides are shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id")


def verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(a, b, common, total) of id pairs (a, b): exact sizes of intersection and union.

    Texts of the paired documents are joined to the pairs and become sets in the task.
    """
    wanted = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = of_documents(wanted, docs)
    both = pairs.select("a", "b") \
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b") \
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        sizes = np.cumsum([len(x or "") + len(y or "") for x, y in zip(
            batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)])
        common, total, start = [], [], 0
        last_id, last = None, None
        with np.errstate(over="ignore"):
            while start < len(a):
                limit = 4_000_000 + (sizes[start - 1] if start else 0)
                end = max(int(np.searchsorted(sizes, limit, "right")), start + 1)
                right = shingle_sets(batch.column("tb").slice(start, end - start), size)
                for k, mine in zip(range(start, end), right, strict=True):
                    if a[k] != last_id:  # pairs come sorted by a
                        last = next(shingle_sets(batch.column("ta").slice(k, 1), size))
                        last_id = a[k]
                    met = len(np.intersect1d(last, mine, assume_unique=True))
                    common.append(met)
                    total.append(len(last) + len(mine) - met)
                start = end
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
            ["a", "b", "common", "total"])

    return row_map(both, work, "a bigint, b bigint, common bigint, total bigint")


def full_sets(some: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, component, values) with the full sets of the documents of ``some``."""
    texts = of_documents(some.select("doc_id", "component"), docs)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            found = [s.view(np.int64) for s in shingle_sets(batch.column("text"), size)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), batch.column("component"),
             pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n", "component", "values"])

    return row_map(texts, work, "doc_id bigint, n bigint, component bigint, values array<bigint>")


def _least_agreement(similarity: float) -> int:
    """Of 128 sign bits, six deviations below what sets of this similarity agree on."""
    p = (1 + similarity) / 2
    return math.floor(128 * p - 6 * math.sqrt(128 * p * (1 - p)))


def _agree(x: str, y: str) -> Column:
    return F.expr(f"128 - bit_count({x}.sign1 ^ {y}.sign1) - bit_count({x}.sign2 ^ {y}.sign2)")


def star_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every document b with the earlier document a that its band keys propose as most alike."""
    keys = sets.select("doc_id", "n_shingles", "sign1", "sign2", F.explode("bands").alias("key"))
    leads = staged(keys.groupBy("key").agg(
        F.min(F.struct("doc_id", "n_shingles", "sign1", "sign2")).alias("l"), F.count("*").alias("n"))
        .filter("n > 1").select("key", "l.*"), "leads")
    met = keys.alias("d").join(leads.alias("l"), "key").filter(
        F.expr("l.doc_id < d.doc_id AND 100 * least(l.n_shingles, d.n_shingles) >= "
               f"{percent} * greatest(l.n_shingles, d.n_shingles)")
        & (_agree("d", "l") >= _least_agreement(percent / 100))) \
        .select("d.doc_id", F.col("l.doc_id").alias("lead"), _agree("d", "l").alias("agree"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("agree", (-F.col("lead")).alias("behind"))).alias("m"))
    return staged(best.select((-F.col("m.behind")).alias("a"), F.col("doc_id").alias("b")), "stars")


def unsettled(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, component) of documents that may link beyond their component.

    Of two linked documents' retained values far more than three in eight are shared,
    each in a list that holds both components.
    """
    placed = sets.alias("s").join(nodes.alias("n"), F.expr("s.doc_id = n.node"), "left").select(
        "s.doc_id", F.expr("coalesce(n.component, s.doc_id)").alias("component"),
        F.slice("sketch", 1, RETAINED).alias("kept"))
    lists = placed.select("doc_id", "component", F.size("kept").alias("m"), F.explode("kept").alias("value"))
    mixed = staged(lists.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .filter("low <> high").select("value"), "lists")
    return staged(lists.join(mixed, "value").groupBy("doc_id", "component").agg(
        F.count("*").alias("shared"), F.max("m").alias("m")).filter("8 * shared >= 3 * m")
        .select("doc_id", "component"), "unsettled")


def overlaps(full: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components by prefix, length and position."""
    values = full.select("doc_id", F.explode("values").alias("value"))
    counts = staged(values.groupBy("value").agg(F.count("*").alias("f")).filter("f > 1"), "counts")
    ordered = values.join(counts, "value").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("f", "value"))).alias("common"))  # at most the document's own set
    prefix = f"n - cast(ceil({percent} * n / 100D - 1e-9) AS bigint) + 1"
    postings = staged(full.select("doc_id", "n", "component").join(ordered, "doc_id").select(
        "doc_id", "n", "component", (F.col("n") - F.size("common")).alias("alone"),
        F.posexplode(F.expr(f"slice(common, 1, greatest(0, cast({prefix} - (n - size(common)) AS int)))"))
        .alias("k", "entry")).select(
        "doc_id", "n", "component", (F.col("alone") + F.col("k") + 1).alias("place"), "entry.value"), "postings")
    largest = staged(postings.groupBy("value", "component").agg(F.count("*").alias("size"))
                     .groupBy("value").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("groups"))
                     .filter("groups > 1").select("value", F.col("m.component").alias("largest")), "largest")
    outside = postings.join(largest, "value").filter("component <> largest")
    pairs = outside.alias("x").join(postings.alias("y"), F.expr(f"""
        x.value = y.value AND x.component <> y.component AND (y.component = x.largest OR x.doc_id < y.doc_id)
        AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND 1 + least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n) / {100 + percent}D - 1e-6"""))
    return staged(pairs.select(F.expr("least(x.doc_id, y.doc_id) AS a"), F.expr("greatest(x.doc_id, y.doc_id) AS b"))
                  .distinct(), "overlaps")


def estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union-sketch estimate is not six deviations below what they need."""
    own = sets.select("doc_id", "sketch")
    met = pairs.alias("p").join(own.alias("x"), F.expr("p.a = x.doc_id")).join(own.alias("y"), F.expr("p.b = y.doc_id"))
    # sketches keep the smallest unsigned hashes: signed ones sort like them with the top bit flipped
    merged = "array_sort(transform(array_union(x.sketch, y.sketch), h -> h ^ (-9223372036854775807L - 1L)))"
    union = F.expr(f"transform(slice({merged}, 1, least({SKETCH}, greatest(size(x.sketch), size(y.sketch)))), "
                   "h -> h ^ (-9223372036854775807L - 1L))")
    rows = met.select("p.a", "p.b", union.alias("low"), F.expr("array_intersect(x.sketch, y.sketch)").alias("both"))
    need = percent / 100
    share = F.size(F.array_intersect("low", "both")) / F.size("low")
    return rows.filter(share >= need - 6 * F.sqrt(F.lit(need * (1 - need)) / F.size("low"))).select("a", "b")


def link_documents(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents link where the Jaccard similarity of their sets of ``size``-word shingles
    is at least ``percent`` (80 or more). Null texts, empty texts and texts without words
    have no shingles and link with nothing. Rows of one id are one node; repeated rows
    get equal results. A null id links with nothing, has no component and is kept. Only
    doc_id and text are read. An empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the filters suit similarities of 80 percent and more")
    figures = staged(sketched(docs, size), "sketches")
    filled = figures.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(filled.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
    sets = staged(filled.alias("d").join(
        classes.alias("c"), F.expr("d.fp1 = c.fp1 AND d.fp2 = c.fp2 AND d.doc_id = c.rep")).select("d.*"), "sets")
    linked = F.col("common") * 100 >= F.col("total") * percent
    first = staged(verified(star_pairs(sets, percent), docs, size).filter(linked).select("a", "b"), "first")
    nodes = staged(components(first), "nodes")
    full = staged(full_sets(unsettled(sets, nodes), docs, size), "full")
    pairs = staged(estimated(overlaps(full, percent), sets, percent), "pairs")
    second = verified(pairs, docs, size).filter(linked).select("a", "b")
    nodes = staged(components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)), "nodes")
    out = figures.alias("d").join(classes.alias("c"), F.expr("d.fp1 = c.fp1 AND d.fp2 = c.fp2 AND d.n_shingles > 0"), "left") \
        .selectExpr("d.doc_id", "d.n_shingles", "CASE WHEN d.doc_id IS NOT NULL THEN coalesce(c.rep, d.doc_id) END AS rep")
    return out.alias("d").join(nodes.alias("n"), F.expr("d.rep = n.node"), "left").select(
        "d.doc_id", "d.n_shingles", F.expr("coalesce(n.component, d.rep)").alias("component_id"),
        F.expr("coalesce(d.doc_id = coalesce(n.component, d.rep), true)").alias("kept"))


def keep_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group with all its columns; of repeated rows one stays."""
    kept = link_documents(docs, size, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.monotonically_increasing_id())
    stay = docs.join(kept, "doc_id", "left_semi").withColumn("_copy", F.row_number().over(order)).filter("_copy = 1")
    return stay.select(*docs.columns).union(docs.filter("doc_id IS NULL"))
