"""Exact nearest neighbours as a blocked matrix product.

Both sides are packed into blocks of bounded size and written once.  Every block of
queries meets every block of items in a join that reads the written blocks and shuffles
none; a task keeps the best ``k`` items of its queries and hands on nothing else, so
that disk grows with the rows, not with their pairs.  Nothing is approximated.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.ranking import top_per_group
from riskloom.session import staged

BLOCK_ROWS, BLOCK_ENTRIES = 2048, 1 << 20
DECIMALS = 6
_FOUND = "query_id bigint, item_id bigint, item_label int, similarity double, compared double"


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and which are known."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(kind), known


def _coded(ids: np.ndarray, weights: np.ndarray) -> dict[str, bytes]:
    """Entries as two-byte numbers of their distinct (id, weight) where these are few; exact, and much smaller."""
    bits = weights.view(np.int64)
    order = np.lexsort((bits, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (bits[order][1:] != bits[order][:-1])
    if np.count_nonzero(new) > min(1 << 16, len(ids) // 3):
        return {"codes": b"", "ids": ids.tobytes(), "weights": weights.tobytes()}
    codes = np.empty(len(ids), np.uint16)
    codes[order] = np.cumsum(new) - 1
    return {"codes": codes.tobytes(), "ids": ids[order][new].tobytes(), "weights": weights[order][new].tobytes()}


def _pack(side: str, labelled: bool):
    """Rows of a side as blocks; a column of a block is one binary value."""
    def run(batches):
        for batch in batches:
            sizes, _ = _numbers(pc.list_value_length(batch.column("ids")), np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                most = ends[start] - sizes[start] + BLOCK_ENTRIES
                stop = min(start + BLOCK_ROWS, max(start + 1, int(np.searchsorted(ends, most, "right"))))
                part = batch.slice(start, stop - start)
                keys, known = _numbers(part.column(side), np.int64)
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "weights")]
                norms = part.column("norm").to_numpy(zero_copy_only=False).astype(float)
                row = {"keys": keys.tobytes(), "known": known.tobytes(), "sizes": sizes[start:stop].tobytes(),
                       "norms": norms.tobytes(), **_coded(flat[0].astype(np.int32), flat[1].astype(float))}
                if labelled:
                    labels, has_label = _numbers(part.column("item_label"), np.int32)
                    row |= {"labels": labels.tobytes(), "has_label": has_label.tobytes()}
                yield pa.RecordBatch.from_pylist([row])
                start = stop
    return run


_BLOCK = "keys binary, known binary, sizes binary, norms binary, codes binary, ids binary, weights binary"


def _blocks(rows: DataFrame, side: str, labelled: bool = False) -> DataFrame:
    kind = _BLOCK + (", labels binary, has_label binary" if labelled else "")
    if "norm" not in rows.columns:
        rows = rows.withColumn("norm", F.lit(1.0))
    packed = rows.mapInArrow(_pack(side, labelled), kind)
    return staged(packed.withColumn("block", F.monotonically_increasing_id()), f"{side}-blocks", "zstd")


class _Side:
    """A block, unpacked: items by id, null ids last."""

    def __init__(self, row: dict, prefix: str):
        read = lambda name, kind: np.frombuffer(row[f"{prefix}_{name}"], kind)
        self.keys, self.known = read("keys", np.int64), read("known", bool)
        self.sizes, self.ids, self.weights = read("sizes", np.int64), read("ids", np.int32), read("weights", float)
        if row[f"{prefix}_codes"]:
            codes = read("codes", np.uint16)
            self.ids, self.weights = self.ids[codes], self.weights[codes]
        self.weights = self.weights / np.repeat(read("norms", float), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.labelled = f"{prefix}_labels" in row
        if self.labelled:
            self.labels, self.has_label = read("labels", np.int32), read("has_label", bool)
            order = np.lexsort((self.keys, ~self.known))
            self.keys, self.known, self.labels, self.has_label, self.sizes, self.starts = (
                x[order] for x in (self.keys, self.known, self.labels, self.has_label, self.sizes, self.starts))

    def entries(self, rows):
        """Numbers of all entries of the given rows, and how many each has."""
        sizes = self.sizes[rows]
        first = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return first + np.arange(len(first)), sizes

    def dense(self, columns, kind):
        """Matrix over the given sorted columns."""
        out = np.zeros((len(self.keys), len(columns)), kind)
        at, sizes = self.entries(np.arange(len(self.keys)))
        if len(at) and len(columns):
            place = np.minimum(np.searchsorted(columns, self.ids), len(columns) - 1)
            known = columns[place] == self.ids
            at, rows = at[known[at]], np.repeat(np.arange(len(self.keys)), sizes)[known[at]]
            out[rows, place[at]] = self.weights[at]
        return out


class _Queries:
    """A block of queries with the best items that it met so far, best first."""

    def __init__(self, row: dict, k: int, per_label: bool, shared: bool):
        self.side, self.k, self.per_label, self.shared = _Side(row, "q"), k, per_label, shared
        self.columns = np.unique(self.side.ids)
        # Products in single precision only choose candidates: unit vectors err by less than this.
        terms = int(self.side.sizes.max(initial=0))
        self.slack = (terms + 4) * 2.0 ** -22 + 4 * 10.0 ** -DECIMALS
        n = len(self.side.keys)
        self.floor = np.full(n, -np.inf)
        self.best = {"row": np.zeros(0, int), "key": np.zeros(0, np.int64), "known": np.zeros(0, bool),
                     "label": np.zeros(0, np.int32), "has_label": np.zeros(0, bool), "raw": np.zeros(0)}
        self.exact = self.quick = None

    def open(self):
        self.exact = self.side.dense(self.columns, float)
        self.quick = None if self.per_label else self.exact.astype(np.float32)

    def close(self):
        self.exact = self.quick = None

    def _close(self, items: _Side):
        """Few enough pairs that may belong to the best, or None."""
        values = self.quick @ items.dense(self.columns, np.float32).T
        if np.isnan(values).any():
            return None
        floor = self.floor
        if np.isinf(floor).any() and values.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(values, -self.k, axis=1)[:, -self.k])
        near = values >= (floor - self.slack)[:, None]
        if self.shared:
            near &= values > 0
        if np.count_nonzero(near) > near.size // 20 + 100_000:
            return None
        return np.nonzero(near)

    def _dots(self, items: _Side, rows, cols):
        at, sizes = items.entries(cols)
        columns = np.minimum(np.searchsorted(self.columns, items.ids), max(len(self.columns) - 1, 0))
        if not len(at) or not len(self.columns):
            return np.zeros(len(rows))
        weights = np.where(self.columns[columns] == items.ids, items.weights, 0.0)
        products = self.exact[np.repeat(rows, sizes), columns[at]] * weights[at]
        return np.bincount(np.repeat(np.arange(len(rows)), sizes), products, len(rows))

    def meet(self, items: _Side):
        pairs = None if self.per_label else self._close(items)
        if pairs is not None:
            step = 20_000
            rows, cols = pairs
            raw = np.concatenate([np.zeros(0), *(self._dots(items, rows[i:i + step], cols[i:i + step])
                                                 for i in range(0, len(rows), step))])
        else:
            dense, parts = items.dense(self.columns, float).T, []
            for start in range(0, len(self.side.keys), 256):
                values = self.exact[start:start + 256] @ dense
                sims = np.round(values, DECIMALS)
                keep = np.zeros(sims.shape, dtype=bool)
                order = np.argsort(-sims, axis=1, kind="stable")
                np.put_along_axis(keep, order[:, :self.k], True, axis=1)
                if self.per_label:
                    for label in np.unique(items.labels[items.has_label]):
                        own = np.flatnonzero((items.labels == label) & items.has_label)
                        keep[np.arange(len(sims)), own[np.argmax(sims[:, own], axis=1)]] = True
                rows, cols = np.nonzero(keep)
                parts.append((rows + start, cols, values[rows, cols]))
            rows, cols, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = {"row": rows, "key": items.keys[cols], "known": items.known[cols],
                 "label": items.labels[cols], "has_label": items.has_label[cols], "raw": raw}
        self._keep({name: np.concatenate([self.best[name], found[name]]) for name in found})

    def _keep(self, all_):
        compared = np.round(all_["raw"], DECIMALS)
        compared = np.where(np.isnan(compared), -np.inf, compared)
        order = np.lexsort((all_["key"], ~all_["known"], -compared, all_["row"]))
        all_, compared = {name: x[order] for name, x in all_.items()}, compared[order]
        row = all_["row"]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        if self.per_label:
            labels = np.where(all_["has_label"], all_["label"].astype(np.int64), np.iinfo(np.int64).max)
            keep[np.unique(np.stack([row, labels]), axis=1, return_index=True)[1]] = True
        full = rank == self.k - 1
        self.floor[row[full]] = compared[full]
        self.best = {name: x[keep] for name, x in all_.items()}

    def found(self) -> pa.RecordBatch:
        b, side = self.best, self.side
        return pa.RecordBatch.from_arrays([
            pa.array(side.keys[b["row"]], mask=~side.known[b["row"]]), pa.array(b["key"], mask=~b["known"]),
            pa.array(b["label"], mask=~b["has_label"]), pa.array(b["raw"]), pa.array(np.round(b["raw"], DECIMALS)),
        ], names=["query_id", "item_id", "item_label", "similarity", "compared"])


def _best(k: int, per_label: bool, shared: bool):
    def run(batches):
        met: dict[int, _Queries] = {}
        now = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if now != row["q_block"]:
                    if now is not None:
                        met[now].close()
                    now = row["q_block"]
                    if now not in met:
                        met[now] = _Queries(row, k, per_label, shared)
                    met[now].open()
                met[now].meet(_Side(row, "i"))
        for queries in met.values():
            yield queries.found()
    return run


def block_neighbours(
    queries: DataFrame, items: DataFrame, k: int, per_label: bool = False, shared: bool = False,
) -> DataFrame:
    """Candidate rows ``(query_id, item_id, item_label, similarity, compared)``.

    ``compared`` is the similarity to six decimals, by which items are ordered, so
    that copies of an item tie and the lower id wins.

    ``queries``: ``query_id, ids, weights``; ``items``: ``item_id, item_label, ids,
    weights``; vectors have unit length, once divided by a column ``norm`` if there is one.  The result holds at least the ``k`` best items
    of every query (ties by item_id) and, on request, the best item of every label.
    ``shared`` leaves out pairs without a common id; no weight may be negative then.
    """
    left, right = _blocks(queries, "query_id"), _blocks(items, "item_id", labelled=True)
    named = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    # Both sides are read as they were written. The partitions of a product that follow
    # each other share their queries; a task that gets several keeps one set of best items.
    pairs = named(left, "q").hint("shuffle_replicate_nl").crossJoin(named(right, "i"))
    tasks = max(left.rdd.getNumPartitions(), 4 * queries.sparkSession.sparkContext.defaultParallelism)
    return pairs.coalesce(tasks).mapInArrow(_best(k, per_label, shared), _FOUND)


def _sides(vectors: DataFrame, key: str, name: str, *extra: str) -> DataFrame:
    return vectors.select(
        F.col(key).alias(name), *extra, F.col("vector.term_id").alias("ids"),
        F.col("vector.weight").alias("weights"), *[c for c in ["norm"] if c in vectors.columns])


def build_cases(labelled_vectors: DataFrame, key: str = "msg_id", label: str = "label") -> DataFrame:
    """Case base ``(item_id, item_label, ids, weights)`` of the two sure classes."""
    kept = labelled_vectors.filter(F.col(label).isin(K.BINARY_LABELS)).withColumn(
        "item_label", (F.col(label) == K.FRAUDULENT).cast("int"))
    return _sides(kept, key, "item_id", "item_label")


def query_cases(
    vectors: DataFrame, cases: DataFrame, k: int = K.NEIGHBOUR_CASES, key: str = "msg_id",
) -> DataFrame:
    """Fraud share among the ``k`` most similar cases of every message.

    Cases without a shared term are no neighbours; missing neighbours count as
    legitimate, because the share is taken over ``k``.
    """
    found = block_neighbours(_sides(vectors, key, "query_id"), cases, k, shared=True).filter(
        F.col("compared") > 0)
    top = top_per_group(found, ["query_id"], [F.desc("compared"), F.col("item_id")], k)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "item_label", "similarity")))
    summed = top.groupBy("query_id").agg(
        F.round(F.sum("item_label") / F.lit(float(k)), 4).alias("cbr_score"),
        ordered.alias("_top"), F.round(F.max("similarity"), 4).alias("most_similar"))
    return vectors.select(F.col(key).alias("query_id")).join(summed, "query_id", "left").select(
        F.col("query_id").alias(key),
        F.coalesce("cbr_score", F.lit(0.0)).alias("cbr_score"),
        F.coalesce("_top.item_label", F.array().cast("array<int>")).alias("top_k_labels"),
        F.coalesce(F.transform("_top.similarity", lambda s: F.round(s, 4)),
                   F.array().cast("array<double>")).alias("similarities"),
        F.coalesce("most_similar", F.lit(0.0)).alias("most_similar"))


def _unit(vectors: DataFrame, key: str, name: str, *extra: str) -> DataFrame:
    wide = vectors.select(
        F.col(key).alias(name), *extra,
        F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
    norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x * x))
    return wide.withColumn("_n", norm).select(
        name, *extra, F.when(F.size("_e") > 0, F.sequence(F.lit(0), F.size("_e") - 1)).alias("ids"),
        F.when(F.col("_n") > 0, F.transform("_e", lambda x: x / F.col("_n")))
        .otherwise(F.col("_e")).alias("weights"))


def reference_sample(
    vectors: DataFrame, per_class: int = K.INDEX_PER_CLASS, key: str = "vec_id",
    label: str = "label", seed: int = K.SEED,
) -> DataFrame:
    """At most ``per_class`` vectors of every class, picked by hash."""
    from riskloom.operators.ranking import stable_hash
    return top_per_group(
        vectors, [label], [stable_hash(F.col(key), seed), F.col(key)], per_class).drop("rank")


def search_vectors(
    queries: DataFrame, index: DataFrame, fraud_label: int = 1, legit_label: int = 0,
    k: int = K.INDEX_NEIGHBOURS, key: str = "vec_id",
) -> DataFrame:
    """Best cosine per class and the ``k`` nearest references of every query."""
    items = _unit(index.withColumn("item_label", F.col("label").cast("int")),
                  key, "item_id", "item_label")
    found = block_neighbours(_unit(queries, key, "query_id"), items, k, per_label=True)
    best = lambda label: F.coalesce(F.max(
        F.when(F.col("item_label") == label, F.col("similarity"))), F.lit(0.0))
    classes = found.groupBy("query_id").agg(
        F.round(best(fraud_label), 4).alias("fraud_similarity"),
        F.round(best(legit_label), 4).alias("legit_similarity"))
    top = top_per_group(found, ["query_id"], [F.desc("compared"), F.col("item_id")], k)
    nearest = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("item_id").alias("vec_id"), F.col("item_label").alias("label"),
        F.round("similarity", 4).alias("similarity")))).alias("top_neighbors"))
    return classes.join(nearest, "query_id").withColumnRenamed("query_id", key)


# Task functions travel by value: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
