"""URL verdicts: host and path rules first, a small trained model for the rest.

The model is a logistic regression on hashed character n-grams of host and path,
fitted in the driver on the short labelled table below and applied in batches.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_map

# Fixed values: (host, path, verdict); the longest fitting rule wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

# The labelled table, 1 for addresses to block.
LABELLED = [
    *((f"{w}.{h}", p, 1) for w, h, p in [
        ("cheap-pills", "example.com", "/en/450"), ("www.spam-farm", "example.org", "/en/728"),
        ("casino-win", "example.com", "/de/12.html"), ("free-bets", "example.org", "/fr/77"),
        ("adult-x", "example.com", "/es/310/"), ("ads-track", "example.org", "/en/9"),
        ("m.cheap-pills", "example.org", "/fr/5"), ("blog.spam-farm", "example.com", "/es/61.html"),
        ("casino-bonus", "example.org", "/en/800"), ("free-casino", "example.com", "/en/win"),
        ("pills-shop", "example.com", "/buy/cheap-pills"), ("bets-online", "example.org", "/free-bets/"),
        ("adult-video", "example.com", "/xxx/12"), ("track-ads", "example.com", "/click?ads"),
        ("spam-links", "example.org", "/farm/3"), ("win-money", "example.com", "/casino/play"),
        ("m.adult-x", "example.org", "/en/44/"), ("www.ads-track", "example.com", "/fr/901"),
        ("blog.free-bets", "example.com", "/de/222"), ("www.casino-win", "example.org", "/es/3"),
    ]),
    *((f"{w}.{h}", p, 0) for w, h, p in [
        ("ththre", "example.com", "/fr/825"), ("m.ththth", "example.org", "/en/25"),
        ("thther", "example.org", "/en/685"), ("therha", "example.com", "/en/676"),
        ("therin", "example.org", "/en/770"), ("blog.tiontion", "example.com", "/en/853/"),
        ("blog.ththan", "example.org", "/en/960"), ("m.therou", "example.com", "/en/474.html"),
        ("ththin", "example.com", "/en/671"), ("www.ththen", "example.com", "/en/148.html"),
        ("blog.thertion", "example.org", "/es/978"), ("ththed", "example.org", "/en/453"),
        ("www.ththwh", "example.org", "/en/471"), ("blog.thernd", "example.com", "/de/612"),
        ("news", "example.com", "/world/article-12"), ("library", "example.org", "/books/list"),
        ("docs", "example.org", "/guide/install.html"), ("www.city-museum", "example.org", "/visit/"),
        ("open-data", "example.org", "/tables/7"), ("blog.tionble", "example.com", "/es/72.html"),
        ("recipes", "example.com", "/de/suppe"), ("school", "example.org", "/fr/histoire"),
        ("m.ththha", "example.org", "/fr/16"),
    ]),
]

BUCKETS = 1 << 14
SIZES = (2, 3, 4, 5)


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path, apart from each other."""
    found = set()
    for mark, text in ((0x9E3779B1, f"^{host}$"), (0x85EBCA77, f"{path}$")):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(raw) < n:
                continue
            value = np.full(len(raw) - n + 1, mark + n, np.uint64)
            for j in range(n):
                value = (value ^ raw[j: len(raw) - n + 1 + j]) * np.uint64(0x100000001B3)
            found.update(((value ^ (value >> np.uint64(29))) % np.uint64(BUCKETS)).tolist())
    return np.fromiter(found, np.int64, len(found))


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent with a ridge penalty."""
    rows = [grams(h, p) for h, p, _ in LABELLED]
    target = np.array([y for *_, y in LABELLED], float)
    x = np.zeros((len(rows), BUCKETS))
    for row, found in zip(x, rows, strict=True):
        row[found] = 1 / np.sqrt(max(len(found), 1))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(600):
        error = 1 / (1 + np.exp(-(x @ weights + bias))) - target
        weights -= 2.0 * (x.T @ error / len(rows) + 2e-4 * weights)
        bias -= 2.0 * error.mean()
    return weights, bias


def address(url):
    """(host, path) columns of a url column: literal cuts, A-Z of the host in lower case."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every url.

    Null urls and urls without ``://`` have empty host and path and are judged by the
    model as such. One row per row of ``pages``; repeated rows stay; other columns are
    not read. An empty table gives an empty result.
    """
    host, path = address(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url") \
        .select("page_id", host.alias("host"), path.alias("path"))
    weights, bias = trained()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[tuple[str, str], float] = {}
        scores = []
        for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if key not in known:
                found = grams(*key)
                known[key] = float(1 / (1 + np.exp(-(weights[found].sum() / np.sqrt(max(len(found), 1)) + bias))))
            scores.append(known[key])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                          ["page_id", "host", "path", "score"])

    scored = row_map(rows, work, "page_id bigint, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, model).alias("verdict"), "score")
