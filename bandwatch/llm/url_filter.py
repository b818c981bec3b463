"""URL filter: fixed rules first, else logistic regression on hashed character n-grams of host and path.

The labelled table is small and made by rule from two word lists; the model is fitted once per session on the
driver (a few hundred rows, a vector of fixed size) and travels to the tasks with the function that scores.
"""

from __future__ import annotations

import functools
import math
import random
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Fixed values: (verdict, host, path start), as given.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of the labelled table's hosts and paths, unwanted and wanted.
UNWANTED = ("casino", "win", "bets", "poker", "slots", "adult", "porn", "xxx", "cheap", "pills", "viagra", "pharma", "free", "spam", "farm", "ads", "track", "click", "loan", "crypto-win", "escort", "torrent", "warez")
WANTED = ("news", "blog", "science", "history", "garden", "recipes", "travel", "music", "library", "school", "docs", "wiki", "forum", "museum", "weather", "health", "sports", "physics", "poems", "village", "theatre", "rivers", "stories")
PLACES = ("com", "net", "org")
FRONTS = ("", "www.", "m.", "blog.")
LANGUAGES = ("en", "fr", "de", "es")
ONSETS = ("th", "r", "l", "s", "sh", "t", "n", "m", "b", "d", "h", "w", "f")
RIMES = ("a", "an", "at", "e", "en", "er", "es", "ed", "in", "ing", "ion", "o", "on", "or", "ou", "y")

ORDERS = (3, 4, 5)
BUCKETS = 1 << 15
ROUNDS, RATE, RIDGE = 600, 2.0, 1e-4
BLOCK_AT = 0.5


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, unwanted) rows: each word joined with its list's next word, over fronts, places and languages."""
    rows = []
    for unwanted, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for j in (0, 1, 5):
                k = 4 * i + j
                other = words[(i + j) % len(words)]
                name = word if j == 0 else f"{word}-{other}"
                host = f"{FRONTS[k % 4]}{name}.example.{PLACES[k % 3]}"
                rows.append((host, f"/{LANGUAGES[(i + j) % 4]}/{37 * k + 1}", unwanted))  # both lists get the same paths
    # plain invented names keep what they share with all others (front, place, language, number) neutral
    rng = random.Random(11)
    for k in range(6 * len(WANTED)):
        name = "".join(rng.choice(ONSETS) + rng.choice(RIMES) for _ in range(rng.randint(2, 3)))
        rows.append((f"{FRONTS[k % 4]}{name}.example.{PLACES[k % 3]}", rows[k][1], 0))
    return rows


def buckets(host: str, path: str) -> np.ndarray:
    """Hash buckets of the distinct n-grams of host and path, kept apart by their first letter."""
    grams = set()
    for part, text in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        for n in ORDERS:
            grams.update(part + text[i : i + n] for i in range(len(text) - n + 1))
    return np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int64, len(grams))


def fit(rows: Sequence[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias: full-batch gradient descent, both classes weighted alike."""
    marks = [buckets(host, path) for host, path, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(m) for m in marks])
    flat = np.concatenate(marks)
    scale = np.array([1 / math.sqrt(max(1, len(m))) for m in marks])
    y = np.array([label for _, _, label in rows], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        z = np.bincount(owner, w[flat], len(rows)) * scale + b
        error = (1 / (1 + np.exp(-z)) - y) * share
        w -= RATE * (np.bincount(flat, (error * scale)[owner], BUCKETS) * 10 + RIDGE * w)
        b -= RATE * error.sum()
    return w, b


@functools.cache
def model() -> tuple[np.ndarray, float]:
    return fit(labelled())


def chance(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    """Probability that the URL is unwanted; without host and path that of the bias is no evidence: 0."""
    marks = buckets(host, path)
    if not len(marks):
        return 0.0
    return 1 / (1 + math.exp(-(weights[marks].sum() / math.sqrt(len(marks)) + bias)))


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, ties by name; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r)), reverse=True):
        verdict, of, start = rule
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(rule_name(rule)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, chance of each URL, a row for a row.

    Null URLs and those without :// have an empty host and path, fit no rule and are allowed. chance is the
    model's, whether or not a rule decided. Very long URLs are used whole.
    """
    weights, bias = model()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if key not in known:
                known[key] = chance(*key, weights, bias)
            out.append(known[key])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "chance"])

    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = parts.mapInArrow(by_batch(rows), f"page_id {dict(parts.dtypes)['page_id']}, host string, path string, chance double")
    ruled = scored.withColumn("found", rule_for(F.col("host"), F.col("path")))
    verdict = F.coalesce("found.verdict", F.when(F.col("chance") >= BLOCK_AT, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "chance")
