"""URL verdicts: host and path rules first, else a logistic regression on hashed
character n-grams of host and path.

The model learns from a small labelled URL table (LABELLED by default) in numpy.
Rules and parsing are DataFrame expressions; only the score needs Python.

Defined results: a url that is null or has no ``://`` has an empty host and path
and is judged by the model (its score is the intercept's). Rows that repeat are
judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A small labelled table: 1 is block.
LABELLED = (
    ("https://www.city-library.example/en/catalogue/1204", 0),
    ("https://news.morning-post.example/2021/politics/budget.html", 0),
    ("https://docs.toolkit.example/guide/install", 0),
    ("http://university.example/departments/physics/", 0),
    ("https://museum.example/fr/expositions/2019", 0),
    ("https://blog.gardening.example/tomatoes-in-may.html", 0),
    ("https://www.weather.example/de/berlin", 0),
    ("https://encyclopedia.example/en/Photosynthesis", 0),
    ("https://recipes.example/es/paella", 0),
    ("https://m.health-service.example/advice/flu", 0),
    ("https://history.example/en/article/4411?page=2", 0),
    ("https://council.example/minutes/2018-03", 0),
    ("https://forum.cycling.example/thread/8831", 0),
    ("https://journal.example/articles/17/3", 0),
    ("http://cheap-pills.example/buy-now", 1),
    ("http://casino-bonus.example/win/free-spins", 1),
    ("http://best-loans.example/apply?ref=spam", 1),
    ("http://xxx-hot-videos.example/watch/99", 1),
    ("http://replica-watches.example/sale/rolex", 1),
    ("http://free-download-crack.example/serial-keygen", 1),
    ("http://online-casino.example/poker/jackpot", 1),
    ("http://cheap-viagra.example/pills/order", 1),
    ("http://win-prize.example/claim/iphone-free", 1),
    ("http://betting-tips.example/odds/bonus", 1),
    ("http://adult-dating.example/join-free", 1),
    ("http://payday-loan.example/instant-cash", 1),
    ("http://torrent-movies.example/download/free", 1),
    ("http://clickbait-spam.example/you-won", 1),
)
GRAMS, SIZE = (3, 4, 5), 1 << 16
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path expressions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        name, verdict = F.when(fits, own + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> np.ndarray:
    """The hashed n-grams, each once; host and path grams are kept apart."""
    found = set()
    for side, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = [f"{side}{text[i:i + n]}".encode() for n in GRAMS for i in range(len(text) - n + 1)]
        found.update(zlib.crc32(g) % SIZE for g in raw)
    return np.fromiter(found, np.int64, len(found))


def train(labelled=LABELLED, *, epochs: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept, by full gradient descent."""
    rows = []
    for url, _ in labelled:
        rest = url.partition("://")[2]
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        end = min((i for i in map(rest.find, "?#") if i >= cut), default=len(rest))
        rows.append(features(rest[:cut].lower(), rest[cut:end]))
    y = np.array([label for _, label in labelled], float)
    weights, bias = np.zeros(SIZE), 0.0
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.array([weights[r].sum() for r in rows]) * scale + bias)))
        slope = (p - y) / len(y)
        weights *= 1 - rate * decay
        for r, g, s in zip(rows, slope, scale):
            weights[r] -= rate * g * s
        bias -= rate * slope.sum()
    return weights, bias


def _scorer(weights: np.ndarray, bias: float, ids: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = [], {}
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if (host, path) not in known:
                    f = features(host, path)
                    known[host, path] = float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(len(f), 1)) + bias))))
                out.append(known[host, path])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return score


def judge_urls(pages: DataFrame, *, rules=RULES, labelled=LABELLED, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (higher: block)."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = parsed(F.col("__url"))
    split = own.select("page_id", host.alias("host"), path.alias("path"))
    weights, bias = train(labelled)
    scored = split.mapInArrow(_scorer(weights, bias, id_col), "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
