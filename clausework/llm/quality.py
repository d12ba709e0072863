"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's.

A logistic classifier over hashed words and shape features gives each document
a probability for each label.  Sums of these by site (host) and section (path)
are shrunk: a section toward its site, a site toward the whole corpus, with the
weight that the spread between sites calls for (method of moments, so sparse
sites keep little of their own).  The posterior log odds are the document's own
plus what its section's posterior adds to the prior; a document is left out of
its own site's sums.

The classifier is fitted on a bounded sample of labelled rows: the
``SAMPLE`` labelled documents whose hashed doc_id is smallest.  Everything else
covers all rows by grouped aggregation with partial sums.

Cases: a null text is the empty text; documents without site or section take the
level above; without labels, or with one class only, the classifier says the
share of the class it saw (a half without labels); repeated rows each get a
result; a doc_id with several labels takes each as an example; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches

#: Labelled documents that the classifier is fitted on.
SAMPLE = 20_000
#: Hashed words; the shape features follow.
BUCKETS = 1 << 15
EPOCHS = 12
APART = 3.0
LABELS = ("quality", "toxic")

_RUN = re.compile(rb"[a-z0-9\x80-\xff]+")


class _Buckets(dict):
    """Word to bucket, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()")) % BUCKETS
        if len(self) > 100_000:
            self.clear()
        self[word] = value
        return value


_bucket_of = _Buckets()


def shape(text: str) -> list[float]:
    """Shares that tell prose from tables, shouting, symbols and repetition, each cut into steps."""
    raw = text.encode()
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    upper = sum(map(raw.count, _UPPER)) / n
    symbols = len(raw.translate(None, _PLAIN)) / n
    lines = raw.split(b"\n")
    return [
        upper, symbols, raw.count(b"|") / m, raw.count(b"!") / m, sum(map(raw.count, _DIGIT)) / n,
        1 - len(set(words)) / m, 1 - len(set(lines)) / len(lines), len(raw) / m / 10,
    ]


_UPPER = [bytes([c]) for c in range(0x41, 0x5B)]
_DIGIT = [bytes([c]) for c in range(0x30, 0x3A)]
_PLAIN = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum() or c in b" \n\t.,")
#: Borders of the steps of a shape feature.
STEPS = np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SHAPES = 8
WIDTH = BUCKETS + SHAPES * (len(STEPS) + 1)


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text, all of them present or not."""
    text = text or ""
    words = set(text.encode().lower().split())
    found = np.unique(np.fromiter(map(_bucket_of.__getitem__, words), np.int32, len(words)))
    steps = np.searchsorted(STEPS, shape(text), side="right") + np.arange(SHAPES) * (len(STEPS) + 1) + BUCKETS
    return np.concatenate([found, steps.astype(np.int32)])


class Classifier:
    """Logistic regression over present features, by stochastic steps with a rate for each feature."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7):
        self.weight = np.zeros(WIDTH, np.float64)
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if not len(labels) or share in (0.0, 1.0):
            return
        # Only features whose share differs between the classes by APART standard errors count.
        positive = labels > 0
        count = lambda part: np.bincount(np.concatenate(part), minlength=WIDTH)
        n1, n0 = int(positive.sum()), int((~positive).sum())
        with_1 = count([r for r, p in zip(rows, positive, strict=True) if p])
        with_0 = count([r for r, p in zip(rows, positive, strict=True) if not p])
        both = (with_1 + with_0) / len(rows)
        error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
        telling = (np.abs(with_1 / n1 - with_0 / n0) > APART * error) & (with_1 + with_0 > 1)
        rows = [at[telling[at]] for at in rows]
        order = np.random.default_rng(seed)
        squared = np.full(WIDTH, 1e-2)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at = rows[i]
                g = 1 / (1 + np.exp(-np.clip(self.weight[at].sum() + self.bias, -30, 30))) - labels[i]
                if abs(g) < 0.02:
                    continue
                step = g + 1e-4 * self.weight[at]
                squared[at] += step * step
                self.weight[at] -= 0.3 * step / np.sqrt(squared[at])

    def log_odds(self, at: np.ndarray) -> float:
        return float(np.clip(self.weight[at].sum() + self.bias, -12, 12))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Classifier]:
    """One classifier for each label, from at most ``sample`` labelled documents."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *LABELS).where("doc_id is not null")
    picked = cut(picked.orderBy(F.xxhash64("doc_id"), "doc_id", *LABELS).limit(sample), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([features(t.as_py()) for t in batch.column(len(LABELS))], pa.list_(pa.int32()))], [*LABELS, "at"])

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(*[F.col(c).cast("int").alias(c) for c in LABELS], "text")
    table = joined.mapInArrow(run, ", ".join(f"{c} int" for c in LABELS) + ", at array<int>").toArrow()
    rows = [np.asarray(x.values) for x in table.column("at")]
    # The rows come in any order; the fit doesn't depend on it.
    rank = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())
    rows = [rows[i] for i in rank]
    out = {}
    for label in LABELS:
        y = table.column(label).to_pylist()
        known = [k for k, i in enumerate(rank) if y[i] is not None]
        out[label] = Classifier([rows[k] for k in known], np.array([y[rank[k]] for k in known], float))
    return out


def _p(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: float) -> float:
    """Rows that the level above counts for: prior variance over the variance between sites, 1 to 1000."""
    if not 0 < prior < 1:
        return 1000.0
    mean = F.col("s") / F.col("n")
    r = sites.where("n >= 2").agg(F.sum(F.col("n") * (mean - prior) ** 2).alias("ss"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r.n or r.k < 2:
        return 10.0
    between = r.ss / r.n - prior * (1 - prior) * r.k / r.n
    return float(min(1000.0, max(1.0, prior * (1 - prior) / between if between > 0 else 1000.0)))


def posteriors(scored: DataFrame, label: str) -> DataFrame:
    """``scored`` (host, path and <label>_own log odds) with the posterior of ``label``."""
    own = _p(F.col(f"{label}_own"))
    total = scored.agg(F.sum(own).alias("s"), F.count("*").alias("n")).first()
    prior = ((total.s or 0.0) + 1.0) / (total.n + 2.0)
    sites = cut(scored.where("host is not null").groupBy("host").agg(F.sum(own).alias("s"), F.count("*").alias("n")), "sites")
    k = _strength(sites, prior)
    sections = scored.where("host is not null and path is not null").groupBy("host", "path").agg(F.sum(own).alias("s"), F.count("*").alias("n"))
    a = sites.select(F.col("host").alias("h1"), F.col("s").alias("s1"), F.col("n").alias("n1"))
    b = sections.select(F.col("host").alias("h2"), F.col("path").alias("p2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    joined = scored.join(a, F.col("host") == F.col("h1"), "left").join(b, (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")), "left")
    host = F.when(F.col("n1").isNull(), F.lit(prior)).otherwise((F.col("s1") - own + k * prior) / (F.col("n1") - 1 + k))
    joined = joined.withColumn(f"{label}_host", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host)))
    path = F.when(F.col("n2").isNull(), F.col(f"{label}_host")).otherwise((F.col("s2") - own + k * F.col(f"{label}_host")) / (F.col("n2") - 1 + k))
    joined = joined.withColumn(f"{label}_path", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path)))
    shift = _logit(F.col(f"{label}_path")) - F.lit(float(np.log(prior / (1 - prior))))
    return joined.withColumn(f"{label}_p", _p(F.col(f"{label}_own") + shift)).drop("h1", "s1", "n1", "h2", "p2", "s2", "n2")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, each label's own, host, path and final probability, and keep.

    ``keep``: good quality is likelier than not and toxicity is not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    sent = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [sent.value[label] for label in LABELS]
        for batch in batches:
            odds = []
            for text in batch.column(3):
                at = features(text.as_py())
                odds.append([m.log_odds(at) for m in models])
            cols = [pa.array([o[i] for o in odds], pa.float64()) for i in range(len(models))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["doc_id", "host", "path", *[f"{x}_own" for x in LABELS]])

    scored = cut(docs.mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"{x}_own double" for x in LABELS)), "scored")
    for label in LABELS:
        scored = posteriors(scored, label)
    values = [
        x for label in LABELS for x in (F.round(_p(F.col(f"{label}_own")), 6).alias(f"{label}_own"), *[F.round(f"{label}_{c}", 6).alias(f"{label}_{c}") for c in ("host", "path", "p")])
    ]
    return scored.select("doc_id", "host", "path", *values, ((F.col("quality_p") >= 0.5) & (F.col("toxic_p") < 0.5)).alias("keep"))
