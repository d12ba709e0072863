"""Language fusion and site posteriors against plain Python, row by row."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clausework.llm import language, quality
from clausework.llm.common import ARROW_BYTES, small_batches

ROWS = "id long, text string, declared string, suffix string, domain string, host string"
WORDS = {"en": ["the", "thing", "and", "of", "water"], "de": ["der", "und", "schön", "nicht", "zwei"], "fr": ["le", "château", "et", "que", "pas"]}


def buckets(text):
    b = b" " + " ".join((text or "").lower().split()).encode() + b" "
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(b) - 2)]


def softmax(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


def fused(rows, levels):
    """What ``identify`` returns for every row, by loops over all rows."""
    counts = defaultdict(Counter)
    for r in rows:
        if r["declared"] is not None and r["text"] is not None:
            seen = buckets(r["text"])
            for at, n in Counter(seen).items():
                counts[r["declared"]][at] += round(n * 4096 * min(1.0, 200 / len(seen)) if seen else 0) / 4096
    names = sorted(counts)
    total = {x: sum(counts[x].values()) + (1 << 14) for x in names}
    for r in rows:
        seen = buckets(r["text"]) if r["text"] else []
        weight = min(1.0, 200 / max(1, len(seen)))
        r["log"] = [weight * sum(n * math.log((counts[x][at] + 1) / total[x]) for at, n in Counter(seen).items()) for x in names]
        r["p"], r["letters"] = softmax(r["log"]), any(c.isalpha() for c in r["text"] or "")
    told = [r for r in rows if r["letters"]]
    sums = [sum(r["p"][i] for r in told) for i in range(len(names))]
    prior = [(s + 1) / (sum(sums) + len(names)) for s in sums]
    tables = {}
    for k, level in enumerate(levels):
        for r in told:
            if r[level] is not None:
                tables.setdefault((k, tuple(r[x] for x in levels[: k + 1])), []).append(r["p"])
    said = {e: {v: [sum(r["p"][i] for r in told if r[e] == v) for i in range(len(names))] for v in {r[e] for r in told} - {None}} for e in ("declared", "suffix")}
    out = []
    for r in rows:
        site = prior
        for k, level in enumerate(levels):
            group = tables.get((k, tuple(r[x] for x in levels[: k + 1]))) if r[level] is not None else None
            if group:
                own = 1.0 if r["letters"] else 0.0
                site = [(max(sum(p[i] for p in group) - own * r["p"][i], 0.0) + 10 * site[i]) / (len(group) - own + 10) for i in range(len(names))]
        logs = [x + math.log(s) for x, s in zip(r["log"], site, strict=True)]
        for e in ("declared", "suffix"):
            if r[e] in said[e]:
                logs = [x + math.log((s + 0.5) / (all_ + 1)) for x, s, all_ in zip(logs, said[e][r[e]], sums, strict=True)]
        p = softmax(logs)
        out.append((r["id"], names[p.index(max(p))], max(p), r["letters"] and max(p) >= 0.6))
    return out


@pytest.mark.parametrize("levels", [["host"], ["suffix", "domain", "host"]])
def test_language_by_loops(spark, levels):
    rng = random.Random(len(levels))
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "de", "fr"])
        text = " ".join(rng.choice(WORDS[rng.choice([lang, lang, lang, "en"])]) for _ in range(rng.randrange(1, 8)))
        declared = rng.choice([lang, lang, None, "en", "de"])
        host = "hot.org" if i % 3 == 0 else rng.choice([f"{lang}{i % 4}.{lang}", None])
        suffix = None if host is None or i % 10 == 9 else host.split(".")[-1]
        rows.append((i, text, declared, suffix, rng.choice([host, None]), host))
    rows += [(900, None, "en", "org", None, "hot.org"), (901, "", None, None, None, None), (902, "12 34", "de", "de", "x", "y"), (903, "der und " * 5000, "fr", "fr", None, "once")]
    rows += [rows[0], rows[0], rows[1]]
    want = fused([dict(zip(("id", "text", "declared", "suffix", "domain", "host"), r, strict=True)) for r in rows], levels)
    df = spark.createDataFrame(rows, ROWS).withColumn("letters", F.lit("clash"))
    got = [(r.id, r.language, r.posterior, r.accepted) for r in language.identify(df, levels).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[0] == w[0] and abs(g[2] - w[2]) < 1e-4, (g, w)
        assert g[1] == w[1] or abs(w[2] - 0.5) < 1e-4, (g, w)
        assert g[3] == w[3] or abs(w[2] - 0.6) < 1e-4, (g, w)


def test_posteriors_by_loops(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", f"once{i}", None]), rng.choice(["x", "y", None]), round(rng.gauss(1 if i % 3 else -1, 2), 3)) for i in range(400)]
    rows += [rows[0], rows[0], (900, None, "x", -12.0), (901, "hot", None, 12.0)]
    p = lambda x: 1 / (1 + math.exp(-x))
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    prior = (sum(p(r[3]) for r in rows) + 1) / (len(rows) + 2)
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, own in rows:
        if host is not None:
            hosts[host].append(p(own))
            if path is not None:
                paths[host, path].append(p(own))
    many = [v for v in hosts.values() if len(v) >= 2]
    n = sum(map(len, many))
    between = sum(len(v) * (sum(v) / len(v) - prior) ** 2 for v in many) / n - prior * (1 - prior) * len(many) / n
    k = min(1000.0, max(1.0, prior * (1 - prior) / between if between > 0 else 1000.0))
    want = []
    for i, host, path, own in rows:
        h, s = hosts.get(host), paths.get((host, path))
        at_host = clip((sum(h) - p(own) + k * prior) / (len(h) - 1 + k) if h else prior)
        at_path = clip((sum(s) - p(own) + k * at_host) / (len(s) - 1 + k) if s else at_host)
        want.append((i, at_host, at_path, p(own + math.log(at_path / (1 - at_path)) - math.log(prior / (1 - prior)))))
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, quality_own double").withColumn("s", F.lit("clash"))
    got = [(r.doc_id, r.quality_host, r.quality_path, r.quality_p) for r in quality.posteriors(df, "quality").collect()]
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(sorted(got), sorted(want), strict=True))
    assert quality.posteriors(df.where("false"), "quality").count() == 0


def test_batches_are_bounded_in_bytes(spark):
    """A thousand blocks of a group are some hundred megabytes: a batch ends at a megabyte, too."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    small_batches(spark)
    large = spark.range(300, numPartitions=1).select(F.repeat(F.lit("abcdefghij"), 2000).alias("text")).mapInArrow(run, "n long").agg(F.max("n")).first()[0]
    assert large < 2 * ARROW_BYTES
