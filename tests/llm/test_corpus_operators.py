"""The operators over whole corpora against brute force and held-out rows, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import components, jaccard, language, lattice, quality

DOCS = "doc_id long, text string, lang string, source string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    sets = defaultdict(list)
    for i, t in docs:
        sets[i].append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss]
    by = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            by[x].append(k)
    for k, (i, s) in enumerate(flat):
        for m, both in Counter(m for x in s for m in by[x] if m < k).items():
            j, o = flat[m]
            if 100 * both >= 80 * (len(s) + len(o) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, i = [], 0
    common = [word() for _ in range(60)]
    original = [word() for _ in range(150)]
    for _ in range(60):  # a family of near copies, some at the border
        docs.append((i := i + 1, " ".join(edited(rng, original, rng.randrange(6)))))
    chain = [word() for _ in range(120)]
    for _ in range(12):  # each links with the one before only
        docs.append((i := i + 1, " ".join(chain)))
        chain = edited(rng, chain, 2)
    for _ in range(80):  # a common passage in texts that are otherwise their own
        docs.append((i := i + 1, " ".join([word() for _ in range(rng.randrange(5, 80))] + common)))
    for _ in range(30):
        docs.append((i := i + 1, " ".join(common)))
    for n in range(12):  # short ones
        docs += [(i := i + 1, " ".join(common[:n])), (i := i + 1, " ".join(common[:n]).upper())]
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "w " * 3000), (904, "W\x0bw\x0c" * 1500), (905, " ".join(word() for _ in range(20_000))), (5, docs[70][1]), (5, docs[4][1])]
    return docs


def test_near_duplicates(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    df = df.withColumn("token", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component_id", F.lit(3))
    got = jaccard.near_duplicates(df).collect()
    want = brute_components(corpus)
    assert len(got) == len(corpus)
    assert {r.doc_id: r.component_id for r in got} == want
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in corpus)
    kept = {r.doc_id for r in jaccard.drop_near_duplicates(df).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(odd).collect()) == [("1", 2, "1"), ("None", 0, "None"), ("None", 2, "None")]


def test_bucket_counts_never_close_a_link(spark, corpus):
    sets = [jaccard.tokens_of(t) for _, t in corpus if t and t.strip()]
    docs = [{"doc_id": k, "data": jaccard._counts(t)} for k, t in enumerate(sets)]
    for a in range(150):
        queries, members = jaccard._near(docs[a : a + 1], [d for k, d in enumerate(docs[:150]) if k != a])
        linked = {b for b in range(150) if b != a and jaccard.links(sets[a], sets[b])}
        assert linked <= {i for i, _ in members} and (not linked or queries)


def test_components_of_a_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (202, 201)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 200: 200, 201: 200, 202: 200}


def words_of(rng, lang, n):
    parts = {"en": ["the", "ing", "tion", "and", "er", "of"], "de": ["der", "ung", "sch", "und", "ei", "ß"], "fr": ["le", "eau", "ment", "et", "qu", "é"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(400):
        lang = rng.choice(["en", "en", "de", "fr"])
        said = lang if rng.random() < 0.85 else rng.choice(["en", "de", "fr"])
        rows.append((i, words_of(rng, lang, rng.randrange(5, 60)), rng.choice([said, said, None, said.upper() + "-XX"]), "hot" if i % 3 == 0 else f"{lang}{i % 9}"))
        truth[i] = lang
    rows += [(1000, None, "en", "hot"), (1001, "", None, None), (1002, "123 456 !!", "en", "s"), (1003, "der und " * 30_000, "en", None), (1, rows[1][1], rows[1][2], rows[1][3])]
    return spark.createDataFrame(rows, DOCS).withColumn("language", F.lit("clash")).withColumn("top_", F.lit(0)), truth


def test_language(spark, languages):
    df, truth = languages
    got = {r.id: r for r in language.identify(language.document_rows(df), ["host"]).collect()}
    assert len(got) == df.select("doc_id").distinct().count()
    right = sum(got[i].language == lang for i, lang in truth.items())
    assert right >= 0.98 * len(truth)
    assert sum(got[i].accepted for i in truth) >= 0.98 * len(truth)
    assert not any(got[i].accepted for i in (1000, 1001, 1002)) and got[1003].language == "de"
    kept = language.drop_unidentified(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() >= 0.98 * len(truth)


def test_language_judges_each_row(spark, languages):
    df, _ = languages
    good = df.where("doc_id = 0").first()
    odd = [(None, "42 !!", "en", "hot"), (None, good.text, good.lang, good.source), (2000, "42 !!", "en", "hot"), (2000, good.text, good.lang, good.source), (2001, None, None, None), (None, None, None, None)]
    more = df.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, DOCS))
    kept = Counter((r.doc_id, r.text) for r in language.drop_unidentified(more).where("doc_id is null or doc_id >= 2000").collect())
    assert kept == Counter({(None, good.text): 1, (2000, good.text): 1})


def test_language_of_many(spark):
    """Seventy languages with words of their own: none is left out of the model."""
    rng = random.Random(3)
    codes = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]
    rows = []
    for k, lang in enumerate(codes):
        parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        rows += [(8 * k + i, " ".join(rng.choice(parts) for _ in range(40)), lang if i else None, f"s{k}") for i in range(8)]
    got = {r.id: r for r in language.identify(language.document_rows(spark.createDataFrame(rows, DOCS)), ["host"]).collect()}
    assert all(got[8 * k + i].language == lang and got[8 * k + i].accepted for k, lang in enumerate(codes) for i in range(8))


def test_language_without_evidence(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(language.document_rows(empty), ["host"]).count() == 0
    bare = spark.createDataFrame([(1, "some text", None, None), (2, None, "not a code", None)], DOCS)
    assert [(r.language, r.accepted) for r in language.identify(language.document_rows(bare), ["host"]).collect()] == [(None, False)] * 2


def test_language_of_pages(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, f"http://www.{lang}{i % 4}.example.{'org' if lang == 'en' else lang}/x", f"<html lang='{lang}'><script>var der=1</script><p>{words_of(rng, lang, 30)}</p></html>"))
    rows += [(100, "http://www.de1.example.de/y", "<p>???</p>"), (101, None, None)]
    got = {r.id: r for r in language.identify(language.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")), ["suffix", "domain", "host"]).collect()}
    assert all(got[i].language == ["en", "de", "fr"][i % 3] and got[i].accepted for i in range(60))
    assert got[100].language == "de" and not got[100].accepted and not got[101].accepted


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = i % 7 == 0, i % 5 == 0
        w = words_of(rng, "en", 40).split()
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron"])
        text = " ".join(x + ("!!" if bad else "") for x in w)
        rows.append((i, text.upper() if bad else text, "en", "hot" if i % 3 == 0 else f"s{i % 50}"))
        if i < 400:
            labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "s1"), (1, rows[1][1], "en", "hot"), (1002, "word " * 100_000, "en", "s2")]
    d = spark.createDataFrame(rows, DOCS).withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, lab).collect()}
    assert len(got) == 603
    held = range(400, 600)
    assert sum((got[i].quality_p >= 0.5) == (i % 5 != 0) for i in held) >= 195
    assert sum((got[i].toxic_p >= 0.5) == (i % 7 == 0) for i in held) >= 195
    assert sum(got[i].keep == (i % 5 != 0 and i % 7 != 0) for i in held) >= 192
    assert all(0 <= got[i].quality_p <= 1 for i in got)
    none = quality.classify(d, lab.where("false")).collect()
    assert len(none) == len(rows) and all(abs(r.quality_own - 0.5) < 1e-6 for r in none)
    assert quality.classify(d.where("false"), lab).count() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [(i, "big", "a", 3.0 if i % 2 else -3.0) for i in range(200)] + [(500, "one", "a", 3.0)] + [(600 + i, "good", "a", 3.0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, quality_own double")
    got = {r.doc_id: r for r in quality.posteriors(df, "quality").collect()}
    assert got[600].quality_host > 0.9 > got[500].quality_host > got[0].quality_host - 0.05
    prior = sum(1 / (1 + math.exp(-r[3])) for r in rows) / len(rows)
    assert abs(got[500].quality_host - prior) < 0.02


PIECES = [("<unk>", 0.0), ("▁", -1.0), ("▁th", -2.0), ("in", -3.0), ("g", -4.0), ("he", -5.0), ("▁the", -6.0), ("ti", -7.0), ("on", -8.0), ("<0x41>", -9.0), ("tion", -10.0), ("er", -11.0)]


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice(PIECES)
    w = {k: model.log_w[i] for i, k in enumerate(model.texts)}

    def brute(word):
        def rest(s):
            return 1.0 if not s else sum(math.exp(w[1, s[:k]]) * rest(s[k:]) for k in range(1, len(s) + 1) if (1, s[:k]) in w)

        return sum(math.exp(w[0, word[:k]]) * rest(word[k:]) for k in range(len(word) + 1) if (0, word[:k]) in w)

    for word in (b"the", b"thing", b"tioning", b"x", "ü".encode(), b"thethetion"):
        assert math.isclose(model.log_p([word], [model.log_w])[0, 0], math.log(brute(word)), rel_tol=1e-9)
    long = b"thing" * 400
    assert np.isfinite(model.log_p([long, b"a" * 30], [model.log_w])).all()
    short, by_log = b"thing" * 4, model._forward(np.frombuffer(b"thing" * 4, np.uint8)[None], model._edges(np.frombuffer(b"thing" * 4, np.uint8)[None]), model.log_w)
    assert math.isclose(model.log_p([short], [model.log_w])[0, 0], by_log[0, -1], rel_tol=1e-12)
    # Expected uses: a word's pieces cover its bytes once in every segmentation.
    for word in (b"thing", b"tion" * 9):
        uses = model.expected([word], model.log_w)
        assert math.isclose(sum(len(t) * u for (_, t), u in zip(model.texts, uses, strict=True)), len(word), rel_tol=1e-9)


def test_lattice_of_unseen_bytes():
    """After training on 10**6 words no piece of these words was used, and each pass left it its old weight only."""
    model = lattice.Lattice(PIECES)
    weights = np.exp(model.log_w[:-1])
    used = np.array([t in (b"the", b"in", b"g") for _, t in model.texts])
    for _ in range(lattice.PASSES):
        log_w = model.normal(weights + 1e6 * used)
        weights = np.exp(log_w[:-1])
    words = ["😀😁😂".encode(), "😀😁😂🤣😃😄".encode(), b"\x01" * 24, b"thing"]
    edges = lambda w: model._edges(np.frombuffer(w, np.uint8)[None])
    want = [model._forward(np.frombuffer(w, np.uint8)[None], edges(w), log_w)[0, -1] for w in words]
    assert min(want) < -700 and np.isfinite(want).all()
    assert np.allclose(model.log_p(words, [model.log_w, log_w])[:, 1], want, rtol=1e-9)
    for at in (words[1:2], words):
        uses = model.expected(at, log_w)
        assert math.isclose(sum(len(t) * u for (_, t), u in zip(model.texts, uses, strict=True)), sum(map(len, at)), rel_tol=1e-9)


def test_lattice_scores(spark):
    rng = random.Random(8)
    rows = [(i, words_of(rng, ["en", "de"][i % 2], rng.randrange(60)), ["en", "de"][i % 2], "s") for i in range(300)] + [(900, None, None, None), (901, "", "en", "s"), (3, "THE the\tOf", "en", "s"), (902, "x" * 70_00, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("row", F.lit(2)).withColumn("base", F.lit(3))
    got = lattice.score(df, PIECES).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    apart = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t, *_ in rows if not apart(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        want[i, apart(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in got)
    assert lattice.score(df.where("false"), PIECES).count() == 0


def test_probabilities_add_up(spark):
    """Over all words of up to two bytes of a tiny alphabet no more than one."""
    model = lattice.Lattice([("▁", 0.0), ("a", -1.0), ("b", -2.0), ("▁a", -3.0), ("ab", -4.0)])
    words = [bytes([x]) for x in range(256)] + [bytes([x, y]) for x in range(256) for y in range(256)]
    assert np.exp(model.log_p(words, [model.log_w])).sum() <= 1


def plain_scores(rows):
    """The whole model by loops: counts by language, the mixture, the sum over languages; only the fitted weights are the operator's."""
    apart = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words_in = lambda t: (t or "").encode().lower().split()
    training = [(t, lang) for i, t, lang, _ in rows if not apart(i)]
    n_docs = Counter(lang for _, lang in training)
    own = sorted(x for x in n_docs if x is not None and n_docs[x] >= lattice.SHARE * len(training))
    counts = {k: Counter() for k in [*own, None]}
    for t, lang in training:
        counts[lang if lang in own else None].update([*words_in(t), b""])
    model, fitted = lattice.Lattice(PIECES), {}
    for k, c in counts.items():
        w = model.log_w
        for _ in range(lattice.PASSES):
            uses = np.exp(w[:-1])
            for size in {len(x) for x in c if x}:  # each word once, however often it is said
                uses = uses + sum(model.expected([x], w) for x in sorted(c) if len(x) == size)
            w = model.normal(uses)
        fitted[k] = w
    out, masses = Counter(), {}
    for k, c in counts.items():
        n, known = sum(c.values()), [x for x in c if x]
        one, two = (sum(c[x] == m for x in known) for m in (1, 2))
        d = min(max(one / max(one + 2 * two, 1), lattice.LEAST), lattice.MOST)
        spread = d * len(known) / n if n else 0.5
        counts[k] = c, n, d, spread
        masses[k] = sum(max(c[x] - d, 0) for x in known) / max(n, 1) + spread + (c[b""] / n if n else 0.5)
    ends = {k: c[b""] for k, (c, *_) in counts.items()}

    def p_of(k, x):
        c, n, d, spread = counts[k]
        if not x:
            return math.log(c[x] / n if n else 0.5)
        known = max(c[x] - d, 0) / max(n, 1)
        return np.logaddexp(math.log(known) if known else -np.inf, math.log(spread) + model.log_p([x], [fitted[k]])[0, 0])

    for i, t, *_ in rows:
        each = [math.log((ends[k] + 1 / len(counts)) / (sum(ends.values()) + 1)) + sum(p_of(k, x) for x in [*words_in(t), b""]) for k in counts]
        top = max(each)
        plain = sum(model.log_p([x], [model.log_w])[0, 0] for x in words_in(t)) + math.log(0.5)
        out[i, round((top + math.log(sum(math.exp(x - top) for x in each))) / math.log(10), 6), round(plain / math.log(10), 6)] += 1
    return out, masses


def test_scores_against_loops(spark):
    rng = random.Random(12)
    rows = [(i, words_of(rng, ["en", "de"][i % 2], rng.randrange(12)), ["en", "de"][i % 2], "s") for i in range(140)]
    rows += [(900, None, None, "s"), (901, "", "en", "s"), (3, "THE the\tOf", "en", "s"), (902, "x" * 300 + " ing", "rare", None), (903, "y" * 65, "en", None), (904, "the" * 40 + " the", "fr", None)]
    rows = [r for r in rows if r[2] not in ("rare", None, "fr") or zlib.crc32(str(r[0]).encode()) % 7 == 2 or r[0] > 900]
    got = Counter((r.doc_id, round(r.score, 6), round(r.lattice_score, 6)) for r in lattice.score(spark.createDataFrame(rows, DOCS).repartition(4), PIECES, plain=True).collect())
    want, masses = plain_scores(rows)
    assert got == want
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in masses.values())


def test_languages_by_their_share(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "a", f"l{i % 40:02d}", "s") for i in range(4000)] + [(9000 + i, "a", "rare", "s") for i in range(9)], DOCS).withColumn("held_out", F.lit(False))
    assert lattice._languages(docs) == [f"l{k:02d}" for k in range(40)]


def test_texts_without_training_are_a_distribution():
    """The end takes one half, all words together the other."""
    m = lattice.Mixture(np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1))
    end, words = m.log_p(np.zeros((2, 1)), np.array([True, False]), np.zeros((2, 1)))[:, 0]
    assert math.isclose(math.exp(end) + math.exp(words), 1)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    bench = [(k, words_of(rng, "en", 30)) for k in range(3)]
    texts = [words_of(rng, ["en", "de", "fr"][i % 3], 40) for i in range(60)]
    rows = [(i, t, ["en", "de", "fr"][i % 3], f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s1", 1), (101, texts[6] + " extra", "en", "s1", 1), (102, bench[1][1], "en", "s2", 1), (103, "42 !!", "en", "s2", 1), (104, texts[5] + " mail me at joe@example.com or 4524132264652876", "fr", "s3", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == columns
        if name == "pii":
            changed = docs.where("doc_id = 104").first() or docs.where("doc_id = 5").first()
            assert "joe@" not in changed.text and "4524132264652876" not in changed.text and changed.n_chars == len(changed.text)
    assert ids[0] == set(range(60)) | {100, 101, 102, 104}
    assert ids[1].isdisjoint({100, 101}) and set(range(60)) - {5} <= ids[1]
    assert ids[2] == ids[1] - {102} and ids[3] == ids[2] == ids[4]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == ids[4]
