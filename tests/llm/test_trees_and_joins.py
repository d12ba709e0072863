"""Manifest, MinHash join and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import merkle, minhash, repair

LEAVES = "doc_id long, text string, lang string, source string, n_chars long, tree int, other string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, place):
    """Sibling or none, and whether it stands left, level by level."""
    for nodes in levels[:-1]:
        other = place ^ 1
        yield (nodes[other] if other < len(nodes) else ""), other < place
        place //= 2


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(*r[:5]), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: sorted(trees[x], key=lambda t: t[:3]) for x in order}
    levels = {x: plain_levels([t[2] for t in made[x]]) for x in order}
    top = plain_levels([levels[x][-1][0] for x in order])
    out = []
    for at, x in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(made[x]):
            steps = [*way(levels[x], k), *way(top, at)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = plain_leaf(*r[:4], r[4] + 1) if changed else leaf
            for other, left in steps:
                node = sha(other, node) if left else sha(node, other)
            out.append((r[0], leaf, levels[x][-1][0], top[-1][0], sha(*(s for s, _ in steps)), node, node == top[-1][0]))
    return Counter(out)


def manifest_of(spark, rows, levels=merkle.BLOCK_LEVELS):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], LEAVES).repartition(3)
    return Counter(tuple(r) for r in merkle.manifest(df, {"n_chars": merkle.tampered_chars(F.col("doc_id"), F.col("n_chars"))}, levels).collect())


def many(n, rng):
    langs = [None, "de", "en", "en", "en", "fr", "é", ""]
    return [(i, f"text {i}", rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5, 2**63 - 1])) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = many(60, rng)
    rows += [(1, None, "en", None, 3), (1, "", "en", None, 3), (None, "x" * 300_000, None, "-", 0), *[(7, "same", "en", "s", 1)] * 20, (99, "alone", "zz", "é", 2)]
    assert manifest_of(spark, rows, levels) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(5, "one", "en", "s", 3)], [(5, "one", "en", "s", 3), (4, "two", None, None, None)], [(k, "t", "en", "s", k) for k in range(5)]])
def test_manifest_of_few(spark, rows):
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_fold_takes_right_siblings_only():
    leaves = [sha(str(k)).encode() for k in range(11)]
    block = merkle.Block(leaves, merkle.height_of(11))
    changed = [*leaves[:6], b"new", *leaves[7:]]
    want = merkle.Block(changed, merkle.height_of(11)).root
    for nodes in block.levels:  # what stands left is not read
        for k in range(len(nodes)):
            if k < 6 >> block.levels.index(nodes):
                nodes[k] = b""
    assert block.fold(6, b"new") == want


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def plain_components(docs):
    flat = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in flat}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            by[x].append(k)
    for k, (i, s) in enumerate(flat):
        for m, both in Counter(m for x in s for m in by[x] if m < k).items():
            j, o = flat[m]
            if 100 * both >= 85 * (len(s) + len(o) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        return words

    docs, i = [], 0
    common, original, chain = ([word() for _ in range(n)] for n in (60, 150, 120))
    for _ in range(80):  # a family, some at the border
        docs.append((i := i + 1, " ".join(edited(original, rng.randrange(8)))))
    for _ in range(14):  # each links with the one before only
        docs.append((i := i + 1, " ".join(chain)))
        chain = edited(chain, 2)
    for _ in range(120):  # a passage that is most of the text, in texts that are not near
        docs.append((i := i + 1, " ".join([word() for _ in range(rng.randrange(9, 60))] + common)))
    for k in range(40):  # pairs of such texts: many components behind one passage
        own = [word() for _ in range(20 + k % 5)] + common
        docs += [(i := i + 1, " ".join(own)), (i := i + 1, " ".join([*own[:-1], "end"]))]
    docs += [(i := i + 1, " ".join(common)) for _ in range(30)]
    for n in range(12):
        docs += [(i := i + 1, " ".join(common[:n])), (i := i + 1, " ".join(common[:n]).upper())]
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "w " * 3000), (904, "W\x0bw\x0c" * 1500), (905, " ".join(word() for _ in range(20_000)))]
    docs += [(5, docs[100][1]), (5, docs[4][1]), (906, docs[3][1]), (906, ""), (907, docs[7][1]), (907, docs[7][1])]
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_minhash(spark, corpus, monkeypatch, small):
    if small:  # lists of several blocks, sides too large to broadcast
        for name, n in (("BLOCK_CLASSES", 16), ("BLOCK_SHINGLES", 500), ("MOST_PICKED", 0)):
            monkeypatch.setattr(minhash, name, n)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    df = df.withColumn("pair", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component_id", F.lit(3))
    got = minhash.near_duplicates(df).collect()
    want = plain_components(corpus)
    assert len(set(want.values())) > 100
    assert {r.doc_id: r.component_id for r in got} == want
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in corpus)
    kept = {r.doc_id for r in minhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in minhash.near_duplicates(odd).collect()) == [("1", 4, "1"), ("None", 0, "None"), ("None", 4, "None")]


def test_linked_sets_agree_in_enough_coordinates():
    rng = random.Random(1)
    least = minhash.COORDINATES
    for n in (1, 7, 40, 400):
        for _ in range(100):
            a = [rng.getrandbits(63) for _ in range(n)]
            b = a[: -(-n * 92 // 100)] + [rng.getrandbits(63) for _ in range(n * 8 // 100)]
            a, b = (np.unique(np.array(x, np.int64)) for x in (a, b))
            if minhash.links(a, b):
                least = min(least, int((minhash.signature_of(a) == minhash.signature_of(b)).sum()))
    assert minhash.MATCHES <= least < minhash.COORDINATES


SPACE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """Counts, cost, audit and digest of ordered (role, text) rows: every edit string is kept whole."""
    n = Counter()
    judged, seen = [], set()
    for role, text in rows:
        t = text.strip(SPACE)
        fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None
        seen.add((role, text))
        n[fault] += 1
        judged.append((role, text, fault))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    legal = re.compile("(s?(ua)*u?|s)")
    states = {"": (0, "", ())}  # by the last two initials that matter: all output initials are kept short below

    def widen(states):
        for _ in range(2):
            for out, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    put(states, out + role[0], cost + 2, audit + "I", (*lines, (role, "")))
        return states

    def put(states, out, cost, audit, lines):
        if not legal.fullmatch(out):
            return
        out = out[-1:] if len(out) > 1 else out  # what follows depends on the last initial alone
        if out not in states or (cost, audit) < states[out][:2]:
            states[out] = (cost, audit, lines)

    states = widen(states)
    for role, text, fault in judged:
        new = {}
        for out, (cost, audit, lines) in states.items():
            full = {"": "", "s": "s", "u": "u", "a": "ua"}[out]
            put(new, full, cost + 3, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                put(new, full + (role[:1] or "?"), cost + more, audit + "K", (*lines, (role, text)))
                for given in ("user", "assistant"):
                    put(new, full + given[0], cost + 2 + more, audit + "R", (*lines, (given, text)))
        states = {}
        for out, (cost, audit, lines) in new.items():
            put(states, {"a": "ua"}.get(out, out), cost, audit, lines)
        for _ in range(2):
            for out, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    put(states, {"a": "ua"}.get(out, out) + role[0], cost + 2, audit + "I", (*lines, (role, "")))
    cost, audit, lines = min(states[x] for x in ("", "a") if x in states)
    return n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines))


def every_edit(rows):
    """The cheapest and least edit string of a few (role, text, fault) rows, by trying all with up to two insertions at a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * ins[0] + "".join(e + "I" * k for e, k in zip(edits, ins[1:], strict=True))
            cost, out, at, ok = 0, "", 0, True
            for e in audit:
                role, fault = (None, None) if e == "I" else rows[at]
                at += e != "I"
                cost += {"D": 3, "K": 0, "R": 2, "I": 2}[e] + (e in "KR" and fault == "truncated")
                ok &= not (e in "KR" and fault in ("blank", "duplicate"))
                if e != "D":
                    out += role[:1] if e == "K" else "a" if out.endswith("u") else "u"
            if ok and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_finds_the_least_of_all_edits():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(5))]
        found = []
        search = repair.Search(lambda e, r, t, found=found: found.append(e))
        for role, fault in rows:
            search.row(role, "x", fault == "blank", fault == "truncated")
        assert (search.end(), "".join(found)) == every_edit(rows), rows


def talks(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Well", "Why? ", " \t", "", None, "One.\nTwo!", "x.é", "no end\x0b", "Yes!\r\n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def plain_repairs(rows):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    for conv, found in by.items():
        kept = []
        for turn, role, text in found:
            role, text = (" " if v is None else v for v in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = {t for known, t, _, _ in kept if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *plain_audit([r[2:] for r in kept]))
    return out


def test_repair(spark):
    rows = talks(random.Random(3), 400)
    rows += [(7000, k, "user", f"again {k}.") for k in range(300)]  # only one role: survivors differ all the way
    rows += [(7001, k, ["user", "assistant"][k % 2], "" if k % 3 else f"Fine {k}." * 5000) for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    df = df.withColumn("dropped", F.lit(True)).withColumn("kind", F.lit(1)).withColumn("seen", F.lit("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r[0]: tuple(r[1:]) for r in repair.audits(repair.damaged(df), "dropped").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_repairs(rows)
    assert {"K", "D", "I", "R"} <= set("".join(r[6] for r in got.values()))
    lines = defaultdict(list)
    for r in repair.repaired(repair.damaged(df), "dropped").orderBy("conv_id", "ix").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(lines[conv])) == r[7] for conv, r in got.items())


def test_repair_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair.audits(repair.damaged(spark.createDataFrame([], kind)), "dropped").count() == 0
    assert repair.repaired(spark.createDataFrame([], kind)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(gone, 0, "user", "Here.")], kind)
    assert [tuple(r) for r in repair.audits(repair.damaged(only), "dropped").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_search_lets_go_of_what_is_certain():
    emitted = []
    search = repair.Search(lambda e, r, t: emitted.append(e))
    for k in range(20_000):
        search.row(["user", "assistant"][k % 2], "x", k % 5 == 0 and k % 2 == 1, False)
        assert k < 10 or len(emitted) > k - 10
    long = repair.Search(lambda e, r, t: None)
    for _ in range(50_000):
        long.row("user", "x", False, False)
    assert long.end() > 0
