"""Subword lattice likelihood of documents under a unigram language model.

A word's segmentations into pieces of an existing vocabulary form a lattice; the
word's probability is the sum over all of them, computed by the forward
recursion in log space.  The vocabulary's own scores (a rank for each piece) are
the first weights of the pieces; ``PASSES`` passes of expected counts over the
distinct training words (forward and backward over each lattice) fit the weights
to the corpus.  Words that the corpus knows have an edge of their own across the
whole lattice.  With c, N, V a word's count, all counts and distinct words of
the training documents of one language k, and D the share of one count that
Good and Turing's rule takes, n1 / (n1 + 2 n2) with n1, n2 words of count 1, 2:

    P_k(word) = max(c - D, 0) / N + D * V / N * lattice_k(word)
    P_k(end) = c / N

The end is counted among N but not among V: it is always known and takes no part in
the discount.  The lattice's weights add up to one over all words, so P_k does too,
and the texts of each language are a distribution; a language without training
documents gives the end one half and the lattice the other.  A text's probability is
the sum over the languages of their share times the product of P_k over its words
and end: the text is not told its language, that is summed out like the
segmentations.  Every path passes every word border, so the product over words is
the forward recursion over the whole document.  ``lattice_score``, where it is asked for, is the plain
marginal: all segmentations of all words by the vocabulary's own scores alone.

Words are counted by tasks, then by a shuffle on the word.  Words with a share of
at least 1 in 2**19 of all counts (at most 2**19 of them, by arithmetic) are
broadcast and scored where the texts are read; the others, none of which is
frequent, are joined.  Words of more than ``KEPT`` bytes stand in both by their digest.

Cases: a null or empty text is the end alone; bytes that no piece covers are
covered by the vocabulary's byte pieces; repeated rows each get a result (their
parts are kept apart by a row number); languages with less than a share of ``SHARE``
of the training documents, and documents without one, are one more language; without training documents
every count is 0 and all mass is the lattice's; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches

#: Bounds of the discount.
LEAST, MOST = 0.1, 0.95
PASSES = 4
#: Share of the training documents from which a language has weights of its own; by arithmetic no more than so many do.
SHARE = 1 / 128
#: Bytes of a word that are kept as they are; longer ones are known by a digest.
KEPT = 64
#: Share of all counts from which a word is broadcast.
HEAD = 1 << 19
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Words that go through the lattice at once.
AT_ONCE = 20_000
#: Words of up to so many bytes are summed as they are and the logarithm is taken
#: once; longer ones, and those whose plain sum is under ``TINY`` (pieces unseen in
#: a language lose their weight with every pass), in log space at every step.
SHORT = 24
#: What a plain sum of at least this has lost to underflow is below its own rounding.
TINY = 1e-290
END = b""  # no word is empty
_BASE = np.uint64(0x100000001B3)


def tokens(text: str | None) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D with A-Z lowered, then the end."""
    out = text.encode().lower().split() if text else []
    out.append(END)
    return out


def key_of(word: bytes) -> bytes:
    """A word, or a digest of a long one behind a byte that no word begins with."""
    return word if len(word) <= KEPT else b" " + blake2b(word, digest_size=32).digest()


class Mixture:
    """Known words and the lattice in one distribution for each language, from counts over its training documents.

    ``ns``: all tokens, ``vs``: distinct words without the end, ``once``, ``twice``: words of count 1 and 2.
    """

    def __init__(self, ns: np.ndarray, vs: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        self.ns = ns
        self.discount = np.clip(once / np.maximum(once + 2 * twice, 1), LEAST, MOST)
        self.spread = np.where(ns > 0, self.discount * vs / np.maximum(ns, 1), 0.5)

    def log_p(self, counts: np.ndarray, is_end: np.ndarray, by_lattice: np.ndarray) -> np.ndarray:
        """Log probabilities of words (rows) in each language (columns)."""
        whole = np.maximum(self.ns, 1)
        ends = np.where(self.ns > 0, counts / whole, 0.5)
        known = np.maximum(counts - self.discount, 0) / whole
        return np.where(is_end[:, None], _log(ends), np.logaddexp(_log(known), _log(self.spread) + by_lattice))


class Lattice:
    """The pieces of a vocabulary with weights, and the recursions over batches of words.

    A piece that begins a word is an edge from the start; the border mark alone
    is an edge to the first byte's place, from which inner pieces go on.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        """``pieces``: text and score; a score is a rank counted down from 0."""
        start: dict[bytes, float] = {}
        inner: dict[bytes, float] = {}
        for piece, score in pieces:
            weight = -np.log(2.7 - score)  # the r-th piece has a weight of about 1/r
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                inner.setdefault(bytes([int(piece[3:5], 16)]), weight)
            elif piece.startswith("<") and piece.endswith(">") and len(piece) > 2:
                continue
            elif piece.startswith("▁"):
                if "▁" not in piece[1:]:
                    start[piece[1:].encode().lower()] = max(weight, start.get(piece[1:].encode().lower(), -np.inf))
            else:
                inner[piece.encode().lower()] = max(weight, inner.get(piece.encode().lower(), -np.inf))
        for b in range(256):
            inner.setdefault(bytes([b]), -np.log(2.7 + len(pieces)))
        start.setdefault(b"", -np.log(2.7))
        keys = [(0, k) for k in sorted(start)] + [(1, k) for k in sorted(inner)]
        self.texts = keys
        weights = np.array([start[k] if kind == 0 else inner[k] for kind, k in keys])
        self.first = next(i for i, k in enumerate(keys) if k == (0, b""))
        self.longest = max(len(k) for _, k in keys)
        # For each kind and length: sorted hashes, and the pieces they are of.
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for kind in (0, 1):
            for size in range(1, self.longest + 1):
                at = [i for i, (k, t) in enumerate(keys) if k == kind and len(t) == size]
                if at:
                    h = np.array([self._hash(np.frombuffer(keys[i][1], np.uint8)[None, :])[0, -1] for i in at], np.uint64)
                    order = np.argsort(h)
                    self.tables[kind, size] = h[order], np.array(at)[order]
        self.log_w = self.normal(np.exp(weights))

    @staticmethod
    def normal(weights: np.ndarray) -> np.ndarray:
        """Log weights that add up to one; the last is no piece."""
        return np.append(np.log(weights / weights.sum()), -np.inf)

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of each row, polynomials modulo 2**64; column k is of the first k bytes."""
        out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                out[:, k + 1] = out[:, k] * _BASE + (words[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def _edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(kind, length, piece of each word at each place or -1) for words of one length."""
        n = words.shape[1]
        h = self._hash(words)
        out = []
        with np.errstate(over="ignore"):
            for (kind, size), (table, at) in self.tables.items():
                if size > n:
                    continue
                power = np.uint64(pow(int(_BASE), size, 1 << 64))
                x = h[:, size : size + 1] if kind == 0 else h[:, size:] - h[:, : n - size + 1] * power
                k = np.minimum(np.searchsorted(table, x), len(table) - 1)
                there = table[k] == x
                if there.any():
                    out.append((kind, size, np.where(there, at[k], -1)))
        return out

    def _forward(self, words: np.ndarray, edges: list, log_w: np.ndarray) -> np.ndarray:
        """alpha[:, j]: log probability of all ways to the place after j bytes."""
        count, n = words.shape
        alpha = np.full((count, n + 1), -np.inf)
        alpha[:, 0] = log_w[self.first]
        for j in range(1, n + 1):
            ways = []
            for kind, size, piece in edges:
                if kind == 0 and size == j:
                    ways.append(log_w[piece[:, 0]])
                elif kind == 1 and size <= j:
                    ways.append(alpha[:, j - size] + log_w[piece[:, j - size]])
            if ways:
                alpha[:, j] = np.logaddexp.reduce(ways)
        return alpha

    def _backward(self, words: np.ndarray, edges: list, log_w: np.ndarray) -> np.ndarray:
        count, n = words.shape
        beta = np.full((count, n + 1), -np.inf)
        beta[:, n] = 0.0
        for j in range(n - 1, -1, -1):
            ways = [beta[:, j + size] + log_w[piece[:, j]] for kind, size, piece in edges if kind == 1 and j + size <= n]
            if ways:
                beta[:, j] = np.logaddexp.reduce(ways)
        return beta

    @staticmethod
    def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            step = max(1, 2_000_000 // (int(n) * 16))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                yield part, np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), int(n))

    def _short_forward(self, n: int, edges: list, w: np.ndarray, count: int) -> np.ndarray:
        """The forward sums of short words, by language, word and place; ``w`` are weights by language and piece."""
        alpha = np.zeros((len(w), count, n + 1))
        alpha[:, :, 0] = w[:, self.first, None]
        for j in range(1, n + 1):
            for kind, size, piece in edges:
                if kind == 0 and size == j:
                    alpha[:, :, j] += w[:, piece[:, 0]]
                elif kind == 1 and size <= j:
                    alpha[:, :, j] += alpha[:, :, j - size] * w[:, piece[:, j - size]]
        return alpha

    def log_p(self, words: list[bytes], log_ws: list[np.ndarray]) -> np.ndarray:
        """Natural log of each word's sum over all segmentations, a column for each set of weights."""
        out = np.zeros((len(words), len(log_ws)))
        w = np.exp(np.stack(log_ws))
        for at, block in self._by_length(words):
            edges = self._edges(block)
            if block.shape[1] <= SHORT:
                plain = self._short_forward(block.shape[1], edges, w, len(block))[:, :, -1]
                out[at] = np.log(np.maximum(plain, TINY)).T
                for k, log_w in enumerate(log_ws):
                    low = plain[k] < TINY
                    if low.any():
                        out[at[low], k] = self._forward(block[low], self._edges(block[low]), log_w)[:, -1]
                continue
            for k, log_w in enumerate(log_ws):
                out[at, k] = self._forward(block, edges, log_w)[:, -1]
        return out

    def expected(self, words: list[bytes], log_w: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, each word once."""
        total = np.zeros(len(log_w))
        w = np.exp(log_w)
        for _, block in self._by_length(words):
            edges = self._edges(block)
            count, n = block.shape
            if n <= SHORT:
                alpha = self._short_forward(n, edges, w[None], count)[0]
                low = alpha[:, -1] < TINY
                if low.any():
                    total += self._log_expected(block[low], self._edges(block[low]), log_w)
                    alpha, edges, count = alpha[~low], [(kind, size, piece[~low]) for kind, size, piece in edges], int((~low).sum())
                beta = np.zeros((count, n + 1))
                beta[:, n] = 1.0
                for j in range(n - 1, -1, -1):
                    for kind, size, piece in edges:
                        if kind == 1 and j + size <= n:
                            beta[:, j] += beta[:, j + size] * w[piece[:, j]]
                whole = alpha[:, -1:]
                for kind, size, piece in edges:
                    p = w[piece] * beta[:, size : size + 1] if kind == 0 else alpha[:, : n - size + 1] * w[piece] * beta[:, size:]
                    total += np.bincount(piece.ravel() % len(total), (p / whole).ravel(), len(total))
                total[self.first] += (w[self.first] * beta[:, 0] / whole[:, 0]).sum()
                continue
            total += self._log_expected(block, edges, log_w)
        return total[:-1]

    def _log_expected(self, block: np.ndarray, edges: list, log_w: np.ndarray) -> np.ndarray:
        """Expected uses over words of one length, in log space."""
        total = np.zeros(len(log_w))
        n = block.shape[1]
        alpha, beta = self._forward(block, edges, log_w), self._backward(block, edges, log_w)
        whole = alpha[:, -1:]
        for kind, size, piece in edges:
            if kind == 0:
                p = log_w[piece] + beta[:, size : size + 1] - whole
            else:
                p = alpha[:, : n - size + 1] + log_w[piece] + beta[:, size:] - whole
            total += np.bincount(piece.ravel() % len(total), np.exp(p).ravel(), len(total))
        total[self.first] += np.exp(log_w[self.first] + beta[:, 0] - whole[:, 0]).sum()
        return total


def _together(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Texts and scores of a public sentence-piece vocabulary."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


def held_out(doc_id):
    """Remainder of the CRC-32 of the decimal doc_id by 7 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _languages(docs: DataFrame) -> list[str]:
    """The languages with a share of the training documents of at least ``SHARE``."""
    training = docs.where("not held_out")
    named = training.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r.lang for r in named.where(F.col("n") >= SHARE * training.count()).collect())


def _counted(docs: DataFrame, languages: list[str]) -> DataFrame:
    """word, c0, c1, ... (counts in training documents by language, the last for all others) over all words of all documents."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[bytes]] = [Counter() for _ in range(len(languages) + 2)]  # the last for words of held-out documents

        def out() -> pa.RecordBatch:
            words = [w for c in counts for w in c]
            lang = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            n = [x for c in counts[:-1] for x in c.values()] + [0] * len(counts[-1])
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(lang, pa.int32()), pa.array(n, pa.int64())], ["word", "k", "n"])

        for batch in batches:
            for text, lang, apart in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts[-1 if apart else place.get(lang, len(languages))].update(tokens(text.as_py()))
            if sum(map(len, counts)) > COUNTED:
                yield out()
        yield out()

    rows = docs.select("text", "lang", "held_out").mapInArrow(run, "word binary, k int, n long")
    return rows.groupBy("word").agg(
        *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(len(languages) + 1)]
    )


def _weights(lattice: Lattice, words: DataFrame, n_languages: int) -> list[np.ndarray]:
    """Log weights for each language by passes of expected counts over its training words.

    The weights of the pass before stay as one word's worth of counts, so no piece
    is lost.  A pass brings to the driver one sum for each language and piece.
    """
    log_ws = [lattice.log_w] * n_languages
    spark = words.sparkSession
    one = spark.sparkContext.broadcast(lattice)
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(log_ws)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_languages, len(one.value.texts)))
            for batch in _together(batches):
                ws = np.array(batch.column(0).to_pylist(), object)
                for k in range(n_languages):
                    known = batch.column(1 + k).to_numpy(zero_copy_only=False) > 0
                    if known.any():
                        total[k] += one.value.expected(ws[known].tolist(), sent.value[k])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece], pa.float64())], ["k", "piece", "uses"])

        sums = (
            words.where("length(word) > 0")
            .select("word", *[f"c{k}" for k in range(n_languages)])
            .mapInArrow(run, "k int, piece int, uses double")
            .groupBy("k", "piece")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        fresh = [np.exp(w[:-1]) for w in log_ws]
        for k in range(n_languages):
            of = sums[sums["k"] == k]
            np.add.at(fresh[k], of["piece"].to_numpy(int), of["uses"].to_numpy(float))
        log_ws = [lattice.normal(w) for w in fresh]
        sent.unpersist()
    return log_ws


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def score(docs: DataFrame, pieces: list[tuple[str, float]], plain: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and, if ``plain``, lattice_score for each row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    languages = _languages(docs)
    size = len(languages) + 1
    words = cut(_counted(docs, languages), "words")
    c_all = sum((F.col(f"c{k}") for k in range(size)), F.lit(0))
    a_word = F.length("word") > 0
    whole = words.agg(
        *[F.sum(f"c{k}").alias(f"n{k}") for k in range(size)],
        *[F.sum(((F.col(f"c{k}") > 0) & a_word).cast("long")).alias(f"v{k}") for k in range(size)],
        *[F.sum(((F.col(f"c{k}") == i) & a_word).cast("long")).alias(f"t{i}{k}") for k in range(size) for i in (1, 2)],
        F.sum((c_all > 0).cast("long")).alias("v"),
        F.max(F.when(F.length("word") == 0, F.struct(*[f"c{k}" for k in range(size)]))).alias("ends"),
    ).first()
    ns = np.array([whole[f"n{k}"] or 0 for k in range(size)], float)
    vs = np.array([whole[f"v{k}"] or 0 for k in range(size)], float)
    n, v = int(ns.sum()), int(whole.v or 0)
    log_ws = _weights(Lattice(pieces), words, size)
    model = spark.sparkContext.broadcast((Lattice(pieces), log_ws))
    # Documents of each language, plus one over all, are the languages' shares.
    ends = np.array([whole.ends[k] if whole.ends else 0 for k in range(size)], float)
    shares = np.log((ends + 1.0 / size) / (ends.sum() + 1.0)).tolist()
    once, twice = (np.array([whole[f"t{i}{k}"] or 0 for k in range(size)], float) for i in (1, 2))
    mixture = Mixture(ns, vs, once, twice)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, weights = model.value
        for batch in _together(batches):
            ws = batch.column(0).to_pylist()
            c = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(size)], 1).astype(float).reshape(len(ws), size)
            is_end = np.array([w == END for w in ws], bool)
            by_lattice = lattice.log_p(ws, [lattice.log_w, *weights] if plain else weights)
            log_p = mixture.log_p(c, is_end, by_lattice[:, 1:] if plain else by_lattice)
            by_vocabulary = [pa.array(np.where(is_end, np.log(0.5), by_lattice[:, 0]) / np.log(10.0))] if plain else []
            total = c.sum(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key_of(w) for w in ws], pa.binary()), pa.array(total.astype(np.int64)), pa.array(np.log10((total + 1) / (n + v + 1.0))), *by_vocabulary,
                    *(pa.array(log_p[:, k]) for k in range(size)),
                ],
                ["word", "c", *sums_of],
            )

    names = [f"p{k}" for k in range(size)]
    sums_of = ["base", *(["plain"] if plain else []), *names]
    doubles = ", ".join(f"{x} double" for x in sums_of)
    valued = cut(words.mapInArrow(value, f"word binary, c long, {doubles}"), "valued")
    frequent = valued.where((F.col("c") * F.lit(HEAD) >= F.lit(n)) & (F.col("c") > 0)).toPandas()
    head = spark.sparkContext.broadcast(
        ({bytes(w): i for i, w in enumerate(frequent["word"])}, frequent[sums_of].to_numpy(float))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = head.value
        for batch in batches:
            rows: list[int] = []
            words: list[bytes | None] = []
            times: list[np.ndarray] = []
            sums, counts = [], []
            for i, text in enumerate(batch.column(2)):
                found = Counter(tokens(text.as_py()))
                own = [key_of(w) for w in found]
                t = np.fromiter(found.values(), np.int64, len(own))
                at = np.fromiter([known.get(w, -1) for w in own], np.int64, len(own))
                there = at >= 0
                sums.append(t[there] @ values[at[there]])
                counts.append((int(t.sum()), int(t[there].sum())))
                rest = np.flatnonzero(~there)
                rows += [i] * (1 + len(rest))
                words += [None, *(own[k] for k in rest)]
                times += [np.zeros(1, np.int64), t[rest]]
            at = pa.array(rows, pa.int64())
            first = pa.array([w is None for w in words], pa.bool_())
            of_doc = lambda x, kind: pc.if_else(first, pa.array(x, kind).take(at), pa.scalar(None, kind))
            table = np.array(sums).reshape(len(sums), len(sums_of))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(words, pa.binary()),
                    pa.array(np.concatenate([*times, np.empty(0, np.int64)])), of_doc([c[0] for c in counts], pa.int64()), of_doc([c[1] for c in counts], pa.int64()),
                    *(of_doc(table[:, k], pa.float64()) for k in range(len(sums_of))),
                ],
                ["row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", *sums_of],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    parts = numbered.mapInArrow(
        read, f"row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, {doubles}"
    )
    parts = cut(parts, "parts")
    sums = sums_of
    done = parts.where("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", *sums)
    rest = parts.where("word is not null").select("row", "word", "times").join(valued, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known_"), *[F.sum(F.col("times") * F.col(x)).alias(f"{x}_") for x in sums]
    )
    joined = done.join(rest, "row", "left")
    add = lambda x: F.col(x) + F.coalesce(F.col(f"{x}_"), F.lit(0))
    logs = F.array(*[add(x) + F.lit(share) for x, share in zip(names, shares, strict=True)])
    return (
        joined.select("doc_id", "held_out", "n_tokens", add("n_known").cast("long").alias("n_known"), add("base").alias("base_score"), *([add("plain").alias("lattice_score")] if plain else []), logs.alias("logs"))
        .withColumn("top", F.array_max("logs"))
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(n).cast("long").alias("train_tokens"),
            "base_score",
            ((F.col("top") + F.log(F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))) / F.log(F.lit(10.0))).alias("score"),
            *(["lattice_score"] if plain else []),
        )
    )
