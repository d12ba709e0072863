"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The encoder never replays merges.  An Aho-Corasick automaton over the tokens
gives the longest token that starts at each place of a word; a table of
compatible pairs says whether two tokens may stand side by side in a BPE
encoding; where the longest token does not fit, the next shorter one is tried,
and where none fits the encoder steps back.  A place from which no way leads on
is marked, so that every place is left at most once and the time is linear.

Cases: a null text is the empty text (no tokens, the digests of nothing);
special tokens that stand literally in a text are those tokens, as the
tokenizer's file declares them; repeated rows each get their own result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import small_batches

END = "</w>"
#: Words of which a worker remembers the tokens: as many again stay from before, and of those what is met moves on.
REMEMBERED = 150_000

# White space as the tokenizer's patterns see it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(f"[{_SPACE}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")  # the same of small ASCII words, without tables of characters
_NOT_SPACE_THERE = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() takes these for white space


# Letters and numbers of Unicode 16, which the tokenizer's tables know and this Python's don't.
_UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
# Capitals of Unicode 16 and their small letters.
_LOWER_16 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {x: x + 0x20 for x in range(0x10D50, 0x10D66)}
_CAPITALS_16 = frozenset(map(chr, _LOWER_16))
_KNOWN_SINCE = frozenset(chr(x) for a, b in _UNICODE_16 for x in range(a, b + 1))


#: Characters that were met and that the tokenizer's tables know.
_ASSIGNED: set[str] = set()


def _pieces(low: str) -> list[str]:
    """The pieces of a word in small letters.  Characters that the tokenizer's tables don't know yet are no letters there, whatever a newer table says."""
    if low.isascii():
        return [low] if low.isalpha() else _ASCII_PIECES.findall(low)
    if not _ASSIGNED.issuperset(low):
        known = "".join("\ue000" if unicodedata.category(c) == "Cn" and c not in _KNOWN_SINCE else c for c in low)
        if known != low:
            return [low[m.start() : m.end()] for m in _PIECES.finditer(known)]
        _ASSIGNED.update(low)
    return [low] if low.isalpha() else _PIECES.findall(low)


def _lower(word: str) -> str:
    """A word composed and in small letters, those of Unicode 16 too."""
    low = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
    return low if _CAPITALS_16.isdisjoint(low) else low.translate(_LOWER_16)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Memory:
    """What was made last, by its text.  When ``young`` is full it becomes ``old`` and what is old goes, so frequent texts stay."""

    def __init__(self, make: Callable[[str], Any]):
        self.make, self.young, self.old = make, {}, {}

    def missed(self, text: str) -> Any:
        """What is not among the young ones."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        got = self.old.get(text)
        if got is None:
            got = self.make(text)
        self.young[text] = got
        return got


class WordBpe:
    """A BPE with word ends, from its public JSON file.

    Inside, a word is a string of one symbol for each byte: chr(byte), and for
    the last one chr(256 + byte).
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        byte_of = {c: chr(i) for i, c in enumerate(_byte_chars())}

        def symbols(token: str) -> str:
            body = token.removesuffix(END)
            s = "".join(byte_of[c] for c in body)
            return s if body is token or body == token else s[:-1] + chr(256 + ord(s[-1]))

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.split: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.pair: dict[tuple[int, int], int] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        merged = set()
        by_symbols: dict[str, int] = {}
        for left, right in model["merges"]:
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            merged.add(t)
            if self._compatible(a, b):  # else BPE never makes this token
                self.pair[a, b] = t
                self.split[t] = (a, b)
                by_symbols[symbols(left + right)] = t
        for token, i in vocab.items():
            if i not in merged and token not in self.special and len(s := symbols(token)) == 1:
                by_symbols[s] = i
        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.automaton.add_word(s, (i, len(s) - 1))  # how far before its end a match begins
        self.automaton.make_automaton()
        self.size = [0] * n
        self.shorter = [-1] * n
        for s, i in by_symbols.items():
            self.size[i] = len(s)
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in by_symbols:
                    self.shorter[i] = by_symbols[s[:k]]
                    break
        # Decoding: all tokens' texts end to end, and where each begins.
        texts = [b""] * n
        for token, i in [*vocab.items(), *self.special.items()]:
            texts[i] = token.encode() + b" "  # the tokenizer declares no decoder: tokens are joined by a space
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.decimal = [b"%d" % i for i in range(n)]
        self._words, self._pieces = _Memory(self._word), _Memory(self.encode_piece)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE can leave a and b side by side: undo merges on both sides of
        the border, latest first, and look for one across it that came earlier."""
        limit = len(self.split) + 1
        while True:
            t = self.pair.get((a, b))
            if t is not None and t < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:  # a single symbol
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        got = self._valid.get((a, b))
        if got is None:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            got = self._valid[a, b] = self._compatible(a, b)
        return got

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        longest = {end - before: t for end, (t, before) in self.automaton.iter(s)}
        if self.size[longest[0]] == len(s):
            return [longest[0]]
        out: list[int] = []
        dead: set[int] = set()
        at, t, n = 0, longest[0], len(s)
        while at < n:
            while True:
                end = at + self.size[t]
                if end not in dead and (not out or self.compatible(out[-1], t)):
                    out.append(t)
                    at = end
                    t = longest.get(at, -1)
                    break
                t = self.shorter[t]
                if t < 0:
                    dead.add(at)
                    t = out.pop()
                    at -= self.size[t]
                    break
        return out

    def _word(self, word: str) -> tuple[bytes, bytes]:
        ids: list[int] = []
        low = word.lower() if word.isascii() else _lower(word)
        for piece in _pieces(low):
            got = self._pieces.young.get(piece)
            ids += self._pieces.missed(piece) if got is None else got
        return array("I", ids).tobytes(), b" ".join([self.decimal[i] for i in ids])

    def _plain(self, text: str) -> list[tuple[bytes, bytes]]:
        odd = any(c in text for c in _NOT_SPACE_THERE)
        words = [w for w in _SPLIT.split(text) if w] if odd else text.split()
        known = self._words
        out = []
        for w in words:
            got = known.young.get(w)
            if got is None:
                got = known.missed(w)
            if got[0]:
                out.append(got)
        return out

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """The ids, and the decimal ids joined by a space."""
        parts: list[tuple[bytes, bytes]] = []
        if self.special_pattern is not None and "<" in text:
            last = 0
            for m in self.special_pattern.finditer(text):
                i = self.special[m[0]]
                parts += [*self._plain(text[last : m.start()]), (array("I", [i]).tobytes(), self.decimal[i])]
                last = m.end()
            text = text[last:]
        parts += self._plain(text)
        return np.frombuffer(b"".join([p[0] for p in parts]), "<u4"), b" ".join([p[1] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by a space, gathered through the offset table."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        where = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.text[where].tobytes()[:-1]


@lru_cache(maxsize=2)
def _loaded(source: str) -> WordBpe:
    return WordBpe(source)


def _source(docs: DataFrame, tokenizer: str):
    """The tokenizer's file goes to the workers as one bounded broadcast (under 2 MB)."""
    with open(tokenizer, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


#: Ids decoded at a time: a long document is never expanded whole.
DECODE_STEP = 1 << 18


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``tokenizer`` is the path of a public word-end BPE file on the driver.
    """
    small_batches(docs.sparkSession)
    source = _source(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source.value)
        for batch in batches:
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for text in batch.column(1):
                ids, decimal = bpe.encode(text.as_py() or "")
                decoded = hashlib.sha256()
                for i in range(0, len(ids), DECODE_STEP):
                    decoded.update((b" " if i else b"") + bpe.decode(ids[i : i + DECODE_STEP]))
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(decimal).hexdigest())
                text_digests.append(decoded.hexdigest())
                if with_ids:
                    all_ids.append(ids)
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate([*all_ids, np.empty(0, "<u4")]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
