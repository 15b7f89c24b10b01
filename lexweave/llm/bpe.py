"""BPE encoding and decoding by batched merge rounds.

Symbols of many words lie in one flat array. A round looks up every neighbouring pair by binary search in
the sorted pair keys, takes each word's lowest rank, joins all its places at once, and drops finished words.

Defined cases: a null text is empty; an empty text has no token, the ids hash of the empty string and an
empty decoded text; special-token strings in a text become their ids, as in the tokenizers library; pairs of one rank
are joined from the left; a very long text is encoded whole; repeated rows and null doc_ids stay rows of their own; an empty
table gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Characters of the encodings that a worker remembers, of chunks up to CACHE_CHUNK characters; and of the chunks encoded at
#: once. Only speed and memory depend on them.
CACHE_CHARS = 12_000_000
CACHE_CHUNK = 200
BATCH_CHARS = 400_000
_NONE = np.iinfo(np.int64).max
_SPACES = "\t\n\v\f\r\x85\x20\xa0  -     　"
#: Words of more symbols are joined one pair at a time from a heap: rounds would be as many as their pair kinds.
LONG_WORD = 2_000
#: Lower-case forms that Unicode added after the version of Python's tables.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Ranges of letters and numbers that Unicode 17 and later added, which the library takes for symbols.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12F8F), (0x16EA0, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DFFF), (0x1E6C0, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
_IS_NEWER = re.compile(f"[{_NEWER_CLASS}]")
_GAP = re.compile(f"[{_SPACES}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary in the tokenizers JSON layout (NFC, lower case, white space dropped)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        without = lambda p: f"[[\\p{{{p}}}]--[{_NEWER_CLASS}]]"
        newer = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_NEWER_CLASS}])")
        newer = newer.replace(r"[\p{L}]+", without("L") + "+").replace(r"|[\p{N}]|", f"|{without('N')}|")
        self.pieces_newer = regex.compile(newer, regex.V1)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        self.width = max(self.token) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.lookup: dict[int, tuple[int, int]] | None = None
        self.keys, self.rank, self.joined = keys[order], order.astype(np.int64), joined[order]

    def merge_long(self, word: bytes) -> list[int]:
        """The same joins for one long word: lowest rank first, then leftmost, from a heap over a linked list."""
        if self.lookup is None:
            self.lookup = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.joined.tolist(), strict=True), strict=True))
        symbols = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] >= 0 and (got := self.lookup.get(key := symbols[a] * self.width + symbols[after[a]])):
                heapq.heappush(heap, (got[0], a, key))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, key = heapq.heappop(heap)
            b = after[a]
            if b < 0 or symbols[a] < 0 or symbols[a] * self.width + symbols[b] != key:
                continue
            symbols[a], symbols[b] = self.lookup[key][1], -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [x for x in symbols if x >= 0]

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at these places: the rank (or _NONE) and the joined symbol."""
        after = np.minimum(at + 1, symbols.size - 1)
        key = symbols[at] * self.width + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        real = (self.keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(real, self.rank[found], _NONE), self.joined[found]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (its UTF-8 bytes; none is empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._ranks(symbols, word, np.arange(symbols.size))
        while symbols.size:
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, word.size))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == _NONE, size)
            if over.any():
                done.append((word[over], symbols[over]))
            place = np.flatnonzero((rank == np.repeat(least, size)) & ~over)
            run = np.append(True, np.diff(place) != 1)[: place.size]
            offset = np.arange(place.size) - np.flatnonzero(run)[np.cumsum(run) - 1]
            # neighbouring places overlap only in runs of one symbol: every second one joins
            place = place[offset % 2 == 0]
            symbols[place] = into[place]
            keep = ~over
            keep[place + 1] = False
            joined = np.zeros(symbols.size, bool)
            joined[place] = True
            symbols, word, rank, into, joined = symbols[keep], word[keep], rank[keep], into[keep], joined[keep]
            joined[:-1] |= joined[1:]  # a join changes its own pair and the one before
            again = np.flatnonzero(joined)
            rank[again], into[again] = self._ranks(symbols, word, again)
        done.append((word, symbols))
        word = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        flat, out, start = symbols[order].tolist(), [], 0
        for n in counts.tolist():
            out.append(flat[start : start + n])
            start += n
        return out

    def chunks(self, text: str) -> list[str]:
        """Normalised text cut at white space; special tokens stay whole, marked by a leading NUL and space."""
        if self.special and "<|" in text:
            out: list[str] = []
            for part in self.split_special.split(text):
                out += ["\0 " + part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        text = text.lower()
        # str.split() takes four control characters for white space that the library does not
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [x for x in _GAP.split(text) if x]
        return text.split()

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else self.pieces.findall(chunk)
        chunk = chunk.translate(NEW_LOWER)
        return (self.pieces_newer if _IS_NEWER.search(chunk) else self.pieces).findall(chunk)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        words: list[bytes] = []
        spans = []
        for chunk in chunks:
            before = len(words)
            if not chunk.startswith("\0 "):
                words += [p.encode("utf-8", "surrogatepass") for p in self._pieces(chunk)]
            spans.append((before, len(words)))
        merged = self.merge([w for w in words if len(w) <= LONG_WORD] or [b"a"])
        if any(len(w) > LONG_WORD for w in words):
            short = iter(merged)
            merged = [self.merge_long(w) if len(w) > LONG_WORD else next(short) for w in words]
        out = []
        for chunk, (a, b) in zip(chunks, spans, strict=True):
            out.append([self.special[chunk[2:]]] if chunk.startswith("\0 ") else [i for w in merged[a:b] for i in w])
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_chunks(self.chunks(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens joined by one space."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def load(spec: str) -> WordBpe:
    return WordBpe(json.loads(spec))


class Memory(dict):
    """Encodings by chunk, and the characters that they hold."""

    chars = 0


@lru_cache(maxsize=2)
def remembered(spec: str, digest: bool) -> Memory:
    """A worker's encodings so far: later tasks of the same worker find them."""
    return Memory()


def _portions(chunks: list[str]) -> Iterator[list[str]]:
    """The chunks in lists of about BATCH_CHARS characters."""
    out, size = [], 0
    for chunk in chunks:
        out.append(chunk)
        size += len(chunk)
        if size >= BATCH_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """One row per document: ids and decoded text, or (digest) their SHA-256. The vocabulary (a few MB,
    read once on the driver, where the path is) is broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        cache = remembered(spec.value, digest)
        token = bpe.token
        for batch in slices(batches):
            split = [bpe.chunks(t) if t else [] for t in batch.column(1).to_pylist()]
            if cache.chars > CACHE_CHARS:
                cache.clear()
                cache.chars = 0
            seen = set().union(*split)
            own = {c: cache[c] for c in seen & cache.keys()}
            for part in _portions(list(seen - own.keys())):
                for chunk, ids in zip(part, bpe.encode_chunks(part), strict=True):
                    made = own[chunk] = (len(ids), " ".join(map(str, ids)) if digest else ids, " ".join([token[i] for i in ids]))
                    if len(chunk) <= CACHE_CHUNK:
                        cache[chunk] = made
                        cache.chars += 2 * len(chunk) + 8 * len(ids)
            n, left, right = [], [], []
            for chunks in split:
                got = [own[c] for c in chunks]
                n.append(sum([g[0] for g in got]))
                text = " ".join([g[2] for g in got if g[0]])
                if digest:
                    ids = " ".join([g[1] for g in got if g[0]])
                    left.append(hashlib.sha256(ids.encode()).hexdigest())
                    right.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    left.append([i for g in got for i in g[1]])
                    right.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.string() if digest else pa.list_(pa.int32())), pa.array(right, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST if digest else SCHEMA)
