"""Encoding a corpus with a byte-level BPE tokenizer.

Two tiers. Texts are cut into pre-tokens by array operations over a whole Arrow batch, and every pre-token is
hashed. (1) A minimal perfect hash over the vocabulary resolves pre-tokens that are whole entries; the entry
is compared character by character, so a hash collision can't give a wrong id. (2) Misses are merged by a heap
of pair ranks over a linked list of bytes, once per distinct miss and worker (a memo that is emptied when full).

Rules: null and empty texts give an empty list; ids are those of ordinary text (special tokens in a text are
plain characters); whole texts, of any length, are encoded; bytes that are no UTF-8 become U+FFFD. An empty
table gives an empty result. The vocabulary file's path is a parameter; the driver reads it (its size is that
of one vocabulary) and the workers get its bytes with the task.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Contractions of the pre-tokenizer, a fixed value of the vocabulary: after an apostrophe that begins a token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MEMO = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class MinimalPerfectHash:
    """Levels of bit arrays: a key that is alone at its place in a level stays there, the others go on to the
    next. A key's index is the rank of its bit. Keys are distinct 64-bit hashes."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.7):
        self.levels, base, self.n = [], 0, len(keys)
        while len(keys):
            size = max(64, int(len(keys) * gamma))
            at = (_mix(keys, len(self.levels) + 1) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            alone = counts == 1
            index = np.where(alone, np.cumsum(alone) - 1 + base, -1).astype(np.int32)
            self.levels.append(index)
            base += int(alone.sum())
            keys = keys[~alone[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for a key that was not put in, any index or -1."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for i, index in enumerate(self.levels):
            at = (_mix(keys, i + 1) % np.uint64(len(index))).astype(np.int64)
            got = index[at]
            out[left] = got
            open_ = got < 0
            left, keys = left[open_], keys[open_]
            if not len(left):
                break
        return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Powers:
    def __init__(self):
        self.up, self.down = _powers(_R, 1 << 16), _powers(_R_INV, 1 << 16)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(_R, size), _powers(_R_INV, size)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, chars):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                if a < b:
                    out[a:b] = kind
    return out


def token_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. cp: code points of texts end to end; doc_starts: where each non-empty text begins."""
    n = len(cp)
    c = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, c[:-1]
    before[doc_starts] = 255
    space = c == SPACE
    after_blank = np.zeros(n, bool)  # behind a U+0020 of the same text: that blank begins the token
    after_blank[1:] = cp[:-1] == 32
    after_blank[doc_starts] = False
    starts = ~space & (c != before) & ~after_blank
    ends = np.empty(n, bool)  # the last white space of a run before more text
    ends[:-1] = space[:-1] & ~space[1:]
    ends[-1] = False
    ends &= ~first[1:]
    starts |= space & ((before != SPACE) | ends)
    quotes = np.flatnonzero((cp == 39) & starts)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(c[quotes + 1] == LETTER) & ~first[quotes + 1]]
    if len(quotes):
        one = cp[quotes + 1]
        two = np.where((quotes + 2 < n) & ~first[np.minimum(quotes + 2, n)], cp[np.minimum(quotes + 2, n - 1)], 0)
        length = np.zeros(len(quotes), np.int64)
        for x in CONTRACTIONS:
            hit = (one == ord(x[0])) & ((two == ord(x[1])) if len(x) == 2 else True) & (length == 0)
            length[hit] = len(x)
        q, length = quotes[length > 0], length[length > 0]
        starts[q + 1] = False
        end = q + 1 + length
        inside = end < n
        starts[end[inside]] |= (c[end[inside]] != SPACE) | (before[end[inside]] != SPACE)
    return np.flatnonzero(starts)


class Encoder:
    """A byte-level BPE vocabulary; `encode_arrow` encodes an Arrow array of strings."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.powers = _Powers()
        words = {}
        for token, i in self.ranks.items():
            try:
                words[token.decode()] = i
            except UnicodeDecodeError:  # a part of a character is never a whole pre-token
                pass
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.array([len(w) for w in words])
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        keys = self._hash(cps, at, at + lens)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries of the vocabulary have one hash")
        self.mph = MinimalPerfectHash(keys)
        place = self.mph(keys)
        self.at, self.len, self.id = np.empty(len(lens), np.int64), np.empty(len(lens), np.int64), np.empty(len(lens), np.int32)
        self.at[place], self.len[place], self.id[place] = at, lens, np.fromiter(words.values(), np.int32)
        self.cps, self.memo = cps, {}

    def _hash(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.powers.to(len(cp) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.powers.up[: len(cp)] * (cp.astype(np.uint64) + np.uint64(1)), out=total[1:])
            return (total[end] - total[start]) * self.powers.down[start]

    def whole(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tier 1: the id of each pre-token that is an entry, else -1."""
        place = self.mph(self._hash(cp, start, end))
        length = end - start
        place = np.where((place >= 0) & (self.len[place] == length), place, -1)
        for n in np.unique(length[place >= 0]):
            rows = np.flatnonzero((place >= 0) & (length == n))
            a, b = start[rows], self.at[place[rows]]
            same = np.ones(len(rows), bool)
            for k in range(int(n)):
                same &= cp[a + k] == self.cps[b + k]
            place[rows[~same]] = -1
        return np.where(place >= 0, self.id[place], -1)

    def merge(self, word: bytes) -> list[int]:
        """Tier 2: the merges of a heap over linked bytes; the lowest rank first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(word)
        parts = [word[i : i + 1] for i in range(n)]
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = following[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two was merged meanwhile
            parts[i] += parts[j]
            parts[j] = b""
            k = following[i] = following[j]
            if k < n:
                previous[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[k])))
            h = previous[i]
            if h >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + size))
        return [ranks[p] for p in parts if p]

    def encode_arrow(self, texts: pa.Array) -> pa.Array:
        offsets, data = _values(texts)
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        if raw.max() < 128:
            cp, bounds, text = raw, offsets, data.decode("ascii")
        else:
            text = data.decode("utf-8", "replace")
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            if chars[-1] != len(cp):  # broken UTF-8: measure each text on its own
                each = [len(data[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
                text = "".join(data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:]))
                cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                bounds = np.concatenate([[0], np.cumsum(each)])
            else:
                bounds = chars[offsets]
        start = token_starts(cp, bounds[:-1][bounds[:-1] < bounds[1:]])
        end = np.append(start[1:], len(cp))
        ids = self.whole(cp, start, end)
        missed = np.flatnonzero(ids < 0)
        memo, found = self.memo, []
        for a, b in zip(start[missed].tolist(), end[missed].tolist()):
            word = text[a:b]
            got = memo.get(word)
            if got is None:
                got = self.merge(word.encode())
                if b - a <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = got
            found.append(got)
        count = np.ones(len(start), np.int64)
        count[missed] = np.fromiter(map(len, found), np.int64, len(found))
        place = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(place[-1], np.int32)
        out[place[:-1][ids >= 0]] = ids[ids >= 0]
        if len(found):
            lens = count[missed]
            inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            out[np.repeat(place[missed], lens) + inner] = np.fromiter((i for x in found for i in x), np.int32, int(lens.sum()))
        return pa.ListArray.from_arrays(pa.array(place[np.searchsorted(start, bounds)].astype(np.int32)), pa.array(out))


def _values(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 and the bytes of a string array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(len(texts) + 1, np.int64), b""
    return offsets - offsets[0], texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]


@functools.lru_cache(maxsize=4)
def _encoder(packed: bytes) -> Encoder:
    return Encoder(zlib.decompress(packed))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`id_col` and `ids`, the token ids of `text_col`. No shuffle: one pass over the two columns."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        packed = df.sparkSession.sparkContext.broadcast(zlib.compress(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(packed.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):  # bounds the arrays of one step
                part = b.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode_arrow(part.column(1))], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
