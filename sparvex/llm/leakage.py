"""Evaluation texts that leak into a training corpus.

A document leaks an item if it holds a passage of at least `MIN_WORDS` words of the item, in order, of which at
most one in `ONE_IN` is changed, missing or added. Case, punctuation, line breaks, markup, comment signs and
escapes do not count; cell borders of a notebook break passages. An opening instruction (the first sentence or
line) that stands in two or more different items is not counted. Items that normalise to one text all leak.

Filter and verification, per Arrow batch of documents:
1. Q-grams: the text of `RUN` words in a row, of any item, looked up for all positions of all texts in a bit table. The edit
   budget counts words, of any number of letters, so q-grams are cut at words. A passage begins and ends with equal words. A
   long one can be cut so that a part is a passage too, so those with up to EDITS edits, of less than ONE_IN (EDITS + 1) words, are
   enough. By the q-gram lemma L words with e edits share L - RUN + 1 - RUN e q-grams with the item: 3 for 12 words and one edit,
   2 for 16 and two, 5 for 24 and three, 8 for 32 and four. No passage has fewer than `SEEDS`.
2. A (document, item) pair's q-grams are counted in overlapping diagonal bands, and bands are cut where none follows
   within a passage's length; regions with fewer than SEEDS are dropped.
3. Banded alignment of the words of each region (`aligned`): for each end of an alignment near the band's diagonals and
   each number of edits up to EDITS, the most words of the item that it spans. All regions of a batch go on side by side, as arrays.

The corpus is read once, whatever the number of items. Items are a small table; `ITEMS_AT_ONCE` of them are held by a task at once,
more are taken in blocks over each batch of documents, with one set of openings and one set of results.
Null, blank and very short items and null, empty texts give nothing; whole texts are searched; repeated
documents and items each give their rows, once. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS, ONE_IN = 12, 8
RUN, SEEDS = 5, 2
BAND, EDITS = 8, 4
#: Diagonals beside a band's middle that an alignment may use, and regions aligned side by side.
REACH_OF_BAND, SIDE_BY_SIDE = BAND // 2 + EDITS, 512
#: Words beside a seed that its passage can reach: less than EDITS + 1 times ONE_IN, and the edits.
REACH = (EDITS + 1) * ONE_IN + EDITS
ITEMS_AT_ONCE = 5000
_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)

_UNICODE = re.compile(r"\\+u([0-9a-fA-F]{4})")
_NOISE = re.compile(r"\\+[nrt]|&(?:[a-zA-Z]{2,8}|#\d{1,6});|</?[a-zA-Z][^<>\n]{0,80}>")
_ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: Lines or keys that stand between cells in the three notebook formats.
_BREAK = re.compile(r'^(?:# )?(?:%%|Out\[|In \[[ \d*]*\]:).*?(?=$|:)|"cell_type": "|"output_type": "', re.M)
_WORD = re.compile(r"[^\W_]+")
_STOP = " \x01 " * MIN_WORDS


def words_of(text: str, notebook: bool = False) -> list[str]:
    if notebook:
        text = _BREAK.sub(_STOP, text)
    if "\\u" in text:
        text = _UNICODE.sub(lambda m: chr(int(m[1], 16)), text)
    if "\\" in text or "&" in text or "<" in text:
        text = _NOISE.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text))
    return (_WORD_OR_STOP if notebook else _WORD).findall(text.casefold())


_WORD_OR_STOP = re.compile(r"[^\W_]+|\x01")


def _opening(text: str) -> tuple[str, str] | None:
    """The first sentence or line, and the whole text, as words; None if it is too short for an instruction."""
    w = words_of(re.split(r"[.:?!]\s|\n", text.strip(), maxsplit=1)[0])
    return (" ".join(w), " ".join(words_of(text))) if len(w) >= 5 else None


def _openings(texts: list[str]) -> set[str]:
    """First sentences or lines, as words, that two or more different items share."""
    seen = defaultdict(set)
    for t in texts:
        if o := _opening(t):
            seen[o[0]].add(o[1])
    return {h for h, full in seen.items() if len(full) > 1}


class Items:
    """The items, without their openings, and the table of their runs of RUN words.

    `openings`: the shared openings, if `rows` are not all items.
    """

    def __init__(self, rows: list[tuple[int, str]], openings: set[str] | None = None):
        if openings is None:
            openings = _openings([t for _, t in rows])
        by_words: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, t in rows:
            w = words_of(t)
            joined = " ".join(w)
            for o in openings:
                if joined.startswith(o + " "):
                    w = w[len(o.split()) :]
                    break
            if len(w) >= MIN_WORDS:
                by_words[tuple(w)].append(i)
        self.words, self.ids = list(by_words), list(by_words.values())
        self.number = {x: n for n, x in enumerate(sorted({x for w in self.words for x in w}))}
        self.coded = [np.array([self.number[x] for x in w], np.int64) for w in self.words]
        flat: list[int] = []
        for w in self.words:
            flat += [self.number[x] for x in w]
            flat.append(-1)
        lens = np.array([len(w) + 1 for w in self.words], np.int64)
        first = np.cumsum(lens) - lens
        at, seed = _runs(np.array(flat, np.int64))
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.seed_item = np.searchsorted(first, at[order], "right") - 1
        self.seed_at = at[order] - first[self.seed_item] if len(at) else at
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[_slot(self.seed)] = True


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where RUN known words (0 or more) follow each other, and a hash of them; verification makes clashes harmless."""
    n = max(0, len(numbers) - RUN + 1)
    known, mixed = np.ones(n, bool), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            part = numbers[i : i + n]
            known &= part >= 0
            mixed = (mixed ^ part.astype(np.uint64)) * _MULT
            mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(known)
    return at, mixed[at]


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g * _MULT) >> np.uint64(64 - _BITS)).astype(np.int64)


def aligned(docs: list[np.ndarray], items: list[np.ndarray], diagonals: list[int]) -> np.ndarray:
    """Which regions hold a passage. A region: the words of a part of a document, those of an item, as numbers, and the middle
    diagonal (place in the part minus place in the item) of its band.

    After place i of all parts, row e of `span` has for each diagonal the most words of the item that an alignment with e edits
    spans that ends there; an alignment begins and ends with an equal word.
    """
    found = np.zeros(len(docs), bool)
    order = np.argsort([len(d) for d in docs], kind="stable")
    offset = np.arange(-REACH_OF_BAND, REACH_OF_BAND + 1)
    for start in range(0, len(order), SIDE_BY_SIDE):
        rows = order[start : start + SIDE_BY_SIDE]
        n, wide = len(rows), max(len(docs[r]) for r in rows)
        tall = max(len(items[r]) for r in rows)
        doc, item = np.full((n, wide), -1), np.full((n, tall + 2), -2)
        for k, r in enumerate(rows):
            doc[k, : len(docs[r])] = docs[r]
            item[k, : len(items[r])] = items[r]
        middle = np.array([diagonals[r] for r in rows])
        span = np.full((EDITS + 1, n, len(offset)), -999)
        good = np.zeros(n, bool)
        for i in range(wide):
            j = i - middle[:, None] + offset  # the item's place on each diagonal
            there = np.take_along_axis(item, np.clip(j, 0, tall), 1)
            there = np.where((j >= 0) & (j < tall), there, -2)
            inside = (j >= 0) & (there != -2)
            equal = (there == doc[:, i : i + 1]) & inside
            new = np.full_like(span, -999)
            new[0] = np.where(equal, np.maximum(span[0], 0) + 1, -999)
            good |= (new[0] >= MIN_WORDS).any(1)
            for e in range(1, EDITS + 1):
                match = np.where(equal & (span[e] > 0), span[e] + 1, -999)
                good |= ((match >= MIN_WORDS) & (match >= ONE_IN * e)).any(1)
                changed = np.where(inside & (span[e - 1] > 0), span[e - 1] + 1, -999)
                added = np.full_like(match, -999)  # a word of the document that the item lacks: the same place of the item before
                added[:, :-1] = span[e - 1][:, 1:]
                missing = np.full_like(match, -999)  # a word of the item that the document lacks
                missing[:, 1:] = np.where(inside[:, 1:] & (new[e - 1][:, :-1] > 0), new[e - 1][:, :-1] + 1, -999)
                new[e] = np.maximum(np.maximum(match, changed), np.maximum(added, missing))
            span = new
            if good.all():
                break
        found[rows] = good
    return found


def regions_of(at: np.ndarray, item_at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first word, end, middle diagonal) of the regions of a document with q-grams enough, from the places of the q-grams of
    one item in both (ascending in the document)."""
    diagonal = at - item_at
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        order = np.argsort(band, kind="stable")
        cuts = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(at[order]) > REACH)) + 1
        for part in np.split(order, cuts):
            if len(part) >= SEEDS:
                a = max(0, int(at[part[0]]) - REACH)
                yield a, int(at[part[-1]]) + RUN + REACH, int(band[part[0]]) * BAND - shift + BAND // 2 - a


def search_batch(items: Items, texts: list[str | None] | list[list[str]], cache: dict) -> Iterator[tuple[int, int]]:
    """(place of the text, item id) of all leaks. Texts may be given as their words."""
    if not items.words:
        return
    words = [t if isinstance(t, list) else words_of(t, notebook=True) if t else [] for t in texts]
    get, flat = items.number.get, []
    for w in words:
        flat += [get(x, -1) for x in w]
        flat.append(-1)
    flat = np.array(flat, np.int64)
    lens = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(lens) - lens
    at, seeds = _runs(flat)
    some = items.bits[_slot(seeds)]
    at, seeds = at[some], seeds[some]
    left, right = np.searchsorted(items.seed, seeds, "left"), np.searchsorted(items.seed, seeds, "right")
    n = right - left
    row = np.repeat(np.arange(len(at)), n)
    hit = left[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    doc = np.searchsorted(first, at[row], "right") - 1
    pair = doc * len(items.words) + items.seed_item[hit]
    order = np.argsort(pair, kind="stable")
    own, start, count = np.unique(pair[order], return_index=True, return_counts=True)
    asked: dict[tuple[int, int], list] = {}
    todo: dict[tuple, tuple] = {}
    for p, i, c in zip(own.tolist(), start.tolist(), count.tolist()):
        if c < SEEDS:
            continue
        d, k = divmod(p, len(items.words))
        mine = order[i : i + c]
        for a, z, middle in regions_of(at[row[mine]] - first[d], items.seed_at[hit[mine]]):
            part = flat[first[d] + a : first[d] + min(z, len(words[d]))]
            key = (k, middle, part.tobytes())
            asked.setdefault((d, k), []).append(key)
            if key not in cache:
                todo[key] = (part, items.coded[k], middle)
    if todo:
        cols = list(zip(*todo.values()))
        said = aligned(*map(list, cols)).tolist()
        if len(cache) + len(todo) > 50_000:
            kept = {key: cache[key] for keys in asked.values() for key in keys if key in cache}
            cache.clear()
            cache.update(kept)
        cache.update(zip(todo, said))
    for (d, k), keys in asked.items():
        if any(cache[key] for key in keys):
            for i in items.ids[k]:
                yield d, i


def _shared_openings(known: DataFrame) -> set[str]:
    """`_openings` over an item table of any size; only the shared openings are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [o for t in batch.column(0).to_pylist() if (o := _opening(t))]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names=["head", "full"])

    heads = known.select("item_text").mapInArrow(run, "head string, full string").distinct().groupBy("head").count()
    return {r["head"] for r in heads.where(F.col("count") > 1).collect()}


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id: every document with every item that leaked into it."""
    spark = documents.sparkSession
    kind_doc, kind_item = documents.schema["doc_id"].dataType, eval_items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind_doc), T.StructField("item_id", kind_item)])
    known = eval_items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", "item_text")
    blocks = max(1, -(-known.count() // ITEMS_AT_ONCE))
    openings = _shared_openings(known) if blocks > 1 else None
    texts = documents.where(F.length("text") > 0).select("doc_id", "text")
    sent = []
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        sent.append(spark.sparkContext.broadcast(sorted({(r.item_id, r.item_text) for r in own.collect()})))  # at most about ITEMS_AT_ONCE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(Items(sent[0].value, openings), {})] if blocks == 1 else None
        for batch in batches:
            words = [words_of(t, notebook=True) for t in batch.column(1).to_pylist()] if blocks > 1 else None
            for block in range(blocks):  # one block's items in memory at a time
                items, cache = held[0] if held else (Items(sent[block].value, openings), {})
                for i in range(0, batch.num_rows, 1000):
                    found = list(search_batch(items, words[i : i + 1000] if words else batch.column(1).slice(i, 1000).to_pylist(), cache))
                    ids = batch.column(0).take(pa.array([i + d for d, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([k for _, k in found], _arrow(kind_item))], names=["doc_id", "item_id"])

    return texts.mapInArrow(run, schema).distinct()


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
