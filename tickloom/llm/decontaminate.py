"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND.

A document's words are cut into overlapping passages, twice as long as the
longest item and half a passage apart, so a whole item always lies within one.
A passage is a query of its distinct words. Impacts are BM25 parts divided by
the item's score for its own text, so one threshold holds for all items. An item's
commonest words, up to SPARE of its score, cannot carry it over the threshold
alone: passages that lack enough of its other words for every item are
dismissed at once, and block-max WAND retrieves every item at or above the
threshold for the rest, exactly. A retrieved item is
a leak if enough of its five-word shingles stand in the passage, in all and of
its question (its first half) and its answer (the rest) each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SPARE = 0.25
OVERLAP, HALF = 0.8, 0.5
SHINGLE = 5
BLOCK = 16
LEAST_WORDS = 32
#: Items, and bytes of their texts, of one index; more are searched in several passes, one index alive at a time.
ITEMS = 50_000
INDEX_BYTES = 16 << 20

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words_of(body: np.ndarray, offsets: np.ndarray) -> textkit.Words:
    return textkit.Words(body, offsets, lower=True, word=_WORD)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, _U)
    code = np.zeros(total, _U)
    for i in range(n):
        code = textkit.mix(code + h[i : i + total] + _U(i + 1))
    return code


@dataclass
class Index:
    items: np.ndarray  # item ids
    terms: np.ndarray  # word hashes, ascending
    bounds: np.ndarray  # greatest impact of each term
    starts: np.ndarray  # postings of each term
    posted: np.ndarray  # item numbers, ascending within a term
    impacts: np.ndarray
    question: list[np.ndarray]  # shingles of the first half
    answer: list[np.ndarray]
    every: list[np.ndarray]
    widths: np.ndarray  # words of a shingle of the item
    stride: int
    maybe: np.ndarray  # by the low bits of a hash, whether a term has them
    spare: np.ndarray  # each item's impacts in words that do not count below
    key_starts: np.ndarray  # the other postings of each term
    key_items: np.ndarray
    key_impacts: np.ndarray

    def lists(self) -> list[tuple]:
        """Per term: postings, impacts, block maxima, the blocks' last items."""
        out = []
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            items, impacts = self.posted[a:b].tolist(), self.impacts[a:b].tolist()
            out.append((items, impacts, [max(impacts[i : i + BLOCK]) for i in range(0, b - a, BLOCK)], [items[min(i + BLOCK, b - a) - 1] for i in range(0, int(b - a), BLOCK)]))
        return out


def build(rows: list[tuple[int, str]]) -> Index | None:
    """The index of (item id, text) rows with words, or None if there are none."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t})
    body, offsets = textkit.raw_text(pa.array([t for _, t in rows], pa.large_string()))
    words = words_of(body, offsets)
    sizes = np.diff(words.first)
    some = np.flatnonzero(sizes)
    if not len(some):
        return None
    number = np.full(len(rows), -1)
    number[some] = np.arange(len(some))
    pairs, counts = np.unique(np.stack([words.hash, number[words.row].astype(_U)], 1), axis=0, return_counts=True)
    terms, starts = np.unique(pairs[:, 0], return_index=True)
    starts = np.append(starts, len(pairs))
    item = pairs[:, 1].astype(np.int64)
    df = np.repeat(np.diff(starts), np.diff(starts))
    idf = np.log1p((len(some) - df + 0.5) / (df + 0.5))
    length = sizes[some]
    impact = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[item] / length.mean()))
    impact /= np.bincount(item, impact)[item]
    maybe = np.zeros(1 << 16, bool)
    maybe[(terms & _U(0xFFFF)).astype(np.int64)] = True
    question, answer, every, widths = [], [], [], []
    for r in some:
        h = words.hash[words.first[r] : words.first[r + 1]]
        n = min(SHINGLE, max(1, len(h) // 2))
        half = -(-len(h) // 2)
        question.append(np.unique(grams(h[:half], n)))
        answer.append(np.unique(grams(h[half:], n)) if len(h) > half else question[-1])
        every.append(np.unique(grams(h, n)))
        widths.append(n)
    bounds = np.maximum.reduceat(impact, starts[:-1])
    # the commonest words of each item, as long as they stay within SPARE of its score
    order = np.lexsort((np.arange(len(df)), -df, item))
    sums = np.cumsum(impact[order])
    head = np.searchsorted(item[order], np.arange(len(some)))
    within = sums - (sums[head] - impact[order][head])[item[order]] <= SPARE
    spare = np.zeros(len(df), bool)
    spare[order[within]] = True
    rest = np.bincount(item, impact * spare, len(some))
    key_starts = np.concatenate([[0], np.cumsum(~spare)])[starts]
    return Index(np.array([rows[r][0] for r in some], np.int64), terms, bounds, starts, item, impact, question, answer, every, np.array(widths), max(LEAST_WORDS, int(length.max())), maybe, rest, key_starts, item[~spare], impact[~spare])


def block_max_wand(lists: list[tuple], bounds: list[float], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of every item whose impacts over the lists add up to the threshold, in order of items."""
    end = 1 << 62
    threshold -= 1e-9
    cursors = [[items[0], i, 0, bounds[i]] for i, (items, *_) in enumerate(lists)]
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[3]
            if total >= threshold:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        if item == end:
            break
        last = pivot
        while last + 1 < len(cursors) and cursors[last + 1][0] == item:
            last += 1
        bound, beyond = 0.0, end
        for c in cursors[: last + 1]:
            _, _, maxima, ends = lists[c[1]]
            b = c[2] // BLOCK
            while b < len(ends) and ends[b] < item:
                b += 1
            if b < len(ends):
                bound += maxima[b]
                beyond = min(beyond, ends[b] + 1)
        if bound < threshold:
            goal = max(item + 1, min(beyond, cursors[last + 1][0] if last + 1 < len(cursors) else end))
            moving = cursors[: last + 1]
        elif cursors[0][0] == item:
            score = sum(lists[c[1]][1][c[2]] for c in cursors[: last + 1])
            if score >= threshold:
                out.append((item, score))
            goal, moving = item + 1, cursors[: last + 1]
        else:
            goal, moving = item, [c for c in cursors[:pivot] if c[0] < item]
        for c in moving:
            items = lists[c[1]][0]
            p = c[2]
            while p < len(items) and items[p] < goal:
                p += 1
            c[2] = p
            c[0] = items[p] if p < len(items) else end
        cursors = [c for c in cursors if c[0] < end]
    return out


class Searcher:
    """An index with its lists unpacked, once for each worker."""

    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP, half: float = HALF):
        self.index, self.lists = index, index.lists()
        self.threshold, self.overlap, self.half = threshold, overlap, half

    def candidates(self, words: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passages that may reach the threshold; half passages with their terms: numbers, offsets, terms). A half passage is numbered row * 2**32 + place; a passage has the number of its first half."""
        ix = self.index
        hit = np.flatnonzero(ix.maybe[(words.hash & _U(0xFFFF)).astype(np.int64)])
        h = words.hash[hit]
        at = np.minimum(np.searchsorted(ix.terms, h), len(ix.terms) - 1)
        good = ix.terms[at] == h
        hit, term = hit[good], at[good]
        row = words.row[hit]
        cell = (row.astype(np.int64) << 32) + (hit - words.first[row]) // ix.stride
        order = np.lexsort((term, cell))
        cell, term = cell[order], term[order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (term[1:] != term[:-1])
        cell, term = cell[new], term[new]
        cells, begin = np.unique(cell, return_index=True)
        begin = np.append(begin, len(cell))
        # impacts of the words that count, by half passage and item
        size = np.diff(ix.key_starts)[term]
        post = np.repeat(ix.key_starts[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        number = np.repeat(np.repeat(np.arange(len(cells)), np.diff(begin)), size)
        n = len(ix.items)
        key, back = np.unique(number * n + ix.key_items[post], return_inverse=True)
        if not len(key):
            return np.zeros(0, np.int64), cells, begin, term
        mass = np.bincount(back, ix.key_impacts[post])
        where, item = cells[key // n], key % n
        # a passage is its half and the next; the one before holds this half as its second
        step = np.zeros(len(cells), bool)
        step[:-1] = cells[1:] == cells[:-1] + 1
        nxt = np.searchsorted(key, key + n)
        met = np.minimum(nxt, len(key) - 1)
        both = mass + np.where(step[key // n] & (key[met] == key + n), mass[met], 0)
        need = self.threshold - 1e-9 - ix.spare[item]
        first = where[both >= need]
        second = where[(mass >= need) & ((where & ((1 << 32) - 1)) > 0)] - 1
        return np.unique(np.concatenate([first, second])), cells, begin, term

    def leaks(self, body: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, item id, score, question overlap, answer overlap) of every leak, the best passage of each."""
        ix = self.index
        words = words_of(body, offsets)
        if not len(words.hash):
            return []
        passages, cells, begin, term = self.candidates(words)
        best: dict[tuple[int, int], tuple] = {}
        seen: dict[int, np.ndarray] = {}
        for p in passages.tolist():
            i = np.searchsorted(cells, [p, p + 1, p + 2]).tolist()
            own = np.unique(term[begin[i[0]] : begin[i[2]]])
            own = own.tolist()
            found = block_max_wand([self.lists[t] for t in own], ix.bounds[own].tolist(), self.threshold)
            if not found:
                continue
            row = p >> 32
            lo = int(words.first[row]) + (p & ((1 << 32) - 1)) * ix.stride
            h = words.hash[lo : min(lo + 2 * ix.stride, int(words.first[row + 1]))]
            seen.clear()
            for item, score in found:
                n = int(ix.widths[item])
                if n not in seen:
                    seen[n] = np.unique(grams(h, n))
                part = [float(np.isin(x[item], seen[n], assume_unique=True).mean()) for x in (ix.every, ix.question, ix.answer)]
                if part[0] >= self.overlap and part[1] >= self.half and part[2] >= self.half:
                    key = (row, int(ix.items[item]))
                    got = (score, part[1], part[2])
                    if key not in best or got > best[key]:
                        best[key] = got
        return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _indexes(benchmark: DataFrame, items: int, size: int = INDEX_BYTES) -> Iterator[tuple[Index, bool]]:
    """Indexes of at most about `items` test items and `size` bytes of text each, and whether it is the last. An item is never split."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, -(-found["n"] // items), -(-(found["b"] or 0) // size))
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        index = build([(r["item_id"], r["text"]) for r in some.collect()])
        if index is not None:
            yield index, k == parts - 1


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _searched(docs: DataFrame, benchmark: DataFrame, items: int, search, fold) -> DataFrame | None:
    """fold(result so far, search(index broadcast)) over the indexes. A pass that is not the last is written, and its index freed, before the next is built."""
    spark, out = docs.sparkSession, None
    session.ship(spark)
    for index, last in _indexes(benchmark, items):
        shared = spark.sparkContext.broadcast(pickle.dumps(index))
        out = fold(out, search(out, shared))
        if not last:
            out = session.materialize(out)
            shared.unpersist()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, BM25 score as a share of the item's own, question and answer overlap (rounded to 6 digits).

    Null texts and items without words match nothing; test items without id are
    left out, and items that share an id are each searched, the best counts. A
    document without id is reported with a null id, repeated rows are reported
    alike. Very long texts are searched whole, passage by passage; of passages that
    hold one item the best score counts, of equal ones the greater overlaps. Empty
    tables give an empty result; other columns, whatever their names, are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(_, shared):
        def run(batches):
            searcher = Searcher(pickle.loads(shared.value))
            for batch in batches:
                ids = textkit.column(batch, "doc_id").to_pylist()
                for lo, hi, body, offsets in textkit.text_slices(batch):
                    found = [(ids[lo + r], i, round(s, 6), round(q, 6), round(a, 6)) for r, i, s, q, a in searcher.leaks(body, offsets)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(_OUT_ARROW.types)], schema=_OUT_ARROW)

        return texts.mapInArrow(run, OUT)

    out = _searched(docs, benchmark, items, search, lambda before, part: part if before is None else before.unionByName(part))
    return docs.sparkSession.createDataFrame([], OUT) if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """docs, all columns, without the documents that hold a test item; the rules of find_leaks."""

    def search(left, shared):
        def run(batches):
            searcher = Searcher(pickle.loads(shared.value))
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, body, offsets in textkit.text_slices(batch):
                    keep[[lo + f[0] for f in searcher.leaks(body, offsets)]] = False
                yield batch.filter(pa.array(keep))

        left = docs if left is None else left
        return left.mapInArrow(run, left.schema)

    out = _searched(docs, benchmark, items, search, lambda _, part: part)
    return docs if out is None else out
