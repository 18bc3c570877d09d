"""Substring dedup by suffix automata of reference shards: every word covered by a repeated 20-word window goes.

A reference shard is the set of contexts of the anchors that hash to one task
(see repeats). Each anchor's earlier contexts form a generalised suffix
automaton over word hashes; later contexts stream through it for matching
statistics, the longest suffix at each word that occurs earlier, and every
maximal span of at least the window is removed. The automata travel by shuffle
to the shard that needs them and not to every executor: broadcast, they would
grow with the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, textkit

WINDOW, GRAM = 20, 10

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
OUT_KEPT = OUT + ", kept string"


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, built online."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.last = 0

    def start(self) -> None:
        self.last = 0

    def extend(self, c: int) -> None:
        nxt, link, size = self.next, self.link, self.size
        p = self.last
        q = nxt[p].get(c)
        if q is not None:
            if size[q] == size[p] + 1:
                self.last = q
                return
            self.last = self._clone(p, q, c)
            return
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, c)
        self.last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence) -> None:
        self.start()
        for c in sequence:
            self.extend(c)

    def matching(self, sequence) -> list[int]:
        """Length of the longest suffix of sequence[:i+1] that occurs in the automaton, for each i."""
        nxt, link, size = self.next, self.link, self.size
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


def maximal_spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Unions of the matches of at least `least` units."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= least:
            lo = i + 1 - n
            if out and lo <= out[-1][1]:
                out[-1] = (min(lo, out[-1][0]), i + 1)
            else:
                out.append((lo, i + 1))
    return out


def _symbols(x: repeats.Context) -> list[int]:
    """A word at its distance from the anchor, so that overlapping contexts of one document do not match themselves."""
    words = np.frombuffer(x.units, np.uint64)
    return (words + (np.arange(len(words)) - x.left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()


def resolve(group, plan):
    """Stream one anchor's contexts, earliest first, through the automaton of earlier doc_ids and that of their own document."""
    before = SuffixAutomaton()
    for _, same in groupby(group, key=lambda x: x.doc):
        read = []
        for _, own in groupby(same, key=lambda x: x.tag):
            within = None
            for x in own:
                words = _symbols(x)
                for automaton in (before, within):
                    for lo, hi in maximal_spans(automaton.matching(words), plan.window) if automaton else ():
                        yield x, lo, hi
                within = within or SuffixAutomaton()
                within.add(words)
                read.append(words)
        for words in read:
            before.add(words)


PLAN = repeats.Plan(WINDOW, GRAM, repeats.word_units)


def _cut(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.string())] * with_text)

    def run(batches):
        for batch in batches:
            ids, found = textkit.column(batch, "doc_id"), textkit.column(batch, "spans")
            for lo, hi, body, offsets in textkit.text_slices(batch):
                starts, ends = textkit.runs(~textkit.SPACE[body], offsets)
                first = np.searchsorted(starts, offsets)
                gone = repeats.removed_mask(len(starts), first, found.slice(lo, hi - lo))
                # every kept word moves with one separator behind it
                size = ends - starts
                mask = np.zeros(len(body) + 1, np.int8)
                np.add.at(mask, starts[~gone], 1)
                np.add.at(mask, ends[~gone], -1)
                inside = np.cumsum(mask[:-1]) > 0
                length = np.where(gone, 0, size + 1)
                ahead = np.concatenate([[0], np.cumsum(length)])
                joined = np.full(ahead[-1], 32, np.uint8)
                place = np.ones(ahead[-1], bool)
                place[ahead[1:][~gone] - 1] = False
                joined[place] = body[inside]
                flat = joined.tobytes()
                texts = [flat[a : max(a, b - 1)] for a, b in zip(ahead[first], ahead[first[1:]], strict=False)]
                words = np.diff(first)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                cols = [ids.slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([t.decode() for t in texts])] * with_text, schema=schema)

    return run


def dedup_windows(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and with_text that text.

    Nulls: a null text has no words; a row without doc_id is kept whole and
    counts for nobody. Documents below 20 words never lose anything. Exact
    copies lose all but the one with the smallest doc_id. Repeated rows of one
    doc_id and text are one document; of two texts under one doc_id neither
    comes before the other, so ties take nothing from either. Very long texts
    are read whole, one at a time. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    found = repeats.spans(docs, PLAN, resolve)
    return repeats.cut(docs, found, _cut(with_text), OUT_KEPT if with_text else OUT)
