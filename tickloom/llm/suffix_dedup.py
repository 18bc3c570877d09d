"""Suffix-array dedup by deep-shallow sorting: every byte that a repeated 100-byte string covers goes.

Open contexts of an anchor (see repeats) are ordered as suffixes, rightwards
from the anchor and leftwards from it. Multikey quicksort orders them to a
shallow depth, eight bytes to a key; what still agrees there goes through a
blind trie, which stores only branching depths and bytes and compares one full
string per insertion. The orders' longest common prefixes say what each context
shares with each earlier one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, textkit

WINDOW, GRAM = 100, 32
SHALLOW = 24

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
OUT_KEPT = OUT + ", kept binary"


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie of strings: inner nodes hold a depth and children by byte (-1 where the string ends), leaves hold strings' numbers."""

    def __init__(self):
        self.root = None
        self.strings: list[bytes] = []

    def add(self, s: bytes) -> None:
        number = len(self.strings)
        self.strings.append(s)
        if self.root is None:
            self.root = [number]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # blind descent: only branching bytes are looked at
            path.append(node)
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[0]]
        same = lcp(s, other)
        if same == len(s) == len(other):
            node.append(number)
            return
        parent = None
        for inner in path:
            if inner[0] >= same:
                break
            parent = inner
        mine = s[same] if same < len(s) else -1
        at = self.root if parent is None else parent[1][s[parent[0]] if parent[0] < len(s) else -1]
        if isinstance(at, tuple) and at[0] == same:
            at[1][mine] = [number]
            return
        theirs = other[same] if same < len(other) else -1
        split = (same, {theirs: at, mine: [number]})
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Indices in order. Multikey quicksort to SHALLOW bytes, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            out.extend(group)
            continue
        if depth >= SHALLOW:
            trie = BlindTrie()
            for i in group:
                trie.add(strings[i])
            out.extend(group[i] for i in trie.ordered())
            continue
        keys = [(strings[i][depth : depth + 8], i) for i in group]
        pivot = sorted((keys[0][0], keys[len(keys) // 2][0], keys[-1][0]))[1]
        less, same, more = [], [], []
        for k, i in keys:
            (less if k < pivot else more if k > pivot else same).append(i)
        if len(pivot) < 8:  # these strings end here and are equal
            stack += [(more, depth), (same, SHALLOW), (less, depth)]
        else:
            stack += [(more, depth), (same, depth + 8), (less, depth)]
    return out


def classes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, lcp of each with its predecessor in that order)."""
    order = deep_shallow(strings)
    return order, [0] + [lcp(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def _ranks(order: list[int], common: list[int], depth: int) -> list[int]:
    """Equal numbers for strings that agree in their first `depth` bytes."""
    out, c = [0] * len(order), 0
    for i, x in enumerate(order):
        c += common[i] < depth
        out[x] = c
    return out


def resolve(group, plan):
    """For each context of an anchor, what it shares with earlier ones: (context, first byte, end).

    A shared window lies `a` bytes left and `window - a` right of the anchor.
    Two contexts share it when both their left parts agree to a and their right
    parts to window - a, so each `a` is one pass over the two orders' classes.
    Small groups compare pairwise bounds instead; both give the same spans.
    """
    left = [x.units[: x.left][::-1] for x in group]
    right = [x.units[x.left :] for x in group]
    if len(group) <= 8:
        rights, lefts = _pairwise(right), _pairwise(left)
        for y in range(1, len(group)):
            most = [(lefts[x][y], rights[x][y]) for x in range(y) if lefts[x][y] + rights[x][y] >= plan.window and _earlier(group[x], group[y])]
            if most:
                at = group[y].left
                yield group[y], at - max(a for a, _ in most), at + max(b for _, b in most)
        return
    lo_order, hi_order = classes(left), classes(right)
    span: dict[int, tuple[int, int]] = {}
    for a in range(plan.reach + 1):
        l, r = _ranks(*lo_order, a), _ranks(*hi_order, plan.window - a)
        seen: dict[tuple, tuple] = {}  # the first doc_id that holds a window, and its texts that do
        for y, x in enumerate(group):
            if x.left < a or len(x.units) - x.left < plan.window - a:
                continue
            pair = (l[y], r[y])
            doc, tags = seen.setdefault(pair, (x.doc, set()))
            if doc != x.doc or x.tag in tags:
                got = span.get(y)
                lo, hi = x.left - a, x.left - a + plan.window
                span[y] = (min(lo, got[0]), max(hi, got[1])) if got else (lo, hi)
            else:
                tags.add(x.tag)
    for y, (lo, hi) in span.items():
        yield group[y], lo, hi


def _earlier(x: repeats.Context, y: repeats.Context) -> bool:
    """Whether x, which comes first in order, starts earlier: two texts under one doc_id do not."""
    return x.doc != y.doc or x.tag == y.tag


def _pairwise(strings: list[bytes]) -> list[list[int]]:
    order, common = classes(strings)
    out = [[0] * len(strings) for _ in strings]
    for i in range(len(order)):
        least = 1 << 30
        for j in range(i + 1, len(order)):
            least = min(least, common[j])
            out[order[i]][order[j]] = out[order[j]][order[i]] = least
    return out


PLAN = repeats.Plan(WINDOW, GRAM, repeats.byte_units)


def _cut(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches):
        for batch in batches:
            ids, found = textkit.column(batch, "doc_id"), textkit.column(batch, "spans")
            for lo, hi, body, offsets in textkit.text_slices(batch):
                gone = repeats.removed_mask(len(body), offsets, found.slice(lo, hi - lo))
                begun, _ = textkit.runs(gone, offsets)
                count = np.diff(np.searchsorted(begun, offsets))
                sums = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept, raw = body[~gone].tobytes(), np.diff(sums)
                texts = [kept[a:b] for a, b in zip(sums, sums[1:], strict=False)]
                size = np.diff(offsets)
                cols = [ids.slice(lo, hi - lo), pa.array(size), pa.array(size - raw), pa.array(count), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_text, schema=schema)

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with_text the kept bytes.

    Nulls: a null text is empty; a row without doc_id is kept whole and counts
    for nobody. Texts below 100 bytes never lose anything. Exact copies lose all
    but the one with the smallest doc_id. Repeated rows of one doc_id and text are
    one document; of two texts under one doc_id neither comes before the other,
    so ties take nothing from either. Very long texts are read whole, one at a
    time. An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    found = repeats.spans(docs, PLAN, resolve)
    return repeats.cut(docs, found, _cut(with_text), OUT_KEPT if with_text else OUT)
