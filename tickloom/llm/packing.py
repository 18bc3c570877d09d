"""Packing documents into token sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids are cut into pieces of the sequence length and one shorter
rest. Pieces are dealt to groups by a hash of document and start, so no
document, source or length is alone in a group, and each group is packed by
itself: longest piece first, into the first open sequence with room, which a
tournament tree of the remaining capacities finds in logarithmic time.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
TOKENIZER = "byte_bpe_50k.json"
#: Distinct space-separated parts whose ids a worker remembers.
MEMORY = 700_000
#: New parts that are encoded in one text.
JOINED = 200

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the characters among which Unicode's other white space lies.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def uneven_rows(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a space beside other white space."""
    at = np.flatnonzero(body == 32)
    ends = len(body)
    row = np.searchsorted(offsets, at, "right") - 1
    nxt, room = body[np.minimum(at + 1, ends - 1)], at + 1 < offsets[row + 1]
    bad = room & (_WHITE[nxt] | _MAYBE[nxt])
    for back, table in ((1, _WHITE), (2, _MAYBE), (3, _MAYBE)):
        bad |= (at - back >= offsets[row]) & table[body[np.maximum(at - back, 0)]]
    return np.unique(row[bad])


class Encoder:
    """Ids of the tokenizers library's vocabulary, remembered by space-separated part.

    The vocabulary's splitter always cuts before a single space that has no
    white space beside it, so a text's ids are those of its parts, each with
    its leading space. Parts are told apart by 64-bit hashes and only new ones
    are encoded, many plain ones in one text, whose ids are told apart by their
    widths in bytes. Texts with other white space beside a space are encoded
    whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level vocabulary writes one character for each byte of a token
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.count = 0
        self.flat = np.zeros(4096, np.uint32)
        self.filled = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> list[list[int]]:
        out: list = [None] * len(parts)
        # a plain part begins with its one space and neither begins nor ends by other white space, so it is split from its neighbours
        plain = [i for i, p in enumerate(parts) if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() and not any([s in p for s in self.special])]
        joined = ["".join([parts[i] for i in plain[k : k + JOINED]]) for k in range(0, len(plain), JOINED)]
        ids = np.array([x for got in self._whole(joined) for x in got], np.int64)
        ends = np.cumsum(self.widths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(parts[i].encode()) for i in plain]), "right").tolist()
        for i, lo, hi in zip(plain, [0, *cuts[:-1]], cuts, strict=False):
            out[i] = ids[lo:hi].tolist()
        late = [i for i, x in enumerate(out) if x is None]
        for i, got in zip(late, self._whole([parts[i] for i in late]), strict=True):
            out[i] = got
        return out

    def _learn(self, hashes: list[int], parts: list[str]) -> None:
        ids = self._ids(parts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        body = np.fromiter((x for r in ids for x in r), np.uint32, int(sizes.sum()))
        while self.filled + len(body) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.count + len(ids) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        at = slice(self.count, self.count + len(ids))
        self.sizes[at] = sizes
        self.starts[at] = self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(body)] = body
        self.known.update(zip(hashes, range(self.count, self.count + len(ids)), strict=True))
        self.count += len(ids)
        self.filled += len(body)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of a slice one after another, offsets)."""
        if self.count > MEMORY:
            self.clear()
        # a part is a run without spaces and the space before it; a row's first part may have none
        starts, ends = textkit.runs(body != 32, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        spaced = (starts > offsets[row]).astype(np.uint64)
        code = textkit.mix(textkit.run_hashes(body, starts, ends) + spaced)
        distinct, where, inverse = np.unique(code, return_index=True, return_inverse=True)
        names = distinct.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        flat = body.tobytes()
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            at = where[some]
            self._learn([names[j] for j in some], [flat[a:b].decode() for a, b in zip(starts[at] - spaced[at].astype(np.int64), ends[at], strict=True)])
        codes = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[inverse]
        sizes = self.sizes[codes]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[codes] - at[:-1], sizes) + np.arange(at[-1])]
        out = at[np.searchsorted(row, np.arange(len(offsets)))]
        whole = set(uneven_rows(body, offsets).tolist())
        # a space at a row's end stands before no part
        whole |= {int(r) for r in np.flatnonzero((np.diff(offsets) > 0) & (body[np.maximum(offsets[1:] - 1, 0)] == 32))} if len(body) else set()
        if not whole:
            return ids, out
        pieces = [ids[a:b] for a, b in zip(out, out[1:], strict=False)]
        rows = sorted(whole)
        for r, got in zip(rows, self._whole([flat[offsets[r] : offsets[r + 1]].decode() for r in rows]), strict=True):
            pieces[r] = np.array(got, np.uint32)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", sequence_id long, offset long, padded_to long"


def _cut(path: str, length: int, with_ids: bool):
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids_in = textkit.column(batch, "doc_id")
            for lo, hi, body, at in textkit.text_slices(batch):
                doc_ids = ids_in.slice(lo, hi - lo).to_pylist()
                tokens, offsets = enc.encode(body, at)
                rows = []
                for i, doc in enumerate(doc_ids):
                    own = np.append(tokens[offsets[i] : offsets[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(own), length):
                        piece = own[s : s + length]
                        rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(own)) + ((piece.tolist(),) if with_ids else ()))
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


class Tournament:
    """First open bin with room, by a tree of maxima over the bins' remaining capacities."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.size

    def take(self, b: int, amount: int) -> int:
        """Use up part of a bin; returns how much of it was left before."""
        tree, i = self.tree, b + self.size
        left = tree[i]
        tree[i] = left - amount
        i //= 2
        while i:
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
            i //= 2
        return left


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given in order of decreasing length."""
    bins = Tournament(len(lengths), capacity)
    out = []
    for n in lengths:
        b = bins.first(n)
        out.append((b, capacity - bins.take(b, n)))
    return out


def _pack(length: int, groups: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        placed = first_fit_decreasing(pdf["length"].tolist(), length)
        bins = np.array([b for b, _ in placed], np.int64)
        used = np.bincount(bins, pdf["length"]).astype(np.int64)[bins]
        out = pdf.drop(columns="group_id")
        out["sequence_id"] = bins * groups + int(key[0])
        out["offset"] = [o for _, o in placed]
        out["padded_to"] = np.where(used & (used - 1) == 0, used, length)
        return out

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document's ids, cut at multiples of the length; the end id counts. Null texts are empty: one piece of that id. Ids of documents may be null or repeat; every row is cut by itself. A very long text is encoded whole, one at a time. Other columns, whatever their names, are ignored; an empty table gives an empty result."""
    session.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_cut(path or tokenizer_path(), length, with_ids), PIECE + ", ids array<long>" * with_ids)


def pack(cut: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Pieces with sequence_id, offset and padded_to: the length, or the used tokens where they are a power of two. Any further columns of the pieces stay. Pieces of one length are placed in order of doc_id and start. An empty table gives an empty result."""
    spark = cut.sparkSession
    session.ship(spark)
    cut = session.materialize(cut)
    groups = max(1, -(-cut.count() // group_pieces))
    # rows without an id are told apart by their place in the written table, so that they are not one group
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    dealt = cut.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place, F.lit(seed)), F.lit(groups)))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name not in {x.split()[0] for x in PIECE.split(", ")})
    schema = PIECE + extra + ", sequence_id long, offset long, padded_to long"
    return dealt.groupBy("group_id").applyInPandas(_pack(length, groups), schema)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, length, with_ids), length)
