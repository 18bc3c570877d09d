"""Finding every window of W units (bytes or words) that also starts earlier in the corpus, exactly and in linear work.

The corpus is not compared pair by pair. Each window names one anchor, the
k-gram of least hash inside it, so equal windows name equal anchors at the same
place. Three passes follow.

1. Each document gives (anchor, context, doc, position) records, the context
   being all units that windows of this anchor can reach, as a hash. Records
   are grouped by anchor. Where a context occurs again, every window in it
   starts earlier, so all of it is repeated; one record per task and context is
   sent, so a context held by a third of all rows is cheap.
2. Anchors seen with two or more contexts are the only open cases: the first
   occurrence of each of their contexts is fetched with its units and handed to
   a resolver, which orders the contexts and says what each shares with earlier
   ones. The resolvers are the methods of the two operators.
   An anchor with more than HOT contexts (a line that stands in very many
   documents) is not handed to one resolver: each window that holds it is hashed
   and meets its equals by that hash, so no task holds the anchor.
3. Intervals meet by document, merge, and cut the text.

An earlier occurrence has a smaller doc_id, or stands in the same document with
an earlier start. A document is a doc_id with a text: rows that share both are
one document read again, rows that share a doc_id only are documents of which
neither comes before the other. Rows without a doc_id are never compared and
keep all their text; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

_U = np.uint64
RECORD = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("pos", "<i4")])
CONTEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("pos", "<i4"), ("left", "<i4"), ("size", "<i4")])
SEGMENT = 1 << 20
#: Contexts of one anchor that one resolver takes, and that one task sends to the anchor's bucket.
HOT = 2000
HOT_TASK = 256
#: Records of a task that are held before they are sent.
HELD = 400_000

BLOB = "bucket int, payload binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
#: kind 0: an interval; 1: an anchor for a resolver, at lo; 2: an anchor whose windows are to be hashed.
FOUND = "doc_id long, tag int, lo int, hi int, kind int"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int32())])


@dataclass(frozen=True)
class Plan:
    """window: units that must repeat; gram: units of an anchor; units: slice -> (codes, row offsets)."""

    window: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

    @property
    def reach(self) -> int:
        return self.window - self.gram


def byte_units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return textkit.BYTE_CODE[body], offsets


def word_units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = textkit.Words(body, offsets)
    return words.hash, words.first


def anchors(codes: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit within the row, hash) of the anchors of all windows."""
    w, window, k = plan.reach + 1, plan.window, plan.gram
    at, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    last = len(codes) - window
    for lo in range(0, last + 1, SEGMENT):
        hi = min(last + 1, lo + SEGMENT)
        # a window is whole only if the row that it starts in reaches its end
        starts = np.arange(lo, hi)
        row = np.searchsorted(offsets, starts, "right") - 1
        whole = starts + window <= offsets[row + 1]
        if not whole.any():
            continue
        part = codes[lo : hi + window - 1]
        n = len(part) - k + 1
        begin = np.arange(n)
        gram = textkit.Prefix(part).of(begin, begin + k)
        rank = (gram & ~_U((1 << 24) - 1)) | begin.astype(_U)
        pad = -n % w
        grid = np.concatenate([rank, np.full(pad, ~_U(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = hi - lo
        least = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])[whole]
        pick = np.unique((least & _U((1 << 24) - 1)).astype(np.int64))
        at.append(pick + lo)
        keys.append(gram[pick])
    where, key = np.concatenate(at), np.concatenate(keys)
    if len(where) and (np.diff(where) <= 0).any():  # segments may name the same anchor
        where, first = np.unique(where, return_index=True)
        key = key[first]
    row = np.searchsorted(offsets, where, "right") - 1
    return row, where - offsets[row], key


def reach(codes, offsets, row, pos, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, end, units left of the anchor) of each anchor's context within the whole slice."""
    place = offsets[row] + pos
    lo = np.maximum(place - plan.reach, offsets[row])
    hi = np.minimum(place + plan.window, offsets[row + 1])
    return lo, hi, place - lo


def context_hashes(codes, lo, hi, left) -> np.ndarray:
    out = np.empty(len(lo), _U)
    i = 0
    while i < len(lo):
        base = int(lo[i])
        j = max(i + 1, int(np.searchsorted(hi, base + SEGMENT, "right")))
        end = int(hi[i:j].max())
        out[i:j] = textkit.mix(textkit.Prefix(codes[base:end]).of(lo[i:j] - base, hi[i:j] - base) + left[i:j].astype(_U))
        i = j
    return out


def _records(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        ids, tags = (textkit.column(batch, c).to_numpy() for c in ("doc_id", "tag"))
        for lo, hi, body, offsets in textkit.text_slices(batch):
            codes, at = plan.units(body, offsets)
            row, pos, key = anchors(codes, at, plan)
            got = np.empty(len(row), RECORD)
            got["key"], got["doc"], got["tag"], got["pos"] = key, ids[lo:hi][row], tags[lo:hi][row], pos
            got["ctx"] = context_hashes(codes, *reach(codes, at, row, pos, plan))
            held.append(got)
            size += len(got)
            if size >= HELD:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _changes(got: np.ndarray, *names: str) -> np.ndarray:
    new = np.ones(len(got), bool)
    new[1:] = False
    for c in names:
        new[1:] |= got[c][1:] != got[c][:-1]
    return new


def _leading(new: np.ndarray) -> np.ndarray:
    """Index of the last True up to each place."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _by_context(got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct records by context, document and place; whether each one's context starts earlier: in a smaller doc_id, or in the same document)."""
    got = got[np.lexsort((got["pos"], got["tag"], got["doc"], got["ctx"], got["key"]))]
    got = got[_changes(got, "key", "ctx", "doc", "tag", "pos")]
    context, document = _changes(got, "key", "ctx"), _changes(got, "key", "ctx", "doc", "tag")
    return got, (got["doc"] != got["doc"][_leading(context)]) | ~document


def _mark(records: np.ndarray, bucket_count: int) -> np.ndarray:
    return (textkit.mix(records["key"]) % _U(bucket_count)).astype(np.int64)


def _contexts_of_key(got: np.ndarray) -> np.ndarray:
    """How many contexts each record's key has among records sorted by key and context."""
    if not len(got):
        return np.zeros(0, np.int64)
    group = np.cumsum(_changes(got, "key")) - 1
    return np.bincount(group, _changes(got, "key", "ctx"))[group].astype(np.int64)


def _emit(plan: Plan, bucket_count: int, hot_task: int):
    """Pass 1: records by bucket. What already repeats within the task is sent under bucket -1, as found intervals.

    An anchor with many contexts in one task is dealt by context, to buckets
    from bucket_count on, and its own bucket is told by a record at place -1.
    """

    def run(batches):
        for got in _records(batches, plan):
            got, again = _by_context(got)
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([got[again].tobytes()], pa.binary())], schema=BLOB_ARROW)
            got = got[~again]
            bucket = _mark(got, bucket_count)
            hot = _contexts_of_key(got) > hot_task
            if hot.any():
                told = got[hot][_changes(got[hot], "key")].copy()
                told["pos"] = -1
                bucket[hot] = bucket_count + (textkit.mix(got["key"][hot] + textkit.mix(got["ctx"][hot])) % _U(bucket_count)).astype(np.int64)
                got, bucket = np.concatenate([got, told]), np.concatenate([bucket, _mark(told, bucket_count)])
            yield textkit.packed(got, bucket, 2 * bucket_count, BLOB_ARROW)

    return run


def _found(records: np.ndarray, lo, hi, kind) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(records["doc"])), pa.array(np.ascontiguousarray(records["tag"])), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.broadcast_to(kind, len(records)).astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, schema=FOUND_ARROW)


def _reached(records: np.ndarray, plan: Plan) -> pa.RecordBatch:
    """A record's whole reach as an interval; the row's end is applied when the text is cut."""
    return _found(records, np.maximum(records["pos"] - plan.reach, 0), records["pos"] + plan.window, 0)


def _decide(plan: Plan, bucket_count: int, hot: int):
    def run(batches):
        held, salted = [], []
        for batch in batches:
            bucket = textkit.column(batch, "bucket").to_numpy()
            if (bucket == -1).any():
                yield _reached(textkit.unpacked([batch.filter(pa.array(bucket == -1))], RECORD), plan)
            for part, into in (((bucket >= 0) & (bucket < bucket_count), held), (bucket >= bucket_count, salted)):
                if part.any():
                    into.append(textkit.unpacked([batch.filter(pa.array(part))], RECORD))
        if held:
            got = np.concatenate(held)
            told = np.unique(got["key"][got["pos"] < 0])
            got, again = _by_context(got[got["pos"] >= 0])
            yield _reached(got[again], plan)
            got = got[~again]
            many = _contexts_of_key(got)
            kind = np.where((many > hot) | np.isin(got["key"], told), 2, 1)
            some = (many > 1) | (kind == 2)
            yield _found(got[some], got["pos"][some], got["pos"][some], kind[some])
        if salted:
            got, again = _by_context(np.concatenate(salted))
            yield _reached(got[again], plan)
            yield _found(got[~again], got["pos"][~again], got["pos"][~again], 2)

    return run


def _asked(batches, plan: Plan):
    """(body, codes, offsets of rows, row, anchor's place within the row, doc ids, tags) of each slice with asked-for anchors."""
    for batch in batches:
        ids, tags = (textkit.column(batch, c).to_numpy() for c in ("doc_id", "tag"))
        asked = textkit.column(batch, "asked")
        for lo, hi, body, offsets in textkit.text_slices(batch):
            part = asked.slice(lo, hi - lo)
            pos = part.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            codes, at = plan.units(body, offsets)
            order = np.lexsort((pos, row))
            if len(order):
                yield body, codes, at, row[order], pos[order], ids[lo:hi], tags[lo:hi]


def _windows(plan: Plan, bucket_count: int):
    """Every window that holds an asked-for anchor, as a record under its own hash; what repeats within the task is sent under bucket -1."""

    def packed(held: list[np.ndarray]):
        got, again = _by_context(np.concatenate(held))
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([got[again].tobytes()], pa.binary())], schema=BLOB_ARROW)
        yield textkit.packed(got[~again], _mark(got[~again], bucket_count), bucket_count, BLOB_ARROW)

    def run(batches):
        held, size = [], 0
        for _, codes, at, row, pos, ids, tags in _asked(batches, plan):
            lo = np.maximum(pos - plan.reach, 0)
            count = np.maximum(np.minimum(pos, np.diff(at)[row] - plan.window) - lo + 1, 0)
            start = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            own = np.repeat(row, count)
            new = np.ones(len(start), bool)  # anchors close together share windows
            new[1:] = (own[1:] != own[:-1]) | (start[1:] > np.maximum.accumulate(start + (own << 32))[:-1] - (own[1:] << 32))
            start, own = start[new], own[new]
            got = np.empty(len(start), RECORD)
            got["key"] = got["ctx"] = _ranges(codes, at[own] + start, at[own] + start + plan.window)
            got["doc"], got["tag"], got["pos"] = ids[own], tags[own], start
            held.append(got)
            size += len(got)
            if size >= HELD:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _decide_windows(plan: Plan):
    def run(batches):
        held = []
        for batch in batches:
            bucket = textkit.column(batch, "bucket").to_numpy()
            if (bucket == -1).any():
                got = textkit.unpacked([batch.filter(pa.array(bucket == -1))], RECORD)
                yield _found(got, got["pos"], got["pos"] + plan.window, 0)
            if (bucket >= 0).any():
                held.append(textkit.unpacked([batch.filter(pa.array(bucket >= 0))], RECORD))
        if held:
            got, again = _by_context(np.concatenate(held))
            got = got[again]
            yield _found(got, got["pos"], got["pos"] + plan.window, 0)

    return run


def _contexts(plan: Plan, bucket_count: int):
    """Pass 2: the units around each asked-for anchor, by bucket of the anchor."""

    def run(batches):
        for body, codes, at, row, pos, ids, tags in _asked(batches, plan):
            a, b, left = reach(codes, at, row, pos, plan)
            head = np.empty(len(row), CONTEXT)
            head["key"] = context_grams(codes, a + left, plan.gram)
            head["doc"], head["tag"], head["pos"], head["left"], head["size"] = ids[row], tags[row], pos, left, b - a
            units = body if plan.units is byte_units else codes
            bucket = _mark(head, bucket_count)
            blobs, last = [], None
            for i in np.argsort(bucket, kind="stable"):
                blob = head[i].tobytes() + units[a[i] : b[i]].tobytes()
                if last == bucket[i]:
                    blobs[-1][1].append(blob)
                else:
                    blobs.append((int(bucket[i]), [blob]))
                    last = bucket[i]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in blobs], pa.int32()), pa.array([b"".join(x) for _, x in blobs], pa.binary())], schema=BLOB_ARROW)

    return run


def context_grams(codes: np.ndarray, place: np.ndarray, gram: int) -> np.ndarray:
    return _ranges(codes, place, place + gram)


def _ranges(codes, lo, hi) -> np.ndarray:
    out = np.empty(len(lo), _U)
    i = 0
    while i < len(lo):
        base = int(lo[i])
        j = max(i + 1, int(np.searchsorted(hi, base + SEGMENT, "right")))
        end = int(hi[i:j].max())
        out[i:j] = textkit.Prefix(codes[base:end]).of(lo[i:j] - base, hi[i:j] - base)
        i = j
    return out


@dataclass(frozen=True, order=True)
class Context:
    """The units around an anchor; `left` of them stand before it. Contexts are ordered by document and place."""

    key: int
    doc: int
    tag: int
    pos: int
    left: int
    units: bytes


def _resolve(plan: Plan, resolver):
    """Contexts by anchor, earliest first, through the resolver; it yields (context, first unit, end) within contexts."""
    width = 1 if plan.units is byte_units else 8

    def run(batches):
        held = set()
        for batch in batches:
            for blob in textkit.column(batch, "payload"):
                blob, i = blob.as_py(), 0
                while i < len(blob):
                    head = np.frombuffer(blob, CONTEXT, 1, i)[0]
                    i += CONTEXT.itemsize
                    n = int(head["size"]) * width
                    held.add(Context(int(head["key"]), int(head["doc"]), int(head["tag"]), int(head["pos"]), int(head["left"]), blob[i : i + n]))
                    i += n
        out = []
        for _, group in groupby(sorted(held), key=lambda x: x.key):
            group = list(group)
            if len(group) > 1:
                out.extend((x.doc, x.tag, x.pos - x.left + lo, x.pos - x.left + hi, 0) for x, lo, hi in resolver(group, plan))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(FOUND_ARROW.types)], schema=FOUND_ARROW)

    return run


def removed_mask(size: int, offsets: np.ndarray, spans: pa.ListArray) -> np.ndarray:
    """Which units of a slice are covered; spans: per row, structs (lo, hi), or null."""
    step = np.zeros(size + 1, np.int64)
    flat = spans.flatten()
    if len(flat):
        counts = np.diff(spans.offsets.to_numpy())
        if spans.null_count:
            counts = np.where(spans.is_valid().to_numpy(zero_copy_only=False), counts, 0)
        row = np.repeat(np.arange(len(spans)), counts)
        lo = np.minimum(offsets[row] + flat.field(0).to_numpy(), offsets[row + 1])
        hi = np.minimum(offsets[row] + flat.field(1).to_numpy(), offsets[row + 1])
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


MERGED = "doc_id long, tag int, spans array<struct<lo:int,hi:int>>"
MERGED_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])


def _merge(batches):
    """Each document's intervals as disjoint ones, in order."""
    for batch in batches:
        found = textkit.column(batch, "spans")
        row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        flat = found.flatten()
        lo, hi = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        shift = row << 32
        reach = np.maximum.accumulate(hi + shift)
        new = np.ones(len(lo), bool)
        new[1:] = (row[1:] != row[:-1]) | (lo[1:] + shift[1:] > reach[:-1])
        begin = np.flatnonzero(new)
        end = reach[np.append(begin[1:], len(lo)) - 1] - shift[begin] if len(begin) else begin
        spans = pa.StructArray.from_arrays([pa.array(lo[begin], pa.int32()), pa.array(end, pa.int32())], ["lo", "hi"])
        offsets = pa.array(np.searchsorted(row[begin], np.arange(len(found) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([textkit.column(batch, "doc_id"), textkit.column(batch, "tag"), pa.ListArray.from_arrays(offsets, spans)], schema=MERGED_ARROW)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): a tag tells the texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))).cast("int").alias("tag"))


def spans(docs: DataFrame, plan: Plan, resolver, hot: int = HOT, hot_task: int = HOT_TASK) -> DataFrame:
    """doc_id, tag and spans array<struct<lo,hi>> (units, hi possibly past the end) of documents with repeated windows; disjoint, in order."""
    spark = docs.sparkSession
    session.ship(spark)
    count = session.buckets(spark)
    texts = _texts(docs)
    known = texts.where("doc_id is not null")

    # local intervals need no meeting, so they are spread over all partitions
    def dealt(sent: DataFrame) -> DataFrame:
        deal = F.when(F.col("bucket") < 0, F.xxhash64("payload")).otherwise(F.col("bucket"))
        return sent.select("bucket", "payload", deal.alias("deal")).repartition("deal").select("bucket", "payload")

    def asked(kind: int) -> DataFrame:
        some = found.where(F.col("kind") == kind).groupBy("doc_id", "tag").agg(F.collect_list("lo").alias("asked"))
        return known.join(session.maybe_broadcast(some, F.size("asked") * 4 + 44), ["doc_id", "tag"]).select("doc_id", "text", "tag", "asked")

    found = session.materialize(dealt(known.mapInArrow(_emit(plan, count, hot_task), BLOB)).mapInArrow(_decide(plan, count, hot), FOUND))
    late = asked(1).mapInArrow(_contexts(plan, count), BLOB).repartition("bucket").mapInArrow(_resolve(plan, resolver), FOUND)
    both = found.where("kind = 0").unionByName(late)
    if found.where("kind = 2").limit(1).count():
        both = both.unionByName(dealt(asked(2).mapInArrow(_windows(plan, count), BLOB)).mapInArrow(_decide_windows(plan), FOUND))
    gathered = both.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return session.materialize(gathered.mapInArrow(_merge, MERGED))


def cut(docs: DataFrame, found: DataFrame, fn, schema: str) -> DataFrame:
    """Apply fn, a mapInArrow function over (doc_id, text, spans), to every document."""
    found = session.maybe_broadcast(found, F.size("spans") * 8 + 52)
    return _texts(docs).join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(fn, schema)
