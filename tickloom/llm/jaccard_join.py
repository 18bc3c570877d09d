"""Jaccard metric-space self-join on 5-word shingle sets: link at 100 * intersection >= 80 * union, exactly.

Jaccard distance is a metric, and eps = 0.2 is the join's radius. A join
works region by region: pivots make Voronoi regions, and a set also goes to
every region whose pivot is no more than 2 eps farther than its own, which by
the triangle inequality brings every linked pair together; regions are split
the same way until they are small, and then joined exactly.

A large region is split over the cluster: its sets are measured, in parts of a
bounded size, against a few pivots. Pivots that are linked make one group; a set linked to a group is in its component and leaves the region,
which is how a group of near copies, however large, costs one pass. Only sets
not linked to a group but within 2 eps of it can be linked to one of the sets
that left, and those visit them, block by block. What no group holds goes on by
Voronoi regions, unless windows would copy it more than SPREAD times; regions
still too large after ROUNDS meet block against block, exactly.

Over a whole corpus almost all documents are at distance 1 from any pivot, where
the triangle inequality says nothing. So the first level cuts the corpus by an
exact guarantee instead: within a band of sizes, shingles are dealt to classes
by hash; two linked sets differ in so few classes that among the first
k + 1 filled classes of each there is one that both fill alike. Sets that share
such a class meet there, and two that meet are neighbours unless the parities
of their shingles, counted by hash in about as many places as there are
shingles, differ in more places than linked sets can differ in shingles. The
components of neighbours are the first regions: no link leaves one. A set that
fills too few classes is looked for once more by its single shingles.

Sets, not documents, are joined: equal sets are one class from the start, named
by a hash of the set, so that a doc_id may stand for several texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, session, textkit

_U = np.uint64
WORDS = 5
#: Shingles, and sets, of a region that one task joins; larger regions are split over the cluster.
REGION = 6_000_000
MEMBERS = 400
#: Pivots of a large region, about; passes over large regions; copies for each set that Voronoi windows may make.
PIVOTS = 16
ROUNDS = 4
SPREAD = 1.5
LEAF = 24
EPS = 0.2
#: Signatures of sets that fill too few classes, as many as every task may hold; beyond them all sets are dealt by single shingles.
RARE = 1_000_000

#: Places of parities, at least; a larger set has the next power of two above its size.
PLACES = 1024
#: Sets that meet in one class and are told apart by parities; more are neighbours of the first of them without a look.
MEETING = 20_000

SIG = np.dtype([("sig", "<u8"), ("node", "<i8")])
PROFILE = np.dtype([("doc", "<i8"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("known", "<i8")])

BLOB = "bucket int, payload binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
MET = "kind int, a long, b long, n long, h2 long, parity binary"
MET_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("h2", pa.int64()), ("parity", pa.binary())])
EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bands() -> np.ndarray:
    """Lower bounds of the bands of set sizes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


BANDS = _bands()


#: Hash classes of a band in percent of its lower bound, for bands from 128 and from 512 on.
PERCENT = (42, 36)


def classes_of(low: np.ndarray, percent: tuple[int, int] = PERCENT) -> np.ndarray:
    """Hash classes of a band by its lower bound; 0: every shingle is its own class."""
    return np.where(low < 128, 0, np.where(low < 512, low * percent[0] // 100, low * percent[1] // 100))


def shingle_sets(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets) of the rows' sets, each in ascending order."""
    rows, codes = textkit.shingle_hashes(textkit.Words(body, offsets, lower=True), WORDS)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return codes[new], np.searchsorted(rows[new], np.arange(len(offsets)))


def set_hashes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x51ED270B7A9C3F15, 0x3C79AC492BA7B653):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(textkit.mix(codes + _U(salt)))])
        out.append(textkit.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(_U)).view(np.int64))
    return out[0], out[1]


def places_of(n: np.ndarray) -> np.ndarray:
    """Places of the parities of sets of n shingles: a power of two."""
    return PLACES << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / PLACES))).astype(np.int64)


def parities(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The parity of each set's shingles in each of its places, as packed bits, set after set.

    Sets that differ in d shingles differ in at most d places; half as many
    places are had by adding one half to the other.
    """
    places = places_of(np.diff(offsets))
    at = np.concatenate([[0], np.cumsum(places)])
    out = []
    lo = 0
    while lo < len(places):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 22), "right")) - 1)
        row = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
        place = (codes[offsets[lo] : offsets[hi]] & (places[row] - 1).astype(_U)).astype(np.int64)
        bits = np.bincount(at[row] - at[lo] + place, minlength=at[hi] - at[lo]) & 1
        out.append(np.packbits(bits.astype(np.uint8)))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def distinct(records: np.ndarray) -> np.ndarray:
    """Distinct SIG records, by signature and node."""
    records = records[np.lexsort((records["node"], records["sig"]))]
    new = np.ones(len(records), bool)
    new[1:] = (records["sig"][1:] != records["sig"][:-1]) | (records["node"][1:] != records["node"][:-1])
    return records[new]


def signatures(codes: np.ndarray, offsets: np.ndarray, fine: bool = False, percent: tuple[int, int] = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) such that linked sets share one; and the rows for which that does not hold, as they fill too few classes (none, if fine)."""
    n = np.diff(offsets)
    size_band = np.searchsorted(BANDS, n, "right") - 1
    least_band = np.searchsorted(BANDS, -(-n * 4 // 5), "right") - 1
    filled = n > 0
    reps = np.where(filled, size_band - least_band + 1, 0)
    row = np.repeat(np.arange(len(n)), reps)  # a row for each (set, band)
    band = least_band[row] + np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    own = band == size_band[row]
    most = np.where(own, n[row] // 4, (n[row] + BANDS[band + 1] - 1) // 9)
    m = np.zeros(len(band), np.int64) if fine else classes_of(BANDS[band], percent)
    size = n[row]
    at = np.concatenate([[0], np.cumsum(size)])
    t = codes[np.repeat(offsets[row] - at[:-1], size) + np.arange(at[-1])]
    slot = np.repeat(np.arange(len(row)), size)
    single = (m == 0)[slot]
    t = np.where(single, t, textkit.mix(t + _U(0x2545F4914F6CDD1D)))
    cls = np.where(single, t, (t >> _U(20)) % np.maximum(m, 1).astype(_U)[slot])
    order = np.lexsort((cls, slot))
    cls, slot, t = cls[order], slot[order], t[order]
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (slot[1:] != slot[:-1])
    begin = np.flatnonzero(new)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(textkit.mix(t))])
    content = sums[np.append(begin[1:], len(t))] - sums[begin]
    cls, slot = cls[begin], slot[begin]
    first = np.searchsorted(slot, np.arange(len(row)))
    rank = np.arange(len(slot)) - first[slot]
    thin = np.unique(row[np.diff(np.append(first, len(slot))) <= most])
    keep = rank <= most[slot]
    sig = textkit.mix(content[keep] + textkit.mix(cls[keep] + _U(7)) + band[slot[keep]].astype(_U) * _U(0x9E3779B97F4A7C15))
    return row[slot[keep]], sig, thin


#: Records of a task that are held before they are sent, so that blobs are few.
HELD = 500_000


def _emit(bucket_count: int, fine: bool, percent: tuple[int, int] = PERCENT, only: np.ndarray | None = None):
    """Profiles (bucket -1) and signatures by bucket; under bucket -2 the fine signatures of sets with too few classes. With `only`, nothing but fine signatures that are among these."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        out = distinct(np.concatenate(held))  # copies within a task are sent once
        return textkit.packed(out, (out["sig"] % _U(bucket_count)).astype(np.int64), bucket_count, BLOB_ARROW)

    def blob(bucket: int, payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], schema=BLOB_ARROW)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = textkit.column(batch, "doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for lo, hi, body, offsets in textkit.text_slices(batch):
                codes, at = shingle_sets(body, offsets)
                h1, h2 = set_hashes(codes, at)
                row, sig, thin = signatures(codes, at, fine or only is not None, percent)
                if only is None:
                    got = np.empty(hi - lo, PROFILE)
                    got["doc"], got["n"], got["h1"], got["h2"], got["known"] = ids[lo:hi], np.diff(at), h1, h2, known[lo:hi]
                    yield blob(-1, len(got).to_bytes(8, "little") + got.tobytes() + parities(codes, at).tobytes())
                    if len(thin):
                        again, more, _ = signatures(codes, at, True)
                        yield blob(-2, np.unique(more[np.isin(again, thin)]).tobytes())
                else:
                    found = np.minimum(np.searchsorted(only, sig), len(only) - 1)
                    some = only[found] == sig
                    row, sig = row[some], sig[some]
                use = known[lo:hi][row]
                out = np.empty(int(use.sum()), SIG)
                out["sig"], out["node"] = sig[use], h1[row[use]]
                held.append(out)
                size += len(out)
                if size >= HELD:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    return run


class Forest:
    """Union-find over 0..n-1; the root of a tree is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _row(kind, a, b, n=None, h2=None, parity=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    bits = pa.nulls(len(a), pa.binary()) if parity is None else pa.array(parity, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(zero if n is None else n), pa.array(zero if h2 is None else h2), bits], schema=MET_ARROW)


def _meet(batches):
    """Profiles (kind 0; 2 without id) and who meets in the classes of each bucket.

    Kind 1: (meeting, node), each distinct group of nodes once for each bucket.
    Kind 4: (node, first node) of a meeting too large to look at. Kind 3: a
    fine signature of a set with too few classes.
    """
    held = []
    for batch in batches:
        bucket = textkit.column(batch, "bucket").to_numpy()
        for blob in textkit.column(batch.filter(pa.array(bucket == -2)), "payload").to_pylist():
            rare = np.frombuffer(blob, np.int64)
            yield _row(3, rare, rare)
        if (bucket == -1).any():
            for blob in textkit.column(batch.filter(pa.array(bucket == -1)), "payload").to_pylist():
                count = int.from_bytes(blob[:8], "little")
                p = np.frombuffer(blob, PROFILE, count, 8)
                at = 8 + p.nbytes + np.concatenate([[0], np.cumsum(places_of(p["n"]) // 8)])
                for kind, some in ((0, np.flatnonzero(p["known"] == 1)), (2, np.flatnonzero(p["known"] == 0))):
                    if len(some):
                        yield _row(kind, *(np.ascontiguousarray(p[c][some]) for c in ("doc", "h1", "n", "h2")), [blob[at[i] : at[i + 1]] for i in some])
        if (bucket >= 0).any():
            held.append(textkit.unpacked([batch.filter(pa.array(bucket >= 0))], SIG))
    if not held:
        return
    got = distinct(np.concatenate(held))
    held.clear()
    new = np.ones(len(got), bool)
    new[1:] = got["sig"][1:] != got["sig"][:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(got)))
    node = np.ascontiguousarray(got["node"])
    shared = np.flatnonzero(size > 1)
    # a meeting is named by its members, so that the same group is looked at once
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(textkit.mix(node.view(_U)))])
    name = textkit.mix(sums[begin[shared] + size[shared]] - sums[begin[shared]] + size[shared].astype(_U)).view(np.int64)
    _, once = np.unique(name, return_index=True)
    large = size[shared[once]] > MEETING
    for kind, some in ((1, once[~large]), (4, once[large])):
        if not len(some):
            continue
        n = size[shared[some]]
        first = begin[shared[some]]
        where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if kind == 1:
            yield _row(1, np.repeat(name[some], n), node[where])
        else:
            yield _row(4, node[where], np.repeat(node[first], n))


def neighbours(size: np.ndarray, parity: list[bytes]) -> np.ndarray:
    """Component (its least member) of each set, by what parities and sizes do not rule out as linked. Sets already in one component are not compared."""
    root = np.arange(len(size))
    order = np.argsort(size, kind="stable")
    places = places_of(size)
    for level in np.unique(places).tolist():
        # sets of this many places, and those of twice as many, folded
        some = order[(places[order] == level) | (places[order] == 2 * level)]
        rows = np.empty((len(some), level // 64), _U)
        for i, x in enumerate(some.tolist()):
            bits = np.frombuffer(parity[x], _U)
            rows[i] = bits if places[x] == level else bits[: level // 64] ^ bits[level // 64 :]
        ordered = size[some]
        for i, x in enumerate(some.tolist()):
            if places[x] != level:
                break
            end = int(np.searchsorted(ordered, ordered[i] * 5 // 4, "right"))
            open_ = np.flatnonzero(root[some[i + 1 : end]] != root[x]) + i + 1
            if len(open_):
                differ = np.bitwise_count(rows[open_] ^ rows[i]).sum(axis=1, dtype=np.int64)
                near = np.unique(root[some[open_[9 * differ <= ordered[i] + ordered[open_]]]])
                if len(near):
                    merged = np.append(near, root[x])
                    root[np.isin(root, merged)] = merged.min()
    return root


def _look(batches):
    """Neighbours within each meeting, as a forest of edges."""
    parts = [pa.Table.from_batches([b]) for b in batches]
    if not parts:
        return
    table = pa.concat_tables(parts).combine_chunks()
    if not table.num_rows:
        return
    meeting, node, size = (table[c].to_numpy() for c in ("meeting", "node", "n"))
    parity = table["parity"]
    order = np.argsort(meeting, kind="stable")
    cut = np.flatnonzero(np.diff(meeting[order])) + 1
    edges = []
    for group in np.split(order, cut):
        root = neighbours(size[group], [parity[int(i)].as_py() for i in group])
        own = node[group]
        moved = np.flatnonzero(root != np.arange(len(group)))
        edges.append(np.stack([own[moved], own[root[moved]]], 1))
    edges = np.unique(np.concatenate(edges), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=EDGE_ARROW)


# ---- the join of one region ----------------------------------------------------------------------------------------


def overlaps(pivot: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Intersection sizes of one sorted set with many laid end to end."""
    if not len(pivot):
        return np.zeros(len(offsets) - 1, np.int64)
    where = np.minimum(np.searchsorted(pivot, codes), len(pivot) - 1)
    sums = np.concatenate([[0], np.cumsum(pivot[where] == codes)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Region:
    """Exact components of sets, joined by recursive Voronoi splitting."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.forest = Forest(len(sets))
        self.split(np.arange(len(sets)))

    def _laid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.sets[i] for i in ids]), np.concatenate([[0], np.cumsum(self.size[ids])])

    def _link(self, x: int, ids: np.ndarray, common: np.ndarray) -> None:
        union = self.size[x] + self.size[ids] - common
        for y in ids[100 * common >= 80 * union].tolist():
            self.forest.join(x, y)

    def _one(self, ids: np.ndarray) -> bool:
        find = self.forest.find
        root = find(int(ids[0]))
        return all(find(i) == root for i in ids.tolist())

    def split(self, ids: np.ndarray) -> None:
        n = len(ids)
        if n < 2 or self._one(ids):
            return
        if n <= LEAF:
            return self.brute(ids)
        k = min(16, max(2, int(n**0.5)))
        pivots = ids[np.linspace(0, n - 1, k).astype(np.int64)]
        codes, offsets = self._laid(ids)
        distance = np.empty((n, k))
        for j, p in enumerate(pivots):
            common = overlaps(self.sets[p], codes, offsets)
            self._link(int(p), ids, common)
            distance[:, j] = 1 - common / (self.size[p] + self.size[ids] - common)
        del codes
        near = distance.min(axis=1)
        regions = [ids[distance[:, j] <= near + 2 * EPS + 1e-9] for j in range(k)]
        if max(map(len, regions)) > 0.8 * n:
            return self.brute(ids)
        home = distance.argmin(axis=1)
        for j in range(k):
            if (home == j).any():
                self.split(regions[j])

    def brute(self, ids: np.ndarray) -> None:
        """Each set against those of a near size that are not yet in its component, a block of them at a time."""
        ids = ids[np.argsort(self.size[ids], kind="stable")]
        size, find = self.size[ids], self.forest.find
        for i, x in enumerate(ids.tolist()):
            end = int(np.searchsorted(size, size[i] * 5 // 4, "right"))
            root = find(x)
            rest = np.array([y for y in ids[i + 1 : end].tolist() if find(y) != root], np.int64)
            for s in range(0, len(rest), 4096):
                part = rest[s : s + 4096]
                self._link(x, part, overlaps(self.sets[x], *self._laid(part)))

    def roots(self) -> np.ndarray:
        return np.array([self.forest.find(i) for i in range(len(self.sets))], np.int64)


LAID = "region long, node long, n long, codes binary"
LAID_ARROW = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("codes", pa.binary())])
_LONGS = pa.list_(pa.int64())
LABELLED = LAID + ", pivot boolean, links array<long>, near array<long>, cells array<long>"
LABELLED_ARROW = pa.schema([*LAID_ARROW, ("pivot", pa.bool_()), ("links", _LONGS), ("near", _LONGS), ("cells", _LONGS)])


def _lay(batches):
    """(region, node, n, set) of the documents that stand for a class within a region."""
    for batch in batches:
        region, node, n, h2 = (textkit.column(batch, c).to_numpy() for c in ("region", "node", "n", "h2"))
        for lo, hi, body, offsets in textkit.text_slices(batch):
            codes, at = shingle_sets(body, offsets)
            first, second = set_hashes(codes, at)
            rows = np.flatnonzero((first == node[lo:hi]) & (second == h2[lo:hi]))  # a doc_id may stand for several texts
            cols = [pa.array(c[lo:hi][rows]) for c in (region, node, n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([codes[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], schema=LAID_ARROW)


def _sets(batches, *keys: str) -> dict[int, dict]:
    """What a task's rows hold, by the first key: a dict from the other columns to the set."""
    out: dict[int, dict] = {}
    for batch in batches:
        columns = [textkit.column(batch, c).to_pylist() for c in (*keys, "codes")]
        for first, *rest, codes in zip(*columns, strict=True):
            out.setdefault(first, {})[tuple(rest)] = codes
    return out


def _join(batches):
    """(node, least node linked with it within the region)."""
    for members in _sets(batches, "region", "node").values():
        nodes = np.array(sorted(n for (n,) in members), np.int64)
        roots = Region([np.frombuffer(members[n,], _U) for n in nodes.tolist()]).roots()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], schema=EDGE_ARROW)


def linked(common, size, other) -> bool:
    return 100 * common >= 80 * (size + other - common)


class Pivots:
    """The pivots of one region, and the groups that linked ones make; a group is named by its least node."""

    def __init__(self, members: list[tuple[int, bytes]]):
        members = sorted(members)
        sets, forest = [np.frombuffer(c, _U) for _, c in members], Forest(len(members))
        for i, x in enumerate(sets):
            for j in range(i):
                if linked(len(np.intersect1d(x, sets[j], assume_unique=True)), len(x), len(sets[j])):
                    forest.join(i, j)
        laid = np.concatenate([np.zeros(0, _U), *sets])
        order = np.argsort(laid, kind="stable")
        self.nodes = {n for n, _ in members}
        self.group = np.array([members[forest.find(i)][0] for i in range(len(members))], np.int64)
        self.size = np.array([len(x) for x in sets], np.int64)
        self.laid, self.owner = laid[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def label(self, mine: np.ndarray) -> tuple[list, list, list]:
        """(groups linked, other groups within 2 eps, groups of its Voronoi cells if it is linked to none) of a set."""
        n = len(mine)
        if not len(self.size):
            return [], [], [0]
        lo, hi = np.searchsorted(self.laid, mine), np.searchsorted(self.laid, mine, "right")
        count = hi - lo
        hit = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(self.owner[hit], minlength=len(self.size))
        far = 1 - common / (n + self.size - common)
        links = np.unique(self.group[linked(common, n, self.size)])
        near = np.setdiff1d(self.group[far <= 2 * EPS + 1e-9], links)
        cells = links[:0] if len(links) else np.unique(self.group[far <= far.min() + 2 * EPS + 1e-9])
        return links.tolist(), near.tolist(), cells.tolist()


def _label(batches):
    """Each set measured against the pivots of its region, which come before it in the order of the rows."""
    at, members, own = None, [], None
    for batch in batches:
        columns = [textkit.column(batch, c).to_pylist() for c in ("region", "part", "kind", "node", "n", "codes")]
        out = []
        for region, part, kind, node, n, codes in zip(*columns, strict=True):
            if at != (region, part):
                at, members, own = (region, part), [], None
            if kind == 0:
                members.append((node, codes))
                continue
            own = own or Pivots(members)
            out.append((region, node, n, codes, node in own.nodes, *own.label(np.frombuffer(codes, _U))))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(LABELLED_ARROW.types)], schema=LABELLED_ARROW)


def _visit(batches):
    """(visitor, home set linked with it), one at most for each visitor and block: the home sets of a block are in one component."""
    for members in _sets(batches, "region", "home", "node").values():
        homes = [(n, np.frombuffer(c, _U)) for (home, n), c in members.items() if home]
        if not homes:
            continue
        laid, size = np.concatenate([c for _, c in homes]), np.array([len(c) for _, c in homes])
        offsets, edges = np.concatenate([[0], np.cumsum(size)]), []
        for (home, node), codes in members.items():
            if not home:
                mine = np.frombuffer(codes, _U)
                hit = np.flatnonzero(linked(overlaps(mine, laid, offsets), len(mine), size))
                if len(hit):
                    edges.append((node, homes[hit[0]][0]))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], schema=EDGE_ARROW)


def _large(laid: DataFrame, limit: int, members: int) -> DataFrame:
    return laid.groupBy("region").agg(F.sum("n").alias("total"), F.count("*").alias("members")).where((F.col("total") > limit) | (F.col("members") > members))


def _blocks(total, limit: int):
    return F.greatest(F.ceil(total / F.lit(limit)), F.lit(1).cast("long"))


def _block(of, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), of)


def _visits(labelled: DataFrame, limit: int, members: int) -> DataFrame:
    """Edges between sets that left with a group and the sets that may be linked to one of them. Both sides are cut into blocks of about `limit` shingles and `members` sets. Groups that a set links are one."""
    both = labelled.where(F.size("links") > 1).select(F.array_min("links").alias("a"), F.explode("links").alias("b"))
    roots = session.maybe_broadcast(components.components(both), F.lit(32))

    def merged(df: DataFrame, group: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(group), "root"), group, "left").withColumn(group, F.coalesce("root", group)).drop("root")

    homes = merged(labelled.where((F.size("links") > 0) & ~F.col("pivot")).select(F.array_min("links").alias("group"), "node", "n", "codes"), "group")
    guests = merged(labelled.where(F.size("near") > 0).select(F.array_min("links").alias("own"), F.explode("near").alias("group"), "node", "n", "codes"), "group")
    guests = merged(guests, "own").where("own is null or own <> group").select("group", "node", "n", "codes").distinct()
    blocks = F.greatest(_blocks(F.sum("n"), limit), _blocks(F.count("*"), members))
    a, b = homes.groupBy("group").agg(blocks.alias("a")), guests.groupBy("group").agg(blocks.alias("b"))
    sizes = session.materialize(a.join(b, "group"))
    sizes = session.maybe_broadcast(sizes, F.lit(32))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = homes.join(sizes, "group").withColumns({"i": _block(F.col("a"), 1)}).withColumn("j", every("b")).withColumn("home", F.lit(True))
    right = guests.join(sizes, "group").withColumns({"j": _block(F.col("b"), 2)}).withColumn("i", every("a")).withColumn("home", F.lit(False))
    both = left.unionByName(right).select(F.xxhash64("group", "i", "j").alias("region"), "home", "node", "codes")
    return both.repartition("region").mapInArrow(_visit, "a long, b long")


def _split_large(laid: DataFrame, limit: int, members: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """(sets of regions that one task can join, edges found on the way or None). Every round is one pass over the large regions' sets."""
    edges = None
    for level in range(rounds):
        sizes = session.materialize(_large(laid, limit, members))
        if not sizes.limit(1).count():
            return laid, edges
        # a region is measured in parts, each with a copy of its pivots: few enough to be a small share of a part
        few = F.greatest(F.least(F.lit(float(PIVOTS)), F.lit(limit / 4.0) * F.col("members") / F.col("total")), F.lit(1.0))
        sizes = sizes.withColumns({"parts": F.greatest(_blocks(F.col("members"), members), _blocks(F.col("total"), limit)), "share": few / F.col("members")})
        sizes = session.maybe_broadcast(sizes, F.lit(48))
        large = laid.join(sizes, "region").withColumns({"part": _block(F.col("parts"), 5), "kind": F.lit(1)})
        chance = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pivots = large.where(chance < F.col("share")).withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "kind": F.lit(0)})
        columns = ["region", "part", "kind", "node", "n", "codes"]
        sent = large.select(*columns).unionByName(pivots.select(*columns)).repartition("region", "part").sortWithinPartitions("region", "part", "kind")
        labelled = session.materialize(sent.mapInArrow(_label, LABELLED))
        found = labelled.select(F.col("node").alias("a"), F.explode("links").alias("b")).where("a <> b").unionByName(_visits(labelled, limit, max(1, members // 4)))
        edges = found if edges is None else edges.unionByName(found)
        # what no group holds goes on, by Voronoi cells where their windows copy little
        rest = labelled.where(F.size("links") == 0)
        copies = rest.groupBy("region").agg((F.sum(F.size("cells")) <= SPREAD * F.count("*")).alias("apart"))
        rest = rest.join(session.maybe_broadcast(session.materialize(copies), F.lit(16)), "region")
        cell = F.explode(F.when(F.col("apart"), F.col("cells")).otherwise(F.array(F.lit(0).cast("long"))))
        rest = rest.select("region", "node", "n", "codes", cell.alias("cell")).select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "node", "n", "codes")
        laid = session.materialize(laid.join(sizes.select("region"), "region", "left_anti").unionByName(rest))
    return _grid(laid, limit, members), edges


def _grid(laid: DataFrame, limit: int, members: int) -> DataFrame:
    """laid with regions above the limit as pairs of blocks, each pair a region of its own."""
    sizes = _large(laid, limit, members).select("region", F.greatest(_blocks(2 * F.col("total"), limit), _blocks(2 * F.col("members"), members)).alias("blocks"))
    sizes = session.maybe_broadcast(session.materialize(sizes), F.lit(32))
    own = laid.join(sizes, "region").withColumn("i", _block(F.col("blocks"), 3)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = own.select(F.xxhash64("region", F.least("i", "j"), F.greatest("i", "j")).alias("region"), "node", "n", "codes")
    return laid.join(sizes.select("region"), "region", "left_anti").unionByName(pairs)


OUT = ("doc_id", "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, region: int = REGION, members: int = MEMBERS, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row.

    A null or wordless text has no shingles and is linked with nothing, so its
    component is itself. A row without doc_id is linked with nothing and has no
    component. Repeated rows of one doc_id share its component; rows that share a
    doc_id but not a text are joined each by its own text. With fewer than five
    words the whole sequence is the one shingle. Very long texts are whole sets
    like others; one is held by a task at a time. Equal distances change nothing:
    every link counts. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    session.ship(spark)
    count = session.buckets(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def meet(emit) -> DataFrame:
        sent = texts.mapInArrow(emit, BLOB).withColumn("deal", F.when(F.col("bucket") < 0, F.xxhash64("payload")).otherwise(F.col("bucket")))
        return session.materialize(sent.repartition("deal").select("bucket", "payload").mapInArrow(_meet, MET))

    met = meet(_emit(count, False, percent))
    meeting = met
    rare = met.where("kind = 3").select("a").distinct()
    if n := rare.count():
        # sets that fill too few classes are met by single shingles; all other signatures stay unsent
        only = np.sort(np.array([r["a"] for r in rare.collect()], np.int64).view(_U)) if n <= RARE else None
        meeting = met.unionByName(meet(_emit(count, True, percent, only)))
    profile = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("h1"), "n", "h2", "parity")
    nobody = met.where("kind = 2").select(F.lit(None).cast("long").alias("doc_id"), "n", F.lit(None).cast("long").alias("component_id"))
    classes = profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("parity").alias("parity"))
    meetings = meeting.where("kind = 1").select(F.col("a").alias("meeting"), F.col("b").alias("node")).distinct()
    looked = meetings.join(classes.select(F.col("h1").alias("node"), "n", "parity"), "node").repartition("meeting").select("meeting", "node", "n", "parity").mapInArrow(_look, "a long, b long")
    first = components.components(looked.unionByName(meeting.where("kind = 4").select("a", "b")))
    asked = session.materialize(classes.join(first.select(F.col("node").alias("h1"), F.col("root").alias("region")), "h1").select("rep", F.col("h1").alias("node"), "region", "n", "h2"))
    large = _large(asked, region, members).limit(1).count() > 0
    asked = session.maybe_broadcast(asked, F.lit(56))
    laid, edges = texts.join(asked, texts["doc_id"] == asked["rep"]).select("node", "region", "n", "h2", "text").mapInArrow(_lay, LAID), None
    if large:
        laid, edges = _split_large(session.materialize(laid.distinct()), region, members)
    links = laid.repartition("region").mapInArrow(_join, "a long, b long")
    joined = components.components(links.unionByName(edges)) if edges is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    joined = joined.select(F.col("node").alias("h1"), "root")
    # only classes of several rows or of a component with others say more of a row than its own id
    named = classes.drop("parity").join(joined, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    told = named.join(least, "root").where("component <> last or rep <> last").select("h1", "h2", F.col("n").alias("size"), "component")
    told = session.maybe_broadcast(session.materialize(told), F.lit(48))
    some = profile.drop("parity").where("n > 0")
    whole_rows = some.join(told, (some["h1"] == told["h1"]) & (some["h2"] == told["h2"]) & (some["n"] == told["size"]), "left")
    found = whole_rows.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    blank = profile.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(blank).unionByName(nobody).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, all columns, with only the least doc_id of each component; rows without doc_id stay, and of repeated rows of the kept doc_id all stay."""
    found = near_duplicates(docs).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    found = session.maybe_broadcast(session.materialize(found), F.lit(16))
    return docs.join(found, docs["doc_id"] == found["__gone"], "left_anti")
