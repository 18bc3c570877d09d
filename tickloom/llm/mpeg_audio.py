"""MPEG audio columns: write payloads as Layer III frames, read any stream back to exact durations and seek offsets.

Writing: an ID3v2.3 tag, a Xing frame with frame count, byte count and seek
table, then one MPEG-2 Layer III frame (16 kHz, 144 kbit/s, mono, CRC) for each
576 payload bytes. The frames are silent: their side information is zero and
the payload lies in the ancillary bytes, one byte to a unit, 576 units to a
frame of 576 samples.

Reading: tags are parsed, frame headers are found again after any junk (a
header counts if the frame that it implies is followed by another header of the
same kind, or by the end), variable-bitrate tables are read and held against the
frames, CRC-16 words are checked, and each frame's offset and start sample are
kept. What a layer II checksum covers depends on its allocation tables; it is
not checked.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

UNIT = 576
FRAME = 648
SIDE = 9

# Fixed values of the format: bit rates in kbit/s and sampling rates in Hz by header index.
RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = [44100, 48000, 32000]
DIVISOR = {3: 1, 2: 2, 0: 4}


def crc16(data: bytes) -> int:
    """CRC-16, polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        c &= 0xFFFF
    return c


@dataclass(frozen=True)
class Header:
    kind: tuple
    layer: int
    hertz: int
    samples: int
    length: int
    side: int
    protected: bool
    covered: int  # bytes behind the checksum that it covers; 0: not known


_headers: dict[bytes, Header | None] = {}
_crcs: dict[bytes, int] = {}


def header(word: bytes) -> Header | None:
    """The header in four bytes, or None."""
    if word in _headers:
        return _headers[word]
    got = _header(word) if len(word) == 4 else None
    if len(_headers) < 100_000:
        _headers[word] = got
    return got


def _header(w: bytes) -> Header | None:
    version, layer = (w[1] >> 3) & 3, 4 - ((w[1] >> 1) & 3)
    rate, hertz = w[2] >> 4, (w[2] >> 2) & 3
    if w[0] != 0xFF or w[1] & 0xE0 != 0xE0 or version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or w[3] & 3 == 2:
        return None
    first = version == 3
    hz = HERTZ[hertz] // DIVISOR[version]
    bits, pad = RATES[(1 if first else 2, layer)][rate] * 1000, (w[2] >> 1) & 1
    mono = w[3] >> 6 == 3
    if layer == 1:
        samples, length = 384, (12 * bits // hz + pad) * 4
    else:
        samples = 1152 if first or layer == 2 else 576
        length = samples // 8 * bits // hz + pad
    side = (17 if mono else 32) if first else (9 if mono else 17)
    # layer III: the side information; layer I: four bits for each subband and channel, one for both above the joint bound
    bound = 4 * ((w[3] >> 4 & 3) + 1) if w[3] >> 6 == 1 else 32
    covered = {3: side, 1: 16 if mono else (32 + bound) // 2, 2: 0}[layer]
    return Header((version, layer, hertz), layer, hz, samples, length, side if layer == 3 else 0, not w[1] & 1, covered)


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    vbr: tuple | None = None
    hertz: int = 0
    offsets: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    samples: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    first: int = 0  # offset of the frame that holds the table


def _size7(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tag(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, i = min(len(data), 10 + _size7(data[6:10])), 10
    while i + 10 <= end and data[i] != 0:
        name = data[i : i + 4].decode("latin-1")
        n = int.from_bytes(data[i + 4 : i + 8], "big") if data[3] < 4 else _size7(data[i + 4 : i + 8])
        body = data[i + 10 : i + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value
        i += 10 + n
    return end


def _vbr(data: bytes, at: int, h: Header) -> tuple | None:
    for i in (at + 4 + h.side, at + 6 + h.side):
        if data[i : i + 4] in (b"Xing", b"Info"):
            flags, j, frames, size, toc = int.from_bytes(data[i + 4 : i + 8], "big"), i + 8, None, None, b""
            if flags & 1:
                frames, j = int.from_bytes(data[j : j + 4], "big"), j + 4
            if flags & 2:
                size, j = int.from_bytes(data[j : j + 4], "big"), j + 4
            if flags & 4:
                toc = data[j : j + 100]
            return data[i : i + 4].decode(), frames, size, toc
    i = at + 36
    if data[i : i + 4] == b"VBRI":
        return "VBRI", int.from_bytes(data[i + 14 : i + 18], "big"), int.from_bytes(data[i + 10 : i + 14], "big"), b""
    return None


def _fill(data: bytes, at: int, kind: tuple) -> bool:
    """Whether frames of a kind follow one another from `at` to the very end."""
    while at < len(data):
        h = header(data[at : at + 4])
        if h is None or h.kind != kind:
            return False
        at += h.length
    return at == len(data)


def parse(data: bytes) -> Stream:
    """Tags, frames and tables of a stream. Bytes that belong to no frame are skipped; an empty one has no frames. The last 128 bytes are an ID3v1 tag if they begin by TAG and are not within frames that reach the end."""
    out = Stream()
    at = _tag(data, out)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    kind, sure, sample, lost = None, False, 0, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and (kind is None or h.kind == kind) and at + h.length > end and _fill(data, at, h.kind):
            end = len(data)
        good = h is not None and (kind is None or h.kind == kind) and at + h.length <= end
        if good and not sure:
            nxt = at + h.length
            other = header(data[nxt : nxt + 4])
            good = nxt == end or (other is not None and other.kind == h.kind)
        if not good:
            out.resyncs += not lost
            lost, sure = True, False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost = False
        if h.protected and h.covered:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.covered]
            crc = _crcs.get(covered)
            if crc is None:
                crc = crc16(covered)
                if len(_crcs) < 100_000:
                    _crcs[covered] = crc
            out.crc_checked += 1
            out.crc_bad += crc != data[at + 4] << 8 | data[at + 5]
        table = _vbr(data, at, h) if kind is None else None
        kind, sure, out.hertz = h.kind, True, h.hertz
        if table:
            out.vbr, out.first = table, at
        else:
            out.offsets.append(at)
            out.lengths.append(h.length)
            out.samples.append(h.samples)
            out.starts.append(sample)
            sample += h.samples
        at += h.length
    if end < len(data):
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return out


_HEAD = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])
_FRAME = np.zeros(FRAME, np.uint8)
_FRAME[:4] = list(_HEAD)
_FRAME[4:6] = list(crc16(_HEAD[2:] + bytes(SIDE)).to_bytes(2, "big"))


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def encode(raw: bytes) -> bytes:
    """A stream that holds raw, padded by bytes 255 to a positive multiple of 576."""
    payload = np.frombuffer(pad(raw), np.uint8).reshape(-1, UNIT)
    frames = np.tile(_FRAME, (len(payload), 1))
    frames[:, 6 + SIDE : 6 + SIDE + UNIT] = payload
    text = b"\0n_bytes\0" + str(len(raw)).encode()
    inner = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(inner)
    tag = b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + inner
    total = FRAME * (len(payload) + 1)
    toc = bytes(min(255, 256 * (FRAME * (1 + i * len(payload) // 100)) // total) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(payload).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    first = np.zeros(FRAME, np.uint8)
    first[:4] = [_HEAD[0], _HEAD[1] | 1, _HEAD[2], _HEAD[3]]
    first[4 + SIDE : 4 + SIDE + len(table)] = list(table)
    return tag + first.tobytes() + frames.tobytes()


def payload(data: bytes, s: Stream) -> bytes:
    """The ancillary units of a stream's frames; empty if some are not of the kind that encode() writes."""
    if any(n != FRAME for n in s.lengths):
        return b""
    view = np.frombuffer(data, np.uint8)
    where = np.asarray(s.offsets, np.int64) + 6 + SIDE
    return view[where[:, None] + np.arange(UNIT)].tobytes() if len(where) else b""


def table_errors(s: Stream) -> int:
    """Entries of the seek table that are more than one off the frame at their percentage, and one more for each of frame and byte count that is not the stream's."""
    if not s.vbr or not s.offsets:
        return 0
    _, frames, size, toc = s.vbr
    held = s.offsets[-1] + s.lengths[-1] - s.first
    wrong = int(frames is not None and frames != len(s.offsets)) + int(size is not None and size != held)
    if len(toc) == 100:
        at = np.asarray(s.offsets, np.int64)[np.arange(100) * len(s.offsets) // 100] - s.first
        wrong += int((np.abs(np.minimum(255, 256 * at // held) - np.frombuffer(toc, np.uint8)) > 1).sum())
    return wrong


def feature(s: Stream) -> str:
    """What the stream holds, as text: rate, frames, exact duration in samples and ms, table and its errors, checksums, a digest of the seek offsets."""
    seek = np.stack([np.asarray(s.starts, "<i8"), np.asarray(s.offsets, "<i8")], 1).tobytes() if s.offsets else b""
    total = sum(s.samples)
    vbr = f"{s.vbr[0]}:{s.vbr[1]}:{s.vbr[2]}:{table_errors(s)}" if s.vbr else "none"
    return f"hz={s.hertz};frames={len(s.offsets)};samples={total};ms={total * 1000 // s.hertz if s.hertz else 0};vbr={vbr};crc={s.crc_checked - s.crc_bad}/{s.crc_checked};resync={s.resyncs};seek={zlib.crc32(seek):08x}"


MEDIA = "doc_id long, media binary"
INDEX = "doc_id long, n_bytes long, payload binary, media binary, hertz int, n_samples long, frame_offsets array<long>, frame_starts array<long>, crc_checked int, crc_bad int, resyncs int, vbr string, feature string"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _write(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        ids = textkit.column(batch, "doc_id")
        for lo, hi, body, offsets in textkit.text_slices(batch):
            flat = body.tobytes()
            media = [encode(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(media, pa.binary())], schema=schema)


def _read(make, schema):
    def run(batches):
        for batch in batches:
            ids = textkit.column(batch, "doc_id")
            for lo, hi, body, offsets in textkit.text_slices(batch, "media"):
                flat = body.tobytes()
                rows = [make(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], schema=schema)

    return run


def _length(s: Stream, body: bytes) -> int:
    n = s.tags.get("n_bytes", "")
    return int(n) if n.isdigit() else len(body)


def _digest(media: bytes) -> tuple:
    s = parse(media)
    body = payload(media, s)
    return _length(s, body), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)


def _full(media: bytes) -> tuple:
    s = parse(media)
    body = payload(media, s)
    return _length(s, body), body, media, s.hertz, sum(s.samples), s.offsets, s.starts, s.crc_checked, s.crc_bad, s.resyncs, s.vbr[0] if s.vbr else None, feature(s)


_L, _B, _S, _I = pa.int64(), pa.binary(), pa.string(), pa.int32()
_NAMES = lambda ddl: [x.split()[0] for x in ddl.split(", ")]
_INDEX_ARROW = pa.schema(list(zip(_NAMES(INDEX), [_L, _L, _B, _B, _I, _L, pa.list_(_L), pa.list_(_L), _I, _I, _I, _S, _S], strict=True)))
_OUT_ARROW = pa.schema(list(zip(_NAMES(OUT), [_L, _L, _L, _S, _L, _L, _S, _S], strict=True)))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, a stream holding each whole text. A null text is empty and gives one frame of padding; ids may be null or repeat, and equal texts give equal streams; a very long text is one stream, made by itself; other columns, whatever their names, are ignored; an empty table gives an empty result."""
    session.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_write, MEDIA)


def index_media(media: DataFrame) -> DataFrame:
    """Every stream of (doc_id, media) with exact duration in samples, seek offsets (byte and start sample of each frame), checksum counts and payload. Null or broken media have no frames; whole frames before or behind the break count. Streams of other writers have no payload."""
    session.ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_read(_full, _INDEX_ARROW), INDEX)


def digest_media(media: DataFrame) -> DataFrame:
    """The digests of index_media's columns, made in one pass so that payloads need not travel."""
    session.ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_read(_digest, _OUT_ARROW), OUT)
