"""Secret scans: a linear-chain CRF tags tokens as begin, inside or outside of a secret, beside three fixed patterns.

Tokens are maximal runs of letters, digits and + / _ . = - (any non-ASCII byte
counts as a letter). Features: shape and length, the number of changes between
letter and digit, the word itself, two words before and one after, the bytes
around it, and how dense the whole text is in assignments. The field is trained
on lines made by rule, with secrets of many forms in many settings, and on a
bounded sample of the documents whose labels are what the fixed patterns find.
Decoding is exact over every token of every text. Pass phrases of plain words
are no secrets here: a field that learns them tags prose that repeats itself.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, session, textkit

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_CHARS = re.compile(r"[A-Za-z0-9+/_.=\-\x80-\U0010ffff](?:.*[A-Za-z0-9+/_.=\-\x80-\U0010ffff])?", re.S)
KINDS = ("assign", "access", "hex", "field")

#: Rows of the documents that the field is trained on, about; at most twice as many.
SAMPLE_ROWS = 300
SAMPLE_WORDS = 400

OUTSIDE, BEGIN, INSIDE = 0, 1, 2

_ASSIGN_MAYBE = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
_ACCESS_MAYBE = r"AKIA[A-Z0-9]{14}"
_HEX_MAYBE = r"[0-9a-f]{16}"

#: Hashed words.
WORDS = 1 << 14
_SHAPE, _TURN, _AROUND, _FILE = 1024, 256, 64, 8
_AT = np.cumsum([0, _SHAPE, _TURN, _AROUND, _FILE, WORDS, WORDS, WORDS, WORDS])
FEATURES = int(_AT[-1])

_KIND = np.zeros(256, np.uint8)  # 0 none, 1 digit, 2 upper, 3 lower, 4 other of the secret alphabet, 5 beyond ASCII
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 5
_KIND[[ord(c) for c in "+/_.=-"]] = 4
_TOKEN = _KIND > 0
_EDGE = np.full(256, 7, np.uint8)  # the byte beside a token
for _i, _chars in enumerate((" ", "\n\r\t", "\"'`", ":", "@&?", "([{<", ",;|")):
    _EDGE[[ord(c) for c in _chars]] = _i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda s: (s[0], s[2]))


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each row) of a slice."""
    starts, ends = textkit.runs(_TOKEN[body], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def features(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Columns of feature ids."""
    n = len(starts)
    kind = _KIND[body]
    size = ends - starts
    has = np.zeros(n, np.int64)
    ahead = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 2, 3, 4, 5)]
    for i, sums in enumerate(ahead):
        has |= ((sums[ends] - sums[starts]) > 0).astype(np.int64) << i
    digit = kind == 1
    turn = np.zeros(len(body) + 1, np.int32)
    if len(body) > 1:
        turn[2:] = np.cumsum(digit[1:] != digit[:-1])
    turns = np.minimum(turn[ends] - turn[np.minimum(starts + 1, len(body))], 15)
    step = np.minimum(np.where(size < 16, size, 12 + 4 * np.log2(np.maximum(size, 1) / 8).astype(np.int64)), 31)
    row = np.searchsorted(offsets, starts, "right") - 1
    before = np.where(starts > offsets[row], _EDGE[body[np.maximum(starts - 1, 0)]], 1)
    after = np.where(ends < offsets[row + 1], _EDGE[body[np.minimum(ends, len(body) - 1)]], 1)
    signs = np.concatenate([[0], np.cumsum((body == 61) | (body == 58))])[offsets]
    share = np.diff(signs) * 200 // np.maximum(1, np.diff(offsets))
    word = (textkit.run_hashes(body, starts, ends, textkit.BYTE_CODE[textkit.LOWER]) >> np.uint64(20)).astype(np.int64) % (WORDS - 1) + 1

    def shifted(by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        where = np.arange(n) - by
        good = (where >= first[row]) & (where < first[row + 1])
        out[good] = word[where[good]]
        return out

    cols = [has * 32 + step, turns * 16 + np.minimum(step // 2, 15), before.astype(np.int64) * 8 + after, np.minimum(share, 7)[row], word, shifted(1), shifted(2), shifted(-1)]
    return [c + at for c, at in zip(cols, _AT, strict=False)]


def _lines(count: int = 1200, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made lines with the spans of their secrets."""
    r = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(r.choice(list(chars), n))
    syllables = ["th", "on", "er", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "ment", "que", "sch", "ung", "ción", "os", "la", "ver", "eau"]
    word = lambda: "".join(r.choice(syllables, int(r.integers(1, 5))))
    prose = lambda n: " ".join(word() for _ in range(n))
    made = [
        lambda: draw(lower[:6] + digits, int(r.choice([20, 32, 40, 64]))),
        lambda: "AKIA" + draw(upper + digits, 16),
        lambda: draw(lower + upper + digits, int(r.integers(20, 44))),
        lambda: draw(lower + upper + digits + "+/", int(r.integers(24, 60))) + "==",
        lambda: "ghp_" + draw(lower + upper + digits, 36),
        lambda: "sk_live_" + draw(lower + upper + digits, 24),
        lambda: "eyJ" + draw(lower + upper + digits, 20) + "." + draw(lower + upper + digits, 30) + "." + draw(lower + upper + digits + "_-", 30),
        lambda: draw(lower + upper + digits, 10) + ":" + draw(lower + upper + digits, 28),
    ]
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "auth", "credential", "bearer", "authorization", "client_secret", "private_key", "access_key"]
    plain = [
        lambda: draw(digits, int(r.integers(1, 12))),
        lambda: f"{r.integers(1, 255)}.{r.integers(1, 255)}.{r.integers(1, 255)}.{r.integers(1, 255)}",
        lambda: f"20{r.integers(10, 30)}-{r.integers(1, 12):02}-{r.integers(1, 28):02}",
        lambda: f"{word()}.{r.integers(1, 99)}@mail{r.integers(1, 9)}.example.com",
        lambda: f"https://{word()}.example.com/{word()}/{r.integers(1, 999)}",
        lambda: f"+{r.integers(1, 99)} {draw(digits, 3)} {draw(digits, 7)}",
        lambda: word().upper() + "!!",
        lambda: "".join(word() for _ in range(int(r.integers(3, 8)))),
        lambda: f"{word()}_{word()}_{word()}",
        lambda: f"v{r.integers(1, 9)}.{r.integers(0, 20)}.{r.integers(0, 9)}",
        lambda: f"{word()} = {word()}",
        lambda: f"{word()}: {draw(digits, 4)}",
        lambda: f"{r.choice(names)} {word()}",
        lambda: (word() + " ") * int(r.integers(3, 15)),
    ]
    titles = ["title", "name", "comment", "subject", "label", "note", "description"]
    out = []
    for _ in range(count):
        text, spans = "", []

        def add(secret: str, behind: str) -> None:
            nonlocal text
            spans.append((len(text.encode()), len(text.encode()) + len(secret.encode())))  # noqa: B023
            text += secret + behind

        for _ in range(int(r.integers(1, 6))):
            text += prose(int(r.integers(1, 9))) + r.choice([" ", "\n", ". "])
            kind = r.random()
            if kind < 0.08:
                name = str(r.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]))
                text += f"-----BEGIN {name}-----\n"
                for i in range(lines := int(r.integers(2, 8))):
                    last = i == lines - 1
                    add(draw(lower + upper + digits + "+/", int(r.integers(20, 60)) if last else 64) + str(r.choice(["", "=", "=="])) * last, "\n")
                text += f"-----END {name}-----\n"
            elif kind < 0.16:
                quote = str(r.choice(['"', "'"]))
                text += f"{r.choice(titles)}{r.choice([': ', ' = ', '='])}{quote}{prose(int(r.integers(2, 9)))}{quote} "
            elif kind < 0.5:
                s = made[int(r.integers(len(made)))]()
                quote = str(r.choice(["", '"', "'"]))
                lead = str(r.choice([f"{r.choice(names)} = ", f"{r.choice(names)}: ", f"{str(r.choice(names)).upper()}=", "Bearer ", f'"{r.choice(names)}": ']))
                text += lead + quote
                add(s, quote + " ")
            else:
                text += plain[int(r.integers(len(plain)))]() + " "
        out.append((text, spans))
    return out


def _labelled(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    body = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(body)])
    starts, ends, first = tokens(body, offsets)
    if not len(starts):
        return None
    y = np.zeros(len(starts), np.int64)
    for a, b in spans:
        hit = np.flatnonzero((starts < b) & (ends > a))
        y[hit], y[hit[:1]] = INSIDE, BEGIN
    return np.stack(features(body, offsets, starts, ends, first), 1), y


def _weak(text: str) -> list[tuple[int, int]]:
    """Byte spans of what the fixed patterns find, without the key's name."""
    out = []
    for a, b, kind in base_spans(text):
        if kind == 0:
            a = b - len(ASSIGN.match(text, a)[2])
        out.append((len(text[:a].encode()), len(text[:b].encode())))
    return out


@functools.lru_cache(2)
def _fit(sample: tuple[str, ...]) -> crf.Chain:
    got = [_labelled(t, s) for t, s in _lines()] + [_labelled(t, _weak(t)) for t in sample]
    return crf.train([g for g in got if g], FEATURES, 3, epochs=3)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> crf.Chain:
    """Fit on made lines and on the first SAMPLE_WORDS words of about `rows` documents, twice as many at most: those of least hash of their ids, then texts, so the choice does not depend on partitions."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chance = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = texts.where(chance < F.lit(rows / max(1, docs.count()))).where("text is not null").select("doc_id", F.expr(f"substring_index(text, ' ', {SAMPLE_WORDS})").alias("text"))
    picked = picked.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "text").limit(2 * rows)
    return _fit(tuple(r["text"] for r in sorted(picked.collect(), key=lambda r: (str(r["doc_id"]), r["text"]))))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
SPANS = "array<struct<start:int,end:int,kind:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def beyond(text: str, span: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the base spans leave of a tagged span, cut down to whole runs that begin and end by a token's characters."""
    (at, end), left = span, []
    for x, y, _ in sorted(base):
        if x > at:
            left.append((at, min(x, end)))
        at = max(at, y)
        if at >= end:
            break
    if at < end:
        left.append((at, end))
    out = []
    for a, b in left:
        found = _CHARS.search(text, a, b)
        if found:
            out.append((found.start(), found.end(), 3))
    return out


def scan_slice(model: crf.Chain, texts: pa.Array, body: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, list], dict[int, list]]:
    """(base spans, added spans) by row of the slice, for rows that have any."""
    maybe = np.zeros(len(texts), bool)
    for pattern in (_ASSIGN_MAYBE, _ACCESS_MAYBE, _HEX_MAYBE):
        hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        maybe |= hit.to_numpy(zero_copy_only=False)
    base = {}
    for i in np.flatnonzero(maybe):
        got = base_spans(texts[int(i)].as_py())
        if got:
            base[int(i)] = got
    starts, ends, first = tokens(body, offsets)
    if not len(starts):
        return base, {}
    e = np.zeros((len(starts), 3), np.float32)
    for c in features(body, offsets, starts, ends, first):
        e += model.weights[c]
    label = crf.decode(e, first, model, OUTSIDE)
    added: dict[int, list] = {}
    hit = np.flatnonzero(label != OUTSIDE)
    if len(hit):
        row = np.searchsorted(first, hit, "right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (np.diff(row) > 0)
        new |= label[hit] == BEGIN
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(hit)) - 1
        for b, z in zip(begin, last, strict=True):
            r = int(row[b])
            o = int(offsets[r])
            a, c = int(starts[hit[b]]), int(ends[hit[z]])
            points = lambda lo, hi: int(np.count_nonzero((body[lo:hi] & 0xC0) != 0x80))
            s = points(o, a)
            t = s + points(a, c)
            if any(s < y and t > x for x, y, _ in base.get(r, ())):
                found = beyond(texts[r].as_py(), (s, t), base[r])
            else:
                found = [(s, t, 3)]
            if found:
                added.setdefault(r, []).extend(found)
    return base, added


def _scan(weights: bytes, transitions: np.ndarray, start: np.ndarray, full: bool, schema: pa.Schema):
    def run(batches):
        model = crf.Chain(np.frombuffer(weights, np.float32).reshape(FEATURES, 3), transitions, start)
        for batch in batches:
            ids, texts = textkit.column(batch, "doc_id"), textkit.column(batch, "text")
            for lo, hi, body, offsets in textkit.text_slices(batch):
                base, added = scan_slice(model, texts.slice(lo, hi - lo), body, offsets)
                rows = []
                for i in range(hi - lo):
                    own = base.get(i, [])
                    every = sorted(own + added.get(i, []), key=lambda s: (s[0], s[2]))
                    if full:
                        rows.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in every])
                    else:
                        say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
                        count = [sum(k == n for _, _, k in own) for n in range(3)]
                        rows.append((*count, hashlib.sha256(say(own).encode()).hexdigest(), say(every)))
                if full:
                    cols = [pa.array(rows, _SPANS_ARROW)]
                    rest = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                    yield pa.RecordBatch.from_arrays(rest + cols, names=[*batch.schema.names, "secret_spans"])
                else:
                    cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], schema=schema)

    return run


def _model(docs: DataFrame, model: crf.Chain | None) -> tuple:
    session.ship(docs.sparkSession)
    model = model or train(docs)
    return model.weights.astype(np.float32).tobytes(), model.transitions, model.start


def scan_digest(docs: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256 and spans as text.

    Null and empty texts have no spans. Ids may be null or repeat: each row is
    scanned by itself. Other columns are ignored, an empty table gives an empty
    result. Added spans never overlap base ones: what a base span covers of a
    tagged one is cut out, and the rest is kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(*_model(docs, model), False, _OUT_ARROW), OUT)


def scan(docs: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """(doc_id, text, secret_spans) with spans as array<struct<start,end,kind>>; the rules of scan_digest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(*_model(docs, model), True, None), f"doc_id long, text string, secret_spans {SPANS}")


def redacted(text: str | None, spans, mark: str = "[secret]") -> str | None:
    """text with every span, overlapping ones as one, replaced by the mark."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """docs, all columns, with spans cut out of text; n_chars, where there is one, is counted again."""
    session.ship(docs.sparkSession)
    weights, transitions, start = _model(docs, model)
    schema = docs.schema

    def run(batches):
        model = crf.Chain(np.frombuffer(weights, np.float32).reshape(FEATURES, 3), transitions, start)
        for batch in batches:
            texts = textkit.column(batch, "text")
            for lo, hi, body, offsets in textkit.text_slices(batch):
                part = texts.slice(lo, hi - lo)
                base, added = scan_slice(model, part, body, offsets)
                rows = {i: base.get(i, []) + added.get(i, []) for i in {*base, *added}}
                piece = batch.slice(lo, hi - lo)
                if rows:
                    new = part.to_pylist()
                    for i, spans in rows.items():
                        new[i] = redacted(new[i], [{"start": a, "end": b} for a, b, _ in spans])
                    at = batch.schema.get_field_index("text")
                    piece = piece.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
                    if (at := batch.schema.get_field_index("n_chars")) >= 0:
                        sizes = pc.utf8_length(textkit.column(piece, "text"))
                        old = textkit.column(piece, "n_chars")
                        changed = pa.array([i in rows for i in range(hi - lo)])
                        piece = piece.set_column(at, batch.schema.field(at), pc.if_else(changed, sizes.cast(old.type), old))
                yield piece

    return docs.mapInArrow(run, schema)
