"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Its text is cut into short segments;
hashed byte 4-gram models give each segment's likelihood under each language,
and expectation-maximisation estimates the languages' proportions. Sets of
languages are nested by proportion and the one with the best penalised
likelihood is kept (half of log(segments) for each language more); the
prediction is its largest member and the score that member's proportion. Sets
grow up to all languages, unless the likelihood under all of them, which no set
exceeds, is too low for a larger set to win.

The models are counted over a bounded sample of labelled rows: at most
SAMPLE_ROWS for each language, chosen by a hash of doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

SAMPLE_ROWS = 1500
GRAM, TABLE = 4, 1 << 16
SEGMENT = 32
SETTLED = 1e-5  # EM stops when no proportion of a row moves by more
PENALTY = 0.5
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-likelihood ratios, TABLE x languages


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table slot of the 4-gram at each byte, offsets): letters in lower case, everything else a space, one space before and three behind each row. Slot 0 is the blank."""
    n = np.diff(offsets)
    at = offsets + 4 * np.arange(len(offsets))
    flat = np.full(at[-1] + 3, 32, np.uint8)
    flat[np.arange(len(body)) + 4 * np.repeat(np.arange(len(n)), n) + 1] = _PLAIN[body]
    wide = flat.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    blank = code == np.uint32(0x20202020)
    slot[blank] = 0
    crossing = at[1:, None] - np.arange(1, 4)  # grams that would reach into the next row
    slot[crossing[crossing >= 0]] = 0
    return slot.astype(np.int32), at


def count(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(grams(body, offsets)[0], minlength=TABLE)


def fit(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    c = np.stack([counts[x] for x in languages], 1).astype(np.float64)
    c[0] = 0
    logp = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * TABLE))
    logp -= logp.mean(axis=1, keepdims=True)
    logp[0] = 0
    return Model(languages, logp.astype(np.float32))


def _sum_rows(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over ranges, none of them empty."""
    return np.add.reduceat(x, first[:-1], axis=0)


def mixtures(model: Model, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the predicted language, its proportion) of each row."""
    slot, at = grams(body, offsets)
    size = np.diff(at)
    cells = -(-size // SEGMENT)
    first = np.concatenate([[0], np.cumsum(cells)])
    row = np.repeat(np.arange(len(size)), cells)
    begin = at[row] + SEGMENT * (np.arange(first[-1]) - first[row])
    like = np.stack([np.add.reduceat(model.table[:, k][slot], begin) for k in range(len(model.languages))], 1)
    like -= like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(like, -60)).astype(np.float32)

    def settle(rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of some rows within their allowed languages, and the log-likelihood."""
        share = (keep / keep.sum(axis=1, keepdims=True)).astype(np.float64)
        sizes = cells[rows]
        mine = like if len(rows) == n else like[np.repeat(first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        moving, part, length = np.arange(len(rows)), mine, sizes
        while len(moving):
            old = share[moving]
            belongs = part * np.repeat(old, length, axis=0)
            belongs /= np.maximum(belongs.sum(axis=1, keepdims=True), 1e-30)
            new = _sum_rows(belongs, np.concatenate([[0], np.cumsum(length)])) / length[:, None]
            share[moving] = new
            still = np.abs(new - old).max(axis=1) > SETTLED
            if not still.all():
                part, moving, length = part[np.repeat(still, length)], moving[still], length[still]
        total = np.log(np.maximum((mine * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-30))
        return share, _sum_rows(total[:, None], np.concatenate([[0], np.cumsum(sizes)]))[:, 0]

    n, k = len(size), len(model.languages)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    every = np.arange(n)
    share, most = settle(every, np.ones((n, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, value, score = order[:, 0], np.full(n, -np.inf), np.ones(n)
    for m in range(1, k + 1):
        price = PENALTY * (m - 1) * np.log(cells + 1)
        rows = np.flatnonzero(most - price > value)  # no other row's larger sets can win
        if not len(rows):
            break
        got, like_m = settle(rows, (rank[rows] < m).astype(np.float64))
        worth = like_m - price[rows]
        better = worth > value[rows]
        won = rows[better]
        best[won] = got[better].argmax(axis=1)
        score[won] = got[better].max(axis=1)
        value[won] = worth[better]
    return best, np.clip(score, 0, 1)


def _remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


_COUNT_ARROW = pa.schema([("lang", pa.string()), ("counts", pa.binary())])


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = textkit.column(batch, "lang").to_pylist()
        for lo, hi, body, offsets in textkit.text_slices(batch):
            for name in set(langs[lo:hi]):
                rows = [i for i in range(hi - lo) if langs[lo + i] == name]
                part = np.concatenate([body[offsets[i] : offsets[i + 1]] for i in rows])
                at = np.concatenate([[0], np.cumsum([offsets[i + 1] - offsets[i] for i in rows])])
                sums[name] = sums.get(name, 0) + count(part, at)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([c.astype("<i8").tobytes() for c in sums.values()], pa.binary())], schema=_COUNT_ARROW)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Models of the languages in docs, from rows with text, lang and doc_id whose crc32(doc_id as text) mod 3 is not 1. None if there are no such rows."""
    session.ship(docs.sparkSession)
    labelled = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where((_remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    rate = F.create_map(*[x for name, n in totals.items() for x in (F.lit(name), F.lit(min(1.0, rows / n)))])
    chance = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.where(chance < rate[F.col("lang")]).select("lang", "text")
    counts: dict[str, np.ndarray] = {}
    for r in sample.coalesce(4).mapInArrow(_count, "lang string, counts binary").collect():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    return fit(counts) if counts else None


OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _predictor(model: Model, table: bytes):
    languages = model.languages

    def run(batches, has_letter: str = "has_letter"):
        own = Model(languages, np.frombuffer(table, np.float32).reshape(TABLE, len(languages)))
        own.table = np.asfortranarray(own.table)
        names = np.array(languages, object)
        for batch in batches:
            letter = textkit.column(batch, has_letter).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, body, offsets in textkit.text_slices(batch):
                best, score = mixtures(own, body, offsets)
                yield batch.slice(lo, hi - lo), np.where(letter[lo:hi], names[best], UNKNOWN), np.where(letter[lo:hi], score, 0.0)

    return run


def _letters(name: str = "text"):
    return F.coalesce(F.col(name).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text, or one without a letter, is `und` with score 0; so is every row
    if there is nothing to learn from. A null doc_id is not held out and not
    learned from. Repeated rows are predicted alike; other columns are ignored.
    """
    model = model or train(docs)
    held = F.coalesce(_remainder() == 1, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), _letters().alias("has_letter"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    predictor = _predictor(model, np.ascontiguousarray(model.table, np.float32).tobytes())

    def run(batches):
        for piece, name, score in predictor(batches):
            yield pa.RecordBatch.from_arrays([textkit.column(piece, "doc_id"), textkit.column(piece, "held_out"), pa.array(name, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.mapInArrow(run, OUT)


def keep_known(docs: DataFrame, least: float = 0.4, model: Model | None = None) -> DataFrame:
    """docs, all columns, without rows whose language is unknown or whose main language has less than `least` of the text."""
    model = model or train(docs)
    if model is None:
        return docs.where(F.lit(False))
    predictor = _predictor(model, np.ascontiguousarray(model.table, np.float32).tobytes())
    flag = "has_letter"
    while flag in docs.columns:
        flag += "_"

    def run(batches):
        for piece, name, score in predictor(batches, flag):
            kept = piece.filter(pa.array((name != UNKNOWN) & (score >= least)))
            yield kept.select([c for c in kept.schema.names if c != flag])

    return docs.withColumn(flag, _letters()).mapInArrow(run, docs.schema)
