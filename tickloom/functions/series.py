"""Ordered-series primitives that split one long series over many tasks.

A window partitioned by symbol alone runs in one task. Bounded frames are cut
into chunks of bars, each with a halo of earlier bars repeated from the chunk
before; unbounded ones are computed per chunk and corrected by a carry, a running
result over one row per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK = 16_384
KEYS = ("symbol", "bar_index")


def chunked(df: DataFrame, size: int = CHUNK) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("bar_index") / F.lit(size)).cast("long"))


def order(*extra: str) -> Window:
    return Window.partitionBy("symbol", "chunk", *extra).orderBy("bar_index")


def with_halo(df: DataFrame, width: int, size: int = CHUNK) -> DataFrame:
    """Rows with chunk and halo; the last `width` bars before a chunk are in it again with halo true. width may span several chunks."""
    reach = -(-width // size)
    at = F.floor(F.col("bar_index") / F.lit(size)).cast("long")
    copies = F.array(*[F.struct((at + k).alias("chunk"), F.lit(k > 0).alias("halo")) for k in range(reach + 1)])
    wide = df.withColumn("_copy", F.explode(copies)).select("*", "_copy.chunk", "_copy.halo").drop("_copy")
    return wide.where(~F.col("halo") | (F.col("bar_index") >= F.col("chunk") * size - width))


def framed(df: DataFrame, width: int, size: int) -> DataFrame:
    """df with a halo, unless it has one already: steps over one frame share one exchange and one sort."""
    return df if "halo" in df.columns else with_halo(df, width, size)


def closed(wide: DataFrame, df: DataFrame) -> DataFrame:
    """wide as df came: without halo rows, unless df had them."""
    return wide if "halo" in df.columns else no_halo(wide)


def no_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("halo")).drop("chunk", "halo")


def _carry(df: DataFrame, parts: dict[str, Column], over: dict[str, str]) -> DataFrame:
    """(symbol, chunk, carry columns): results over all earlier chunks. over: how parts combine, sum or max."""
    totals = df.groupBy("symbol", "chunk").agg(*[c.alias(n) for n, c in parts.items()])
    w = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("symbol", "chunk", *[getattr(F, over[n])(n).over(w).alias(n) for n in parts])


def running_sum(df: DataFrame, value: str, out: str, size: int = CHUNK) -> DataFrame:
    parts = chunked(df, size)
    carry = _carry(parts, {"_carry": F.sum(value)}, {"_carry": "sum"})
    local = F.sum(value).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_local", local).join(carry, ["symbol", "chunk"], "left").withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0.0))).drop("_local", "_carry", "chunk")


def last_before(df: DataFrame, marks: dict[str, tuple[Column, str]], size: int = CHUNK, inclusive: bool = False) -> DataFrame:
    """For each mark (flag, value) a column with the value, even if null, at the last flagged bar strictly before each bar, or up to it; and `<mark>_index`, that bar."""
    parts = chunked(df, size).withColumns({f"_m_{n}": F.when(flag, F.struct("bar_index", F.col(value).alias("value"))) for n, (flag, value) in marks.items()})
    carry = _carry(parts, {f"_c_{n}": F.max(f"_m_{n}") for n in marks}, {f"_c_{n}": "max" for n in marks})
    w = order().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = parts.withColumns({f"_l_{n}": F.max(f"_m_{n}").over(w) for n in marks}).join(carry, ["symbol", "chunk"], "left")
    got = got.withColumns({f"_a_{n}": F.coalesce(f"_l_{n}", f"_c_{n}") for n in marks})
    out = got.withColumns({n: F.col(f"_a_{n}.value") for n in marks} | {f"{n}_index": F.col(f"_a_{n}.bar_index") for n in marks})
    return out.drop("chunk", *[f"_{k}_{n}" for k in "mcla" for n in marks])


def forward_filled(df: DataFrame, value: str, out: str, size: int = CHUNK) -> DataFrame:
    """The last value that is not null up to each bar; null before the first."""
    return last_before(df, {out: (F.col(value).isNotNull(), value)}, size, inclusive=True).drop(out + "_index")


def rolling_sum(df: DataFrame, value: str, width: int, out: str, size: int = CHUNK) -> DataFrame:
    """Sum of the last `width` bars, this one included; null until the frame is full of values. By prefix sums, so the cost does not grow with the width."""
    wide = framed(df, width, size)
    w = order().rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumn("_s", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)).withColumn("_n", F.count(value).over(w))
    total, count = (F.col(c) - F.coalesce(F.lag(c, width).over(order()), F.lit(0)) for c in ("_s", "_n"))
    return closed(wide.withColumn(out, F.when(count == width, total)), df).drop("_s", "_n")


def rolling_extreme(df: DataFrame, value: str, width: int, high: str, low: str, size: int = CHUNK) -> DataFrame:
    """Greatest and least of the last `width` bars, this one included; null until full."""
    wide = framed(df, width, size)
    w = order().rowsBetween(1 - width, 0)
    full = F.count(value).over(w) == width
    return closed(wide.withColumns({high: F.when(full, F.max(value).over(w)), low: F.when(full, F.min(value).over(w))}), df)


def trailing_std(df: DataFrame, value: str, width: int, out: str, size: int = CHUNK) -> DataFrame:
    """Sample deviation of the `width` bars before each; null until full. Prefix sums of values centred on the chunk's mean."""
    wide = framed(df, width + 1, size)
    x = F.col(value) - F.avg(value).over(Window.partitionBy("symbol", "chunk"))
    wide = wide.withColumn("_x", x)
    w = order().rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumns({"_s": F.sum("_x").over(w), "_q": F.sum(F.col("_x") * F.col("_x")).over(w), "_n": F.count("_x").over(w)})
    back = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.lag(c, width).over(order()), F.lit(0))
    wide = wide.withColumns({"_ds": back("_s"), "_dq": back("_q"), "_dn": back("_n")})
    var = (F.col("_dq") - F.col("_ds") * F.col("_ds") / width) / (width - 1)
    got = wide.withColumn(out, F.when(F.col("_dn") == width, F.sqrt(F.greatest(var, F.lit(0.0)))))
    return closed(got, df).drop("_x", "_s", "_q", "_n", "_ds", "_dq", "_dn")


def previous(df: DataFrame, value: str, at: str, out: str, size: int = CHUNK) -> DataFrame:
    """The value of the row before each in the order of the whole number `at`, per symbol, whatever lies between; null for the first."""
    parts = df.withColumn("chunk", F.floor(F.col(at) / F.lit(size)).cast("long"))
    last = parts.groupBy("symbol", "chunk").agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("_last"))
    w = Window.partitionBy("symbol").orderBy("chunk")
    carry = last.select("symbol", "chunk", F.lag("_last").over(w)["value"].alias("_carry"))
    own = Window.partitionBy("symbol", "chunk").orderBy(at)
    got = parts.withColumns({"_lag": F.lag(value).over(own), "_nth": F.row_number().over(own)}).join(carry, ["symbol", "chunk"])
    return got.withColumn(out, F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("chunk", "_lag", "_nth", "_carry")


#: Values that a rank step holds beside its input.
_BLOCK = 2_000_000


def _in_utc(table: pa.Table) -> pa.Table:
    """The same instants, named in UTC: rows come in the session's zone, and grouped Arrow functions must give them back in UTC."""
    for i, f in enumerate(table.schema):
        if pa.types.is_timestamp(f.type) and f.type.tz:
            table = table.set_column(i, f.name, table[i].cast(pa.timestamp("us", "UTC")))
    return table


def _by_chunk(wide: DataFrame, names: list[str], fn, spent: str | None = None) -> DataFrame:
    """wide, but for the column `spent`, with the double columns that fn(one chunk's table in order) gives."""
    schema = StructType([f for f in wide.schema if f.name != spent] + [StructField(n, DoubleType()) for n in names])

    def run(table: pa.Table) -> pa.Table:
        table = _in_utc(table.take(pc.sort_indices(table["bar_index"])))
        out = table if spent is None else table.drop_columns([spent])
        for name, column in zip(names, fn(table), strict=True):
            out = out.append_column(name, pa.array(column, pa.float64(), from_pandas=True))
        return out

    return wide.groupBy("symbol", "chunk").applyInArrow(run, schema)


def trailing_quantile(df: DataFrame, value: str, width: int, index: int, out: str, size: int = CHUNK) -> DataFrame:
    """The value of the 0-based rank `index` among the `width` bars before each; null until full.

    Built-in frames would gather and sort `width` values for every row; here a
    chunk's frames are views of one array and only the asked rank is selected.
    """

    def ranks(table: pa.Table):
        x = table[value].to_numpy().astype(float)
        got = np.full(len(x), np.nan)
        if len(x) > width:
            frames = np.lib.stride_tricks.sliding_window_view(x, width)[:-1]
            step = max(1, _BLOCK // width)
            for lo in range(0, len(frames), step):
                got[width + lo : width + lo + step] = np.partition(frames[lo : lo + step], index, axis=1)[:, index]
            gone = np.concatenate([[0], np.cumsum(np.isnan(x))])
            got[width:][gone[width:-1] > gone[: -width - 1]] = np.nan
        return [got]

    return closed(_by_chunk(framed(df, width, size), [out], ranks), df)


def pooled_ranks(df: DataFrame, values: str, width: int, shares: dict[str, float], size: int = CHUNK) -> DataFrame:
    """For each share a column with that pooled percentile (rank min(int(p n), n - 1)) of all values of the array column in the `width` bars before each; null if there are none."""

    def ranks(table: pa.Table):
        lists = table[values].combine_chunks()
        flat = lists.flatten().to_numpy().astype(float)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        got = np.full((len(shares), len(lists)), np.nan)
        for i in range(len(lists)):
            part = flat[at[max(0, i - width)] : at[i]]
            if len(part):
                where = [min(int(p * len(part)), len(part) - 1) for p in shares.values()]
                got[:, i] = np.partition(part, sorted(set(where)))[where]
        return list(got)

    return closed(_by_chunk(framed(df, width, size), list(shares), ranks, values), df)
