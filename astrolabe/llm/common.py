"""What the text operators share: row ids, shared-folder tables, Arrow row maps, fast word hashing."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.scratch import delete, new_path

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() with no argument splits on exactly these six.
SPACE = r"[\x20\x09-\x0D]+"

#: Texts are hashed in chunks of about this many bytes, so that a worker's arrays stay near 40 MB
#: however many documents an Arrow batch holds; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


#: Paths of tables that open scopes delete when they end, the innermost last.
_SCOPES: list[list[str]] = []


def staged(df: DataFrame, label: str, keep: int = 0) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go when the innermost scope ends; with keep, when the one so many around it does, if there is such.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those to keep: stage the result so."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)
        drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that are collected, which by itself it does when the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """A stored copy of df with its rows numbered once. Numbers that are drawn again in a later pass may differ, as
    file splits depend on the cores that are there at the time; those of the copy are facts."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()), label)


#: Rows of a page of a bit map are 2 ** PAGE_BITS that follow each other.
PAGE_BITS = 12


def with_row_values(rows: DataFrame, row: str, values: DataFrame, most: int, name: str) -> DataFrame:
    """rows, a stored copy numbered in the column `row`, with the value that values (row_id, value) has of each; 0 where it has none.

    Values are whole numbers from 0 to `most`. They travel as bit maps, one for each binary digit, of a bit a row, that are
    broadcast: rows, however wide, stay where they are.
    """
    digits = range(max(1, int(most).bit_length()))
    words = values.where("value > 0").groupBy(F.shiftright("row_id", PAGE_BITS).alias("page"), F.shiftright("row_id", 6).bitwiseAND((1 << PAGE_BITS - 6) - 1).cast("int").alias("word"))
    one = "shiftleft(cast(shiftright(value, {}) & 1 AS bigint), cast(row_id & 63 AS int))"
    words = words.agg(*[F.expr(f"bit_or({one.format(k)})").alias(f"d{k}") for k in digits])
    every = F.sequence(F.lit(0), F.lit((1 << PAGE_BITS - 6) - 1))

    def dense(k: int) -> Column:
        held = F.map_from_entries(F.collect_list(F.struct("word", f"d{k}")))
        return F.transform(every, lambda w: F.coalesce(F.element_at(held, w), F.lit(0).cast("long")))

    page, bits = fresh(rows, "page"), [fresh(rows, f"bits{k}") for k in digits]
    pages = words.groupBy("page").agg(*[dense(k).alias(bits[k]) for k in digits]).withColumnRenamed("page", page)
    at = F.col("`" + row.replace("`", "``") + "`")
    word = F.shiftright(at, 6).bitwiseAND((1 << PAGE_BITS - 6) - 1).cast("int") + 1
    place = at.bitwiseAND(63).cast("int")
    out = rows.join(F.broadcast(pages), F.shiftright(at, PAGE_BITS) == F.col(page), "left")
    digit = lambda k: F.call_function("shiftright", F.element_at(F.col(bits[k]), word), place).bitwiseAND(1)
    value = sum((digit(k) * (1 << k) for k in digits), F.lit(0))
    return out.withColumn(name, F.coalesce(value, F.lit(0)).cast("int")).drop(page, *bits)


#: A key is hot if it has HOT_ROWS rows and one in MOST_HOT of all rows, so there are MOST_HOT hot keys at most.
HOT_ROWS, MOST_HOT = 1000, 10_000


def hot_least(rows: int) -> int:
    """From how many rows on a key is hot, in a table of so many rows."""
    return max(HOT_ROWS, rows // MOST_HOT)


def skew_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of unique, non-null keys, whose column `count` bounds how many rows a key has.

    Rows of hot keys, known by their hash, meet a broadcast of those keys alone, MOST_HOT rows at most, where they are; rows with
    a null key meet nothing; only the others shuffle. `how` is inner or left.
    """
    keys = list(keys)
    least = hot_least(total)
    code = F.xxhash64(*[F.col(k).cast(table.schema[k].dataType) for k in keys])
    hot = [r.code for r in table.where(F.col(count) >= least).select(code.alias("code")).distinct().collect()]
    known = rows.dropna(subset=keys)
    if not hot:
        out = known.join(table, keys, how)
    else:
        # a key that shares its code with a hot one goes with it, on both sides
        is_hot = code.isin(hot)
        out = known.where(is_hot).join(F.broadcast(table.where(is_hot)), keys, how).unionByName(known.where(~is_hot).join(table.where(~is_hot), keys, how))
    if how == "left":
        bare = rows.where(" or ".join(f"`{k}` is null" for k in keys))
        out = out.unionByName(bare, allowMissingColumns=True)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow with columns as Python lists; make() runs once a task and returns the function of a batch."""
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # slices keep the Python copies of long texts small
            step = max(1, min(batch.num_rows, int(batch.num_rows * 8 * CHUNK_BYTES / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = work({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def logistic(x: np.ndarray, y: np.ndarray, signed: bool = True, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; unsigned: weights that would turn negative are left at 0."""
    x1 = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    free = np.ones(x1.shape[1], bool)
    w = np.zeros(x1.shape[1])
    for _ in range(x.shape[1] + 1):
        w[:] = 0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            g = x1.T @ (p - y) + penalty * w
            h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        bad = (w[:-1] < 0) & free[:-1]
        if signed or not bad.any():
            break
        free[:-1] &= ~bad
    return w[:-1], float(w[-1])


# --- hashing of whole chunks ---------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH_FACTOR, _PIECE_FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _is_space(raw: np.ndarray) -> np.ndarray:
    """Space, and tab to carriage return; bytes wrap below 0."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, read eight bytes at a time; words of up to eight bytes and one length never collide."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = mix((eights.take(starts) & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _LENGTH_FACTOR)
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        left = lengths[more] - at
        piece = eights.take(starts[more] + at) & _FIRST_BYTES[np.minimum(left, 8)]
        out[more] = mix(out[more] * _PIECE_FACTOR + piece)
        more, at = more[left > 8], at + 8
    return out


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of blob."""
    raw = np.frombuffer(blob, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _is_space(raw), [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, hash_words(raw, starts, ends)


def word_chunks(column: pa.Array, size: int = CHUNK_BYTES >> 3) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of a column of texts, A-Z lower-cased, without a Python object for any text.

    Yields, for consecutive texts of about `size` bytes, the index of the first, the hashes, and the bounds of each
    text among them.
    """
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        raw = whole[bounds[at] : bounds[end]]
        raw = raw + ((raw - np.uint8(65)) < 26) * np.uint8(32)
        edges = bounds[at : end + 1] - bounds[at]
        space = _is_space(raw)
        cut = np.zeros(len(raw) + 1, bool)
        cut[edges] = True
        starts = np.flatnonzero(~space & (np.concatenate(([True], space))[: len(raw)] | cut[:-1]))
        ends = np.flatnonzero(~space & (np.concatenate((space, [True]))[1:] | cut[1:])) + 1 if len(raw) else starts
        hashes = hash_words(raw, starts, ends)
        yield at, hashes, np.searchsorted(starts, edges)
        at = end


def chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Joins consecutive texts to chunks: index of the first text, the chunk, and the bounds of its texts."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) + 1 <= CHUNK_BYTES:
            size += len(texts[end]) + 1
            end += 1
        bounds = np.zeros(end - at + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[at:end]], out=bounds[1:])
        yield at, b"\n".join(texts[at:end]), bounds
        at = end
