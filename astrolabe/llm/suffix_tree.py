"""Scoring by a probabilistic suffix tree over words.

A context of k words is a candidate if it occurs LEAST_CONTEXT times and its suffix of k - 1 words is a state; of its next
symbols, those that follow it LEAST_PAIR times are weighed. It becomes a state if what follows diverges from what the
shorter state expects by more than chance (a log-likelihood ratio test), and holds own probabilities for the symbols that
bear the divergence. The rest of its mass, smoothed by KAPPA, backs off to the shorter state. The root is the additively
smoothed unigram. The tree grows a word of context at a time until no candidate diverges, with no other bound of depth or
number of states, so what is gathered grows with the corpus. Each token is scored from the longest state that ends before it.

Scores add up: log P(w | longest state) is log P(w) and, for each longer state of the chain, what it changes: for a symbol of
its own log P(w | s) - log P(w | shorter state), else its back-off weight. So every n-gram of the tree has one value, and a
text's score is its base score and the values of its n-grams, whatever their order. Words and n-grams are known by 64-bit
hashes; counts and values are tables joined on them. Bit maps of fixed sizes (MAP_BITS, ROUGH_BITS) spare the joins most
n-grams that are in no table; those that pass by chance are dropped by the join. An n-gram has a value only if it is a state or
follows one, and the suffix of a state is a state: scoring looks up what continues a chain of states, so that chance does not
add up with the tokens and the depth. The COMMON tokens and values that are used most are broadcast; every other one is found
by the join, a slice of the codes at a time (SLICES), so these bounds do not change a score.

Defined results: a null or empty text is one end token; null ids count as an empty text in the hash; repeated rows count
and are scored each; equal texts have equal scores; with no training row every token has probability one in V + 1 = 1; an
empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, hot_least, mix, remainder, scope, staged, text_or_empty, word_chunks

ALPHA, KAPPA = 0.1, 1.0
LEAST_CONTEXT, LEAST_PAIR, LEAST_EVIDENCE = 8, 4, 8.0
COMMON = 500_000
MAP_BITS = 26
#: Of the bit maps that the rough counts of pairs and triples make, by order.
ROUGH_BITS = {2: 28, 3: 27}
#: N-grams to look up are joined in so many slices of their codes, a power of two, one after the other.
SLICES = 4
#: Documents are scored in so many parts, one after the other.
PARTS = 2
#: Task-wise counts are handed on once so many n-grams differ.
HELD = 500_000
#: N-grams that a task counts at once in the first count of pairs, about.
BUCKET = 1_000_000

END = np.uint64(0x243F6A8885A308D3)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def token_codes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Index of the first text, hashes of words and end tokens, bounds of the texts, places within texts."""
    for at, words, first in word_chunks(column):
        n = np.diff(first)
        bounds = first + np.arange(len(first))
        h = np.empty(bounds[-1], np.uint64)
        inner = np.ones(len(h), bool)
        inner[bounds[1:] - 1] = False
        h[inner] = words
        h[~inner] = END
        yield at, h, bounds, np.arange(len(h)) - np.repeat(bounds[:-1], n + 1)


def joined(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Codes of n-grams of an order, from those of their first and of their last order - 1 tokens."""
    return mix(a * _NEXT + b + np.uint64(order))


def longer(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams of an order that end at each token, from those of the order below; the first have no meaning."""
    out = np.zeros(len(codes), np.uint64)
    if len(codes) > 1:
        out[1:] = joined(codes[:-1], codes[1:], order)
    return out


def in_map(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_map(codes: DataFrame) -> np.ndarray:
    """The bit map of the longs in the column `g`: one bit for each value of their first MAP_BITS bits."""
    at = codes.select(F.shiftrightunsigned("g", 64 - MAP_BITS).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    table = words.toArrow()  # 2 ** (MAP_BITS - 6) rows at most
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


class Lookup:
    """An open-addressing table of distinct codes, probed for whole arrays at once."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes)).bit_length() + 1)
        self.keys, self.owner = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]
            self.keys[at[free]] = codes[left[free]]
            done = self.owner[at] == left
            left, at = left[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code among those given at first, or -1."""
        at = self._home(codes)
        out, live = self.owner[at], np.flatnonzero((self.keys[at] != codes) & (self.owner[at] >= 0))
        at = at[live]
        while len(live):
            at = (at + 1) & (len(self.keys) - 1)
            out[live] = self.owner[at]
            on = (self.keys[at] != codes[live]) & (self.owner[at] >= 0)
            live, at = live[on], at[on]
        return out


# --- counting -----------------------------------------------------------------------------


def _passes(make: Callable[[], tuple[Callable, Callable]]):
    """A map over batches of texts: add(h, place) returns how much it holds, flush() hands it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = make()
        for batch in batches:
            for _, h, _, place in token_codes(batch.column(0)):
                if add(h, place) > HELD:
                    yield flush()
                    pa.default_memory_pool().release_unused()
        yield flush()

    return run


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.values()], list(columns))


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys, the place of one, and the sum of their n; by ascending key."""
    at = np.argsort(key)
    key = key[at]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return at[head], np.add.reduceat(n[at], head) if len(key) else n


class Tally:
    """Counts of n-grams, each known by the codes of its parts. Equal ones are merged when the room ends, so that a task hands
    on one row for each n-gram, not one for each HELD tokens, as long as no more than HELD differ."""

    def __init__(self, parts: int, key: Callable[..., np.ndarray]):
        room = HELD * 3 // 2 + (1 << 16)
        self.codes, self.n, self.used, self.merged, self.key = np.empty((parts, room), np.uint64), np.empty(room, np.int64), 0, 0, key

    def add(self, codes: tuple[np.ndarray, ...], n: np.ndarray | int) -> int:
        """How many different n-grams it held when it last merged them."""
        size = len(codes[0])
        if self.used + size > len(self.n):
            self.merge()
        start, end = self.used, self.used + size
        if end > len(self.n):  # a very long text
            self.codes = np.concatenate([self.codes[:, :start], np.empty((len(codes), size), np.uint64)], 1)
            self.n = np.concatenate([self.n[:start], np.empty(size, np.int64)])
        for row, part in zip(self.codes, codes, strict=True):
            row[start:end] = part
        self.n[start:end] = n
        self.used = end
        return self.merged

    def merge(self) -> None:
        at, n = _merged(self.key(*self.codes[:, : self.used]), self.n[: self.used])
        self.used = self.merged = len(at)
        for row in self.codes:
            row[: len(at)] = row[at]
        self.n[: len(at)] = n

    def taken(self) -> tuple[np.ndarray, ...]:
        """The codes and counts that it held, once."""
        self.merge()
        out = (*[row[: self.used].copy() for row in self.codes], self.n[: self.used].copy())
        self.used = self.merged = 0
        return out


def _count_tokens():
    tally = Tally(1, lambda g: g)

    def add(h: np.ndarray, place: np.ndarray) -> int:
        g, n = np.unique(h, return_counts=True)
        return tally.add((g,), n)

    return add, lambda: _longs(**dict(zip("gn", tally.taken(), strict=True)))


def _planes(numbers: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize)


def _cut(codes: np.ndarray, counts: np.ndarray, width: int, bits: int) -> pa.RecordBatch:
    """Sorted codes of a width by bucket (their first bits): steps from one to the next, byte by byte, and so their counts."""
    counts = _planes(counts)
    edges = np.searchsorted(codes, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(width - bits))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    sizes, packed = [], []
    for b in full.tolist():
        part = codes[edges[b] : edges[b + 1]] - (np.uint64(b) << np.uint64(width - bits))
        step = np.diff(part, prepend=np.uint64(0)).astype("<u8")
        planes = _planes(step)[:, : max(1, (int(step.max()).bit_length() + 7) // 8)]
        packed.append(pa.compress(planes.T.tobytes() + counts[edges[b] : edges[b + 1]].T.tobytes(), codec="zstd", asbytes=True))
        sizes.append((len(step), planes.shape[1]))
    sizes = np.array(sizes, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]), pa.array(packed, pa.binary())], ["bucket", "codes", "planes", "packed"])


def _uncut(codes: int, planes: int, packed: bytes, size: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The codes, from the start of their bucket, and their counts, of `size` bytes each."""
    raw = np.frombuffer(pa.decompress(packed, codes * (planes + size), codec="zstd", asbytes=True), np.uint8).reshape(planes + size, codes)
    step, counts = np.zeros((codes, 8), np.uint8), np.zeros((codes, 8), np.uint8)
    step[:, :planes], counts[:, :size] = raw[:planes].T, raw[planes:].T
    return np.cumsum(step.view("<u8")[:, 0]), counts.view("<i8")[:, 0]


def _candidates(h: np.ndarray, place: np.ndarray, order: int, maps: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of an order, those of one token less that end with them, and the places of those that can matter.

    Order 2: all pairs. Above: the first part is in the map of possible contexts, the last in that of all n-grams counted, and
    one of both in that of contexts whose own suffix is a state.
    """
    shorter = h
    for k in range(2, order):
        shorter = longer(shorter, k)
    g = longer(shorter, order)
    at = np.flatnonzero(place >= order - 1)
    if order > 2:
        counted, often, suited = maps
        at = at[in_map(counted, shorter[at])]
        at = at[in_map(often, shorter[at - 1])]
        at = at[in_map(suited, shorter[at]) | in_map(suited, shorter[at - 1])]
    return g, shorter, at


def _count_roughly(order: int, width: int, bits: int, maps: Callable[[], tuple[np.ndarray, ...]]):
    def make():
        held: list[np.ndarray] = []
        known = maps()

        def add(h: np.ndarray, place: np.ndarray) -> int:
            g, _, at = _candidates(h, place, order, known)
            held.append(g[at] >> np.uint64(64 - width))
            return sum(map(len, held))

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            held.clear()
            return _cut(codes, np.minimum(n, 255).astype(np.uint8), width, bits)

        return add, flush

    return make


def _often(order: int, width: int, bits: int):
    """Of a bucket of codes, the bit map of those counted LEAST_PAIR times, as far as the bucket reaches."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_uncut(*row) for row in zip(*(table[c].to_pylist() for c in ("codes", "planes", "packed")), strict=True)]
        codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
        at = np.argsort(codes)
        codes, counts = codes[at], counts[at]
        head = np.flatnonzero(np.diff(codes, prepend=np.uint64(1 << 63)) != 0)
        often = codes[head][np.add.reduceat(counts, head) >= LEAST_PAIR]
        marks = np.zeros(1 << (ROUGH_BITS[order] - bits), bool)
        marks[(often >> np.uint64(width - ROUGH_BITS[order])).astype(np.int64)] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return run


def _bucket_bits(total: int) -> int:
    return min(MAP_BITS - 6, max(3, math.ceil(math.log2(max(1, total / BUCKET)))))


def _frequent(train: DataFrame, total: int, order: int, maps: Callable[[], tuple[np.ndarray, ...]]) -> np.ndarray:
    """A bit map of the n-grams of an order that occur LEAST_PAIR times, and, by chance, of a few others.

    Codes are cut to a width at which a code is shared by one in 64 n-grams at most, if all of them differ.
    """
    bits = _bucket_bits(total)
    width = min(48, max(34, math.ceil(math.log2(total)) + 6))
    cut = train.mapInArrow(_passes(_count_roughly(order, width, bits, maps)), "bucket long, codes long, planes long, packed binary")
    got = cut.groupBy("bucket").applyInArrow(_often(order, width, bits), "bucket long, marks binary").toArrow()  # 2 ** ROUGH_BITS bits in all
    out = np.zeros((1 << bits, 1 << (ROUGH_BITS[order] - bits - 3)), np.uint8)
    for b, marks in zip(got["bucket"].to_pylist(), got["marks"].to_pylist(), strict=True):
        out[b] = np.frombuffer(marks, np.uint8)
    return out.reshape(-1).view(np.uint64)


def _count_grams(order: int, maps: Callable[[], tuple[tuple[np.ndarray, ...], np.ndarray | None]], form: Callable[[], Callable[..., pa.RecordBatch]]):
    """Counts of n-grams of an order that can matter, by the codes of their first (`a`) and last (`b`) order - 1 tokens."""

    def make():
        hand_on = form()
        known, frequent = maps()
        tally = Tally(2, lambda a, b: joined(a, b, order))

        def add(h: np.ndarray, place: np.ndarray) -> int:
            g, shorter, at = _candidates(h, place, order, known)
            if frequent is not None:
                at = at[in_map(frequent, g[at])]
            return tally.add((shorter[at - 1], shorter[at]), 1)

        return add, lambda: hand_on(*tally.taken())

    return make


def _with_codes(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
            yield _longs(g=joined(a.view(np.uint64), b.view(np.uint64), order), a=a, b=b, n=n)

    return run


def _counted(train: DataFrame, order: int, maps: Callable[[], tuple[tuple[np.ndarray, ...], np.ndarray | None]]) -> DataFrame:
    """g, a, b and n of the n-grams of an order that can matter and occur LEAST_PAIR times."""
    parts = train.mapInArrow(_passes(_count_grams(order, maps, lambda: lambda a, b, n: _longs(a=a, b=b, n=n))), "a long, b long, n long")
    out = parts.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAIR)
    return out.mapInArrow(_with_codes(order), "g long, a long, b long, n long")


class Ranks:
    """Pairs of common tokens as numbers of few bits, spread evenly over a width: their ranks side by side, times an odd number."""

    def __init__(self, common: int, bits: int):
        self.rank = max(1, common.bit_length())
        self.width = max(2 * self.rank, bits)

    def spread(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(self.rank)) + b.astype(np.uint64)) * _NEXT & np.uint64((1 << self.width) - 1)

    def back(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = codes * np.uint64(pow(int(_NEXT), -1, 1 << self.width)) & np.uint64((1 << self.width) - 1)
        return both >> np.uint64(self.rank), both & np.uint64((1 << self.rank) - 1)


def _packed_pairs(bits: int, common: Callable[[], np.ndarray]):
    """Of counted pairs, those of two common tokens as cut codes; others, of no planes, as they are, by the first bits of their code."""

    def make():
        lookup, ranks = Lookup(common()), Ranks(len(common()), bits)

        def hand_on(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first, last = lookup.find(a), lookup.find(b)
            known = (first >= 0) & (last >= 0)
            codes, rare = ranks.spread(first[known], last[known]), ~known
            at = np.argsort(codes)
            cut = _cut(codes[at], n[known][at], ranks.width, bits)
            bucket = (joined(a[rare], b[rare], 2) >> np.uint64(64 - bits)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            rows, bucket = np.stack([a[rare], b[rare], n[rare].view(np.uint64)])[:, at], bucket[at]
            full, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts, len(bucket))[1:]
            packed = [pa.compress(rows[:, i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            others = [pa.array(full), pa.array(ends - starts), pa.array(np.zeros(len(full), np.int64)), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(cut.columns, others, strict=True)], cut.schema.names)

        return hand_on

    return make


def _summed_pairs(bits: int, common: Callable[[], np.ndarray]):
    """Of a bucket of packed pairs, g, a, b and n of those that occur LEAST_PAIR times."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tokens = common()
        ranks, bucket = Ranks(len(tokens), bits), key[0].as_py()
        codes, counts, others = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((3, 0), np.uint64)]
        for size, planes, packed in zip(*(table[c].to_pylist() for c in ("codes", "planes", "packed")), strict=True):
            if planes:
                c, n = _uncut(size, planes, packed, 8)
                codes.append(c)
                counts.append(n)
            else:
                others.append(np.frombuffer(pa.decompress(packed, 24 * size, codec="zstd", asbytes=True), np.uint64).reshape(3, size))
        codes, others = np.concatenate(codes), np.concatenate(others, 1)
        at, n = _merged(codes, np.concatenate(counts))
        first, last = ranks.back(codes[at][n >= LEAST_PAIR] + (np.uint64(bucket) << np.uint64(ranks.width - bits)))
        rare, more = _merged(joined(others[0], others[1], 2), others[2].view(np.int64))
        rare = others[:, rare[more >= LEAST_PAIR]]
        a, b = np.append(tokens[first.astype(np.int64)], rare[0]), np.append(tokens[last.astype(np.int64)], rare[1])
        return pa.Table.from_batches([_longs(g=joined(a, b, 2), a=a, b=b, n=np.append(n[n >= LEAST_PAIR], more[more >= LEAST_PAIR]))])

    return run


def _counted_pairs(train: DataFrame, total: int, maps: Callable[[], tuple[tuple[np.ndarray, ...], np.ndarray | None]], common: Callable[[], np.ndarray]) -> DataFrame:
    """As _counted, of pairs: most are of two common tokens, whose ranks take about a quarter of the bytes of their codes."""
    bits = _bucket_bits(total)
    parts = train.mapInArrow(_passes(_count_grams(2, maps, _packed_pairs(bits, common))), "bucket long, codes long, planes long, packed binary")
    return parts.groupBy("bucket").applyInArrow(_summed_pairs(bits, common), "g long, a long, b long, n long")


# --- the tree -----------------------------------------------------------------------------


@dataclass
class Model:
    """Distributed counts of tokens and values of n-grams, the commonest of both as arrays, and the deepest context."""

    tokens: DataFrame  # g, n
    values: DataFrame  # g, value
    common: tuple[np.ndarray, np.ndarray]  # codes, counts
    used: tuple[np.ndarray, np.ndarray]  # codes, values
    known: np.ndarray  # bit map of all n-grams with a value
    contexts: np.ndarray  # bit map of all states
    depth: int
    total: int
    distinct: int
    states: tuple[int, ...] = ()


def _least_of_commonest(table: DataFrame, most: int) -> int:
    """The least n that at most so many rows reach, from a histogram of n."""
    capped = table.groupBy(F.least("n", F.lit(1_000_000)).alias("k")).count()
    # one row for each count up to a million
    least, seen = 1 << 62, 0
    for k, rows in sorted(((r.k, r["count"]) for r in capped.collect()), reverse=True):
        seen += rows
        if seen > most:
            break
        least = k
    return least


def _looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, **columns: str) -> DataFrame:
    """rows with columns of a table (g, n, ..) by rows.key = table.g, null where that has no such row; a key has n rows at most.

    Keys with one in MOST_HOT of all tokens are broadcast; their rows, once they have met them, scatter by their own code.
    """
    held = F.struct(*[F.col(c).alias(new) for new, c in columns.items()])
    few = table.where(F.col("n") >= hot_least(total)).select(F.col("g").alias("hot_g"), held.alias("hot"))
    rest = table.where(F.col("n") < hot_least(total)).select(F.col("g").alias("cold_g"), held.alias("cold"))
    out = rows.join(F.broadcast(few), F.col(key) == F.col("hot_g"), "left").withColumn("at", F.when(F.col("hot").isNull(), F.col(key)).otherwise(F.col("g")))
    got = F.coalesce("hot", "cold")
    return out.join(rest, F.col("at") == F.col("cold_g"), "left").select(*rows.columns, *[got[new].alias(new) for new in columns])


def _tested(whole: DataFrame, shorter: DataFrame, total: int, depth: int) -> DataFrame:
    """Rows g, a, b, n and whole with q, what the tree so far expects, and e, how far they diverge from it; null if that is unknown.

    `shorter` has g, n and logp, log10 P(last token | the tokens before it) as the tree has it so far, null where the tokens
    before it are no state.
    """
    ln10 = math.log(10)
    rows = _looked_up(whole, shorter, "b", total, q="logp")
    whole = F.col("whole") + KAPPA
    e = 2 * F.col("n") * (F.log(F.col("n") / whole) - F.col("q") * ln10) + 2 * (F.col("whole") * F.pow(F.lit(10.0), F.col("q")) - F.col("n"))
    return staged(rows.withColumn("e", F.when(F.col("whole") >= LEAST_CONTEXT, e)).select("g", "a", "b", "n", "whole", "q", "e"), f"tree-tested-{depth}", keep=1)


def _grow(rows: DataFrame, total: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows g, n, logp of the n-grams tested, with values of those that are symbols of a state; and the states."""
    whole = F.col("whole") + KAPPA
    told = rows.where(F.col("e") >= LEAST_EVIDENCE)
    states = told.groupBy("a", "whole").agg(F.sum("e").alias("sum_e"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("sum_n"), F.sum(F.pow(F.lit(10.0), F.col("q"))).alias("sum_q"))
    # the divergence that the telling symbols bear, against that of chance
    states = states.where((F.col("sum_e") >= 2 * LEAST_EVIDENCE + F.col("k")) & (F.col("sum_q") < 1 - 1e-9))
    states = staged(states.select(F.col("a").alias("g"), F.col("whole").alias("n"), F.log10((whole - F.col("sum_n")) / whole / (1 - F.col("sum_q"))).alias("back")), f"tree-states-{depth}", keep=1)
    rows = _looked_up(rows, states, "a", total, back="back")
    own = F.log10(F.col("n") / whole)
    logp = F.when(F.col("back").isNotNull(), F.when(F.col("e") >= LEAST_EVIDENCE, own).otherwise(F.col("q") + F.col("back")))
    value = F.when(F.col("back").isNotNull() & (F.col("e") >= LEAST_EVIDENCE), own - F.col("q") - F.col("back"))
    return staged(rows.select("g", "b", "n", logp.alias("logp"), value.alias("value")), f"tree-grams-{depth}", keep=1), states


def fit(docs: DataFrame) -> Model:
    """Learns from the rows whose crc32(doc_id) modulo 10 is not 0."""
    with scope(docs.sparkSession):
        return _fit(docs)


def _fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    train = docs.where(remainder("doc_id", 10) != 0).select(text_or_empty().alias("text"))
    tokens = staged(train.mapInArrow(_passes(_count_tokens), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "tree-tokens", keep=1)
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    root = tokens.select("g", "n", F.log10((F.col("n") + ALPHA) / F.lit(total + ALPHA * (distinct + 1))).alias("logp"))
    common = _commonest(tokens, "n")
    ranked = spark.sparkContext.broadcast(common[0])
    # no token of an n-gram is rarer than it
    grams, parts, held, counts, depth, maps = root.where(F.col("n") >= LEAST_PAIR), [], [], [], 0, ()
    while total:
        order = depth + 2
        shared = spark.sparkContext.broadcast(maps)  # three bit maps
        # pairs and triples are mostly of one kind each; a rough count spares the exact one those
        frequent = spark.sparkContext.broadcast(_frequent(train, total, order, lambda shared=shared: shared.value) if order <= 3 else None)
        drop_shuffles(spark)
        with scope(spark):
            # what a step has read goes before the next
            with scope(spark):
                with scope(spark):
                    take = lambda shared=shared, frequent=frequent: (shared.value, frequent.value)
                    counted = staged(_counted(train, order, take) if order > 2 else _counted_pairs(train, total, take, lambda: ranked.value), f"tree-counted-{order}")
                    shared.destroy()
                    frequent.destroy()
                    drop_shuffles(spark)
                    whole = staged(_looked_up(counted, grams, "a", total, whole="n"), f"tree-whole-{order}", keep=1)
                tested = _tested(whole, grams, total, depth + 1)
            grams, states = _grow(tested, total, depth + 1)
            found = states.count()
        if not found:
            break
        depth += 1
        counts.append(found)
        parts += [grams.where("value is not null").select("g", "n", "value"), states.select("g", "n", F.col("back").alias("value"))]
        held.append(states)
        # contexts to come: often enough, and their suffix is a state
        often = grams.where(F.col("n") >= LEAST_CONTEXT)
        suited = _looked_up(often, states, "b", total, back="back").where("back is not null")
        maps = (bit_map(grams), bit_map(often), bit_map(suited))
    ranked.destroy()
    values, contexts = spark.createDataFrame([], "g long, n long, value double"), spark.createDataFrame([], "g long")
    for p in parts:
        values = values.union(p)
    for p in held:
        contexts = contexts.union(p.select("g"))
    # an n-gram can be a symbol of one state and a state itself
    values = staged(values.groupBy("g").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "tree-values", keep=1)
    return Model(tokens, values, common, _commonest(values, "value"), bit_map(values), bit_map(contexts), depth, total, distinct, tuple(counts))


def _commonest(table: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a column of the COMMON rows at most of greatest n."""
    got = table.where(F.col("n") >= _least_of_commonest(table, COMMON)).select("g", column).toArrow()
    return got["g"].to_numpy().view(np.uint64), got[column].to_numpy()


def _valued(h: np.ndarray, place: np.ndarray, known: np.ndarray, contexts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order, the places at which n-grams end that can have a value, and their codes.

    An n-gram of k tokens has one only if it is a state or its first k - 1 tokens are; and the last k - 1 tokens of a state are one.
    """
    g, state = h, np.ones(len(h), bool)
    for order in range(1, depth + 2 if depth else 1):
        g = longer(g, order) if order > 1 else g
        fits = place >= order - 1
        after = np.append(False, state[:-1]) & fits if order > 1 else np.zeros(len(h), bool)
        at = np.flatnonzero(state & fits)
        at = at[in_map(contexts, g[at])]
        state = np.zeros(len(h), bool)
        state[at] = True
        at = np.flatnonzero(after | state)
        at = at[in_map(known, g[at])]
        yield at, g[at]
        if not state.any():
            return


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with scope(docs.sparkSession):
        return _score(docs, model)


def _score(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    denominator = model.total + ALPHA * (model.distinct + 1)
    depth, slices = model.depth, SLICES
    slice_bits = slices.bit_length() - 1
    shared = spark.sparkContext.broadcast((model.common, model.used, model.known, model.contexts))  # COMMON rows each, and bit maps
    lists = [f"grams{k}" for k in range(slices)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, counts), (grams, values), known, contexts = shared.value
        tokens, used = Lookup(codes), Lookup(grams)
        logs, values = np.append(np.log10((counts + ALPHA) / denominator), 0.0), np.append(values, 0.0)
        for batch in batches:
            for at, h, bounds, place in token_codes(batch.column(2)):
                starts, n = bounds[:-1], len(bounds) - 1
                found = tokens.find(h)
                rare = np.flatnonzero(found < 0)
                gain, rest, where = np.zeros(len(h)), [h[:0]], [np.empty(0, np.int64)]
                for live, g in _valued(h, place, known, contexts, depth):
                    k = used.find(g)
                    gain[live] += values[k]  # the last value, for -1, is 0
                    rest.append(g[k < 0])
                    where.append(live[k < 0])
                where, rest = np.concatenate(where), np.concatenate(rest)
                order_ = np.argsort(where, kind="stable")
                where, rest = where[order_], rest[order_]
                slice_ = (rest >> np.uint64(32)) & np.uint64(slices - 1)
                ids, held = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, held, pa.array(np.diff(bounds)), pa.array(np.add.reduceat((found >= 0).astype(np.int64), starts)),
                        pa.array(np.add.reduceat(logs[found], starts)), pa.array(np.add.reduceat(gain, starts)),
                        _lists(rare, h[rare], bounds), *[_lists(where[slice_ == k], rest[slice_ == k], bounds) for k in range(slices)],
                    ],
                    ["doc_id", "held_out", "n_tokens", "common", "part", "gain", "others", *lists],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 10) == 0).alias("held_out"), text_or_empty().alias("text"))
    schema = "doc_id long, held_out boolean, n_tokens long, common long, part double, gain double, others array<long>"
    schema += "".join(f", {c} array<long>" for c in lists)
    # equal ids are of one part, whatever the splits
    parts = []
    for k in range(PARTS):
        with scope(spark):
            part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == k).mapInArrow(run, schema)
            parts.append(_summed(part, model, lists, denominator))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _summed(scored: DataFrame, model: Model, lists: list[str], denominator: float) -> DataFrame:
    """Adds to the rows that scoring made what the joins find: the other tokens, and the n-grams of each slice's list."""
    spark, slices = scored.sparkSession, len(lists)
    scored = staged(scored.withColumn("row_id", F.monotonically_increasing_id()), "tree-scores")
    rare = scored.select("row_id", F.explode("others").alias("g")).join(model.tokens, "g", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.select("row_id", F.log10((n + ALPHA) / denominator).alias("rest"), (n > 0).cast("long").alias("seen"))
    rare = staged(rare.groupBy("row_id").agg(F.sum("rest").alias("rest"), F.sum("seen").alias("seen")), "tree-rare")
    # one slice of the n-grams after the other, so that the disk holds the shuffles of one
    more = []
    for k, column in enumerate(lists):
        drop_shuffles(spark)
        values = model.values.where(F.expr(f"shiftrightunsigned(g, 32) & {slices - 1} = {k}")).select("g", "value")
        got = scored.select("row_id", F.explode(column).alias("g")).join(values, "g").groupBy("row_id").agg(F.sum("value").alias("more"))
        more.append(staged(got, f"tree-more-{k}"))
    drop_shuffles(spark)
    sums = rare.withColumn("more", F.lit(0.0))
    for m in more:
        sums = sums.union(m.select("row_id", F.lit(0.0), F.lit(0).cast("long"), "more"))
    sums = sums.groupBy("row_id").agg(F.sum("rest").alias("rest"), F.sum("seen").alias("seen"), F.sum("more").alias("more"))
    base = F.col("part") + F.coalesce("rest", F.lit(0.0))
    out = scored.drop("others", *lists).join(sums, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("common") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
    return staged(out, "tree-parts", keep=2)


def _lists(at: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The codes at sorted token places, as one list a text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pa.array(codes.view(np.int64)))
