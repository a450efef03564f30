"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (fewer words: the whole sequence as
one). Documents with one set (128-bit digest of the sorted set, and its size) form a class. A class has one
sketch: of 128 buckets of the hash space each keeps, of its least hash, the number of leading zeros (6 bits)
and the next 10 bits. Bands of registers give bucket keys; empty registers borrow from the next full one.

Candidates are never listed as pairs. In each bucket, a union-find over sketches joins classes whose corrected Jaccard
estimate is promising and hands on a forest, at most one row a member. The connected components of these forests are
families; two linked classes that share a bucket are in one family. Texts travel to their family, where another
union-find compares classes that are still apart: by the small sketch, by a larger one, and at last by exact counts
on the full sets; again a forest of confirmed links is handed on, whose components are the answer.

A group (bucket or family) of more than BLOCK members is dealt into blocks, each member to one. Links within the blocks
come first; where they leave a large group in one piece, as for copies of one text, that is all. Else one member of each
piece is compared with those of the others, and what is still apart after that in full: the largest piece block by
block with all that is outside it, and that with itself. So what travels grows with the group, and only for members that are
truly apart with the square of their number over BLOCK. No task holds more than two blocks.

Documents are linked from a similarity of `percent` on (85 by default), a parameter that also sets the size filter, the
estimates that count as promising, and the bands: 25 of 5 registers at 85, 32 of 4 at 80. A pair at the threshold shares no
bucket with probability 4e-7 at 85 and 5e-8 at 80, and less at higher similarity.

Rows are numbered once, in a stored copy that all later passes read.

Defined results: null, empty and blank texts have n_shingles 0 and stand alone; null doc_ids count only where a
component has no other; texts are compared whole, however long; repeated rows share a class; an empty table gives an empty
table; further columns, whatever their names, are ignored by `near_duplicates` and carried along by `drop_near_duplicates`,
which keeps one row of a component, the first stored one, where its smallest doc_id is repeated.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, map_rows, mix, numbered, scope, skew_join, staged, text_or_empty, with_row_values, word_hashes
from .exact_dedup import docs_column

WIDTH = 5
PERCENT = 85
BUCKETS, MANTISSA = 128, 10
EMPTY = 0xFFFF
#: The larger sketch is made where the texts are.
MORE_BUCKETS = 1024
#: A pair at the threshold shares no bucket with at most this probability.
MOST_MISSED = 1e-6
BLOCK = 512
#: So many edges are joined by the driver, 16 bytes each; more of them by alternating stars.
FEW_EDGES = 500_000

_COEFFICIENTS = mix(np.arange(11, 11 + WIDTH, dtype=np.uint64)) | np.uint64(1)


def band_shape(percent: int) -> tuple[int, int]:
    """Bands and registers a band: the longest bands that miss a pair of this similarity by MOST_MISSED at most."""
    for rows in range(BUCKETS, 1, -1):
        if (1 - (percent / 100) ** rows) ** (BUCKETS // rows) <= MOST_MISSED:
            return BUCKETS // rows, rows
    return BUCKETS, 1


def least_estimate(percent: int, registers: int, digits: int) -> float:
    """From where on estimates count as promising: five standard deviations below the threshold, rounded down."""
    p = percent / 100
    return math.floor((p - 5 * math.sqrt(p * (1 - p) / registers)) * 10**digits) / 10**digits


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    coded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    coefficients = _COEFFICIENTS if width == WIDTH else mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    for _, blob, bounds in chunks(coded):
        starts, _, words = word_hashes(blob)
        first = np.searchsorted(starts, bounds)
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * coefficients[k]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                with np.errstate(over="ignore"):
                    out.append(mix(np.array([(words[a:b] * coefficients[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def sketch(s: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes."""
    registers = np.full(buckets, EMPTY, np.uint16)
    bits = buckets.bit_length() - 1
    bucket = (s >> np.uint64(64 - bits)).astype(np.int64)
    head = np.concatenate(([True], bucket[1:] != bucket[:-1])) if len(s) else np.empty(0, bool)
    rest = (s[head] << np.uint64(bits)).astype(np.float64)
    part, power = np.frexp(rest)
    zeros = np.clip(64 - power, 0, 62).astype(np.uint16)
    digits = np.clip((part * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    registers[bucket[head]] = (zeros << np.uint16(MANTISSA)) | digits
    return registers


def band_keys(registers: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys by band of one or more sketches (rows); empty registers take the next full one and its distance."""
    bands, rows = band_shape(percent)
    registers = np.atleast_2d(registers)
    full = registers != EMPTY
    n = registers.shape[1]
    at = np.arange(2 * n)
    twice = np.where(np.concatenate([full, full], 1), at, 4 * n)
    nearest = np.minimum.accumulate(twice[:, ::-1], 1)[:, ::-1][:, :n]
    far = nearest - np.arange(n)
    values = np.take_along_axis(registers, nearest % n, 1).astype(np.uint64) + far.astype(np.uint64) * np.uint64(65536)
    values = values[:, : bands * rows].reshape(len(registers), bands, rows)
    keys = np.zeros((len(registers), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return keys.view(np.int64)


@lru_cache(4096)
def _accidents(log_a: int, log_b: int) -> float:
    """Chance that registers of unlike least hashes agree, with 2**log_a/2 and 2**log_b/2 hashes in a bucket."""
    low = np.ldexp(1 + np.arange(1 << MANTISSA) / (1 << MANTISSA), -np.arange(1, 41)[:, None])
    high = low + np.ldexp(1.0, -np.arange(1, 41)[:, None] - MANTISSA)
    a, b = 2.0 ** (log_a / 2), 2.0 ** (log_b / 2)
    return float(((np.exp(-a * low) - np.exp(-a * high)) * (np.exp(-b * low) - np.exp(-b * high))).sum())


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of sketches."""
    used = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & used).sum(1) / np.maximum(1, used.sum(1))
    scale = lambda n: np.maximum(-4, np.round(2 * np.log2(np.maximum(n, 1) / a.shape[-1]))).astype(int)
    pairs, at = np.unique(scale(n_a) * 1000 + scale(n_b), return_inverse=True)
    c = np.array([_accidents((p + 500) // 1000, (p + 500) % 1000 - 500) for p in pairs.tolist()])[at] if len(a) else np.empty(0)
    return (share - c) / (1 - c)


def _unpack(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BUCKETS)


def _signatures():
    def work(b: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(b["text"])
        return {
            "row_id": b["row_id"],
            "doc_id": b["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "set_hash": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "sketch": [sketch(s).tobytes() if len(s) else None for s in sets],
        }

    return work


def _banded(percent: int):
    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            return {"cid": b["cid"], "keys": list(band_keys(_unpack(b["sketch"]), percent)) if b["cid"] else []}

        return work

    return make


def _forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray, same_block: bool, linked) -> list[tuple[int, int]]:
    """Union-find over the members at `left` and `right`; linked(i, js) gives the js that i is joined to.

    Members of one label are joined already. Only pairs of different labels are looked at, and of each label that i
    meets one pair is handed on.
    """
    out: list[tuple[int, int]] = []
    for at, i in enumerate(left.tolist()):
        others = right[at + 1 :] if same_block else right
        others = others[labels[others] != labels[i]]
        if not len(others):
            continue
        for j in linked(i, others):
            if labels[j] != labels[i]:
                out.append((i, int(j)))
                labels[labels == labels[j]] = labels[i]
    return out


def _blocks(table: pa.Table, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Labels of the members (their pieces so far), the members of both blocks, and whether these are one."""
    low, high = key[1].as_py(), key[2].as_py()
    block = table["block"].to_numpy()
    labels = np.unique(table["piece"].to_numpy(), return_inverse=True)[1]
    return labels, np.flatnonzero(block == low), np.flatnonzero(block == high), low == high


def _edges(cid: np.ndarray, got: list[tuple[int, int]]) -> pa.Table:
    at = np.array(got, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(cid[at[:, 0]]), "b": pa.array(cid[at[:, 1]])})


def _family_edges(percent: int, key: tuple, table: pa.Table) -> pa.Table:
    """A forest of promising pairs within two blocks of a bucket."""
    n = table["n"].to_numpy()
    registers = _unpack(table["sketch"].to_pylist())
    least = least_estimate(percent, BUCKETS, 2)

    def linked(i: int, js: np.ndarray):
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        if len(js):
            js = js[estimates(registers[js], np.broadcast_to(registers[i], (len(js), BUCKETS)), n[js], np.full(len(js), n[i])) >= least]
        return js.tolist()

    return _edges(table["cid"].to_numpy(), _forest(*_blocks(table, key), linked))


def _family_links(percent: int, key: tuple, table: pa.Table) -> pa.Table:
    """A forest of confirmed links within two blocks of a family."""
    sets = shingle_sets(table["text"].to_pylist())
    n = np.array([len(s) for s in sets])
    small = np.array([sketch(s) for s in sets])
    large = np.array([sketch(s, MORE_BUCKETS) for s in sets])
    labels, *sides = _blocks(table, key)
    steps = ((small, least_estimate(percent, BUCKETS, 2)), (large, least_estimate(percent, MORE_BUCKETS, 3)))

    def linked(i: int, js: np.ndarray):
        for registers, least in steps:
            js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
            if not len(js):
                return
            e = estimates(registers[js], np.broadcast_to(registers[i], (len(js), registers.shape[1])), n[js], np.full(len(js), n[i]))
            js, e = js[e >= least], e[e >= least]
        for j in js[np.argsort(-e, kind="stable")].tolist():
            if labels[j] != labels[i]:  # joined meanwhile, through another of its label
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    yield j

    return _edges(table["cid"].to_numpy(), _forest(labels, *sides, linked))


def _with(grouped, percent: int):
    """The two-argument function that applyInArrow wants."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return grouped(percent, key, table)

    return run


def _own_block(members: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Each member in one block of its group; sizes: (key, n)."""
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = skew_join(members, sizes, ["key"], "n", total).withColumn("block", block)
    return dealt.select("key", "cid", F.col("cid").alias("piece"), "block", F.col("block").alias("low"), F.col("block").alias("high"))


def _across(members: DataFrame, total: int) -> DataFrame:
    """Pairs of blocks in which all members of unlike pieces of a group meet; members: (key, cid, piece).

    Members outside the largest piece have blocks 0.. of their own; those of the largest have the blocks after them, which
    meet only the former.
    """
    sizes = members.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "piece")).alias("most"), F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    groups = groups.select("key", "all", F.col("most.piece").alias("main"), up(F.col("most.n")).alias("inner"), up(F.col("all") - F.col("most.n")).alias("outer"))
    dealt = skew_join(members, groups, ["key"], "all", total).withColumn("apart", F.col("piece") != F.col("main"))
    block = F.when(F.col("apart"), F.pmod(F.xxhash64("cid"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("cid"), F.col("inner"))).cast("int")
    last = F.when(F.col("apart"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", "cid", "piece", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _joined_groups(members: DataFrame, attach, find, label: str) -> DataFrame:
    """(id, root) of what find joins within groups; members: (key, cid), attach(dealt) adds what find needs."""

    def edges(dealt: DataFrame, step: str) -> DataFrame:
        found = attach(dealt).groupBy("key", "low", "high").applyInArrow(find, "a long, b long")
        return staged(found.where("a <> b"), f"{label}-{step}")

    members = staged(members, f"{label}-placed")
    sizes, total = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), members.count()
    found = edges(_own_block(members, sizes, total), "within")
    large = sizes.where(F.col("n") > BLOCK).select("key", "n")
    if large.isEmpty():
        return components(found, label)
    large = staged(skew_join(members, large, ["key"], "n", total).select("key", "cid"), f"{label}-large")
    for step in ("heads", "across"):
        roots = components(found, label)
        pieces = staged(large.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("piece")), f"{label}-pieces")
        if step == "heads":
            pieces = pieces.groupBy("key", "piece").agg(F.min("cid").alias("cid"))
        found = found.unionByName(edges(_across(pieces, total), step))
    return components(found, label)


def components(links: DataFrame, label: str = "near-components") -> DataFrame:
    """(id, root) for every id in links (a, b), root the least id reachable: by the driver where edges are few, else by
    alternating large and small stars.

    Both steps keep what is connected; they end once every edge leads straight to the root of its component. The edges
    of hubs meet their least neighbour by a broadcast of the hubs alone.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    if edges.count() <= FEW_EDGES:
        return staged(_few_components(edges), f"{label}-few")
    k = 0
    while not _all_stars(edges):
        k += 1
        both, total = edges.union(edges.select("v", "u")), 2 * edges.count()
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = skew_join(both, least, ["u"], "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), f"{label}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = skew_join(large, least, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = staged(small.where("u <> v").distinct(), f"{label}-{k}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _few_components(edges: DataFrame) -> DataFrame:
    """(id, root) of FEW_EDGES edges at most, found by the driver: each id takes its neighbours' least root, and that one's."""
    table = edges.toArrow()
    ids, at = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    u, v = np.split(at, 2)
    root, last = np.arange(len(ids)), None
    while last is None or (root != last).any():
        last = root.copy()
        least = np.minimum(root[u], root[v])
        for ends in (u, v):
            np.minimum.at(root, ends, least)
            np.minimum.at(root, last[ends], least)
        while (root != root[root]).any():
            root = root[root]
    return edges.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(ids[root], pa.int64())}))


def _all_stars(edges: DataFrame) -> bool:
    """Whether no id has two edges to lesser ids, or one to a lesser and one from a greater id."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _class_roots(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures by row, classes, and (id, root) of the linked classes; texts: (row_id, doc_id, text), stored."""
    signed = staged(map_rows(texts, "row_id long, doc_id long, n_shingles long, set_hash binary, sketch binary", _signatures), "near-signatures")
    made = signed.where("n_shingles > 0").groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("least_id"), F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("size"))
    made = made.join(signed.select("row_id", "sketch"), "row_id")
    classes = staged(made.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    keyed = map_rows(classes.select("cid", "sketch"), "cid long, keys array<long>", _banded(percent)).select(F.explode("keys").alias("key"), "cid")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sketches = classes.select("cid", F.col("n_shingles").alias("n"), "sketch")
    kept = skew_join(keyed, shared, ["key"], "members", classes.count() * band_shape(percent)[0]).select("key", "cid")
    families = _joined_groups(
        kept, lambda dealt: dealt.join(sketches, "cid"), _with(_family_edges, percent), "near-families"
    )
    families = staged(families.select(F.col("root").alias("key"), F.col("id").alias("cid")), "near-members")
    rows = classes.select("cid", "row_id")
    # only texts of families travel
    wanted = rows.join(families.select("cid"), "cid", "left_semi").select("row_id", F.lit(1).alias("value"))
    text = with_row_values(texts, "row_id", wanted, 1, "wanted").where("wanted = 1").select("row_id", "text")
    links = _joined_groups(families, lambda dealt: text.join(dealt.join(rows, "cid"), "row_id").drop("row_id"), _with(_family_links, percent), "near-links")
    return signed, classes, staged(links, "near-roots")


def _labelled(texts: DataFrame, percent: int) -> DataFrame:
    """row_id, doc_id, n_shingles, root, component_id for every row."""
    with scope(texts.sparkSession):
        signed, classes, roots = _class_roots(texts, percent)
        named = classes.join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        totals = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("size").alias("rows")).where("rows > 1")
        groups = named.join(totals, "root").select("set_hash", "n_shingles", "root", "component_id", "size")
        slim = signed.select("row_id", "doc_id", "n_shingles", "set_hash")
        out = skew_join(slim, staged(groups, "near-groups"), ["set_hash", "n_shingles"], "size", slim.count(), "left")
        return staged(out.select("row_id", "doc_id", "n_shingles", "root", "component_id"), "near-labels", keep=1)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    with scope(docs.sparkSession):
        texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "row_id", "near-texts").select("row_id", "doc_id", "text")
        out = _labelled(texts, percent).withColumn("component_id", F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        return staged(out, "near-answer", keep=1)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns."""
    row = fresh(docs, "row_id")
    rows = numbered(docs, row, "near-rows")
    texts = rows.select(docs_column(rows, row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    grouped = _labelled(texts, percent).where("root is not null")
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row_id").alias("keep_row"))
    # rows that are kept, one a component; all others of a component go
    gone = grouped.select("row_id").join(first.select(F.col("keep_row").alias("row_id")), "row_id", "left_anti").select("row_id", F.lit(1).alias("value"))
    mark = fresh(rows, "gone")
    return with_row_values(rows, row, gone, 1, mark).where(F.col(mark) == 0).select(*[docs_column(docs, c) for c in docs.columns])
