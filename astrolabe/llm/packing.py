"""Packing by first-fit decreasing over a tournament tree of bin capacities.

A document's ids, with the end id, are cut into pieces of exactly `capacity` from the start, each a sequence of
its own, and one rest. Rests are dealt to randomised groups of about GROUP (a hash of the row, not of the document,
so that repeated rows spread), and each group is packed by itself: rests by falling length, each into the first bin
that has room, found by walking down a tree whose nodes hold the largest free capacity below them.

Only lengths and checksums leave the tokenising tasks; ids are never shuffled.

Defined results: null and empty texts are one end id; very long texts are tokenised whole; rests of one length go in
the order of their rows; repeated rows are packed each on their own; an empty table gives an empty table; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, staged, text_or_empty

CAPACITY, END_ID, GROUP = 2048, 1, 4096
TOKENIZER = "byte_bpe_50k.json"

#: The pre-tokeniser pattern of the public byte-level vocabulary, and the bytes that its JSON form
#: writes as themselves (the others follow from code point 256 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SELF_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Texts of these characters only, all white space of one character, are encoded by words; a word with the space
#: before it never shares a token with its neighbours. Other texts go through the tokeniser whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ]*")
_DOUBLE = re.compile(r"\s\s")
_KEPT_WORDS = 600_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers; remembers the ids of words it has seen."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {chr(b): b for b in SELF_BYTES} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(SELF_BYTES))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.special}
        self.quick = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, each with a space before it, in one go."""
        if len(self.words) > _KEPT_WORDS:
            self.words.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        ids = self.quick.encode_to_numpy(" " + " ".join(new), disallowed_special=())
        ends = np.cumsum([len(w.encode()) + 1 for w in new])
        cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
        raw, at = ids.astype("<u4").tobytes(), 0
        for w, cut in zip(new, (4 * cuts).tolist(), strict=True):
            self.words[w] = raw[at:cut]
            at = cut

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _DOUBLE.search(text) or text[0].isspace() or text[-1].isspace():
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        first, *words = text.split(" ")
        head = self.quick.encode_to_numpy(first, disallowed_special=()).astype("<u4").tobytes()
        get = self.words.__getitem__
        try:
            return head + b"".join(map(get, words))
        except KeyError:
            self._learn(words)
            return head + b"".join(map(get, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; worker processes outlive tasks, and its words with them."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, all between 1 and capacity; ties in the order given."""
    n = 1
    while n < max(1, len(lengths)):
        n *= 2
    free = [capacity] * (2 * n)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[i], 1
        while at < n:
            at *= 2
            if free[at] < need:
                at += 1
        out[i] = (at - n, capacity - free[at])
        free[at] -= need
        at //= 2
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
            at //= 2
    return out


def _cut(path: str, capacity: int, end_id: int):
    def make():
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()

        def work(b: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for row, doc, text in zip(b["row_id"], b["doc_id"], b["text"], strict=True):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for k, v in zip(out, (row, doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        out[k].append(v)
            return out

        return work

    return make


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, seed: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_or_empty().alias("text"))
    pieces = staged(map_rows(rows, "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long", _cut(tokenizer_path, capacity, end_id)).withColumn("piece", F.monotonically_increasing_id()), "packing-pieces")
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("piece", "ascending")])
        bins = first_fit_decreasing(table["length"].to_pylist(), capacity)
        at = pa.array([2 * ((key[0].as_py() << 32) + b) for b, _ in bins], pa.int64())
        return table.select(names).append_column("sequence_id", at).append_column("offset", pa.array([o for _, o in bins], pa.int64()))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"])
    dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(groups)))
    packed = dealt.select("group", "piece", *names).groupBy("group").applyInArrow(fit, schema)
    # full pieces take odd sequence ids, bins even ones
    return full.select(*names, (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(packed)
