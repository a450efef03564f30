"""Quality rules: counts of every text, and a hashed n-gram log-likelihood ratio.

Byte n-grams (n = 4) of every text are hashed to 65,536 buckets. The raw multinomial counts all documents, the
trusted one all documents labelled of good quality: labels meet the ids of a stored, numbered copy, and a bit map of its rows
finds the texts where they are. A document's score is the mean, over its n-grams, of the log ratio of trusted to raw probability; documents whose score
is under one threshold, the same for all, fail. The threshold lies below the trusted scores: under their first
percentile by `SLACK` times the distance from it to their median, both exact, over the scores of all trusted documents.

Defined results: null and empty texts have no words and fail the base rules, as all texts under 50 words; texts are read
whole, however long; without trusted documents the ratio rejects nothing; a score that equals the threshold passes; null labels
and null ids teach nothing; repeated rows are counted and judged each; an empty table gives an empty table; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows, mix, numbered, scope, staged, text_or_empty, with_row_values, word_hashes

BUCKETS, GRAM, SLACK = 1 << 16, 4, 3.0
#: A quantile is sought in a histogram of so many bins, then in the bin that holds it, until so few values are left.
BINS, FEW = 4096, 100_000
LEAST_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WHITE = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def base_counts(texts: list[str]) -> dict[str, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    out: dict[str, list[int]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for first, blob, bounds in chunks(coded):
        starts, _, words = word_hashes(blob)
        edge = np.searchsorted(starts, bounds)
        n = max(0, len(words) - 2)
        c = mix(np.arange(3, 6, dtype=np.uint64)) | np.uint64(1)
        windows = mix(words[:n] * c[0] + words[1 : n + 1] * c[1] + words[2 : n + 2] * c[2]) if n else np.empty(0, np.uint64)
        for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            text, raw = texts[first + k], coded[first + k]
            out["n_words"].append(b - a)
            out["word_chars"].append(len(text) - sum(map(raw.count, _WHITE)))
            out["n_symbols"].append(sum(map(raw.count, b"#*$%&|<>")))
            lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else []
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(_repeated(windows[a : b - 2]) if b - a > 2 else 0)
    return out


def _repeated(windows: np.ndarray) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    order = np.argsort(windows)
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows) + 2, bool)
    at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    code = raw[:n].copy()
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | raw[k : n + k]
    return ((code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> np.uint32(16)


def _counted():
    def work(b: dict[str, list]) -> dict[str, list]:
        # one slice of a batch at a time: 8 MB of text give one table
        total = np.zeros(BUCKETS, np.int64)
        for text in b["text"]:
            total += np.bincount(grams(text), minlength=BUCKETS) if len(text) > 4 * BUCKETS else 0
        short = [grams(t) for t in b["text"] if len(t) <= 4 * BUCKETS]
        if short:
            total += np.bincount(np.concatenate(short), minlength=BUCKETS)
        at = np.flatnonzero(total)
        return {"bucket": at.tolist(), "n": total[at].tolist()}

    return work


def _multinomial(docs: DataFrame) -> np.ndarray:
    """Counts of the BUCKETS buckets over all texts of docs."""
    counts = map_rows(docs.select("text"), "bucket int, n long", _counted).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The table of log ratios and the threshold."""
    with scope(docs.sparkSession):
        trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null and quality = 1").distinct()
        texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "row_id", "quality-texts")
        at = texts.select("row_id", "doc_id").join(trusted, "doc_id", "left_semi").select("row_id", F.lit(1).alias("value"))
        good = with_row_values(texts, "row_id", at, 1, "good").where("good = 1").select("text")
        raw, target = _multinomial(texts), _multinomial(good)
        if not target.sum():
            return np.zeros(BUCKETS), -1.0
        share = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS))
        ratio = share(target) - share(raw)
        scores = map_rows(good, "score double, n_words long", _scored(ratio)).where(F.col("n_words") >= LEAST_WORDS)
        low, middle = quantiles(staged(scores.select("score"), "quality-scores"), (0.01, 0.5)) or (0.0, 0.0)
        return ratio, low - SLACK * (middle - low)


def quantiles(scores: DataFrame, shares: tuple[float, ...]) -> list[float] | None:
    """Exact quantiles of the column `score`, between two values by their distance; None of no values."""
    least, most, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    if not n:
        return None

    def ranked(k: int) -> float:
        low, high, part, k = least, most, scores, k
        rows = n
        while low < high and rows > FEW:
            width = (high - low) / BINS
            cell = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
            found = part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            for r in sorted(found.collect()):  # BINS rows at most
                if k < r.n:
                    break
                k -= r.n
            part, low, high, rows = part.where(F.col("score").between(r.low, r.high)), r.low, r.high, r.n
        return low if low == high else sorted(x.score for x in part.collect())[k]  # FEW at most

    out = []
    for share in shares:
        place = share * (n - 1)
        below, above = ranked(int(place)), ranked(min(n - 1, int(place) + 1))
        out.append(below + (above - below) * (place - int(place)))
    return out


def _scored(ratio: np.ndarray):
    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = base_counts(b["text"])
            out["score"] = [float(ratio[g].mean()) if len(g) else 0.0 for g in map(grams, b["text"])]
            return b | out

        return work

    return make


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, score."""
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    out = map_rows(docs.select("doc_id", text_or_empty().alias("text")), f"doc_id long, {counts}, score double", _scored(ratio))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    # the verdict is by the score as it is; what is shown is rounded, as sums of floats end differently in another order
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    return out.withColumn("score", F.round("score", 8))
