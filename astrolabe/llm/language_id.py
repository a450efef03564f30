"""Language identification as inference of a mixture.

For each language a character n-gram model (orders 1 to 3, interpolated) is learned from labelled texts. A word's
likelihood in a language is that of its letters, all of them; a run of more than LONGEST letters is judged as consecutive
pieces, each of which knows the two letters before it. Expectation-maximisation then estimates each document's language
proportions from the likelihoods of its words; the language set is chosen by penalised likelihood: languages are
dropped, smallest share first, as long as the penalised log-likelihood (half the log of the number of words for each language)
does not fall. The prediction is the language of the largest share.

The model is fitted on at most FIT_ROWS labelled rows of each language, chosen by a hash of the id (a parameter), which
are read whole, as is every document then. Every language that a training row has is learned.

Defined results: null texts and texts without a letter are `und` with score 0; equal shares go to the language first in
code-point order; with no labelled row every text is `und`; null ids count as an empty text in the hash; repeated rows
are judged alike; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, remainder, staged, text_or_empty

FIT_ROWS = 1000
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
ROUNDS = 20
#: Longer runs of letters are judged in pieces of so many.
LONGEST = 64
#: Caches hold so many words, or fewer where there are many languages; chosen ids are broadcast up to so many.
_KEPT_WORDS, _KEPT_VALUES = 300_000, 6_000_000
_MOST_BROADCAST = 1_000_000


def _counted():
    def work(b: dict[str, list]) -> dict[str, list]:
        by: dict[str, Counter] = {}
        for lang, text in zip(b["lang"], b["text"], strict=True):
            count = by.setdefault(lang, Counter())
            for w in WORD.findall(text.lower()):
                w = f"\x02{w}\x03"
                for k in range(1, len(w)):
                    count[w[max(0, k - 2) : k + 1]] += 1
                    count[w[k]] += 1
                    if k > 1:
                        count[w[k - 1 : k + 1]] += 1
        rows = [(lang, g, n) for lang, c in by.items() for g, n in c.items()]
        return {"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}

    return work


def pieces(word: str) -> list[str | tuple[str, str]]:
    """A word as it is; a run of more than LONGEST letters as (letters before, letters) of consecutive pieces."""
    if len(word) <= LONGEST:
        return [word]
    x = f"\x02{word}\x03"
    return [(x[max(0, k - 2) : k], x[k : k + LONGEST]) for k in range(1, len(x), LONGEST)]


class Model:
    """Log-likelihood of a word or piece in each language, remembered for those seen."""

    def __init__(self, langs: list[str], counts: dict[str, dict[int, int]]):
        self.langs, self.counts = langs, counts  # by gram: number of a language -> count
        self.zero = np.zeros(len(langs))
        letters = [g for g in counts if len(g) == 1]
        self.total = sum(map(self._count, letters), self.zero)
        self.alphabet = max(1, len(letters))
        self.kept = max(1, min(_KEPT_WORDS, _KEPT_VALUES // max(1, len(langs))))
        self.grams: dict[str, np.ndarray] = {}
        self.ids: dict[str | tuple[str, str], int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.empty((0, len(langs)))

    def _count(self, gram: str) -> np.ndarray:
        seen = self.counts.get(gram)
        if not seen:
            return self.zero
        out = np.zeros(len(self.langs))
        out[list(seen)] = list(seen.values())
        return out

    def _letter(self, before: str, letter: str) -> np.ndarray:
        got = self.grams.get(before + letter)
        if got is None:
            c = self._count
            p = (c(letter) + 0.5) / (self.total + 0.5 * (self.alphabet + 1))
            for k in range(1, len(before) + 1):
                context = before[-k:]
                seen, both = c(context), c(context + letter)
                p = (both + 4 * p) / (np.maximum(seen, both) + 4)
            if len(self.grams) > self.kept:
                self.grams.clear()
            got = self.grams[before + letter] = np.log(p)
        return got

    def likelihoods(self, words: list[str | tuple[str, str]]) -> np.ndarray:
        ids = self.ids
        try:
            at = [ids[w] for w in words]
        except KeyError:
            if len(ids) > self.kept:
                ids.clear()
                self.rows, self.table, self.filled = [], self.table[:0], 0
            for w in dict.fromkeys(words):
                if w not in ids:
                    ids[w] = len(self.rows)
                    before, letters = ("\x02", f"{w}\x03") if isinstance(w, str) else w
                    x = before + letters
                    self.rows.append(sum((self._letter(x[max(0, k - 2) : k], x[k]) for k in range(len(before), len(x))), self.zero))
            at = [ids[w] for w in words]
        if len(self.table) < len(self.rows):
            grown = np.empty((2 * len(self.rows) + 1024, len(self.langs)))
            grown[: len(self.rows)] = self.rows
            self.table = grown
            self.filled = len(self.rows)
        elif self.filled < len(self.rows):
            self.table[self.filled : len(self.rows)] = self.rows[self.filled :]
            self.filled = len(self.rows)
        return self.table[at]

    filled = 0


def mixture(ll: np.ndarray) -> np.ndarray:
    """Proportions of the languages in a document, from its words' log-likelihoods (words by languages)."""
    n, k = ll.shape
    top = ll.max(1, keepdims=True)
    lik = np.exp(np.maximum(ll - top, -60))
    active = np.ones(k, bool)
    share = np.full(k, 1 / k)

    def settle(share: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(ROUNDS):
            joint = lik * share
            after = (joint / joint.sum(1, keepdims=True)).mean(0)
            done = np.abs(after - share).max() < 1e-4
            share = after
            if done:
                break
        return share, float(np.log((lik * share).sum(1) + 1e-300).sum())

    share, value = settle(share)
    cost = 0.5 * np.log(max(2, n))
    while active.sum() > 1:
        least = min(np.flatnonzero(active), key=lambda i: (share[i], -i))
        trial = np.where(active, share, 0.0)
        trial[least] = 0
        if trial.sum() <= 0:
            break
        trial, without = settle(trial / trial.sum())
        if without < value - cost:
            break
        share, value = trial, without
        active[least] = False
    return share


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows with a language whose crc32(doc_id) modulo 5 is not 0."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where("lang is not null").where(remainder("doc_id", 5) != 0)
    sizes = staged(rows.groupBy("lang").count(), "language-sizes")
    langs = sorted(r.lang for r in sizes.select("lang").collect())  # one row a language
    if not langs:
        return Model([], {})
    # a hash threshold for each language that about twice fit_rows rows pass, then exactly the first fit_rows
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    bounds = sizes.select("lang", (F.lit(2.0 * fit_rows) / F.col("count")).alias("bound"))
    near = rows.join(F.broadcast(bounds), "lang").where(unit <= F.col("bound")).select("doc_id", "lang").dropDuplicates(["doc_id"])
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(unit, "doc_id"))).where(F.col("k") <= fit_rows).select("doc_id")
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).where("lang is not null")
    # at most fit_rows ids a language
    sample = texts.join(F.broadcast(first) if fit_rows * len(langs) <= _MOST_BROADCAST else first, "doc_id")
    counts = map_rows(sample.select("lang", "text"), "lang string, gram string, n long", _counted).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # single letters, their pairs and triples within fit_rows texts a language
    index, table = {g: i for i, g in enumerate(langs)}, {}
    for r in staged(counts, "language-grams").where(F.length("gram") <= 3).collect():
        table.setdefault(r.gram, {})[index[r.lang]] = r.n
    return Model(langs, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    langs, counts = model.langs, model.counts

    def make():
        own = Model(langs, counts)

        def one(text: str) -> tuple[str, float]:
            words = WORD.findall(text.lower())
            if not langs or not any(c.isalpha() for w in words for c in w):  # a word may be all superscripts
                return UNDETERMINED, 0.0
            share = mixture(own.likelihoods([p for w in words for p in pieces(w)]))
            k = int(share.argmax())
            return langs[k], min(1.0, float(share[k]))

        def work(b: dict[str, list]) -> dict[str, list]:
            got = [one(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [g for g, _ in got], "score": [s for _, s in got]}

        return work

    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), text_or_empty().alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)
