"""Toxicity by a weighted finite-state pattern grammar.

Transducers read the tokens of a clause: insults and threats carry weight, and machines that remember targets, negations, words
of speech and quotation marks say what is in force at each of them. Their composition (`compose`) is one deterministic
machine; targets are also looked for after the trigger, by the same memory run from the end of the clause. A trigger and
what is in force make a pattern (a directed insult, a negated one, a threat with its object, ..), whose gain multiplies
the trigger's weight; a threat without a target is no match. A document is scored by what its matched clauses emit.
A clause is what lies between stops; a quotation that a word of speech opened goes on past stops, to its end or that of the line.

The insult acceptors are induced from labelled rows: whole words and word beginnings (3 to 8 letters) whose
log-likelihood ratio between toxic and other documents exceeds that of chance among all candidates, weighted by
their log odds ratio; a beginning whose evidence is that of a longer one gives way to it. A word takes the weight of its
most specific acceptor, a threat the median weight of insults. A logistic curve over the clause features, and the gains,
from where they are set at first, are fitted on the same rows. Labels are read for rows of `FIT_ROWS` at most, chosen by a
hash of the id; that bound is a parameter, everything else covers all rows.

Defined results: null and empty texts get the score of a document without matched clauses; texts are read whole, however
long; rows without label, with a null label or a null doc_id teach nothing; of several labels of one id the toxic one counts;
without toxic or without other labels every score is (toxic + 0.5) / (labelled + 2); of clauses that match by the same words
the heaviest counts, and of equal words of a clause the heaviest; repeated rows are scored alike; an empty table gives an
empty table; further columns, whatever their names, are ignored by `score_toxicity` and carried along by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, logistic, map_rows, remainder, scope, staged, text_or_empty
from .exact_dedup import docs_column

FIT_ROWS = 20_000
LEAST_ODDS, LEAST_DOCS = 3.0, 4
#: A ratio of 2 log n is what the best of n candidates reaches by chance; acceptors exceed it by this much.
CHANCE = 2.0
SHORTEST, LONGEST = 3, 8
#: A beginning gives way to a longer one that has this share of its toxic documents.
SAME_EVIDENCE = 0.8

# Word lists of the hand-written transducers. Threats are beginnings of verbs, that may take one of the endings.
THREATS = "kill hurt destroy murder stab stabb shoot burn hang tuer tue tué frapp töt töte umbring schlag erschlag mata matar golpe golpea".split()
ENDINGS = {"", *"s d ed ing er ers e es t st en et est te ten r rai ra ras ré rá ront ai as a an o ez ons ent é ée és rte".split()}
TARGETS = "you your you're u du dich dir ihr euch tu te toi vous usted tú vosotros".split()
OTHERS = "he she him her they them people those".split()
NEGATIONS = (
    "not no never isn't aren't wasn't weren't don't doesn't didn't can't cannot couldn't won't wouldn't shouldn't haven't hasn't hadn't ain't neither nor "
    "kein keine keinen nicht nie pas jamais nunca jamás"
).split()
REPORTS = "said says say told called calls wrote writes reported quoted claimed dit sagt sagte dijo dice".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n\"“”«»]")
OTHER, STOP, LINE, INSULT, THREAT, TARGET, THIRD, NEGATION, REPORT, QUOTE = range(10)
CLASSES = 10
_FIXED = (
    {w: k for k, words in ((TARGET, TARGETS), (THIRD, OTHERS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
    | dict.fromkeys(".!?;", STOP) | {"\n": LINE} | dict.fromkeys("\"“”«»", QUOTE)
)

#: What can be in force at a trigger.
DIRECTED, NAMED, DENIED, TOLD, QUOTED = 1, 2, 4, 8, 16


@dataclass
class Transducer:
    """start state, moves[state][class] to a state, and marks[state]: what is in force there."""

    start: int
    moves: list[list[int]]
    marks: list[int]


def _memory(triggers: Iterable[int], span: int, mark: int) -> Transducer:
    """Remembers classes for the span tokens after them, to the end of the clause at most."""
    moves = [[span + 1 if c in triggers else 0 if c in (STOP, LINE) else max(0, s - 1) for c in range(CLASSES)] for s in range(span + 2)]
    return Transducer(0, moves, [mark if s else 0 for s in range(span + 2)])


def _quotation() -> Transducer:
    """Between quotation marks, after a word of speech in the clause before them; stops do not end it, lines do."""
    moves = [
        [1 if c == REPORT else 0 for c in range(CLASSES)],
        [2 if c == QUOTE else 0 if c in (STOP, LINE) else 1 for c in range(CLASSES)],
        [1 if c == QUOTE else 0 if c == LINE else 2 for c in range(CLASSES)],
    ]
    return Transducer(0, moves, [0, 0, QUOTED])


def compose(*parts: Transducer) -> Transducer:
    """The product machine; what is in force in any part is in force in it."""
    states = {tuple(p.start for p in parts): 0}
    moves: list[list[int]] = []
    queue = list(states)
    for state in queue:
        row = []
        for c in range(CLASSES):
            after = tuple(p.moves[s][c] for p, s in zip(parts, state, strict=True))
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            row.append(states[after])
        moves.append(row)
    return Transducer(0, moves, [sum(p.marks[s] for p, s in zip(parts, state, strict=True)) for state in queue])


_BEFORE = (_memory((TARGET,), 6, DIRECTED), _memory((THIRD,), 6, NAMED), _memory((NEGATION,), 3, DENIED), _memory((REPORT,), 2, TOLD))
GRAMMAR = compose(*_BEFORE, _quotation())
#: Run from the end of a clause. Whom a threat is aimed at stands near it, or is named after it.
AHEAD = compose(_memory((TARGET,), 6, DIRECTED), _memory((THIRD,), 3, NAMED))

#: Gains at first: of an insult with a target in its clause and without, of a threat, and what the others multiply by.
GAINS = {"aimed": 1.25, "bare": 1.0, "threat": 1.0, "denied": 0.4, "told": 0.8, "quoted": 0.5}
_STEPS, _STRAY = (0.64, 0.8, 1.25, 1.5625), 2.0


def gain(kind: int, marks: int, gains: dict[str, float]) -> float:
    """What the pattern of a trigger multiplies its weight by."""
    if kind == INSULT:
        g = gains["aimed" if marks & (DIRECTED | NAMED) else "bare"]
    else:
        g = gains["threat"] if marks & (DIRECTED | NAMED) else 0.0
    for mark, name in ((DENIED, "denied"), (TOLD, "told"), (QUOTED, "quoted")):
        if marks & mark:
            g *= gains[name]
    return g


Clause = list[tuple[str, float, int, int]]  # triggers: word, weight, class, what is in force
N_FEATURES = 4


@dataclass
class Model:
    """Acceptors (exact words, and beginnings) with weights, gains, and the curve over clause features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=lambda: dict(GAINS))
    mean: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * N_FEATURES)
    curve: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    bias: float = 0.0

    @property
    def threat(self) -> float:
        return median([*self.words.values(), *self.stems.values()] or [5.0])


def is_threat(word: str) -> bool:
    return any(word.startswith(t) and word[len(t) :] in ENDINGS for t in THREATS)


class Matcher(dict):
    """Class of a token, worked out once a word; weights of insults and threats in `weight`."""

    def __init__(self, model: Model):
        super().__init__(_FIXED)
        self.model, self.weight, self.threat = model, {}, model.threat

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(_FIXED)
        m, kind = self.model, OTHER
        w = m.words.get(word)
        for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if w is None:
                w = m.stems.get(word[:k])
        if w is not None:
            kind, self.weight[word] = INSULT, w
        elif is_threat(word):
            kind, self.weight[word] = THREAT, self.threat
        self[word] = kind
        return kind

    def matches(self, text: str) -> list[Clause]:
        """The triggers of each clause that has any."""
        tokens = TOKEN.findall(text.lower().replace("’", "'"))
        kinds = bytes(map(self.__getitem__, tokens))
        out: list[Clause] = []
        at = -1
        for m in _HIT.finditer(kinds):
            if m.start() < at:
                continue  # in a clause that was read
            line = kinds.rfind(LINE, 0, m.start()) + 1
            begin = max(line, kinds.rfind(STOP, line, m.start()) + 1)
            end = _END.search(kinds, m.start())
            at = end.start() if end else len(kinds)
            state = GRAMMAR.start
            # a quotation may be open where the clause begins
            for k in range(line if kinds.find(QUOTE, line, begin) >= 0 else begin, begin):
                state = GRAMMAR.moves[state][kinds[k]]
            ahead, later = AHEAD.start, {}
            for k in range(at - 1, begin - 1, -1):
                ahead = AHEAD.moves[ahead][kinds[k]]
                if kinds[k] == INSULT or kinds[k] == THREAT:
                    later[k] = AHEAD.marks[ahead]
            clause: Clause = []
            for k in range(begin, at):
                state = GRAMMAR.moves[state][kinds[k]]
                if k in later:
                    marks = GRAMMAR.marks[state]
                    if kinds[k] == THREAT:
                        marks &= ~NAMED  # who stands before a threat may be the one who makes it
                    clause.append((tokens[k], self.weight[tokens[k]], kinds[k], marks | later[k]))
            out.append(clause)
        return out

    def clauses(self, text: str) -> list[float]:
        """What each matched clause emits; a word that a clause repeats counts once, at its most."""
        return [sum(e.values()) for c in self.matches(text) if (e := emitted(c, self.model.gains))]

    def features(self, text: str) -> list[float]:
        return features(self.matches(text), len(text), self.model.gains)


_HIT = re.compile(bytes([91, INSULT, THREAT, 93]), re.DOTALL)  # either class
_END = re.compile(bytes([91, STOP, LINE, 93]), re.DOTALL)


def emitted(clause: Clause, gains: dict[str, float]) -> dict[str, float]:
    """The greatest emission of each word of a clause; nothing for words whose pattern is no match."""
    out: dict[str, float] = {}
    for word, weight, kind, marks in clause:
        w = weight * gain(kind, marks, gains)
        if w > out.get(word, 0.0):
            out[word] = w
    return out


def features(found: list[Clause], length: int, gains: dict[str, float]) -> list[float]:
    """Of clauses that match by the same words the heaviest counts."""
    by: dict[frozenset, float] = {}
    for c in found:
        e = emitted(c, gains)
        if e:
            words = frozenset(e)
            by[words] = max(by.get(words, 0.0), sum(e.values()))
    best = max(by.values(), default=0.0)
    return [best, math.log1p(sum(by.values())), float(sum(x > 3 for x in by.values()) > 1), math.log1p(best / (1 + length / 2000))]


def _terms(text: str) -> set[str]:
    words = set(TOKEN.findall(text.lower().replace("’", "'")))
    out = {"=" + w for w in words if len(w) > 1}
    for k in range(SHORTEST, LONGEST + 1):
        out.update(w[:k] for w in words if len(w) >= k)
    return out


def _count_terms():
    def work(b: dict[str, list]) -> dict[str, list]:
        by = (Counter(), Counter())
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            by[toxic].update(_terms(text))
        terms = list(by[0].keys() | by[1].keys())
        return {"term": terms, "p": [by[1][t] for t in terms], "n": [by[0][t] for t in terms]}

    return work


def _specific(kept: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of the terms, without beginnings whose toxic documents are those of a longer one."""
    longer: dict[str, int] = {}
    for t, (p, _) in kept.items():
        if t[0] != "=":
            for k in range(SHORTEST, len(t)):
                longer[t[:k]] = max(longer.get(t[:k], 0), p)
    return {t: w for t, (p, w) in kept.items() if t[0] == "=" or longer.get(t, 0) < SAME_EVIDENCE * p}


def _likelihood(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w, bias = logistic((x - mean) / scale, y, signed=False)
    z = np.clip(((x - mean) / scale) @ w + bias, -30, 30)
    return float((y * z - np.logaddexp(0, z)).sum()), (mean.tolist(), scale.tolist(), w.tolist(), bias)


def _fit_curve(model: Model, found: list[tuple[list[Clause], int]], y: np.ndarray) -> None:
    """The curve, and gains by coordinate ascent on the likelihood; gains stray from where they are set at a cost."""
    held = {i: f for i, f in enumerate(found) if f[0]}
    plain = np.zeros((len(found), N_FEATURES))

    def value(gains: dict[str, float]) -> tuple[float, tuple]:
        x = plain.copy()
        for i, (clauses, length) in held.items():
            x[i] = features(clauses, length, gains)
        got, curve = _likelihood(x, y)
        return got - _STRAY * sum(math.log(g / GAINS[k]) ** 2 for k, g in gains.items()), curve

    best, curve = value(model.gains)
    for name in GAINS:
        for step in _STEPS:
            trial = model.gains | {name: GAINS[name] * step}
            got, other = value(trial)
            if got > best + 1e-6:
                best, curve, model.gains = got, other, trial
    model.mean, model.scale, model.curve, model.bias = curve


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows whose crc32(doc_id) modulo 5 is not 0."""
    with scope(docs.sparkSession):
        return _fit(docs, labels, fit_rows)


def _fit(docs: DataFrame, labels: DataFrame, fit_rows: int) -> Model:
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows rows of two numbers
    rows = staged(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-fit")
    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    model = Model()
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 2)
        model.bias = math.log(share / (1 - share))
        return model
    counts = map_rows(rows, "term string, p long, n long", _count_terms).groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    odds = F.log((p + 0.5) / (pos + 1.0)) - F.log((n + 0.5) / (neg + 1.0))
    xlog = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    seen = p + n
    ratio = 2 * (xlog(p, seen * (pos / (pos + neg))) + xlog(n, seen * (neg / (pos + neg))))
    counts = staged(counts.where(F.col("p") >= LEAST_DOCS), "toxicity-terms")
    candidates = counts.count()
    kept = counts.select("term", "p", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= CHANCE + 2 * math.log(max(2, candidates))))
    # terms of LEAST_DOCS of fit_rows documents
    for t, weight in sorted(_specific({r.term: (r.p, r.odds) for r in kept.collect()}).items()):
        if t[0] == "=":
            model.words[t[1:]] = weight
        else:
            model.stems[t] = weight

    def found():
        matcher = Matcher(model)

        def work(b: dict[str, list]) -> dict[str, list]:
            got = [matcher.matches(t) for t in b["text"]]
            return {
                "toxic": b["toxic"], "length": list(map(len, b["text"])), "sizes": [list(map(len, g)) for g in got],
                "words": [[t[0] for c in g for t in c] for g in got], "weights": [[t[1] for c in g for t in c] for g in got],
                "kinds": [[t[2] for c in g for t in c] for g in got], "marks": [[t[3] for c in g for t in c] for g in got],
            }

        return work

    # the triggers of at most fit_rows documents
    schema = "toxic int, length int, sizes array<int>, words array<string>, weights array<double>, kinds array<int>, marks array<int>"
    rows_found = []
    for r in map_rows(rows, schema, found).collect():
        triggers = iter(zip(r.words, r.weights, r.kinds, r.marks, strict=True))
        rows_found.append((r.toxic, r.length, [[next(triggers) for _ in range(k)] for k in r.sizes]))
    rows_found.sort()
    _fit_curve(model, [(clauses, length) for _, length, clauses in rows_found], np.array([t for t, _, _ in rows_found], float))
    return model


def _scores(model: Model):
    cache: dict[str, Matcher] = {}
    mean, scale, curve = np.array(model.mean), np.array(model.scale), np.array(model.curve)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        matcher = cache.setdefault("m", Matcher(model))
        x = np.array([matcher.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ curve + model.bias, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), _scores(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score under 0.5, with all their columns."""
    name = fresh(docs, "score")
    return docs.withColumn(name, _scores(model)(text_or_empty())).where(F.col(name) < 0.5).select(*[docs_column(docs, c) for c in docs.columns])
