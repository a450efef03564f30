"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

The field tags tokens as secret begin, inside or outside. Its features are a token's shape, those of its two
neighbours on either side, and of the file (whether it names credentials, whether it is more code than prose). Tags are
decoded by Viterbi. Its spans are added to the base ones where they do not overlap; base spans always stay.

The field is trained here, on windows of at most FIT_ROWS documents, chosen by a hash of the id (a parameter). Their
labels are the base spans; beside each window stands one in which a name that the base patterns know is replaced by one that
they do not, so that the field learns what a secret looks like and where it stands, not the patterns. Made-up lines show further
well-known forms: keys with a prefix of their own, short passwords after other names or in prose, credentials in
addresses, and lines that look alike but hold none. Every text is then decoded whole; spans of any length count.

Viterbi skips no case: with M a bound on what a path can gain by its other choices, a token whose score as outside
leads by more than M is outside on every best path, so that only stretches without such tokens are decoded.

Defined results: null and empty texts have no span; texts are scanned whole, however long; spans are in code points, ends
exclusive; of equally good paths the one with the first tag in the order begin, inside, outside is taken; repeated rows are
scanned each; null ids are carried along; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

FIT_ROWS, WINDOW = 2000, 12
TOKEN = re.compile(r"[\w+/.-]+|[^\w\s]")
B, I, O = range(3)

_KEYWORD = re.compile(r"pass(word|wd|phrase|code)?|pwd|secret|token|(api|access|private|signing)[_-]?key|credentials?|bearer|auth(orization)?|private|access", re.I)
_LINKS = {"is", "was", "ist", "est", "es", "war"}
_LETTERS = re.compile(r"[^\W\d_]+")
_MAIL_OR_NUMBER = re.compile(r"[\d.+/-]+$|[\w.+-]*\.(com|net|org|example)\b")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' spans."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- features -----------------------------------------------------------------------------

N_CLASSES = 12


def neighbour_class(token: str) -> int:
    """What neighbours see of a token."""
    if len(token) == 1 and not token.isalnum():
        return {"=": 1, ":": 2, '"': 3, "'": 3, "`": 3, "@": 9}.get(token, 4)
    if token.startswith("//"):
        return 11
    if token.lower() in _LINKS:
        return 10
    if _KEYWORD.fullmatch(token) or (_KEYWORD.search(token) and ("_" in token or "-" in token)):
        return 5
    if _LETTERS.fullmatch(token):
        return 6
    return 7 if token.isdigit() else 8


def shape(token: str) -> tuple[int, ...]:
    """Indices of the shape features of a token."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper, lower = sum(c.isupper() for c in token), sum(c.islower() for c in token)
    f = [min(n // 4, 9)]  # 0..9
    f.append(10 + (1 + min(3, int(4 * digits / n)) if digits else 0))  # 10..14
    kinds = (upper > 0) + (lower > 0) + (digits > 0)
    f.append(15 + kinds)  # 15..18
    changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:]))
    f.append(19 + min(5, changes // 2))  # 19..24
    if n >= 16 and re.fullmatch(r"[0-9a-f]+", token):
        f.append(25)
    if n >= 16 and digits and (upper or lower) and token.isascii():
        f.append(26)
    if _LETTERS.fullmatch(token):
        f.append(27)
    if _MAIL_OR_NUMBER.match(token):
        f.append(28)
    if not token.isascii():
        f.append(29)
    if re.match(r"(AKIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-)", token):
        f.append(30)
    if n == 1:
        f.append(31)
    if n >= 16 and len(set(token)) >= 10:
        f.append(32)
    if token == "=":
        f.append(33)
    if n >= 6 and digits and (upper or lower):
        f.append(MIXED)
    return tuple(f)


N_SHAPE, N_FILE, N_CONTEXT = 34, 4, 6
OFFSETS = (-2, -1, 1, 2)
MIXED = 34  # among the shapes of a token, but without a weight of its own


def contexts(classes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """0..5: no name of a credential in the three tokens before; one; one, and the token mixes letters and digits; the
    same for tokens between a colon and an at sign."""
    named = np.concatenate(([False] * 3, classes == 5))
    after = np.concatenate(([False], classes[:-1] == 2)) & np.concatenate((classes[1:] == 9, [False]))
    return (named[:-3] | named[1:-2] | named[2:-1]) * (1 + mixed) + 3 * after


def file_features(text: str) -> int:
    """0..3: names credentials; has more assignments than sentences."""
    low = text.lower()
    return (2 if any(n in low for n in NAMES) else 0) + (1 if low.count("=") + low.count("{") > low.count(". ") else 0)


class Weights:
    """Emission tables and transitions of the field."""

    def __init__(self):
        self.shape = np.zeros((N_SHAPE + 1, 3))
        self.near = np.zeros((len(OFFSETS), N_CLASSES + 1, 3))  # the last class: beyond the text
        self.file = np.zeros((N_FILE, 3))
        self.context = np.zeros((N_CONTEXT, 3))
        self.move = np.zeros((3, 3))


def _emissions(w: Weights, shapes: list[tuple[int, ...]], classes: np.ndarray, file: int) -> np.ndarray:
    e = np.array([w.shape[list(s)].sum(0) for s in shapes]).reshape(-1, 3) + w.file[file]
    padded = np.concatenate(([N_CLASSES] * 2, classes, [N_CLASSES] * 2))
    for k, d in enumerate(OFFSETS):
        e += w.near[k][padded[2 + d : 2 + d + len(classes)]]
    return e + w.context[contexts(classes, np.array([MIXED in s for s in shapes]))]


_FORBIDDEN = -1e9


def _moves(w: Weights) -> np.ndarray:
    t = w.move.copy()
    t[O, I] = _FORBIDDEN
    return t


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(windows: list[tuple[list[str], list[int], int]], epochs: int = 100, rate: float = 0.15, ridge: float = 1e-3) -> Weights:
    """Maximum conditional likelihood by Adam; all windows go through the forward and backward pass at once.

    The features of all tokens are one 0/1 matrix: shapes, then the classes of each neighbour, those of the file, contexts.
    """
    w = Weights()
    if not windows:
        w.shape[:, O] = 1.0
        return w
    n, longest = len(windows), max(len(t) for t, _, _ in windows)
    wide = len(OFFSETS) * (N_CLASSES + 1)
    mask, tags = np.zeros((n, longest), bool), np.full((n, longest), O)
    seen: dict[str, tuple[list[int], int]] = {}
    x = np.zeros((n, longest, N_SHAPE + wide + N_FILE + N_CONTEXT), np.float32)
    for i, (tokens, labels, file) in enumerate(windows):
        k = len(tokens)
        mask[i, :k] = True
        tags[i, :k] = labels
        for t in tokens:
            if t not in seen:
                seen[t] = (list(shape(t)), neighbour_class(t))
        classes = np.concatenate(([N_CLASSES] * 2, [seen[t][1] for t in tokens], [N_CLASSES] * 2))
        for at, t in enumerate(tokens):
            x[i, at, [f for f in seen[t][0] if f != MIXED]] = 1
        mixed = np.array([MIXED in seen[t][0] for t in tokens])
        x[i, np.arange(k), N_SHAPE + wide + N_FILE + contexts(classes[2:-2], mixed)] = 1
        for j, d in enumerate(OFFSETS):
            x[i, np.arange(k), N_SHAPE + j * (N_CLASSES + 1) + classes[2 + d : 2 + d + k]] = 1
        x[i, :k, N_SHAPE + wide + file] = 1
    flat = x.reshape(n * longest, -1)
    gold = np.eye(3)[tags] * mask[:, :, None]
    pairs = mask[:, 1:]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    weights = [np.zeros((x.shape[2], 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    start = np.array([0.0, _FORBIDDEN, 0.0])
    for step in range(1, epochs + 1):
        e = (flat @ weights[0].astype(np.float32)).astype(float).reshape(n, longest, 3)
        w.move = weights[1]
        move = _moves(w)
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            a = _logsum(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        z = _logsum(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            b = _logsum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0.0)
        marginal = np.exp(np.clip(alpha + beta - z[:, None, None], -50, 0)) * mask[:, :, None]
        joint = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.clip(joint, -50, 0)) * pairs[:, :, None, None]).sum((0, 1))
        g_move = gold_moves - expected
        g_move[O, I] = 0
        grads = [(flat.T @ (gold - marginal).reshape(-1, 3).astype(np.float32)).astype(float), g_move]
        for p, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / n - ridge * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w.shape[:N_SHAPE], w.near = weights[0][:N_SHAPE], weights[0][N_SHAPE : N_SHAPE + wide].reshape(len(OFFSETS), N_CLASSES + 1, 3).copy()
    w.file, w.context = weights[0][N_SHAPE + wide :][:N_FILE].copy(), weights[0][N_SHAPE + wide + N_FILE :].copy()
    w.move = weights[1]
    return w


def viterbi(e: np.ndarray, move: np.ndarray) -> list[int]:
    """The best path; a path cannot begin inside."""
    score, back = e[0] + np.array([0.0, _FORBIDDEN, 0.0]), []
    for row in e[1:]:
        both = score[:, None] + move
        back.append(both.argmax(0))
        score = both.max(0) + row
    at = int(score.argmax())
    path = [at]
    for row in reversed(back):
        at = int(row[at])
        path.append(at)
    return path[::-1]


class Tagger:
    """Decodes whole texts; tokens with the same features share an emission."""

    def __init__(self, w: Weights):
        self.w, self.move = w, _moves(w)
        self.kind: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.own: list[np.ndarray] = []
        self.classes: list[int] = []
        self.mixed: list[bool] = []
        near = np.abs(w.near).max((1, 2)).sum() + np.abs(w.context).max()
        allowed = np.abs(np.where(self.move > _FORBIDDEN / 2, self.move, 0)).max()
        #: Setting a token to outside splits the secret it was in: that changes up to four moves, and turns the
        #: next token from inside to begin, whose scores differ by at most what shape, file and neighbours give.
        self.gap = 4 * allowed + 2 * near + 2 * np.abs(w.file).max() + float((w.shape[:, I] - w.shape[:, B]).clip(0).sum())

    def _kind(self, token: str) -> int:
        key = (shape(token), neighbour_class(token))
        k = self.kinds.get(key)
        if k is None:
            k = self.kinds[key] = len(self.own)
            self.own.append(self.w.shape[list(key[0])].sum(0))
            self.classes.append(key[1])
            self.mixed.append(MIXED in key[0])
        if len(self.kind) > 400_000:
            self.kind.clear()
        self.kind[token] = k
        return k

    def tags(self, tokens: list[str], file: int) -> np.ndarray:
        try:
            kinds = np.fromiter(map(self.kind.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            get, make = self.kind.get, self._kind
            kinds = np.fromiter(((make(t) if (k := get(t)) is None else k) for t in tokens), np.int64, len(tokens))
        own, classes = np.array(self.own), np.array(self.classes)[kinds]
        e = own[kinds] + self.w.file[file]
        padded = np.concatenate(([N_CLASSES] * 2, classes, [N_CLASSES] * 2))
        for k, d in enumerate(OFFSETS):
            e += self.w.near[k][padded[2 + d : 2 + d + len(tokens)]]
        e += self.w.context[contexts(classes, np.array(self.mixed)[kinds])]
        out = np.full(len(tokens), O)
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.gap)
        if len(open_):
            # no secret can begin where beginning and all that could follow in the stretch lose to outside
            for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                a, b = max(0, part[0] - 1), min(len(tokens), part[-1] + 2)
                if (e[a:b, :2].max(1) > e[a:b, O] - self.worth).any():
                    out[a:b] = viterbi(e[a:b], self.move)
        return out

    @property
    def worth(self) -> float:
        """What the moves of a secret can add, at most, for each of its tokens, over staying outside."""
        m = self.move
        stay = m[O, O]
        return float(max(m[O, B] - stay, m[B, I] - stay, m[I, I] - stay, m[B, B] - stay, m[I, B] - stay, 0) + max(m[B, O] - stay, m[I, O] - stay, 0))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the tagged secrets."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        tags = self.tags(tokens, file_features(text))
        hits = np.flatnonzero(tags != O)
        if not len(hits):
            return []
        last, places = int(hits[-1]), []
        for k, m in enumerate(TOKEN.finditer(text)):
            places.append(m.span())
            if k == last:
                break
        out: list[tuple[int, int, int]] = []
        for k in hits.tolist():
            a, b = places[k]
            if tags[k] == I and out and k and tags[k - 1] != O:
                out[-1] = (out[-1][0], 3, b)
            else:
                out.append((a, 3, b))
        return out


# --- training windows ---------------------------------------------------------------------


#: Names of credentials that the base patterns do not know.
OTHER_NAMES = ("pwd", "pass", "passphrase", "passcode", "credential", "credentials", "auth", "access_key", "private_key", "Authorization", "db_pass", "signing-key")

Window = tuple[list[str], list[int], int]


def labelled_windows(text: str, plain: random.Random) -> list[Window]:
    """Windows around the base spans of a text, overlapping ones as one, those again with other names, and two elsewhere."""
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    tokens, starts = [m.group() for m in found], np.array([m.start() for m in found])
    tags, names = [O] * len(found), []
    for start, kind, end in base_spans(text):
        if kind == 0:
            m = ASSIGN.match(text, start)
            names.append(int(np.searchsorted(starts, start, "right")) - 1)
            start = m.start(2)
        before = O
        for k in range(int(np.searchsorted(starts, start)), len(found)):
            if found[k].end() > end:
                break
            tags[k] = before = I if before != O else B
    file = file_features(text)
    stretches: list[list[int]] = []
    for k in [k for k, t in enumerate(tags) if t != O]:
        if stretches and k - WINDOW <= stretches[-1][1]:
            stretches[-1][1] = k + WINDOW + 1
        else:
            stretches.append([max(0, k - WINDOW), k + WINDOW + 1])
    out = [(tokens[a:b], tags[a:b], file) for a, b in stretches]
    if names:
        for k in names:
            tokens[k] = plain.choice(OTHER_NAMES)
        file = file & 1  # the names that a file is known by went with them
        out += [(tokens[a:b], tags[a:b], file) for a, b in stretches if any(a <= k < b for k in names)]
    for _ in range(2):
        k = plain.randrange(len(found))
        a = max(0, k - WINDOW)
        if all(t == O for t in tags[a : k + WINDOW + 1]):
            out.append((tokens[a : k + WINDOW + 1], tags[a : k + WINDOW + 1], file))
    return out


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WORDS = "the a user set value name to of config file line see mail host port and for with item page needed below here none changed".split()


def made_up(n: int, plain: random.Random) -> list[Window]:
    """Lines of well-known credential forms, and lines that look alike but hold none."""

    def rand(k: int, letters: str = _ALNUM) -> str:
        return "".join(plain.choice(letters) for _ in range(k))

    def word() -> str:
        return plain.choice(_WORDS)

    def short() -> str:
        """Letters and digits of a password, often a word in disguise."""
        while True:
            if plain.random() < 0.5:
                value = rand(plain.randrange(7, 16))
            else:
                value = plain.choice([str.capitalize, str.lower])(word() + plain.choice([word(), ""])) + rand(plain.randrange(1, 4), "0123456789") + plain.choice(["", "", rand(3)])
            if len(value) >= 6 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                return value

    def long() -> str:
        return plain.choice([
            lambda: "ghp_" + rand(36), lambda: "sk_live_" + rand(24), lambda: "sk-" + rand(40), lambda: "AKIA" + rand(16, _ALNUM[:26] + _ALNUM[52:]),
            lambda: rand(40, "0123456789abcdef"), lambda: rand(32, "0123456789abcdef"), lambda: rand(40), lambda: "xoxb-" + rand(12, _ALNUM[52:]) + "-" + rand(24),
            lambda: "eyJ" + rand(30) + "." + "eyJ" + rand(50) + "." + rand(40), lambda: rand(64, _ALNUM + "+/"),
        ])()

    def harmless() -> str:
        return plain.choice([
            lambda: f"{word()}.{rand(2, '0123456789')}@mail{rand(1, '0123456789')}.example.com", lambda: ".".join(rand(3, "123456789") for _ in range(4)),
            lambda: rand(plain.randrange(4, 17), "0123456789"), lambda: "https://www.example.com/" + word(), word, lambda: "2021-03-04",
            lambda: "".join(word() for _ in range(5)), lambda: f"{word()}_{word()}", lambda: "".join(word().upper() for _ in range(5)),
        ])()

    known = ("password", "api_key", "token", "secret", "client_secret", "auth_token", "aws_access_key_id")
    host = lambda: plain.choice(["host", "db", "cache", "mail"]) + plain.choice(["", rand(1, "0123456789")]) + plain.choice(["", ".example.com"])
    out = []
    for _ in range(n):
        pre, quote, marked = "", plain.choice(['"', "'", "", ""]), True
        form = plain.random()
        if form < 0.3:  # a key by its own looks, named or not
            key = plain.choice([*known, *OTHER_NAMES, "", "", ""])
            pre, value = (key + plain.choice([" = ", ": ", "=", " := "]) if key else word() + " "), long()
        elif form < 0.5:  # a short one by what stands before it
            pre, value = plain.choice([*known, *OTHER_NAMES, *OTHER_NAMES]) + plain.choice([" = ", ": ", "=", " := ", " is ", " is ", " was ", " "]), short()
        elif form < 0.6:  # in an address
            pre, quote, value = plain.choice(["postgres", "https", "mysql", "redis", "amqp", "ftp"]) + "://" + word() + ":", "", short()
        elif form < 0.85:
            key = plain.choice([*known, *OTHER_NAMES, "", "", ""])
            pre, value, marked = (key + plain.choice([" = ", ": ", "=", " is ", " "]) if key else word() + plain.choice([" ", " = ", ": ", "=", " is "])), harmless(), False
        elif form < 0.95:  # names of things with digits, where no credential is named
            pre, value, marked = word() + plain.choice([" ", " = ", ": ", " is "]), plain.choice([word() + rand(2, "0123456789"), "v" + ".".join(rand(1, "123456789") for _ in range(3)), "sha256", "utf8", rand(3, "ABCDEF") + "-" + rand(4, "0123456789")]), False
        else:
            pre, quote, value, marked = plain.choice(["https", "postgres"]) + "://", "", host() + ":" + plain.choice(["8080", "5432", "443"]), False
        post = "@" + host() + "/" + word() if 0.5 <= form < 0.6 else "/" + word() if form >= 0.95 else quote
        text = " ".join(word() for _ in range(plain.randrange(1, 9))) + " " + pre + quote
        start, end = len(text), len(text) + len(value)
        text += value + post + " " + " ".join(word() for _ in range(plain.randrange(1, 9)))
        tokens, tags = [], []
        for m in TOKEN.finditer(text):
            inside = marked and m.start() >= start and m.end() <= end
            tags.append((I if tags and tags[-1] != O else B) if inside else O)
            tokens.append(m.group())
        out.append((tokens, tags, file_features(text)))
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Weights:
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            got = [w for i, t in zip(b["doc_id"], b["text"], strict=True) for w in labelled_windows(t, random.Random(i))]
            return {"tokens": [w[0] for w in got], "tags": [w[1] for w in got], "file": [w[2] for w in got]}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # fit_rows ids at most
    # the surroundings of the secrets of fit_rows documents; equal windows teach once
    got = map_rows(rows, "tokens array<string>, tags array<int>, file int", make).distinct().collect()
    windows = [w for r in got for w in _pieces((list(r.tokens), list(r.tags), r.file))]
    return train([*sorted(windows), *made_up(max(1200, len(windows) // 4), random.Random(1))])


def _pieces(window: Window, longest: int = 60) -> list[Window]:
    """Long stretches of close secrets in pieces, cut where a token is outside."""
    tokens, tags, file = window
    out, at = [], 0
    while at < len(tokens):
        end = at + longest
        while end < len(tokens) and tags[end] == I:
            end += 1
        out.append((tokens[at:end], tags[at:end], file))
        at = end
    return out


def scan(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""

    def make():
        tagger = Tagger(weights)

        def one(text: str) -> tuple:
            base = base_spans(text)
            added = [s for s in tagger.spans(text) if not any(s[0] < b and a < s[2] for a, _, b in base)]
            count = [sum(k == i for _, k, _ in base) for i in range(3)]
            return *count, len(added), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + added))

        def work(b: dict[str, list]) -> dict[str, list]:
            got = [one(t) for t in b["text"]]
            names = ("n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")
            return {"doc_id": b["doc_id"]} | {n: [g[i] for g in got] for i, n in enumerate(names)}

        return work

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return map_rows(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string", make)
