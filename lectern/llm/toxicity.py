"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist for documents only. Words and beginnings of words that stand in far more toxic than clean training
documents become a lexicon, which labels the tokens of toxic training documents. A chain with two states (clean,
toxic) is fitted to these by gradient ascent on the exact log-likelihood; its features are the lexicon entry (the
word, else its longest listed beginning), being in the lexicon at all, and the state before. Forward and backward messages give each token's marginal; a logistic
function of their largest value and of their sum, fitted on the training documents, is the document's score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit reads at most so many labelled rows of each kind, the first by a hash of their id, and of these only
#: texts up to so many bytes. Scoring has no such bounds.
TOXIC_ROWS, CLEAN_ROWS, FIT_BYTES = 3000, 4000, 100_000
#: A lexicon entry: found in this share of toxic training documents (and in MIN_DOCS), so many times the share of clean ones.
MIN_SHARE, MIN_DOCS, MIN_LIFT = 0.02, 6, 12.0
#: The same for beginnings, which other words share by chance.
MIN_LIFT_BEGINNING = 20.0
#: Lengths of beginnings, which are entries like words, marked with a trailing "*". A beginning longer than
#: another entry's is only listed if that one isn't.
BEGINNINGS = (5, 6, 7, 8)
#: Tokens of a training sequence, and at most so many sequences each with and without lexicon words, the first by a hash of
#: their place, so that all texts of the sample are drawn from.
SEQUENCE, SEQUENCES = 48, 3000
STEPS, RATE, PENALTY = 200, 0.2, 1e-3
THRESHOLD = 0.5
_TOKEN = re.compile(r"\w+")


HEAD = min(BEGINNINGS)


def entry_of(token: str, entries: dict) -> str | None:
    """The entry that a token falls under, if any."""
    if token in entries:
        return token
    return next((b for n in reversed(BEGINNINGS) if len(token) >= n and (b := token[:n] + "*") in entries), None)


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class Model:
    """Emissions of the toxic state over the clean one, by word; transitions; and the document's logistic function."""

    words: dict[str, float]
    heads: frozenset[str]
    background: float
    start: float
    move: tuple[tuple[float, float], tuple[float, float]]
    weights: tuple[float, float, float]

    def marginals(self, tokens: list[str]) -> np.ndarray:
        """The probability that a token is toxic, for each."""
        n = len(tokens)
        if not n:
            return np.empty(0)
        words, heads, rest = self.words, self.heads, self.background
        weight = np.exp(np.array([words.get(entry_of(t, words), rest) if t[:HEAD] in heads else rest for t in tokens]))
        (a, b), (c, d) = np.exp(np.array(self.move)).tolist()
        return _marginals(weight, float(np.exp(self.start)), a, b, c, d)

    def score(self, tokens: list[str], quiet: dict[int, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
        heads = self.heads
        if quiet is not None and not any(t[:HEAD] in heads for t in tokens):
            p = self._quiet(len(tokens), quiet)
        else:
            p = self.marginals(tokens)
        x = _features(p)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, x), -30, 30)))), p

    def _quiet(self, n: int, kept: dict[int, np.ndarray]) -> np.ndarray:
        """Marginals of n words without features. Messages along such a chain depend on the way from its ends alone."""
        size = 64
        while size < n:
            size *= 2
        if size not in kept:
            (a, b), (c, d) = np.exp(np.array(self.move)).tolist()
            w = float(np.exp(self.background))
            kept[size] = _messages(np.full(size, w), float(np.exp(self.start)), a, b, c, d)
        forward, backward = kept[size]
        x = forward[:n] * backward[size - n :]
        return x[:, 1] / x.sum(axis=1) if n else np.empty(0)


def _messages(weight: np.ndarray, start: float, a: float, b: float, c: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages; weight is that of the toxic state, from clean: a, b, from toxic: c, d."""
    w = weight.tolist()
    n = len(w)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    x, y = 1.0, start * w[0]
    for i in range(n):
        if i:
            x, y = x * a + y * c, (x * b + y * d) * w[i]
        s = x + y
        x, y = x / s, y / s
        forward[i] = x, y
    x = y = 1.0
    for i in range(n - 2, -1, -1):
        y *= w[i + 1]
        x, y = a * x + b * y, c * x + d * y
        s = x + y
        x, y = x / s, y / s
        backward[i] = x, y
    return forward, backward


def _marginals(weight: np.ndarray, start: float, a: float, b: float, c: float, d: float) -> np.ndarray:
    forward, backward = _messages(weight, start, a, b, c, d)
    x = forward * backward
    return x[:, 1] / x.sum(axis=1)


def _features(p: np.ndarray) -> np.ndarray:
    return np.array([1.0, p.max(), np.log1p(p[p > 0.2].sum())]) if len(p) else np.array([1.0, 0.0, 0.0])


def _entries(text: str) -> set[str]:
    words = set(tokens_of(text))
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) >= n}


def lexicon(toxic: list[str], clean: list[str]) -> list[str]:
    """Words and beginnings far more frequent in toxic texts than in clean ones, by counts of different texts."""
    toxic, clean = list(dict.fromkeys(toxic)), list(dict.fromkeys(clean))
    counts: dict[str, int] = {}
    for text in toxic:
        for w in _entries(text):
            counts[w] = counts.get(w, 0) + 1
    least = max(MIN_DOCS, MIN_SHARE * len(toxic))
    counts = {w: n for w, n in counts.items() if n >= least}
    other = dict.fromkeys(counts, 0)
    for text in clean:
        for w in _entries(text):
            if w in other:
                other[w] += 1
    lift = lambda w: (counts[w] / len(toxic)) / ((other[w] + 0.5) / (len(clean) + 1))
    found = {w for w in counts if lift(w) >= (MIN_LIFT_BEGINNING if w[-1] == "*" else MIN_LIFT)}
    return sorted(w for w in found if not (w[-1] == "*" and any(w[:n] + "*" in found for n in BEGINNINGS if n < len(w) - 1)))


def _fit_chain(seen: np.ndarray, labels: np.ndarray, mask: np.ndarray, n_words: int) -> np.ndarray:
    """Gradient ascent on the likelihood of label sequences. seen: word number + 1 or 0, padded where mask is 0.

    Parameters: background, start, to toxic, stay toxic, leave toxic, lexicon, words.
    """
    m, length = seen.shape
    w, first, second = np.zeros(6 + n_words), 0.0, 0.0
    gold = np.zeros_like(w)
    on = (labels == 1) & mask
    gold[0], gold[1] = (on & (seen == 0)).sum(), on[:, 0].sum()
    pair = mask[:, 1:]
    gold[2], gold[3], gold[4] = ((labels[:, :-1] == 0) & on[:, 1:] & pair).sum(), ((labels[:, :-1] == 1) & on[:, 1:] & pair).sum(), ((labels[:, :-1] == 1) & (labels[:, 1:] == 0) & pair).sum()
    gold[5] = (on & (seen > 0)).sum()
    gold[6:] = np.bincount(seen[on & (seen > 0)] - 1, minlength=n_words)
    for step in range(1, STEPS + 1):
        table = np.concatenate(([w[0]], w[5] + w[6:]))
        emit = np.exp(table[seen])
        a, b, c, d = 1.0, np.exp(w[2]), np.exp(w[4]), np.exp(w[3])
        f = np.empty((m, length, 2))
        x, y = np.ones(m), np.exp(w[1]) * emit[:, 0]
        for t in range(length):
            if t:
                x, y = x * a + y * c, (x * b + y * d) * emit[:, t]
            s = x + y
            x, y = x / s, y / s
            f[:, t, 0], f[:, t, 1] = x, y
        expected = np.zeros_like(w)
        x, y = np.ones(m), np.ones(m)
        for t in range(length - 1, -1, -1):
            live = mask[:, t]
            total = f[:, t, 0] * x + f[:, t, 1] * y
            p = np.where(live, f[:, t, 1] * y / total, 0.0)
            expected[0] += p[seen[:, t] == 0].sum()
            known = seen[:, t] > 0
            expected[5] += p[known].sum()
            expected[6:] += np.bincount(seen[known, t] - 1, weights=p[known], minlength=n_words)
            if t == 0:
                expected[1] = p.sum()
                break
            y1 = y * emit[:, t]
            g0, g1 = f[:, t - 1, 0], f[:, t - 1, 1]
            parts = [g0 * a * x, g0 * b * y1, g1 * c * x, g1 * d * y1]
            z = sum(parts)
            expected[2] += np.where(live, parts[1] / z, 0).sum()
            expected[3] += np.where(live, parts[3] / z, 0).sum()
            expected[4] += np.where(live, parts[2] / z, 0).sum()
            u, v = a * x + b * y1, c * x + d * y1
            s = u + v
            x, y = np.where(live, u / s, 1.0), np.where(live, v / s, 1.0)
        grad = (gold - expected) / m - PENALTY * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Penalized logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from whole texts and their labels. Without both kinds of labels it never says toxic. Tokens of one text at a time are held."""
    y = np.array(labels)
    toxic, clean = ([t for t, k in zip(texts, labels, strict=True) if k == want] for want in (1, 0))
    words = lexicon(toxic, clean) if toxic and clean else []
    if not words:
        return Model({}, frozenset(), -5.0, 0.0, ((0.0, 0.0), (0.0, 0.0)), (-3.0, 0.0, 0.0))
    number = {w: i + 1 for i, w in enumerate(words)}
    marked: list[tuple[int, int, int, list[int], bool]] = []
    plain: list[tuple[int, int, int, list[int], bool]] = []
    for n, (text, k) in enumerate(zip(texts, labels, strict=True)):
        own = [number.get(entry_of(t, number), 0) for t in tokens_of(text)]
        for i in range(0, len(own), SEQUENCE):
            piece = own[i : i + SEQUENCE]
            kind = marked if any(piece) else plain
            kind.append((xxhash.xxh64_intdigest(f"{n}:{i}"), n, i, piece, k == 1))
            if len(kind) >= 2 * SEQUENCES:
                kind[:] = sorted(kind)[:SEQUENCES]
    pieces = [x[3:] for kind in (marked, plain) for x in sorted(kind)[:SEQUENCES]]
    seen, labs, mask = (np.zeros((len(pieces), SEQUENCE), kind) for kind in (np.int64, np.int8, bool))
    for i, (piece, bad) in enumerate(pieces):
        seen[i, : len(piece)] = piece
        mask[i, : len(piece)] = True
        labs[i] = (seen[i] > 0) & bad
    w = _fit_chain(seen, labs, mask, len(words))
    emissions = {x: float(w[5] + w[5 + i]) for x, i in number.items()}
    model = Model(emissions, frozenset(x.rstrip("*")[:HEAD] for x in words), float(w[0]), float(w[1]), ((0.0, float(w[2])), (float(w[4]), float(w[3]))), (0.0, 0.0, 0.0))
    quiet: dict = {}
    model.weights = _fit_logistic(np.array([_features(model.score(tokens_of(t), quiet)[1]) for t in texts]), y)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a document's labels are kept from the fit."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled documents that aren't held out: a sample with the bounds above, drawn by hash, read to the driver.
    A document with several labels is toxic if one says so; null labels count as none."""
    known = labels.filter(~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL AND __id IS NOT NULL")
    order = [F.xxhash64("__id"), F.col("__id")]
    drawn = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).union(known.filter("toxic <> 1").orderBy(*order).limit(CLEAN_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.octet_length(text) <= FIT_BYTES).select(F.col(id_col).alias("__doc"), text.alias("text"))
    rows = rows.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).groupBy("__doc").agg(F.min(F.struct("text", "toxic")).alias("r")).select("__doc", "r.*")
    sample = sorted(rows.collect(), key=lambda r: r["__doc"])
    return fit([r["text"] for r in sample], [int(r["toxic"] == 1) for r in sample])


def scores(model: Model):
    """A UDF: the score of each text."""

    def run(texts: pd.Series) -> pd.Series:
        quiet: dict = {}
        return pd.Series([model.score(tokens_of(t or ""), quiet)[0] for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without tokens. Texts are whole. Equal texts get equal scores. Ids may
    repeat or be null (then not held out). An empty table gives an empty result. Extra columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scores(model)(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: start and end (characters) and probability of each run of tokens that are likelier toxic than not."""

    def one(text: str) -> list[tuple[int, int, float]]:
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = list(_TOKEN.finditer(low))
        out: list[tuple[int, int, float]] = []
        last = -2
        for i, (m, p) in enumerate(zip(found, model.marginals([m[0] for m in found]).tolist(), strict=True)):
            if p >= THRESHOLD:
                if i == last + 1:
                    out[-1] = (out[-1][0], m.end(), max(out[-1][2], p))
                else:
                    out.append((m.start(), m.end(), p))
                last = i
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "p": p} for a, b, p in one(t or "")] for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "array<struct<start:int,end:int,p:double>>")(F.col(text_col)).alias("spans"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns. Null and empty texts are judged as texts without tokens; repeated
    rows stay or go together; null ids and other columns don't matter; an empty table gives an empty result."""
    return docs.filter(scores(model)(F.col(text_col)) < THRESHOLD)
