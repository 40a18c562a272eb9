"""Toxicity by a linear-chain conditional random field over words.

A two-state chain (plain, toxic) tags each word of a text. Training takes at most MAX_ROWS of the labelled rows
given, drawn by a seeded hash, so the model costs the same at any corpus size. Labels mark documents, so token
labels come first: a word is toxic in a document labelled so if its document frequency there is far above that in
the others (signed root of the likelihood ratio, of at least MIN_Z and more the more words there are). All such
words get weights. Words are counted where the rows are; what reaches the driver is the weighted words, and of
each row their order and the lengths of the gaps between them. The field is fitted to these labelled tokens by
quasi-Newton ascent on the regularised log likelihood, weights, base and transitions together, until its
gradient vanishes. Words without a weight of their own share one potential, so a stretch of them is one power
of the transition matrix, and forward-backward runs over the weighted words only, whatever the text's length;
its marginals and expected transitions are exact. A document's score is a logistic of the strongest
marginal and of the logarithm of their sum, as of a count; spans whose marginal is at least
one half are its offending offsets (code points).

Rows: a null or empty text is scored as no words are. Rows are scored one by one, repeated rows alike.
Empty tables give empty results; without labelled rows of both kinds the score is the labels' mean, or 0.
Texts are scanned whole. Input columns named as results are replaced; others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, from_text, materialize

#: Labelled rows that the model is made from at most, and the least z of toxic words.
MAX_ROWS, MIN_Z = 4000, 3.0
#: A word: letters, digits, apostrophes within.
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: Precision of the normal prior of each log potential, the gradient at which the ascent ends, and its steps at most.
PRIOR, GRADIENT, MOST_STEPS = 1.0, 1e-3, 500


def words(text: str | None) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]


@dataclass
class Field:
    """Weights: of toxic against plain for each known word (other words: base), and log potentials of transitions."""

    weight: dict[str, float] = field(default_factory=dict)
    base: float = -4.0
    step: list[list[float]] = field(default_factory=lambda: [[0.0, -1.0], [-1.0, 0.0]])
    score_weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    constant: float | None = None

    def __post_init__(self):
        self._eig = None

    def known(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[int], int]:
        """A text's weighted words, the plain words before each of them and after the last, and the number of words."""
        found, gaps, last, n = [], [], -1, 0
        if not text or self.weight.keys().isdisjoint(WORD.findall(text.lower())):
            return [], [], 0
        for n, m in enumerate(WORD.finditer(text or ""), 1):
            w = m[0].lower()
            if w in self.weight:
                found.append((w, m.start(), m.end()))
                gaps.append(n - 2 - last)
                last = n - 1
        return found, [*gaps, n - 1 - last], n

    def powers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of one plain word's matrix: a transition, then the potential of a word without weight."""
        a = np.exp(np.array(self.step)) * np.exp([0.0, self.base])[None, :]
        values, vectors = np.linalg.eig(a)
        return values.real, vectors.real, np.linalg.inv(vectors).real

    def marginals(self, found: list[str], gaps: list[int]) -> np.ndarray:
        """P(toxic) at each weighted word.

        Messages are scaled at each step; a gap is a power of one matrix.
        """
        values, vectors, inverse = self._eig or self.powers()
        top = np.abs(values).max()
        step = np.exp(np.array(self.step))
        n = len(found)
        emit = np.array([[1.0, math.exp(self.base + self.weight[w])] for w in found])

        def gap(k: int) -> np.ndarray:
            return vectors @ np.diag((values / top) ** k) @ inverse

        first = np.array([1.0, 1.0])
        forward = []
        for i in range(n):
            if i == 0:
                if gaps[0]:
                    message = np.array([1.0, math.exp(self.base)])
                    message = message @ gap(gaps[0] - 1) @ step
                else:
                    message = first
            else:
                message = forward[-1] @ gap(gaps[i]) @ step
            message = message * emit[i]
            forward.append(message / message.sum())
        backward = [None] * n
        message = np.array([1.0, 1.0])
        message = gap(gaps[n]) @ message
        for i in range(n - 1, -1, -1):
            backward[i] = message / message.sum()
            if i:
                message = gap(gaps[i]) @ step @ (emit[i] * backward[i])
        both = np.array(forward) * np.array(backward)
        both /= both.sum(1, keepdims=True)
        return both[:, 1]

    def evidence(self, text: str | None) -> tuple[list[tuple[int, int, float]], float, float]:
        """Weighted words with their marginals; the largest marginal; and log(1 + their sum), which is the expected number of toxic words."""
        found, gaps, _ = self.known(text)
        if not found:
            return [], 0.0, 0.0
        p = self.marginals([w for w, _, _ in found], gaps)
        return [(s, e, float(q)) for (_, s, e), q in zip(found, p, strict=True)], *self.summed(p)

    @staticmethod
    def summed(p: np.ndarray) -> tuple[float, float]:
        return (float(p.max()), math.log1p(float(p.sum()))) if len(p) else (0.0, 0.0)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        spans, top, total = self.evidence(text)
        if self.constant is not None:
            return self.constant, spans
        a, b, c = self.score_weights
        return 1 / (1 + math.exp(-(a + b * top + c * total))), spans


def fit(rows: list[tuple[str | None, int]]) -> Field:
    """The field of labelled texts (text, 0 or 1)."""
    rows = [(t, int(y)) for t, y in rows if y is not None]
    seen = [Counter(), Counter()]
    for t, y in rows:
        seen[y].update({w for w, _, _ in words(t)})
    counts = [(w, seen[1][w], seen[0][w] + seen[1][w]) for w in seen[0] | seen[1]]
    n1 = sum(y for _, y in rows)
    toxic = associated(counts, n1, len(rows), len(counts))
    return _fitted([(chain(t, toxic), y) for t, y in rows], toxic, n1)


def chain(text: str | None, toxic: dict[str, int]) -> tuple[list[int], list[int]]:
    """The places in toxic of a text's weighted words, and the numbers of words before each and after the last."""
    found, gaps, last, n = [], [], 0, 0
    for n, m in enumerate(WORD.finditer(text or ""), 1):
        if (place := toxic.get(m[0].lower())) is not None:
            found.append(place)
            gaps.append(n - 1 - last)
            last = n
    return found, [*gaps, n - last]


def least_z(n_words: int) -> float:
    """MIN_Z, or the z that half a word of so many would reach by chance."""
    need = MIN_Z
    while n_words * math.erfc(need / math.sqrt(2)) / 2 > 0.5:
        need += 0.01
    return need


def associated(counts: list[tuple[str, int, int]], n1: int, n: int, n_words: int) -> dict[str, int]:
    """Places of the words that mark toxic documents, of (word, toxic documents, documents): those whose signed root of the likelihood ratio is at least least_z."""
    need, z = least_z(n_words), {}
    for w, a, total in counts:
        expected = total * n1 / max(n, 1)
        if a > expected:
            cells = ((a, expected), (total - a, total - expected), (n1 - a, n1 - expected), (n - n1 - total + a, n - n1 - total + expected))
            z[w] = math.sqrt(max(0.0, 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)))
    return {w: i for i, w in enumerate(sorted((w for w, v in z.items() if v >= need), key=lambda w: (-z[w], w)))}


def _fitted(chains: list[tuple[tuple[list[int], list[int]], int]], toxic: dict[str, int], n1: int) -> Field:
    if not n1 or n1 == len(chains):
        return Field(constant=float(n1 > 0) if chains else 0.0)
    if not toxic:
        return Field(constant=n1 / len(chains))
    model = Field(weight=dict.fromkeys(toxic, 0.0))
    _ascend(model, chains, toxic)
    names = list(toxic)
    data = [model.summed(model.marginals([names[i] for i in found], gaps) if found else np.zeros(0)) for (found, gaps), _ in chains]
    model.score_weights = _logistic(np.array(data), np.array([y for _, y in chains], float))
    return model


def _ascend(model: Field, given: list[tuple[tuple[list[int], list[int]], int]], toxic: dict[str, int]) -> None:
    """Ascends the log likelihood of the token labels less the prior's penalty, from the potentials that counts alone give.

    The parameters are each weighted word's potential (base + weight), the base, and the transitions but plain to
    plain, which stays 0 as only differences matter.
    """
    chains = Chains(given, len(toxic))
    hit, seen = chains.tokens(chains.tag), chains.tokens(1.0 - chains.tag)
    start = np.concatenate([np.log((hit + 0.1) / (seen + 0.9)), [-math.log(chains.n_plain + 1.0), 0.0, 0.0, 0.0]])

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = chains.likelihood(theta)
        return PRIOR / 2 * float(theta @ theta) - value, PRIOR * theta - gradient

    theta = _minimum(loss, start)
    base, (s01, s10, s11) = float(theta[-4]), theta[-3:].tolist()
    model.base, model.step = base, [[0.0, s01], [s10, s11]]
    model.weight = {w: float(theta[i]) - base for w, i in toxic.items()}
    model._eig = model.powers()


class Chains:
    """Labelled texts as their weighted words and the gaps of plain words around them, longest chains first."""

    def __init__(self, given: list[tuple[tuple[list[int], list[int]], int]], n_words: int):
        chains = [(found, gaps, y) for (found, gaps), y in given if found or gaps[0]]
        chains.sort(key=lambda c: -len(c[0]))
        self.size = np.array([len(found) for found, _, _ in chains])
        n, most = len(chains), int(self.size.max(initial=0))
        self.word, self.tag, self.gap = np.full((n, most), -1), np.zeros((n, most)), np.zeros((n, most + 1))
        for c, (found, gaps, y) in enumerate(chains):
            self.word[c, : len(found)], self.tag[c, : len(found)], self.gap[c, : len(gaps)] = found, y, gaps
        self.n_words, self.n_plain = n_words, int(self.gap.sum())
        #: Whether a chain begins with a plain word, whose potential comes without a transition.
        self.led = self.gap[:, 0] > 0
        self.inner = self.gap.copy()
        self.inner[:, 0] = np.maximum(self.gap[:, 0] - 1, 0)
        self.given = np.zeros((2, 2))
        for k in range(most):
            now = self.size > k
            tag, beside = self.tag[now, k], (self.gap[now, k] == 0) & (k > 0)
            before = self.tag[now, k - 1] * beside if k else np.zeros(len(tag))
            linked = beside | (self.gap[now, k] > 0)
            self.given[1, 1] += (before * tag).sum()
            self.given[0, 1] += (linked * (1 - before) * tag).sum()
            self.given[1, 0] += (before * (1 - tag)).sum()
            after = np.where(self.gap[now, k + 1] > 0, 1.0, 0.0)
            self.given[1, 0] += (tag * after).sum()

    def tokens(self, value: np.ndarray) -> np.ndarray:
        """Sums of value over the places of each weighted word."""
        known = self.word >= 0
        return np.bincount(self.word[known], value[known], self.n_words)

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood of all tags, and its gradient: counts given less counts expected."""
        potential, base = theta[: self.n_words], theta[-4]
        step = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
        plain = step * np.exp([0.0, base])[None, :]
        values, vectors = np.linalg.eig(plain)
        values, vectors = values.real, vectors.real
        inverse, top = np.linalg.inv(vectors), np.abs(values).max()
        ratio = values / top
        emit = np.stack([np.ones(self.word.shape), np.where(self.word >= 0, np.exp(potential[self.word]), 1.0)], -1)
        n, most = self.word.shape
        left = np.where(self.led[:, None], np.exp([0.0, base])[None, :], 1.0)
        lefts, mids, log_z = [left], [], float(self.inner.sum()) * math.log(top)
        for k in range(most + 1):
            here = int((self.size >= k).sum())
            left = lefts[k][:here]
            mid = ((left @ vectors) * ratio[None, :] ** self.inner[:here, k, None]) @ inverse
            mids.append(mid)
            log_z += float(np.log(mid[self.size[:here] == k].sum(1)).sum())
            more = int((self.size > k).sum())
            if more:
                message = mid[:more] @ step if k else np.where(self.led[:more, None], mid[:more] @ step, 1.0)
                message = message * emit[:more, k]
                scale = message.sum(1, keepdims=True)
                log_z += float(np.log(scale).sum())
                lefts.append(message / scale)
        toxic, expected, base_toxic = np.zeros(self.word.shape), np.zeros((2, 2)), 0.0
        onward = np.zeros((0, 2))
        for k in range(most, -1, -1):
            here, more = len(mids[k]), len(onward)
            right = np.ones((here, 2))
            if more:  # by the transition into the next weighted word
                arrive = emit[:more, k] * onward
                right[:more] = arrive @ step.T
                joint = mids[k][:more, :, None] * step[None] * arrive[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                expected += joint[self.led[:more] | (k > 0)].sum(0)
            left, count = lefts[k][:here], self.inner[:here, k]
            powers = ratio[None, :] ** count[:, None]
            turned = right @ inverse.T
            begin = (turned * powers) @ vectors.T
            # sum over the gap's steps of left A^j and A^(count - 1 - j) right
            few = np.maximum(count - 1, 0)
            cross = (powers[:, 0] - powers[:, 1]) / (ratio[0] - ratio[1])
            sums = np.stack([np.stack([count * ratio[0] ** few, cross], -1), np.stack([cross, count * ratio[1] ** few], -1)], -2)
            inside = np.einsum("cp,pa,cpq,bq,cq->cab", left @ vectors, inverse, sums, vectors, turned, optimize=True) * plain[None] / top
            z = (left * begin).sum(1)
            if k == 0:  # a chain that begins with a weighted word has no gap there
                inside = inside[self.led]
                z_led = z[self.led]
                base_toxic += float((left[self.led, 1] * begin[self.led, 1] / z_led).sum())
                inside = (inside / z_led[:, None, None]).sum(0)
            else:
                inside = (inside / z[:, None, None]).sum(0)
                toxic[:here, k - 1] = left[:, 1] * begin[:, 1] / z
            expected += inside
            base_toxic += float(inside[:, 1].sum())
            onward = begin / begin.sum(1, keepdims=True)
        given = np.concatenate([self.tokens(self.tag), [0.0, self.given[0, 1], self.given[1, 0], self.given[1, 1]]])
        counted = np.concatenate([self.tokens(toxic), [base_toxic, expected[0, 1], expected[1, 0], expected[1, 1]]])
        return float(given @ theta) - log_z, given - counted


def _minimum(loss, x: np.ndarray) -> np.ndarray:
    """L-BFGS with backtracking: where the gradient of a convex loss is at most GRADIENT."""
    value, gradient = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(gradient).max() <= GRADIENT:
            break
        way, used = -gradient, []
        for s, y in reversed(pairs):
            used.append((s @ way) / (s @ y))
            way = way - used[-1] * y
        way = way * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(gradient).max())))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        length, slope = min(1.0, 5.0 / float(np.abs(way).max())), float(gradient @ way)
        while length > 1e-12:
            after, slant = loss(x + length * way)
            if after <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = length * way, slant - gradient
        x, value, gradient = x + s, after, slant
        if s @ y > 1e-12:
            pairs = [*pairs[-19:], (s, y)]
    return x


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", seed: int = 0) -> Field:
    """Fits a field to the texts of at most MAX_ROWS labelled keys, those with the least seeded hash.

    Keys are drawn from the labels alone. Of the texts drawn the driver gets the words that mark toxic documents
    (by counts made where the texts are) and, of each text, their order and gaps. A key that stands in several rows
    of docs or labels counts as often; beyond MAX_ROWS rows the ones with the greatest hashes stay out.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    last = given.select("h").orderBy("h").limit(MAX_ROWS).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    drawn = given.where(F.col("h") <= last)
    texts = docs.select(F.col(key).alias("k2"), F.col(text).alias("text")).where(F.xxhash64(F.lit(seed), F.col("k2")) <= last)
    rows = texts.join(drawn, F.col("k") == F.col("k2")).select("text", "y", "h", F.xxhash64("text").alias("t"))
    rows = materialize(rows.orderBy("h", "t", "y").limit(MAX_ROWS), "labelled")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({w for w, _, _ in words(t)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["word", "y"])

    counts = rows.select("text", "y").mapInArrow(spread, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("total"))
    counts = materialize(counts, "words")
    n1, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    n_words = counts.count()
    # words in too few toxic documents can't mark them: a of n1 give a likelihood ratio of at most 2 a (log(n / n1) + 1)
    most = 2 * F.col("a") * (math.log(max(n, 1) / max(n1, 1)) + 1)
    marking = counts.where((F.col("a") * n > F.col("total") * n1) & (most >= least_z(n_words) ** 2))
    toxic = associated([tuple(r) for r in marking.collect()], n1, n, n_words)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chain(t, toxic) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (0, 1)] + [batch.column(1)], ["found", "gaps", "y"])

    made = rows.select("text", "y").mapInArrow(shorten, "found array<int>, gaps array<int>, y int").collect()
    discard(rows, counts)
    return _fitted(sorted(((list(r["found"]), list(r["gaps"])), r["y"]) for r in made), toxic, n1)


def score(df: DataFrame, model: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of df with score and toxic_spans (start, end, marginal of words at one half or more)."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])

    def compute(t: str) -> tuple:
        p, spans = model.score(t)
        return p, [{"start": s, "end": e, "p": q} for s, e, q in spans if q >= 0.5]

    return from_text(df, text, df.columns if keep is None else keep, compute, fields)
