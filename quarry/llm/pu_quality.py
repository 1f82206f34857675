"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good. The unlabelled rows are web texts
of `documents` that have no label; labels other than "good" are not read at all.
The share of good texts among the unlabelled, the class prior, is estimated from
the two sets (`class_prior`). The fit minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

of an additive logistic model over measurements of the whole text. Where the
second term falls below zero the step goes back along its gradient, so the model
cannot buy risk by overfitting the positives.

Measurements are shares of signs and repeats, and how surprising the text's byte
trigrams are to a table of those of the positives (gibberish), and which kinds of
bytes stand where words meet (words out of order). Positives are measured with the table of
the other half of them, so none is known to its own table. Unlabelled texts need
not show every way of being bad, so what lies beyond the positives in surprise is
held against a text whatever the fit says of it.

What is fitted on is a bounded sample (`SAMPLE` positives and as many unlabelled
rows, by the hash of doc_id); every document is scored by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._ragged import groups
from ._shared import fresh, release, written

#: Positives, and unlabelled rows, that are fitted on at most: the bound of what the driver holds, as measurements and not as texts.
SAMPLE = 12_000
#: Documents among which the unlabelled rows are looked for.
LOOK = 4 * SAMPLE
#: With fewer unlabelled rows, labelled ones whose labels are hidden are added.
FEW = 100
FOLDS = 5
THRESHOLD = 0.3
#: Prior where it cannot be estimated.
OPEN_PRIOR = 0.8
#: Bins of the table of byte trigrams.
BINS = 1 << 18
#: Classes of bytes; behind the bins come the counts of which class stands before and behind a space or a line's end.
KINDS = 11
MEETINGS = 2 * KINDS * KINDS
#: Trigrams of usual surprise that each text is given, so that a few words say little.
USUAL = 150
#: Added to the number of meetings, likewise.
FEW_MEETINGS = 40
#: Weight of surprise beyond that of 99 of 100 positives.
BEYOND = 6.0

MEASURES = ("symbols", "marks", "bars", "upper", "digits", "echo", "windows", "distinct", "top_word", "word_length", "lines", "same_lines", "ends", "other", "size", "surprise", "meetings", "unseen")
LEXICAL = slice(MEASURES.index("surprise"), len(MEASURES))
#: Knots of each measure's hinges, as quantiles of the sample.
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.97)
_CLASS = np.zeros(256, np.int64)
for _c in b"#*$%&<>":
    _CLASS[_c] = 1
for _c in b"!?":
    _CLASS[_c] = 2
_CLASS[ord("|")] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[ord("0") : ord("9") + 1] = 5
for _c in b".,;:":
    _CLASS[_c] = 6
_CLASS[10] = 7
_CLASS[ord("a") : ord("z") + 1] = 8
_CLASS[32] = 9
_CLASS[128:] = 10


def gram_bins(raw: np.ndarray) -> np.ndarray:
    """Bins of the byte trigrams of a text."""
    x = raw.astype(np.uint32)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77) + (x[1:-1] << np.uint32(15))) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BINS - 1)


def meetings(raw: np.ndarray) -> np.ndarray:
    """Of each place where two words meet, the classes of the bytes beside it; not of letters beyond ASCII, whose bytes do not tell capitals."""
    at = np.flatnonzero(((raw[1:-1] == 32) | (raw[1:-1] == 10)) & (raw[:-2] < 128) & (raw[2:] < 128)) + 1
    return ((raw[at] == 10) * KINDS + _CLASS[raw[at - 1]]) * KINDS + _CLASS[raw[at + 1]]


def counted(raw: np.ndarray) -> np.ndarray:
    """Trigrams by bin, then meetings."""
    return np.concatenate([np.bincount(gram_bins(raw), minlength=BINS), np.bincount(meetings(raw), minlength=MEETINGS)])


@dataclass
class Grams:
    """How surprising each trigram and each meeting is, in bits, after those of trusted texts; usual values."""

    bits: np.ndarray
    unseen: np.ndarray
    meeting: np.ndarray
    usual: tuple[float, float]

    @staticmethod
    def of(counts: np.ndarray) -> Grams:
        grams, met = counts[:BINS], counts[BINS:].reshape(2 * KINDS, KINDS)
        bits = -np.log2((grams + 0.5) / (grams.sum() + 0.5 * BINS)).astype(np.float32)
        # of a meeting: the class behind, after what stands before
        meeting = -np.log2((met + 0.5) / (met.sum(axis=1, keepdims=True) + 0.5 * KINDS)).astype(np.float32).ravel()
        usual = (float(grams @ bits / grams.sum()) if grams.any() else float(bits[0]), float(met.ravel() @ meeting / met.sum()) if met.any() else float(meeting[0]))
        return Grams(bits, grams == 0, meeting, usual)

    def measure(self, raw: np.ndarray) -> tuple[float, float, float]:
        """Mean surprise of trigrams; by how much meetings of words surprise more than usual, in deviations of their number; share of unseen trigrams."""
        if len(raw) < 3:
            return self.usual[0], 0.0, 0.0
        at = gram_bins(raw)
        bits, met = self.bits[at], self.meeting[meetings(raw)]
        return (
            (float(bits.sum()) + USUAL * self.usual[0]) / (len(bits) + USUAL),
            (float(met.sum()) - len(met) * self.usual[1]) / (len(met) + FEW_MEETINGS) ** 0.5,
            float(np.count_nonzero(self.unseen[at])) / (len(bits) + USUAL),
        )


def no_grams() -> Grams:
    return Grams(np.zeros(BINS, np.float32), np.zeros(BINS, bool), np.zeros(MEETINGS, np.float32), (0.0, 0.0))


def measure(text: str | None, grams: Grams) -> list[float]:
    """Measurements of a whole text; counts and shares are zero for a null or empty one, surprise is as usual."""
    if not text:
        return [0.0] * LEXICAL.start + [grams.usual[0], 0.0, 0.0]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    kinds = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=11)
    words = text.split()
    n = max(1, len(words))
    letters = max(1.0, kinds[4] + kinds[8] + kinds[10])
    h = np.fromiter(map(hash, words), np.int64, len(words))
    echo = np.count_nonzero(h[1:] == h[:-1]) / n
    share = 0.0
    if len(h) >= 6:
        mixed = h[:-5] * 3
        for k in range(1, 6):
            mixed = mixed * 1_000_003 + h[k : len(h) - 5 + k]
        share = 1 - len(np.unique(mixed)) / len(mixed)
    counts = np.unique(h, return_counts=True)[1]
    lines = [x for x in text.split("\n") if x]
    same = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [
        kinds[1] / n,
        kinds[2] / n,
        kinds[3] / n,
        kinds[4] / letters,
        kinds[5] / len(raw),
        echo,
        share,
        len(counts) / n,
        float(counts.max()) / n if len(counts) else 0.0,
        len(text) / n,
        len(lines) / n,
        same,
        kinds[6] / n,
        kinds[0] / len(raw),
        float(np.log1p(len(words))),
        *grams.measure(raw),
    ]


def measures(texts: list[str | None], grams: Grams) -> np.ndarray:
    return np.array([measure(t, grams) for t in texts], dtype=np.float64).reshape(-1, len(MEASURES))


@dataclass
class Model:
    knots: np.ndarray  # per measure
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    #: Of the lexical measures of positives: the median, and what nearly none is above.
    middle: np.ndarray = field(default_factory=lambda: np.zeros(len(MEASURES) - LEXICAL.start))
    high: np.ndarray = field(default_factory=lambda: np.full(len(MEASURES) - LEXICAL.start, np.inf))
    grams: Grams = field(default_factory=no_grams)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Each measure with its hinges, on a common scale; beyond the scale a value counts as its square root."""
        parts = [x] + [np.maximum(0.0, x - self.knots[:, k]) for k in range(self.knots.shape[1])]
        z = np.concatenate(parts, axis=1) / self.scale
        return np.sign(z) * np.where(np.abs(z) > 1, np.sqrt(np.abs(z)), np.abs(z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        beyond = np.maximum(0.0, x[:, LEXICAL] - self.high) / np.maximum(self.high - self.middle, 1e-3)
        margin = self.features(x) @ self.weights + self.bias - BEYOND * np.minimum(beyond, 10).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, contrast: bool = False) -> Model:
    """Adam on the non-negative risk with logistic losses, full batches, from zero: the same rows give the same model.

    With `contrast` the risk is that of telling the two sets apart, `prior` being the weight of the positives.
    """
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, len(MEASURES)))
    model = Model(np.quantile(both, KNOTS, axis=0).T, np.ones(len(MEASURES) * (1 + len(KNOTS))), np.zeros(len(MEASURES) * (1 + len(KNOTS))), 0.0, prior)
    hinges = np.concatenate([both] + [np.maximum(0.0, both - model.knots[:, k]) for k in range(len(KNOTS))], axis=1)
    model.scale = np.maximum(hinges.std(axis=0), 1e-3)
    if len(positive):
        lexical = positive[:, LEXICAL]
        model.middle, model.high = np.median(lexical, axis=0), np.quantile(lexical, 0.99, axis=0)
    if not len(positive) or not len(unlabelled):
        model.bias = float(np.log(prior / (1 - prior)))
        return model
    p, u = (np.concatenate([model.features(x), np.ones((len(x), 1))], axis=1) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if contrast:
            g = prior * (p.T @ (sp - 1)) / len(p) + (1 - prior) * (u.T @ su) / len(u)
        elif negative >= 0:
            g = prior * (p.T @ (sp - 1)) / len(p) + g_negative
        else:
            g = -g_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, estimated from both sets alone.

    A classifier tells the two sets apart, each half of the rows being scored by
    what was fitted on the other half. Above any score the unlabelled rows hold
    at least the prior times the positives' share there; the score is taken at
    which the ratio of the two shares is least, with the bound of its error.
    """
    if len(positive) < 8 or len(unlabelled) < 8:
        return OPEN_PRIOR
    scores = []
    for rows in (positive, unlabelled):
        scores.append(np.empty(len(rows)))
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled[half::2], 0.5, steps=200, contrast=True)
        for rows, out in zip((positive, unlabelled), scores):
            out[1 - half :: 2] = model.scores(rows[1 - half :: 2])
    p, u = np.sort(scores[0]), np.sort(scores[1])
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    error = np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((share_u + error) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is for evaluation only; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def samples(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """part, text of the rows to fit on: part 0 and 1 are halves of the positives, 2 and 3 of the unlabelled rows.

    Positives are labelled good, by all rows of a document, outside the held-out
    fold. Unlabelled are documents of the same folds without any label. Both come
    in the order of the hash of doc_id, `sample` of each at most; a written table.
    """
    half = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int")
    marked = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    good = marked.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    positive = good.filter("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", half.alias("part"))
    look = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    look = written(look.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LOOK), "quality-look")  # LOOK rows at most
    known = marked.join(F.broadcast(look), "doc_id").select("doc_id").distinct()
    open_ = written(look.join(known.hint("merge"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "quality-open")
    if open_.count() < FEW:
        hidden = good.select("doc_id").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(sample)
        open_ = open_.union(hidden)
    chosen = positive.unionByName(open_.select("doc_id", (half + 2).alias("part")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    return written(texts.select("part", "text"), "quality-sample")


def gram_counts(rows: DataFrame) -> np.ndarray:
    """Trigrams and meetings of the two halves of the positives: sums per bin come to the driver, two for each at most."""
    schema = pa.schema([("part", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        release()
        counts = np.zeros((2, BINS + MEETINGS), np.int64)
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8"), np.uint8)
                if len(raw) > 2:
                    counts[part] += counted(raw)
        for part in (0, 1):
            at = np.flatnonzero(counts[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[part][at])], schema=schema)

    found = rows.filter("part < 2").mapInArrow(run, "part int, bin int, n long").groupBy("part", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BINS + MEETINGS))
    counts[found.column("part").to_numpy(), found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return counts


def usual(grams: Grams, rows: np.ndarray) -> Grams:
    """The same with the usual surprise of texts that it does not know."""
    if len(rows):
        grams.usual = (float(np.median(rows[:, LEXICAL.start])), grams.usual[1])
    return grams


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` positives and as many unlabelled rows outside the held-out fold.

    Labels that are null, or of unknown documents, are left out; a document whose
    labels disagree is no trusted positive. Without positives or unlabelled rows
    every text scores the open prior.
    """
    rows = samples(docs, labels, sample)
    counts = gram_counts(rows)
    tables = [Grams.of(counts[1]), Grams.of(counts[0])]  # each half is measured by the other one's table

    def run(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                kinds = part.column(0).to_pylist()
                x = [measure(t, tables[k % 2]) for k, t in zip(kinds, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pydict({"positive": pa.array([k < 2 for k in kinds]), "x": pa.array(x, pa.list_(pa.float64()))})

    found = rows.select("part", "text").mapInArrow(run, "positive boolean, x array<double>").orderBy("positive", "x").limit(4 * sample).collect()
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(-1, len(MEASURES))
    good = np.array([r["positive"] for r in found], dtype=bool)
    mix = np.random.default_rng(0).permutation(len(x))  # the order of the values says nothing
    x, good = x[mix], good[mix]
    prior = class_prior(x[good], x[~good])
    model = fit(x[good], x[~good], prior)
    model.grams = usual(Grams.of(counts.sum(axis=0)), x[good])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with score and predicted.

    A null text scores as an empty one. The score is of the text alone, so equal
    texts score alike; repeated rows each give a row, an empty table gives none.
    Where `docs` has a score or predicted of its own (in any case of letters), the
    new column beside it gets an underscore behind its name.
    """
    name, verdict = fresh("score", docs.columns), fresh("predicted", docs.columns)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for column in texts:
            parts = [model.scores(measures(column.slice(begin, end - begin).to_pylist(), model.grams)) for begin, end in groups(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    # only the texts go to Python, and only the scores come back
    out = docs.withColumn(name, scored(F.col("text")))
    return out.withColumn(verdict, (F.col(name) >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    names = docs.columns
    return score(docs, train(docs, labels)).filter(F.col(fresh("predicted", names)) == 1).select(*[F.col(f"`{c}`") for c in names])
