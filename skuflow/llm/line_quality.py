"""Operator 5: document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are shares of character
kinds, word repetition, length and repeated lines, in steps, its own and its neighbours'.
The field is trained with lines labelled as their documents are; forward-backward gives
each line's marginal, and the marginals, weighted by length in bytes, add up to the
document's. A calibration on training documents turns that into a probability.

Defined results: a null or empty text is one empty line; rows that share a ``doc_id`` are
scored each; labels that are null, or of unknown documents, teach nothing; without labels
of both classes every score is the share of good labels, or 1; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import buffers, documents, fold, labels, ship, texts, whole_text
from skuflow.session import stage

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bound of the sample: documents of each class, and neighbouring lines of each.
SAMPLE_BAD, SAMPLE_GOOD, SAMPLE_LINES = 1500, 3000, 200
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
_CUTS = (0.001, 0.01, 0.03, 0.08, 0.2, 0.5)
_MEASURES = 8
_CODES = len(_CUTS) + 1
WIDTH = _MEASURES * _CODES + 2 * _MEASURES + 1


def _table(codes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(codes)] = 1
    return out


_UPPER = _table([*range(0x41, 0x5B)])
_DIGIT = _table(range(0x30, 0x3A))
_SYMBOL = _table(b"#*$%&|<>")
_POINT = _table(b"!?.,;:'\"()[]{}-_/\\@=+~^`")
_WIDE_UPPER = _table([*range(0x80, 0x9F)])  # second bytes of the capitals U+00C0 to U+00DE
_SPACE = _table([0x20, *range(9, 14)]).astype(bool)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes: sums of bytes times powers, made comparable by place."""
    powers = np.cumprod(np.full(int((ends - starts).max()) if len(starts) else 0, _MIX))
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = data[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * powers[at])])
    stop = np.cumsum(lengths)
    return total[stop] - total[stop - lengths]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of each line; a text ends its last line."""
    breaks = np.flatnonzero(data == 0x0A)
    text = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([np.arange(len(offsets) - 1), text])
    order = np.lexsort([start, owner])
    ends = np.lexsort([end, np.concatenate([text, np.arange(len(offsets) - 1)])])
    return owner[order], start[order], end[ends]


def measures(data: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shares that describe each line, as step numbers."""
    n = len(start)
    size = np.maximum(1, end - start)
    upper = _UPPER[data]
    upper[1:] |= _WIDE_UPPER[data[1:]] & (data[:-1] == 0xC3)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    line_heads = start[start < len(data)]
    first[line_heads] = word[line_heads]
    w_start = np.flatnonzero(first)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    tails = end[(end > 0) & (end <= len(data))] - 1
    stop[tails] = word[tails]
    w_end = np.flatnonzero(stop) + 1
    words = np.searchsorted(w_start, end) - np.searchsorted(w_start, start)
    hashed = _hashes(data, w_start, w_end)
    w_line = np.searchsorted(start, w_start, "right") - 1
    same = np.zeros(len(w_start), np.int64)
    if len(w_start) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (w_line[1:] == w_line[:-1])
    repeats = np.bincount(w_line, same, n) if len(w_start) else np.zeros(n)
    line_hash = _hashes(data, start, end)
    order = np.lexsort([np.arange(n), line_hash, text])
    again = np.zeros(n)
    if n > 1:
        pair = (text[order][1:] == text[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
        again[order[1:]] = pair & (size[order[1:]] > 1)
    shares = np.stack([
        _sums(upper, start, end) / size, _sums(_DIGIT[data], start, end) / size,
        _sums(_SYMBOL[data], start, end) / size, _sums(_POINT[data], start, end) / size,
        repeats / np.maximum(1, words), again,
        np.minimum(1, words / 100), _sums(data >= 0x80, start, end) / size,
    ], 1)
    return np.searchsorted(_CUTS, shares, "right").astype(np.uint8)


def design(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Indicator features of each line: its steps, its neighbours' sums, and one."""
    n = len(codes)
    x = np.zeros((n, WIDTH), np.float32)
    x[np.arange(n)[:, None], np.arange(_MEASURES) * _CODES + codes] = 1
    scaled = codes / np.float32(len(_CUTS))
    base = _MEASURES * _CODES
    if n > 1:
        same = text[1:] == text[:-1]
        x[1:, base:base + _MEASURES] = scaled[:-1] * same[:, None]
        x[:-1, base + _MEASURES:base + 2 * _MEASURES] = scaled[1:] * same[:, None]
    x[:, -1] = 1
    return x


def _scan(matrices: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running products of 2x2 matrices from the head of each run, scaled to sum one.

    Doubling: after step k each product covers 2**k places, or back to its head.
    """
    out = matrices / matrices.sum(axis=(1, 2), keepdims=True)
    head = np.maximum.accumulate(np.where(begins, np.arange(len(out)), 0))
    reach = np.arange(len(out)) - head
    step = 1
    while step <= (reach.max() if len(reach) else 0):
        use = np.flatnonzero(reach >= step)
        new = np.einsum("nij,njk->nik", out[use - step], out[use])
        out[use] = new / new.sum(axis=(1, 2), keepdims=True)
        step *= 2
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, text: np.ndarray):
    """Forward-backward: probability of good for each line, and the joint with the line
    before (zero at heads). ``scores``: log odds of good; ``moves``: log weights 2x2."""
    n = len(scores)
    emit = np.stack([np.exp(-np.maximum(scores, 0)), np.exp(np.minimum(scores, 0))], 1)
    emit = np.maximum(emit, 1e-30)
    begins = np.ones(n, bool)
    begins[1:] = text[1:] != text[:-1]
    ends = np.append(begins[1:], True)
    weight = np.exp(moves)
    step = weight[None] * emit[:, None, :]
    step[begins] = 0.5 * emit[begins][:, None, :]
    forward = _scan(step, begins)
    alpha = forward.sum(axis=1)
    # Backward: the same on reversed lines; the matrix at t leads from t to t + 1.
    back = np.empty((n, 2, 2))
    back[:-1] = weight[None] * emit[1:, None, :]
    back[ends] = 0.5
    reverse = _scan(back[::-1].transpose(0, 2, 1), ends[::-1])[::-1]
    beta = reverse.sum(axis=1)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    joint = np.zeros((n, 2, 2))
    if n > 1:
        j = alpha[:-1, :, None] * weight[None] * (emit[1:] * beta[1:])[:, None, :]
        j /= j.sum(axis=(1, 2), keepdims=True)
        joint[1:] = j * ~begins[1:, None, None]
    return good, joint


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    level: float
    constant: float | None = None


def _document_means(good: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    weight = size + 1.0
    return np.bincount(text, good * weight, n) / np.bincount(text, weight, n)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_texts(model: Model, values: pa.Array) -> np.ndarray:
    n = len(values)
    if model.constant is not None or not n:
        return np.full(n, model.constant or 0.0)
    data, offsets = buffers(values)
    text, start, end = lines(data, offsets)
    x = design(measures(data, text, start, end), text)
    good, _ = marginals((x * model.weights).sum(axis=1), model.moves, text)
    mean = _document_means(good, end - start, text, n)
    return 1 / (1 + np.exp(-(model.slope * _log_odds(mean) + model.level)))


def score_column(model: Model, text: Column, run: int = 1000) -> Column:
    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        parts = [score_texts(model, values.slice(i, run)) for i in range(0, len(values), run)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def _training_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Line steps of the sampled documents: at most ``SAMPLE_LINES`` neighbours of each,
    from a place that the id's hash picks."""
    known = (
        marks.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    key = F.xxhash64("doc_id")
    parts = [
        known.where(F.col("quality") == value).orderBy(key, "doc_id").limit(bound)
        for value, bound in ((0, SAMPLE_BAD), (1, SAMPLE_GOOD))
    ]
    picked = F.broadcast(parts[0].union(parts[1]))  # bounded by the two numbers

    def describe(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            text, start, end = lines(data, offsets)
            codes = measures(data, text, start, end)
            first = np.searchsorted(text, np.arange(batch.num_rows))
            n = np.diff(np.append(first, len(text)))
            spare = np.maximum(0, n - SAMPLE_LINES)
            ids = batch.column("doc_id").to_numpy()
            skip = (ids.astype(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % (spare + 1)
            rows = [
                (codes[f + s:f + min(k, s + SAMPLE_LINES)].tobytes(),
                 (end - start)[f + s:f + min(k, s + SAMPLE_LINES)].astype("<i8").tobytes())
                for f, s, k in zip(first.tolist(), skip.tolist(), (n).tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality"),
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
            ], names=["doc_id", "quality", "codes", "sizes"])

    return texts(docs).join(picked, "doc_id").select("doc_id", "quality", "text").mapInArrow(
        describe, "doc_id long, quality int, codes binary, sizes binary"
    )


def fit(codes: np.ndarray, sizes: np.ndarray, text: np.ndarray, label: np.ndarray,
        weight: np.ndarray) -> Model:
    """Gradient ascent on the likelihood of the lines' labels, documents weighted alike."""
    x = design(codes, text)
    y = label[text].astype(float)
    n_docs = len(label)
    per_line = weight[text] / np.bincount(text, minlength=n_docs)[text]
    per_line /= per_line.sum()
    inside = np.zeros(len(text), bool)
    inside[1:] = text[1:] == text[:-1]
    w, moves = np.zeros(WIDTH), np.zeros((2, 2))
    m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    pair = y.astype(int)
    seen = np.zeros((len(text), 2, 2))
    seen[np.flatnonzero(inside), pair[:-1][inside[1:]], pair[1:][inside[1:]]] = 1
    for t in range(1, STEPS + 1):
        good, joint = marginals((x * w).sum(axis=1), moves, text)
        g_w = ((y - good) * per_line) @ x - RIDGE * w
        g_m = ((seen - joint) * per_line[:, None, None]).sum(axis=0) - RIDGE * moves
        g = np.concatenate([g_w, g_m.ravel()])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        delta = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w = w + delta[:WIDTH]
        moves = moves + delta[WIDTH:].reshape(2, 2)
    good, _ = marginals((x * w).sum(axis=1), moves, text)
    z = _log_odds(_document_means(good, sizes, text, n_docs))
    slope, level = 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(50):  # Newton steps of a logistic curve
        p = 1 / (1 + np.exp(-(slope * z + level)))
        r, h = weight * (label - p), weight * p * (1 - p)
        g = np.array([(r * z).sum(), r.sum()])
        a = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
        slope += (a[1, 1] * g[0] - a[0, 1] * g[1]) / det
        level += (a[0, 0] * g[1] - a[1, 0] * g[0]) / det
    return Model(w, moves, float(max(slope, 1e-3)), float(level))


def train(docs: DataFrame, marks: DataFrame) -> Model:
    ship(docs.sparkSession)
    rows = stage(_training_rows(docs, marks), "quality-sample").orderBy("doc_id", "codes").collect()
    label = np.array([r["quality"] for r in rows], float)
    if not rows or label.min() == label.max():
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0, float(label.mean()) if rows else 1.0)
    codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, _MEASURES) for r in rows]
    sizes = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in rows])
    text = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
    counts = {
        r["q"]: r["count"] for r in
        marks.where(F.col("quality").isNotNull() & (fold(FOLDS) != HELD_OUT))
        .groupBy(F.col("quality").cast("int").alias("q")).count().collect()
    }
    bad = label == 0
    weight = np.where(bad, counts.get(0, 1) / bad.sum(), counts.get(1, 1) / (~bad).sum())
    return fit(np.concatenate(codes), sizes, text, label, weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score``."""
    ship(docs.sparkSession)
    return docs.withColumn("_score", score_column(model, whole_text(docs)))


def op5_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
