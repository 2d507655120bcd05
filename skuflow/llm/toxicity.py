"""Operator 1: toxicity by compression distance.

Two zstandard dictionaries are trained. The ordinary one holds what ordinary windows of
text share, and then those ordinary windows that resemble toxic passages by chance. The
toxic one holds the same before a list of passages that set toxic training documents apart:
words and word beginnings with a high likelihood ratio. Every whole text is cut into windows
of words; each window is compressed with both, and the toxic dictionary saves bytes where
toxic passages stand. Each number of saved bytes has a weight, the log ratio of how often
windows of toxic and of ordinary documents save so much; a document's sum of weights is
turned into a probability by thresholds calibrated on training documents.

Defined results: a null or empty text has one empty window, which saves nothing; rows that
share a ``doc_id`` are scored each; labels that are null, or of unknown documents, teach
nothing; without labels of both classes every score is the share of toxic labels, or 0;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import buffers, documents, fold, labels, ship, texts, whole_text
from skuflow.session import stage

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bound of the sample that the model learns from: documents of each class.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 4000
#: Windows of each sampled ordinary document that train the ordinary dictionary.
WINDOWS_PER_DOC, DICTIONARY_BYTES = 12, 32_768
WINDOW_WORDS = 12
#: Longer windows are cut, so that a text without spaces has bounded windows too.
WINDOW_BYTES = 1024
#: Passages need this share of the best passage's likelihood ratio.
PASSAGE_SHARE, MAX_PASSAGES = 0.1, 200
PREFIXES = (4, 5, 6, 7, 8)
#: A passage counts by whether it stands in a text once, twice and so on up to this often.
OFTEN = 3
#: Rounds in which ordinary windows that save bytes join the ordinary dictionary, the bytes
#: that a round may add, and the saving from which a window does.
ROUNDS, ROUND_BYTES, CONFUSED = 2, 12_000, 2
LEVEL = 7
#: Savings over this count as this.
MOST_SAVED = 12
#: Sums of weights from -_LOWEST on have bins of one, _SCORE_CAP in all.
_LOWEST, _SCORE_CAP = 8, 24
_GAPS = re.compile(r"[\s!-/:-@\[-`{-~]+")  # white space and ASCII punctuation


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (MOST_SAVED + 1))
    table: list[float] = field(default_factory=lambda: [0.0] * (_SCORE_CAP + 1))
    passages: list[str] = field(default_factory=list)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=17, min_match=5, write_content_size=0, write_checksum=0,
        write_dict_id=0,
    )
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=parameters,
    )


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(9, 14)]] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of each window; every text has one at least.

    A window begins with the character before its first word, if there is one.
    """
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]
    at = np.flatnonzero(begins)
    text = np.searchsorted(offsets, at, "right") - 1
    first = np.searchsorted(at, offsets[:-1])
    rank = np.arange(len(at)) - first[text]
    use = rank % WINDOW_WORDS == 0
    start, text = at[use], text[use]
    missing = np.setdiff1d(np.arange(len(offsets) - 1), text)
    start = np.concatenate([start, offsets[missing]])
    text = np.concatenate([text, missing])
    order = np.argsort(text, kind="stable")
    start, text = start[order], text[order]
    end = np.append(start[1:], 0)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = offsets[text[last] + 1]
    start = np.where(start > offsets[text], start - 1, start)
    pieces = np.maximum(1, -(-(end - start) // WINDOW_BYTES))
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, text = (np.repeat(x, pieces) for x in (start, end, text))
        start = start + k * WINDOW_BYTES
        end = np.minimum(end, start + WINDOW_BYTES)
    return text, start, end


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.toxic:
            self._ordinary, self._toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def _sizes(self, compressor, data: bytes, segments: bytes) -> np.ndarray:
        out = compressor.multi_compress_to_buffer(
            zstandard.BufferWithSegments(data, segments), threads=0
        )
        return np.fromiter(map(len, out), np.int64, len(out))

    def saved(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window, 0 to ``MOST_SAVED``."""
        saved = np.zeros(len(start), np.int64)
        filled = end > start  # zstandard takes no empty input; an empty window saves nothing
        if self.model.toxic and filled.any():
            segments = np.stack([start[filled], (end - start)[filled]], 1).astype("<u8").tobytes()
            raw = data.tobytes()
            saved[filled] = self._sizes(self._ordinary, raw, segments) - self._sizes(
                self._toxic, raw, segments
            )
        return np.clip(saved, 0, MOST_SAVED)

    def histograms(self, lowered: pa.Array) -> np.ndarray:
        """For each text its number of windows by saved bytes."""
        data, offsets = buffers(lowered)
        text, start, end = windows(data, offsets)
        at = text * (MOST_SAVED + 1) + self.saved(data, start, end)
        return np.bincount(at, minlength=len(lowered) * (MOST_SAVED + 1)).reshape(len(lowered), -1)

    def scores(self, lowered: pa.Array) -> np.ndarray:
        if not len(lowered):
            return np.zeros(0)
        x = _bins(self.histograms(lowered) @ np.array(self.model.weights))
        return np.interp(x, np.arange(_SCORE_CAP + 1), np.array(self.model.table))


def _bins(sums: np.ndarray) -> np.ndarray:
    return np.clip(sums + _LOWEST, 0, _SCORE_CAP)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def _in_runs(texts: pa.Array, work, run: int = 2000) -> pa.Array:
    parts = [work(_lower(texts.slice(i, run))) for i in range(0, len(texts), run)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())


def score_column(model: Model, text: Column) -> Column:
    """Score of each whole text, in the task that holds it."""
    shared: dict[str, Scorer] = {}

    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        if "scorer" not in shared:
            shared["scorer"] = Scorer(model)
        return _in_runs(values, shared["scorer"].scores)

    return score(text)


def _sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Training documents: of each class those with the lowest hash of their id."""
    known = (
        marks.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    key = F.xxhash64("doc_id")
    parts = [
        known.where(F.col("toxic") == value).orderBy(key, "doc_id").limit(bound)
        for value, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))
    ]
    picked = F.broadcast(parts[0].union(parts[1]))  # bounded by the two numbers
    return texts(docs).join(picked, "doc_id")


def _variants(text: str) -> Counter:
    """How often each word, with a space behind it, and each word beginning stands there."""
    out: Counter = Counter()
    for word, n in Counter(_GAPS.split(text)).items():
        if len(word) >= PREFIXES[0]:
            out[word + " "] += n
            for k in PREFIXES:
                if k <= len(word):
                    out[word[:k]] += n
    return out


def _passages(sample: DataFrame, n_toxic: int, n_ordinary: int) -> list[str]:
    """Words and word beginnings that tell toxic documents apart, best first; of equals the
    longest, which saves most. What counts is the best of standing there once, twice, ..."""

    def count(batches):
        for batch in batches:
            held: tuple[Counter, Counter] = (Counter(), Counter())
            lowered = _lower(batch.column("text")).to_pylist()
            for toxic, text in zip(batch.column("toxic").to_pylist(), lowered, strict=True):
                for passage, n in _variants(text).items():
                    held[toxic].update((passage, m) for m in range(1, min(n, OFTEN) + 1))
            found = list(held[0] | held[1])
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in found], pa.string()),
                pa.array([m for _, m in found], pa.int32()),
                pa.array([held[1][key] for key in found], pa.int64()),
                pa.array([held[0][key] for key in found], pa.int64()),
            ], names=["passage", "m", "a", "b"])

    t, o = F.lit(float(n_toxic)), F.lit(float(n_ordinary))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(count: Column, total: Column) -> Column:
        expected = total * (a + b) / (t + o)
        term = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
        return term(count, expected) + term(total - count, total - expected)

    counted = (
        sample.select("toxic", "text")
        .mapInArrow(count, "passage string, m int, a long, b long")
        .groupBy("passage", "m").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= 3) & (F.col("a") * n_ordinary > F.col("b") * n_toxic))
        .groupBy("passage").agg(F.max(F.round(2 * (part(a, t) + part(b, o)), 6)).alias("ratio"))
        .orderBy(F.desc("ratio"), F.desc(F.length("passage")), "passage").limit(20 * MAX_PASSAGES)
        .collect()
    )
    chosen: list[str] = []
    for row in counted:
        p = row["passage"]
        if row["ratio"] < PASSAGE_SHARE * counted[0]["ratio"] or len(chosen) == MAX_PASSAGES:
            break
        if not any(p.startswith(c) or c.startswith(p) for c in chosen):
            chosen.append(p)
    return chosen


def _dictionaries(train_on: list[bytes], passages: list[str]) -> Model:
    """Both dictionaries. They are equally long and differ in the passages only, which stand
    last, where references to them are shortest; the ordinary one has zero bytes there."""
    try:
        ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, train_on).as_bytes()
    except zstandard.ZstdError:  # too few windows to find common parts in
        ordinary = b" ".join(train_on)[-DICTIONARY_BYTES:]
    if not passages:
        return Model(ordinary)
    tail = (" " + " ".join(p.rstrip() for p in reversed(passages)) + " ").encode()
    data = np.frombuffer(b"".join(train_on), np.uint8)
    end = np.cumsum([len(w) for w in train_on]).astype(np.int64)
    start = end - np.array([len(w) for w in train_on], np.int64)

    def model() -> Model:
        return Model(ordinary + bytes(len(tail)), ordinary + tail, passages=passages)

    for _ in range(ROUNDS if train_on else 0):
        saved = Scorer(model()).saved(data, start, end)
        confused: dict[bytes, None] = {}
        size = 0
        for k in np.argsort(-saved, kind="stable").tolist():
            if saved[k] < CONFUSED or size > ROUND_BYTES:
                break
            if train_on[k] not in confused:
                confused[train_on[k]] = None
                size += len(train_on[k])
        ordinary = b"".join(reversed(confused)) + ordinary
    return model()


def _training_windows(sample: DataFrame) -> list[bytes]:
    """Some windows of each ordinary document, from all over its text."""

    def pick(batches):
        for batch in batches:
            lowered = _lower(batch.column("text"))
            data, offsets = buffers(lowered)
            text, start, end = windows(data, offsets)
            first = np.searchsorted(text, np.arange(len(lowered)))
            n = np.diff(np.append(first, len(text)))
            rank = np.arange(len(text)) - first[text]
            step = np.maximum(1, n // WINDOWS_PER_DOC)[text]
            use = (rank % step == 0) & (rank // step < WINDOWS_PER_DOC) & (end > start)
            raw = data.tobytes()
            out = [raw[a:b] for a, b in zip(start[use].tolist(), end[use].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])

    rows = sample.where("toxic = 0").select("text").mapInArrow(pick, "w binary").collect()
    return sorted(bytes(r["w"]) for r in rows)


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Rising probabilities at 0, 1, ... by pooling neighbours that fall."""
    blocks: list[list[float]] = []  # mean, weight, first bin
    for k in range(_SCORE_CAP + 1):
        at = np.minimum(np.ceil(x), _SCORE_CAP) == k
        w = float(weight[at].sum())
        blocks.append([float((y * weight)[at].sum()) / w if w else math.nan, w, k])
        while len(blocks) > 1 and (
            not blocks[-1][1] > 0 or (blocks[-2][1] > 0 and blocks[-2][0] >= blocks[-1][0])
        ):
            m, w1, _ = blocks.pop()
            total = blocks[-1][1] + w1
            if w1 > 0:
                mean = blocks[-1][0] if blocks[-1][1] > 0 else 0.0
                blocks[-1][0] = (mean * blocks[-1][1] + m * w1) / total
                blocks[-1][1] = total
    filled = [b for b in blocks if b[1] > 0]
    if filled and not blocks[0][1] > 0:  # bins below the first document's are like its own
        blocks = [[filled[0][0], filled[0][1], 0], *filled[1:]]
    out = [0.0] * (_SCORE_CAP + 1)
    for (mean, _, first), nxt in zip(blocks, [*blocks[1:], [0, 0, _SCORE_CAP + 1]], strict=True):
        for k in range(first, nxt[2]):
            out[k] = mean
    # More saving always scores a little more, so that ranks have no ties.
    return [0.98 * p + 0.02 * k / _SCORE_CAP for k, p in enumerate(out)]


def train(docs: DataFrame, marks: DataFrame) -> Model:
    """Fit dictionaries and thresholds on the bounded sample of labelled documents."""
    ship(docs.sparkSession)
    sample = stage(_sample(docs, marks), "toxicity-sample")
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_ordinary = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_ordinary:
        share = n_toxic / (n_toxic + n_ordinary) if counts else 0.0
        return Model(table=[share] * (_SCORE_CAP + 1))
    passages = _passages(sample, n_toxic, n_ordinary)
    model = _dictionaries(_training_windows(sample), passages)

    @F.arrow_udf("array<long>")
    def histogram(values: pa.Array) -> pa.Array:
        scorer, parts = Scorer(model), []
        for i in range(0, len(values), 2000):
            parts.extend(scorer.histograms(_lower(values.slice(i, 2000))).tolist())
        return pa.array(parts, pa.list_(pa.int64()))

    rows = sample.select("toxic", histogram("text").alias("h")).collect()  # bounded sample
    by_saved = np.array([r["h"] for r in rows], float)
    y = np.array([r["toxic"] for r in rows], float)
    plain = y == 0
    often, seldom = (
        (n + 0.5) / (n.sum() + 0.5 * len(n))
        for n in (by_saved[~plain].sum(axis=0), by_saved[plain].sum(axis=0))
    )
    # Saving more never speaks for less.
    model.weights = np.maximum.accumulate(np.log(often / seldom)).tolist()
    x = _bins(by_saved @ np.array(model.weights))
    all_known = {
        r["toxic"]: r["count"] for r in
        marks.where(F.col("toxic").isNotNull() & (fold(FOLDS) != HELD_OUT))
        .groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()
    }
    weight = np.where(plain, all_known.get(0, 1) / n_ordinary, all_known.get(1, 1) / n_toxic)
    model.table = _isotonic(x, y, weight)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score``."""
    ship(docs.sparkSession)
    return docs.withColumn("_score", score_column(model, whole_text(docs)))


def _rows_scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row``, a whole row of ``docs`` whatever its columns are named, and ``score``."""
    ship(docs.sparkSession)
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        score_column(model, whole_text(docs)).alias("score"),
    )


def without_toxic(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that are not found toxic, with their columns."""
    kept = _rows_scored(docs, train(docs, marks)).where(F.col("score") < threshold)
    return kept.select("row.*")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
