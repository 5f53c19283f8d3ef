"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text are hashed into ``FEATURES`` columns.
Document frequencies are counted over all training rows; the model is fitted on a sample of
at most about ``SAMPLE_PER_LANGUAGE`` training rows a language, by follow-the-regularised-
leader with elastic-net penalties (most weights stay exactly zero); every fifth sample row
is kept aside to fit the temperature that calibrates the probabilities.

Cases: a text that is null or has no letter is ``und`` with score 0; rows with null ``lang``
teach nothing; without any training row every text is ``und``; repeated rows and null ids
keep their rows (a null id counts as held out); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, mix

FEATURES = 1 << 14
#: Bound of the sample the weights are fitted on (rows a language); counts use all rows.
SAMPLE_PER_LANGUAGE = 1_500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Fewest letters and least calibrated score of a text that the pipeline keeps.
REJECT_BELOW = 0.5
UNKNOWN = "und"

_U = np.uint64
_PART = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a text's character n-grams; parts of a long text are added up."""
    total = np.zeros(FEATURES, np.int64)
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), _PART):
        code = points[max(0, at - 2) : at + _PART].astype(np.uint64)
        skip = min(2, at)
        for size in (1, 2, 3):
            # Every gram is counted in the part in which it ends.
            begin = max(0, skip - size + 1)
            n = len(code) - begin - size + 1
            if n <= 0:
                continue
            gram = np.full(n, size, np.uint64)
            for k in range(size):
                gram = gram * _U(0x110000) + code[begin + k : begin + k + n]
            total += np.bincount((mix(gram) >> _U(50)).astype(np.int64), minlength=FEATURES)
    columns = np.flatnonzero(total)
    return columns, total[columns]


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each hashed n-gram, over all of ``train``; FEATURES numbers at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                columns, _ = _counts(text)
                found[columns] += 1
                rows += 1
        found[FEATURES] = rows
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["place", "rows"])

    total = train.select("text").mapInArrow(run, "place bigint, rows bigint").groupBy("place").agg(F.sum("rows").alias("rows")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for place, rows in total:
        out[place] = rows
    return out[:FEATURES], int(out[FEATURES])


@dataclass
class Model:
    """Weights (classes x features), bias, inverse document frequencies and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        columns, counts = _counts(text)
        values = (1 + np.log(counts)) * self.idf[columns]
        return columns, values / max(float(np.sqrt((values * values).sum())), 1e-12)

    def logits(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, columns] @ values + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> None:
    """Follow-the-regularised-leader, per coordinate, with L1 and L2 penalties; sets the weights."""
    classes = len(model.languages)
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        lean = z[:, at]
        w = -(lean - np.sign(lean) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2)
        return np.where(np.abs(lean) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            columns, values, label = rows[k]
            at, x = np.append(columns, FEATURES), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(w @ x)
            error[label] -= 1
            g = error[:, None] * x
            before = n[:, at]
            after = before + g * g
            z[:, at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[:, at] = after
    final = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = final[:, :FEATURES], final[:, FEATURES]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _by_content(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> int:
    """Order of two sample rows: label, number of columns, columns, values."""
    for get in (lambda r: r[2], lambda r: len(r[0]), lambda r: r[0].tobytes(), lambda r: r[1].astype(np.float64).tobytes()):
        if (x := get(a)) != (y := get(b)):
            return -1 if x < y else 1
    return 0


def fit(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """A model from (doc_id, text, lang).

    The sample is the part of ``train`` with the smallest hashes of id and text, so that
    copies of a text don't come in together; its expected size is bounded.
    """
    train = train.where("lang is not null and text is not null").select("text", "lang", "doc_id").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(counts)
    found, rows = _document_frequencies(train)
    idf = np.log((1 + rows) / (1 + found)) + 1
    model = Model(languages, np.zeros((len(languages), FEATURES)), np.zeros(len(languages)), idf)
    if not languages:
        return model
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))))
    sample = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [model.features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
            ["lang", "columns", "values"],
        )

    held = arrow_map(sample, "lang string, columns array<int>, values array<float>", run).toArrow()
    number = {lang: k for k, lang in enumerate(languages)}
    data = []
    for batch in held.to_batches():
        # Views of the batch's buffers: the sample stands in the driver's memory once.
        columns, values = (batch.column(k).values.to_numpy() for k in (1, 2))
        starts, ends = (batch.column(1).offsets.to_numpy()[cut] for cut in (slice(None, -1), slice(1, None)))
        data += [(columns[i:j], values[i:j], number[lang]) for lang, i, j in zip(batch.column(0).to_pylist(), starts, ends, strict=True)]
    # The rows come in task order; the order of their contents makes the fit the same in every run.
    data.sort(key=cmp_to_key(_by_content))
    aside = data[::5] if len(data) >= 50 else []
    _ftrl(model, [r for k, r in enumerate(data) if not aside or k % 5], epochs)
    if aside:
        model.temperature = _temperature(np.array([model.logits(c, v) for c, v, _ in aside]), np.array([y for _, _, y in aside]))
    return model


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [known.value.predict(t) for t in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return arrow_map(docs, schema, run)


def accepted(docs: DataFrame, model: Model, least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose language is known with a calibrated score of ``least`` or more."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [known.value.predict(t) for t in batch.column(place).to_pylist()]
        yield batch.filter(pa.array([x != UNKNOWN and p >= least for x, p in found], pa.bool_()))

    return arrow_map(docs, docs.schema, run)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()))
    found = predict(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
