"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is a logistic model of hashed words, word beginnings and binned
text statistics, fitted by follow-the-regularised-leader on a bounded sample of labelled
rows. Sites add to it: grouped aggregation over all documents gives the mean evidence of each
host and of each path within a host; variance components estimated from the same groups say
how strongly a sparse path is shrunk toward its host and a sparse host toward the global
prior; a document's log odds move by what its site's posterior differs from the prior. Its own
share is taken out of its site, so it doesn't count twice.

Cases: null texts count as empty; null hosts and paths are a site of their own; rows whose
label is null teach nothing; without labels, or with one class only, evidence is the labels'
mean (0.5 without any); repeated rows and null ids keep their rows (a null id has no label;
of several labels of an id the mean counts); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, blocks, lower_ascii, only_listed, span_hashes, stage, text_column, word_spans

#: Bound of the sample a model is fitted on (expected rows of each class).
SAMPLE_PER_CLASS = 2_500
BINS, HASHED = 64, (1 << 16) - 64
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
_EDGES = np.array([0.0, 0.003, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64


def features(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of each of the joined rows."""
    low = lower_ascii(data)
    starts, ends, rows = word_spans(low, bounds, _SPLIT)
    n = len(bounds) - 1
    whole = span_hashes(low, starts, ends)
    begin = span_hashes(low, starts, np.minimum(ends, starts + 6)) ^ _U(0xABCDEF)
    count = np.bincount(rows, minlength=n)
    size = np.maximum(np.diff(bounds), 1)
    marks = np.add.reduceat(np.append(_SPLIT[data] & (data > 32), False), np.minimum(bounds[:-1], len(data))) * (np.diff(bounds) > 0)
    digits = np.add.reduceat(np.append((data > 47) & (data < 58), False), np.minimum(bounds[:-1], len(data))) * (np.diff(bounds) > 0)
    again = np.bincount(rows[1:], (whole[1:] == whole[:-1]) & (rows[1:] == rows[:-1]), minlength=n)
    edge = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for k in range(n):
        words, heads = whole[edge[k] : edge[k + 1]], begin[edge[k] : edge[k + 1]]
        distinct = len(np.unique(words)) / max(1, count[k])
        stats = (marks[k] / size[k], digits[k] / size[k], again[k] / max(1, count[k]), distinct)
        bins = [j * 16 + int(np.searchsorted(_EDGES, x, "right")) for j, x in enumerate(stats)]
        hashed = np.unique(np.concatenate([words, heads]) % _U(HASHED)).astype(np.int64)
        # A statistic of the whole text weighs as much as several words.
        out.append((np.concatenate([bins, hashed + BINS]), np.concatenate([np.full(len(bins), 6.0), np.ones(len(hashed))])))
    return out


@dataclass
class Evidence:
    """A logistic model: weights, bias and the log odds of labels over those of the sample."""

    weights: np.ndarray
    bias: float = 0.0

    def score(self, columns: np.ndarray, values: np.ndarray) -> float:
        z = float(self.weights[columns] @ values) + self.bias
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Evidence:
    size = BINS + HASHED + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        lean = z[at]
        return np.where(np.abs(lean) <= L1, 0.0, -(lean - np.sign(lean) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            columns, values, label = rows[k]
            at, x = np.append(columns, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(float(w @ x), -30, 30))) - label) * x
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
            n[at] = after
    final = weights(np.arange(size))
    return Evidence(final[:-1], float(final[-1]))


def fit(sample: DataFrame, none: int, some: int) -> Evidence:
    """A model from sampled rows (text, label 0 or 1) of ``none`` and ``some`` rows in all."""
    if not none or not some:
        odds = (some + 0.5 * (not none)) / max(1e-9, none + 0.5 * (not some)) if none or some else 1.0
        return Evidence(np.zeros(BINS + HASHED), float(np.clip(np.log(odds), -20, 20)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = text_column(batch.column(0))
        for i, j in blocks(bounds):
            found = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["label", "columns", "values"])

    held = arrow_map(sample, "label int, columns array<int>, values array<float>", run).toArrow()
    rows = [(c.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64), y) for y, c, v in zip(held["label"].to_pylist(), held["columns"], held["values"], strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    model = _ftrl(rows)
    ones = max(1, sum(y for _, _, y in rows))
    model.bias += float(np.log(some / none) - np.log(ones / max(1, len(rows) - ones)))
    return model


def fit_all(rows: DataFrame, marks: DataFrame, labels: list[str], per_class: int = SAMPLE_PER_CLASS) -> dict[str, Evidence]:
    """A model for each label of ``marks`` (doc_id, labels 0 or 1) from ``rows`` (doc_id, text).

    Classes are counted over all labelled documents by their ids; only the sample's texts
    are fetched.
    """
    ids = stage(marks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-marks")
    counts = ids.agg(*(F.count_if(F.col(c) == y).alias(f"{c}{y}") for c in labels for y in (0, 1))).first()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = {c: F.when(F.col(c) == 1, min(1.0, per_class / max(1, counts[f"{c}1"]))).when(F.col(c) == 0, min(1.0, per_class / max(1, counts[f"{c}0"]))).otherwise(0.0) for c in labels}
    chosen = ids.select("doc_id", *(F.when(place < share[c] * (1 << 20), F.col(c)).alias(c) for c in labels))
    chosen = stage(chosen.where(F.coalesce(*labels).isNotNull()), "quality-chosen")
    taught = stage(only_listed(rows.select("doc_id", "text"), "doc_id", chosen).join(chosen, "doc_id"), "quality-taught")
    return {c: fit(taught.where(F.col(c).isNotNull()).select("text", F.col(c).alias("label")), counts[f"{c}0"], counts[f"{c}1"]) for c in labels}


def scored(docs: DataFrame, models: dict[str, Evidence]) -> DataFrame:
    """doc_id, host, path and the evidence of each model, for rows (doc_id, text, host, path)."""
    known = docs.sparkSession.sparkContext.broadcast(models)
    names = list(models)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = text_column(batch.column(3))
        for i, j in blocks(bounds):
            found = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            scores = [pa.array([known.value[m].score(c, v) for c, v in found], pa.float64()) for m in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *scores], ["doc_id", "host", "path", *names])

    schema = "doc_id bigint, host string, path string" + "".join(f", {m} double" for m in names)
    return arrow_map(docs.select("doc_id", "host", "path", "text"), schema, run)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def with_sites(rows: DataFrame, evidence: str) -> DataFrame:
    """``rows`` (host, path, evidence...) with ``<evidence>_site`` and ``<evidence>_posterior``.

    Paths and hosts are reduced by grouped sums (combined before the shuffle, so a hot host
    costs a row a task); five numbers reach the driver.
    """
    p = F.col(evidence)
    paths = stage(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count("*").alias("parts"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"))
    hosts = stage(hosts, "quality-hosts")
    t = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.count("*").alias("hosts"), F.sum("parts").alias("parts"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("between"), F.sum("ss").alias("within_paths"), F.sum(F.col("hn") * F.col("hn")).alias("nn"), F.sum(F.col("nn") / F.col("hn")).alias("path_nn"),
    ).first()
    total = t["n"] or 1
    prior = (t["s"] or 0.0) / total if t["n"] else 0.5
    # One-way variance components: of documents in paths, of paths in hosts, of hosts.
    noise = max(1e-9, ((t["q"] or 0.0) - (t["within_paths"] or 0.0)) / max(1, total - (t["parts"] or 0)))
    spread = lambda gain, groups, size: max(1e-9, (gain - max(groups, 0) * noise) / max(size, 1e-9))
    of_paths = spread((t["within_paths"] or 0.0) - (t["between"] or 0.0), (t["parts"] or 0) - (t["hosts"] or 0), total - (t["path_nn"] or 0.0))
    of_hosts = spread((t["between"] or 0.0) - total * prior * prior, (t["hosts"] or 0) - 1, total - (t["nn"] or 0.0) / total)
    k_path, k_host = min(1e6, noise / of_paths), min(1e6, noise / of_hosts)
    sites = paths.join(hosts.select("host", "hn", "hs"), paths["host"].eqNullSafe(hosts["host"]), "left").select(paths["host"].alias("site_host"), paths["path"].alias("site_path"), "n", "s", "hn", "hs")
    joined = rows.join(sites, rows["host"].eqNullSafe(sites["site_host"]) & rows["path"].eqNullSafe(sites["site_path"]), "left")
    host_mean = (F.col("hs") - p + k_host * prior) / (F.col("hn") - 1 + k_host)
    path_mean = (F.col("s") - p + k_path * host_mean) / (F.col("n") - 1 + k_path)
    out = joined.select(*rows.columns, F.least(F.greatest(path_mean, F.lit(0.0)), F.lit(1.0)).alias(f"{evidence}_site"))
    z = _logit(p) + _logit(F.col(f"{evidence}_site")) - _logit(F.lit(prior))
    return out.withColumn(f"{evidence}_posterior", 1 / (1 + F.exp(-z)))


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, evidence, site means and posteriors of quality and toxicity, and ``keep``.

    A document is kept if good quality is likelier than not and toxicity is not.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*((F.avg(c) >= 0.5).cast("int").alias(c) for c in ("quality", "toxic")))
    models = fit_all(rows, marks, ["quality", "toxic"], per_class)
    found = stage(scored(rows, models), "quality-scored")
    for c in models:
        found = with_sites(found, c)
    keep = (F.col("quality_posterior") >= 0.5) & (F.col("toxic_posterior") < 0.5)
    return found.select("doc_id", *(f"{c}{part}" for c in models for part in ("", "_site", "_posterior")), keep.alias("keep"))
