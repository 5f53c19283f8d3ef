"""Quality classifier: held-out labels, shrinkage of sparse sites, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapline.llm import quality as Q

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, source string, lang string, quality string, host string"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = Q.classified(docs, labels.where(~held)).where(held).join(labels.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), "doc_id").collect()
    toxic = [r for r in out if r["t"]]
    assert np.mean([r["toxic_posterior"] >= 0.5 for r in toxic]) > 0.7
    assert np.mean([r["toxic_posterior"] < 0.5 for r in out if not r["t"]]) > 0.97
    assert np.mean([(r["quality_posterior"] >= 0.5) == bool(r["q"]) for r in out]) > 0.93
    good = [r for r in out if r["q"] and not r["t"]]
    assert np.mean([r["keep"] for r in good]) > 0.95


def test_sparse_sites_are_shrunk(spark):
    rng = np.random.default_rng(1)
    rows = [("big", "p", float(x)) for x in np.clip(rng.normal(0.9, 0.05, 400), 0, 1)]
    rows += [("low", f"q{k % 4}", float(x)) for k, x in enumerate(np.clip(rng.normal(0.2, 0.05, 400), 0, 1))]
    rows += [(f"h{k}", "p", float(x)) for k, x in enumerate(np.clip(rng.normal(0.5, 0.2, 60), 0, 1))]
    rows += [("big", "rare", 0.1), ("big", "rare", 0.1), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "host string, path string, e double")
    out = Q.with_sites(df, "e").collect()
    assert len(out) == len(rows)
    prior = np.mean([r[2] for r in rows])
    big = [r["e_site"] for r in out if r["host"] == "big" and r["path"] == "p"]
    rare = [r["e_site"] for r in out if r["path"] == "rare"]
    single = [r["e_site"] for r in out if (r["host"] or "").startswith("h")]
    assert abs(np.mean(big) - 0.9) < 0.03 and all(0.1 < x < 0.9 for x in rare)
    assert all(abs(x - prior) < 0.02 for x in single)
    assert all((r["e_posterior"] > r["e"]) == (r["e_site"] > prior) for r in out if 0.01 < r["e"] < 0.99 and abs(r["e_site"] - prior) > 1e-6)


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x", "h"), (2, "", "s", None, "x", "h"), (2, "", "s", None, "x", "h"), (None, "good text", None, "en", "x", "h"), (4, "word " * 300_000, "s", "en", "x", "h")]
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 0, 0), (None, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    out = Q.classified(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r[f"{c}_posterior"] <= 1 for r in out for c in ("quality", "toxic"))
    none = Q.classified(docs, labels.limit(0)).collect()
    assert all(abs(r["quality"] - 0.5) < 1e-9 for r in none)
    assert Q.classified(docs.limit(0), labels).collect() == []
