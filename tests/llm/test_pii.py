"""Format-preserving pseudonyms: permutations, formats, links and untouched text."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tapline.llm import pii

SCHEMA = "doc_id bigint, text string, parts string, row int, kind string"


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def new_of(spark, values, key="k"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    rows = df.select("i", pii.pseudonym(F.col("text"), key).alias("p")).orderBy("i").collect()
    return [None if r["p"] is None else (r["p"]["kind"], r["p"]["new"]) for r in rows]


def test_feistel_is_a_permutation(spark):
    df = spark.range(35 * 11).select((F.col("id") % 35).alias("a"), F.floor(F.col("id") / 35).alias("b"))
    rows = df.select(pii.feistel(F.col("a"), F.col("b"), F.lit(35), F.lit(11), "k", "t").alias("s")).collect()
    got = {(r["s"]["a"], r["s"]["b"]) for r in rows}
    assert got == {(a, b) for a in range(35) for b in range(11)}


def test_dates_are_permuted_among_all_days(spark):
    assert (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1 == 17 * 4297
    day = datetime.date(1900, 1, 1)
    df = spark.range(0, 73049, 1).select(F.date_format(F.date_add(F.lit(day), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    out = df.select(pii._date(F.col("t"), "k", 1, 6, 9, "yyyy-MM-dd").alias("n"))
    assert out.where("n is null").count() == 0 and out.distinct().count() == 73049


def test_small_digit_strings_are_permuted(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    rows = df.select(pii.permuted_digits(F.col("d"), "k", "t").alias("n")).collect()
    assert sorted(r["n"] for r in rows) == [f"{i:03}" for i in range(1000)]


def test_formats_stay_valid(spark):
    values = ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "123-45-6789", "+1 (974) 555-3436", "212-555-0199", "10.0.255.1", "2024-02-29", "29.02.2024", "12/31/1999", "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71", "Jo.Doe@mail3.example.com"]
    got = new_of(spark, values)
    assert [k for k, _ in got] == ["card", "card", "card", "ssn", "phone", "phone", "ip", "date", "date", "date", "secret", "email"]
    for old, (kind, new) in zip(values, got, strict=True):
        assert new != old
        if kind != "email" and kind != "ip":
            assert re.sub(r"[0-9a-f]" if kind == "secret" else r"\d", "9", new) == re.sub(r"[0-9a-f]" if kind == "secret" else r"\d", "9", old)
    assert luhn(got[0][1]) and luhn(got[2][1]) and got[1][1].replace(" ", "") == got[0][1]
    datetime.date.fromisoformat(got[7][1])
    assert "-".join(reversed(got[8][1].split("."))) == got[7][1]
    assert all(0 <= int(x) < 256 for x in got[6][1].split("."))
    assert got[4][1].startswith("+1 (9") and got[4][1][9] == "5"
    assert new_of(spark, values, "other") != got and new_of(spark, values) == got


def test_invalid_values_are_left(spark):
    assert new_of(spark, ["4111111111111112", "666-12-1234", "000-12-1234", "256.1.1.1", "1.2.3.04", "2023-02-29", "1899-12-31", "2100-01-01", "31/12/1999", "a" * 40, "1" * 40]) == [None] * 11


def test_text_between_values_is_untouched(spark):
    texts = [
        "call +1 (017) 555-7713 or 4111111111111111, and 4111111111111111 again", "4111111111111111", "no value here", "", None,
        "version 2.0 and 3.1 of 1234567890123 items", "x4111111111111111", "a@b.co@c.de", "é 10.1.2.3. ü\n\x01$1\\E", "9" * 5000 + " " + "a." * 3000,
    ]
    df = spark.createDataFrame([(i, t, "p", 1, "k") for i, t in enumerate(texts)] + [(None, "10.1.2.3", "p", 1, "k")] * 2, SCHEMA)
    out = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert out[0]["n_values"] == 3 and re.fullmatch(r"call \+1 \(0\d\d\) 5\d\d-\d{4} or (\d{16}), and \1 again", out[0]["text"])
    assert out[0]["text"].split(" or ")[1][:16] == out[1]["text"]
    for i in (2, 3, 4, 5, 6, 9):
        assert out[i]["text"] == texts[i] and out[i]["n_values"] == 0
    assert re.fullmatch(r"é \d+\.\d+\.\d+\.\d+\. ü\n\x01\$1\\E", out[8]["text"]) and "10.1.2.3" not in out[8]["text"]
    whole = pii.pseudonymised(df)
    assert whole.columns == df.columns and whole.count() == len(texts) + 2
    assert len({r["text"] for r in whole.where("doc_id is null").collect()}) == 1
    assert pii.report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("bad", ["+1 (974) 555-3436", "248.167.124.71", "thhe.58@mail5.example.com"])
def test_no_value_of_a_kind_stays(spark, bad):
    out = pii.report(spark.createDataFrame([(1, f"so {bad}, and {bad} ({bad})\n{bad}", "p", 1, "k")], SCHEMA)).collect()[0]
    assert bad not in out["text"] and out["n_values"] == 4 and len({x["new"] for x in out["pseudonyms"]}) == 1


def test_no_python_on_the_main_path(spark):
    plan = pii.pseudonymised(spark.createDataFrame([(1, "t", "p", 1, "k")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_long_labels_leave_the_stack_alone(spark):
    """Addresses of 200,000 labels, digits in 100,000 groups: Java's patterns must not recurse for each."""
    texts = ["a@b" + ".b" * 200_000, "x " + "12 " * 100_000, "1.2" * 100_000, "a." * 200_000 + "@b.c"]
    rows = spark.createDataFrame([(i, t, "p", 1, "k") for i, t in enumerate(texts)], SCHEMA)
    assert pii.report(rows).count() == 4
