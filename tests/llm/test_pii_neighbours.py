"""Values beside other numbers."""

import re

import pytest

from tapline.llm import pii

SCHEMA = "doc_id bigint, text string"
CARD = "4111111111111111"


def report(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r for r in pii.report(df, "k").orderBy("doc_id").collect()]


def test_cards_beside_other_numbers_are_replaced_and_linked(spark):
    forms = [CARD, "4111 1111 1111 1111", "4111-1111-1111-1111", "41 11 1111 1111 1111"]
    new = report(spark, [CARD])[0]["text"]
    assert re.fullmatch(r"4\d{15}", new) and new != CARD
    texts = [t.format(f) for f in forms for t in ("{} 12/25", "{} 123", "12 {}", "{} 12th", "1234 {}", "{0} {0}", "no {0} 1234567 items", "{} 1 2 3 4 5 6 7 8 9")]
    for text, row in zip(texts, report(spark, texts), strict=True):
        n = sum(text.count(f) for f in forms[:3]) or text.count(forms[3])
        if "41 11" in text and ("12 41" in text or "1234 41" in text):
            continue  # digits before a card in no usual form: several readings may be valid
        assert row["n_values"] == n, (text, row["text"])
        assert re.sub(r"\d", "9", row["text"]) == re.sub(r"\d", "9", text)
        assert re.sub(r"[ -]", "", row["text"]) == re.sub(r"[ -]", "", text).replace(CARD, new), (text, row["text"])
    amex = report(spark, ["3782 822463 10005 1234", "378282246310005"])
    assert amex[0]["text"].replace(" ", "") == amex[1]["text"] + "1234"


@pytest.mark.parametrize("value", ["212-555-0199", "12/25/2024", "10.1.2.3", "2024-02-29", "29.02.2024", "123-45-6789", "12@mail.example.com"])
def test_a_value_after_a_number_is_not_swallowed(spark, value):
    alone, after, before = report(spark, [value, f"{CARD} {value}", f"{value} {CARD}"])
    card = report(spark, [CARD])[0]["text"]
    assert after["text"] == f"{card} {alone['text']}" and before["text"] == f"{alone['text']} {card}"


def test_dates_with_a_time(spark):
    date, stamp, other = report(spark, ["2024-02-29", "at 2024-02-29T10:00Z", "2024-02-29Tx"])
    assert date["text"] != "2024-02-29" and stamp["text"] == f"at {date['text']}T10:00Z" and other["n_values"] == 0


def test_long_rows_of_numbers(spark):
    text = "1 " * 500 + CARD + " 2" * 500
    row = report(spark, [text])[0]
    assert CARD not in row["text"] and re.sub(r"\d", "9", row["text"]) == re.sub(r"\d", "9", text)
