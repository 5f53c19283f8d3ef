"""Format-preserving pseudonyms of personal numbers, dates and addresses, in SQL functions only.

Values are found by pattern and validated (check digit, calendar, number ranges); a keyed
Feistel network permutes each within its own format, so the pseudonym is valid again, and
equal values have equal pseudonyms in all documents. Rounds add a keyed hash of one half to
the other half modulo its size, which makes every step a permutation.

| kind | validated by | what is permuted |
| --- | --- | --- |
| card | 13-19 digits in whole groups, check digit | all digits but the first; the check digit follows |
| ssn | ranges of area, group, serial | the number among all valid ones |
| phone | ten digits in groups | all but country code and the first digits of area and exchange |
| ip | four octets without leading zeros | the 32 bits |
| date | calendar, years 1900-2099 | the day among all days of these years |
| secret | 32, 40 or 64 lower-case hex digits, letter and digit among them | all digits |
| email | address pattern | replaced by a keyed name at ``mail.invalid`` |

Cases: null texts stay null, empty ones empty; a value that fails its validation is left
alone; repeated rows and null ids keep their rows; an empty table gives no rows; other
columns are passed on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: A key for tests and the registered query; a caller passes its own.
DEMO_KEY = "not-a-secret"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)"
ISO_DATE = r"(?<![0-9A-Za-z/-])\d{4}-\d{2}-\d{2}(?![0-9A-SU-Za-z/-]|T(?!\d\d))"
DOT_DATE = r"(?<![0-9A-Za-z.])\d{2}\.\d{2}\.\d{4}(?![0-9A-Za-z]|\.\d)"
US_DATE = r"(?<![0-9A-Za-z/])\d{2}/\d{2}/\d{4}(?![0-9A-Za-z/])"
SSN = r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])"
#: A document without this has no value; most texts are told by this short pattern alone.
HINT = r"[0-9@]"
OTHER = "|".join((EMAIL, SECRET, IP, ISO_DATE, DOT_DATE, US_DATE, SSN, PHONE))
#: Groups of digits in which cards are looked for, up to where another value begins.
RUN = r"(?<![0-9A-Za-z])(?=\d(?:[ -]?\d){12})\d++(?![A-Za-z])(?:[ -](?!" + OTHER + r")\d++(?![A-Za-z]))*+"
#: Digits of the groups of a card as they are usually written.
USUAL = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{4}\3\d{5})$"
ANY = OTHER + "|" + RUN

_AREAS = 898  # 001-899 without 666
_FIRST_DAY, _DAYS_A, _DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days end with 2099-12-31


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _keyed(key: str, *parts: Column | str) -> Column:
    """60 bits of a keyed hash as a number."""
    said = F.concat_ws("|", F.lit(key), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs with 0 <= a < size_a and 0 <= b < size_b."""

    def step(s: Column, r: Column) -> Column:
        own = (s["a"] + _keyed(key, kind, size_a, size_b, r, s["b"])) % size_a
        other = (s["b"] + _keyed(key, kind, size_a, size_b, r, s["a"])) % size_b
        even = r % 2 == 0
        return F.struct(F.when(even, own).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(other).alias("b"))

    begin = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once (a let binding: fold over one element)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _number(digits: Column) -> Column:
    return digits.cast("bigint")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        v = n - u
        mixed = feistel(_number(F.substring(d, F.lit(1), u)), _number(F.substring(d, u + 1, v)), _power(u), _power(v), key, kind)
        return _with(mixed, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, F.lit("0")), F.lpad(s["b"].cast("string"), v, F.lit("0"))))

    return _with(digits, halves)


def laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, everything else in place."""

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def _luhn_total(digits: Column, doubled: int) -> Column:
    """Digit sum with every other digit doubled, from the right; ``doubled`` is the first place doubled."""
    turned = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when((i - doubled) % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _card(value: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _with(body, lambda b: laid_out(value, F.concat(b, ((10 - _luhn_total(b, 1) % 10) % 10).cast("string"))))

    return _with(_digits(value), lambda d: F.when(_luhn_total(d, 2) % 10 == 0, new(d)))


def _phone(value: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        country, last = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, F.length(d) - 9, F.lit(10))
        moved = permuted_digits(F.concat(F.substring(last, 2, 2), F.substring(last, 5, 6)), key, "phone")
        return _with(moved, lambda m: laid_out(value, F.concat(country, F.substring(last, 1, 1), F.substring(m, 1, 2), F.substring(last, 4, 1), F.substring(m, 3, 6))))

    return _with(_digits(value), new)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def new(s: Column) -> Column:
        place = F.floor(s["a"] / 99)
        area = F.when(place >= 665, place + 2).otherwise(place + 1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _with(feistel(place * 99 + group - 1, serial - 1, F.lit(_AREAS * 99), F.lit(9999), key, "ssn"), new))


def _ip(value: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        n = [o[k].cast("bigint") for k in range(4)]
        mixed = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
        return _with(mixed, lambda s: F.concat_ws(".", *(x.cast("bigint").cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))))

    valid = F.forall(F.split(value, r"\."), lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0")))
    return F.when(valid, _with(F.split(value, r"\."), new))


def _date(value: Column, key: str, year: int, month: int, day: int, form: str) -> Column:
    """A date whose parts begin at these places; ``form`` writes it."""
    iso = F.concat_ws("-", F.substring(value, year, 4), F.substring(value, month, 2), F.substring(value, day, 2))
    at = F.datediff(iso.try_cast("date"), F.lit(_FIRST_DAY).cast("date"))

    def new(n: Column) -> Column:
        mixed = feistel(F.floor(n / _DAYS_B), n % _DAYS_B, F.lit(_DAYS_A), F.lit(_DAYS_B), key, "date")
        return _with(mixed, lambda s: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["a"] * _DAYS_B + s["b"]).cast("int")), form))

    return _with(at, lambda n: F.when(n.between(0, _DAYS_A * _DAYS_B - 1), new(n)))


def _secret(value: Column, key: str) -> Column:
    """Hex digits in blocks of eight; each round adds a hash of all other blocks to one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 8).cast("int") - 1), lambda i: F.conv(F.substring(value, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))

    def step(state: Column, r: Column) -> Column:
        n = F.size(state)
        others = F.concat_ws(",", F.transform(F.filter(state, lambda x, i: i != r % n), lambda x: x.cast("string")))
        return F.transform(state, lambda x, i: F.when(i == r % n, (x + _keyed(key, "secret", n, r, others)) % (1 << 32)).otherwise(x))

    mixed = F.aggregate(F.sequence(F.lit(0), (F.length(value) / 2).cast("int") - 1), blocks, step)  # four turns each
    new = F.concat_ws("", F.transform(mixed, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))
    return F.when(value.rlike("[a-f]") & value.rlike("[0-9]"), new)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)).cast("binary"), 256), 1, 16), F.lit("@mail.invalid"))


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, new) of one matched value; null where it fails its validation."""
    kinds = (
        ("email", EMAIL, _email(value, key)), ("secret", SECRET, _secret(value, key)), ("ip", IP, _ip(value, key)),
        ("date", ISO_DATE, _date(value, key, 1, 6, 9, "yyyy-MM-dd")), ("date", DOT_DATE, _date(value, key, 7, 4, 1, "dd.MM.yyyy")),
        ("date", US_DATE, _date(value, key, 7, 1, 4, "MM/dd/yyyy")), ("ssn", SSN, _ssn(value, key)), ("phone", PHONE, _phone(value, key)), ("card", CARD, _card(value, key)),
    )
    found = None
    for kind, pattern, new in kinds:
        made = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
        match = value.rlike(_whole(pattern))
        found = F.when(match, made) if found is None else found.when(match, made)
    return _with(found, lambda s: F.when(s["new"].isNotNull(), s))


def _pieces(run: Column) -> Column:
    """A run of digit groups as its cards, which begin and end at group borders, and what is between them.

    At each group a valid card in a usual form goes first, then the longest valid one in
    another form that holds no beginning of a valid usual one.
    """

    def valid(text: Column) -> Column:
        return _with(_digits(text), lambda d: F.length(d).between(13, 19) & (_luhn_total(d, 2) % 10 == 0))

    def sizes(groups: Column) -> Column:
        """struct(usual, others): groups of the valid cards at each group."""

        def at(i: Column) -> Column:
            texts = F.transform(F.sequence(F.lit(1), F.least(F.size(groups) - i, F.lit(19))), lambda n: F.regexp_replace(F.array_join(F.slice(groups, i + 1, n), ""), "[ -]$", ""))
            good = F.filter(texts, valid)
            count = lambda t: F.size(F.split(t, "[ -]"))
            return F.struct(F.coalesce(F.array_max(F.transform(F.filter(good, lambda t: t.rlike(USUAL)), count)), F.lit(0)).alias("usual"), F.transform(good, count).alias("others"))

        return F.transform(groups, lambda g, i: at(i))

    def taken(found: Column) -> Column:
        """Groups of the card that begins at each group, 0 for none."""
        free = lambda x, i: F.filter(x["others"], lambda n: ~F.exists(F.slice(found, i + 2, n - 1), lambda y: y["usual"] > 0))
        return F.transform(found, lambda x, i: F.when(x["usual"] > 0, x["usual"]).otherwise(F.coalesce(F.array_max(free(x, i)), F.lit(0))))

    def cut(groups: Column, counts: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            n = F.element_at(counts, i)
            text = F.array_join(F.slice(groups, i, F.greatest(n, F.lit(1))), "")
            both = F.array(F.regexp_replace(text, "[ -]$", ""), F.regexp_extract(text, "[ -]$", 0))
            on = i < s["next"]
            return F.struct(F.when(on, s["out"]).otherwise(F.concat(s["out"], both)).alias("out"), F.when(on, s["next"]).otherwise(i + F.greatest(n, F.lit(1))).alias("next"))

        begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), begin, step, lambda s: s["out"])

    return _with(F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0)), lambda g: _with(sizes(g), lambda z: _with(taken(z), lambda c: F.when(F.exists(c, lambda n: n > 0), cut(g, c)).otherwise(F.array(run)))))


def parts(text: Column) -> Column:
    """struct(gaps, values): the text between matches and the pieces of each match."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    values = F.transform(matches, lambda v: F.when(v.rlike(_whole(OTHER)), F.array(v)).otherwise(_pieces(v)))
    return F.when(text.rlike(HINT), F.struct(F.split(text, ANY, -1).alias("gaps"), values.alias("values")))


def made(p: Column, key: str) -> Column:
    """The pseudonyms of the pieces in ``parts``."""
    return F.transform(p["values"], lambda pieces: F.transform(pieces, lambda v: pseudonym(v, key)))


def joined(p: Column, made: Column, text: Column) -> Column:
    """The text of ``parts`` with the pseudonyms in place."""
    new = F.zip_with(p["values"], made, lambda v, m: F.array_join(F.zip_with(v, m, lambda x, y: F.coalesce(y["new"], x)), ""))
    whole = F.array_join(F.zip_with(p["gaps"], new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    return F.when(p.isNull(), text).otherwise(whole)


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; all columns stay."""
    rows = docs.select(F.struct("*").alias("row"), parts(F.col("text")).alias("parts")).select("row", "parts", made(F.col("parts"), key).alias("made"))
    return rows.select(*(joined(F.col("parts"), F.col("made"), F.col("row.text")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """doc_id, text, n_values and the pseudonyms (kind, new) in order of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", parts(F.col("text")).alias("parts")).select("*", made(F.col("parts"), key).alias("made"))
    found = F.coalesce(F.filter(F.flatten("made"), lambda m: m.isNotNull()), F.array().cast("array<struct<kind:string,new:string>>"))
    return rows.select("doc_id", joined(F.col("parts"), F.col("made"), F.col("text")).alias("text"), F.size(found).cast("bigint").alias("n_values"), found.alias("pseudonyms"))
