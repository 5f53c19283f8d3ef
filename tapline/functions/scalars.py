"""Number parsing, identifiers, time text and other row-local helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint text per failure status code.
FAILURE_HINTS = {
    408: "Request Timeout — no timely response from the peer.",
    481: "Call/Transaction Does Not Exist — dialog state mismatch.",
    488: "Not Acceptable Here — typically a codec mismatch.",
    491: "Request Pending — competing re-INVITEs (glare).",
    500: "Server Internal Error.",
    503: "Service Unavailable — peer overloaded or marked down.",
    606: "Not Acceptable — media negotiation failure.",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use`` applied to a value that is worked out once per row.

    Binds the value to a lambda variable; without it every mention of a long
    expression is evaluated again.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x) -> Column:
    """Trim every kind of white space on both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def blank_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(""))


def parse_int(x) -> Column:
    """Decimal or 0x-prefixed text to BIGINT; anything else, or a number beyond it, is null."""
    x = _c(x)
    # Sixteen digits after leading zeros fill 64 bits; more are out of range.
    hexa = F.conv(F.regexp_extract(x, r"^0[xX]0*([0-9a-fA-F]{1,16})$", 1), 16, 10).try_cast("bigint")
    return F.when(x.rlike(r"^0[xX]0*[0-9a-fA-F]{1,16}$"), hexa).when(
        x.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(x).try_cast("bigint")
    )


def parse_float(x) -> Column:
    x = _c(x)
    ok = x.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(ok, x.try_cast("double"))


def split_ints(x) -> Column:
    """Comma list to an int array; unreadable pieces stay as null entries."""
    x = _c(x)
    pieces = F.split(F.replace(x, F.lit(" "), F.lit("")), ",")
    return F.when(
        F.coalesce(F.length(x), F.lit(0)) > 0, F.transform(pieces, parse_int)
    ).otherwise(F.array().cast("array<bigint>"))


def ssrc_hex(x, missing: str | None = "?") -> Column:
    x = _c(x)
    text = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.when(x.isNotNull(), text).otherwise(F.lit(missing))


def flow_key(src_ip, src_port, dst_ip, dst_port) -> Column:
    def part(v):
        return F.coalesce(_c(v).cast("string"), F.lit(""))

    return F.concat(
        part(src_ip), F.lit(":"), part(src_port), F.lit("->"), part(dst_ip), F.lit(":"), part(dst_port)
    )


def endpoint_text(ip, port) -> Column:
    """ip:port, the ip alone, or "unknown"."""
    ip = F.coalesce(blank_to_null(ip), F.lit("unknown"))
    port = _c(port)
    return F.when(port.isNotNull(), F.concat(ip, F.lit(":"), port.cast("string"))).otherwise(ip)


def round_exact(x, digits: int) -> Column:
    """Round the exact binary value of a double, true ties to the even digit.

    Spark rounds the shortest decimal text of a double instead, which turns
    2.675 (below the tie in binary) into 2.68. The product with the power of
    ten is split into its rounded value and its exact error, and the error
    decides where the rounded value falls on a tie.
    """
    scale = float(10**digits)

    def split(v: Column) -> Column:
        wide = v * F.lit(134217729.0)
        high = wide - (wide - v)
        p = v * F.lit(scale)
        error = (high * F.lit(scale) - p) + (v - high) * F.lit(scale)
        return F.struct(p.alias("p"), error.alias("e"), F.floor(p).cast("double").alias("f"))

    def settle(s: Column) -> Column:
        rest = s["p"] - s["f"]
        odd = F.pmod(s["f"], F.lit(2.0)) == 1.0
        up = (rest > 0.5) | ((rest == 0.5) & ((s["e"] > 0) | ((s["e"] == 0) & odd)))
        return (s["f"] + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)

    return let(_c(x).cast("double"), lambda v: let(split(v), settle))


def one_decimal(x, digits: int = 1) -> Column:
    """Fixed-point text with the same rounding."""
    return F.format_string(f"%.{digits}f", round_exact(x, digits))


def _utc(seconds) -> Column:
    """Epoch seconds as a zone-free timestamp, independent of the session zone."""
    micros = round_exact(_c(seconds) * F.lit(1e6), 0).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def epoch_to_utc(x, digits: int = 6) -> Column:
    """UTC text of epoch seconds with micro- or millisecond digits."""
    return F.date_format(_utc(x), "yyyy-MM-dd'T'HH:mm:ss." + "S" * digits + "'Z'")


def utc_day(x) -> Column:
    return F.date_format(_utc(x), "yyyy-MM-dd")


def format_duration(seconds) -> Column:
    """HH:MM:SS.mmm; "unknown" for null or negative input."""
    s = _c(seconds)

    def text(ms: Column) -> Column:
        return F.format_string(
            "%02d:%02d:%02d.%03d",
            F.floor(ms / F.lit(3600000)).cast("bigint"),
            (F.floor(ms / F.lit(60000)) % 60).cast("bigint"),
            (F.floor(ms / F.lit(1000)) % 60).cast("bigint"),
            (ms % 1000).cast("bigint"),
        )

    return F.when(s >= 0, let(round_exact(s * F.lit(1000.0), 0).cast("bigint"), text)).otherwise(F.lit("unknown"))


def failure_hint(code) -> Column:
    out = F.lit(None).cast("string")
    for number, text in FAILURE_HINTS.items():
        out = F.when(_c(code) == number, F.lit(text)).otherwise(out)
    return out


def cseq_method(method="method", cseq="cseq") -> Column:
    """Upper-cased method, else the last word of a CSeq of two or more words."""
    words = F.filter(F.split(_c(cseq), r"\s+"), lambda w: w != "")
    return F.coalesce(
        F.upper(blank_to_null(method)),
        F.when(F.size(words) >= 2, F.upper(F.element_at(words, -1))),
    )


def is_request(method="method", status="status_code") -> Column:
    return F.coalesce(_c(method) != "", F.lit(False)) & _c(status).isNull()


def is_response(status="status_code") -> Column:
    return _c(status).isNotNull()


def infer_rtcp_port(port, rtcp_port, rtcp_mux) -> Column:
    """Explicit port, else the media port when multiplexed, else port + 1."""
    port = _c(port)
    return F.coalesce(
        _c(rtcp_port), F.when(_c(rtcp_mux), port), F.when(port != 0, port + F.lit(1))
    )


def contact_host(x) -> Column:
    return blank_to_null(F.regexp_extract(_c(x), r"@([^>;\s]+)", 1))


def sdp_origin_address(x) -> Column:
    words = F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def aor_from_header(x) -> Column:
    return blank_to_null(F.regexp_extract(_c(x), r"(?i)sip:[^>;\s]+", 0))


def via_branch(x) -> Column:
    return blank_to_null(F.regexp_extract(_c(x), r"(?i)branch=([^;,\s]+)", 1))


def via_sent_by(x) -> Column:
    words = F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.element_at(F.split(F.element_at(words, 2), ";"), 1))


def case_dir_name(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("@"), F.lit("_at_")), F.lit("/"), F.lit("_"))


def stream_label(stream_id, ssrc, dst_ip, dst_port) -> Column:
    """Name of a stream in finding text: declared id, SSRC or destination."""
    return F.coalesce(
        F.concat(F.lit("stream "), blank_to_null(stream_id)),
        F.when(_c(ssrc).isNotNull(), F.concat(F.lit("SSRC "), ssrc_hex(ssrc))),
        F.concat(_c(dst_ip), F.lit(":"), F.coalesce(_c(dst_port).cast("string"), F.lit("None"))),
    )


def participant_text(name, aor) -> Column:
    """"NAME (ident)" where ident is the AOR between ":" and "@"."""
    aor = _c(aor)
    after = F.when(
        F.instr(aor, ":") > 0, F.regexp_extract(aor, r"(?s)^[^:]*:(.*)$", 1)
    ).otherwise(aor)
    ident = blank_to_null(F.element_at(F.split(after, "@"), 1))
    name = blank_to_null(name)
    return F.coalesce(
        F.concat(name, F.lit(" ("), ident, F.lit(")")), name, ident
    )


def parse_capture_info(text) -> Column:
    """snaplen / truncated / drops out of a capture-information text report."""
    lines = F.split(_c(text), r"\r\n|\r|\n")
    size_line = lambda l: F.lower(l).contains("packet size limit") | F.lower(l).contains("snaplen")
    drop_line = lambda l: ~size_line(l) & (
        F.lower(l).contains("number of dropped") | F.lower(l).contains("drop count")
    )

    def last_number(pred):
        hits = F.filter(
            F.transform(F.filter(lines, pred), lambda l: F.regexp_extract(l, r"([0-9]+)", 1)),
            lambda v: v != "",
        )
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)).try_cast("bigint")

    return F.struct(
        last_number(size_line).alias("snaplen"),
        F.exists(lines, lambda l: size_line(l) & F.lower(l).contains("truncat")).alias("truncated"),
        last_number(drop_line).alias("drops"),
    )
