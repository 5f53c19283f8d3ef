"""SIP text, multipart bodies and hex bodies as column expressions.

Everything here is evaluated per message row inside the JVM. Arrays hold the
lines or parts of one message, so their size is bounded by one datagram.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blank_to_null, let, strip, via_branch, via_sent_by

# Fixed values.
METADATA_TYPES = ("application/rs-metadata", "application/rs-metadata+xml")
CANONICAL_METADATA_TYPE = "application/rs-metadata+xml"
HEX_MIN_CHARS = 8
PRINTABLE_SHARE = 0.85
STATUS_LINE = r"(?i)^SIP/2\.0\s+(\d{3})\s*(.*)$"
REQUEST_LINE = r"^([A-Za-z]+)\s+(\S+)\s+SIP/2\.0\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_type_base(x) -> Column:
    return F.lower(strip(F.split_part(_c(x), F.lit(";"), F.lit(1))))


def is_rs_metadata(x) -> Column:
    return F.coalesce(content_type_base(x).isin(*METADATA_TYPES), F.lit(False))


def normalize_content_type(x) -> Column:
    return F.when(is_rs_metadata(x), F.lit(CANONICAL_METADATA_TYPE)).otherwise(_c(x))


def header_boundary(content_type) -> Column:
    return blank_to_null(
        strip(F.regexp_extract(_c(content_type), r'(?i)boundary="?([^";]+)"?', 1))
    )


def sniffed_boundary(body) -> Column:
    return blank_to_null(F.regexp_extract(_c(body), r"(?m)^--([A-Za-z0-9'()+_,\-./:=?]+)\s*$", 1))


def maybe_hex_decode(text) -> Column:
    """Readable text of an all-hex body; any other body stays as it is."""
    text = _c(text)

    def readable(decoded: Column) -> Column:
        kept = F.length(F.regexp_replace(decoded, r"[\p{C}\p{Z}&&[^ \r\n\t]]", ""))
        share = kept.cast("double") / F.greatest(F.length(decoded), F.lit(1))
        return F.when(share >= PRINTABLE_SHARE, decoded)

    def from_bytes(raw: Column) -> Column:
        as_text = raw.cast("string")
        return let(
            F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(raw, "ISO-8859-1")), readable
        )

    def from_packed(packed: Column) -> Column:
        is_hex = (
            (F.length(packed) >= HEX_MIN_CHARS)
            & (F.length(packed) % 2 == 0)
            & packed.rlike("^[0-9a-fA-F]+$")
        )
        return F.when(is_hex, let(F.unhex(packed), from_bytes))

    decoded = let(F.regexp_replace(strip(text), "[: \n]", ""), from_packed)
    # A first look at the leading characters spares plain text the full scan.
    return F.when(text.rlike(r"^\s*[0-9a-fA-F: \n]{8}"), F.coalesce(decoded, text)).otherwise(text)


def _name_values(lines: Column) -> Column:
    """name (lower-cased) and value of every line that has a colon."""
    return F.transform(
        F.filter(lines, lambda l: F.instr(l, ":") > 0),
        lambda l: F.struct(
            F.lower(strip(F.regexp_extract(l, r"(?s)^([^:]*):", 1))).alias("name"),
            strip(F.regexp_extract(l, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )


def header_value(headers: Column, *names: str) -> Column:
    """Last value of a header; further names are used when the first is absent or empty."""

    def last_of(name: str) -> Column:
        hits = F.filter(headers, lambda h: h["name"] == name)
        return F.try_element_at(hits, F.lit(-1))["value"]

    picks = [last_of(name) for name in names]
    return F.coalesce(*[blank_to_null(p) for p in picks[:-1]], picks[-1])


def _before_blank_line(x: Column) -> Column:
    pos = F.instr(x, "\n\n")
    return F.when(pos > 0, F.substring(x, F.lit(1), pos - 1)).otherwise(x)


def _after_blank_line(x: Column) -> Column:
    pos = F.instr(x, "\n\n")
    return F.when(pos > 0, F.substring(x, pos + 2, F.length(x))).otherwise(F.lit(""))


def body_parts(body, content_type) -> Column:
    """Parts of a message body: array of (headers, content_type, content).

    A body without a boundary is one part under the message's own type.
    """
    ctype = _c(content_type)

    def to_part(s: Column) -> Column:
        def built(headers: Column) -> Column:
            return F.struct(
                headers.alias("headers"),
                header_value(headers, "content-type").alias("content_type"),
                F.regexp_replace(_after_blank_line(s), r"^\n+|\n+$", "").alias("content"),
            )

        return let(_name_values(F.split(_before_blank_line(s), "\n")), built)

    def parts(text: Column) -> Column:
        # Without a boundary in the header, a boundary line anywhere in the body decides.
        found = F.coalesce(header_boundary(ctype), sniffed_boundary(text))

        def cut(boundary: Column) -> Column:
            pieces = F.transform(
                F.split(
                    F.replace(text, F.lit("\r\n"), F.lit("\n")), F.concat(F.lit("\\Q--"), boundary, F.lit("\\E"))
                ),
                lambda s: F.regexp_replace(s, r"^\n+|\n+$", ""),
            )
            whole = F.array(
                F.struct(
                    F.array().cast("array<struct<name:string,value:string>>").alias("headers"),
                    ctype.alias("content_type"),
                    text.alias("content"),
                )
            )
            split = F.transform(F.filter(pieces, lambda s: (s != "") & (strip(s) != "--")), to_part)
            return F.when(boundary.isNotNull(), split).otherwise(whole)

        return F.when(text.isNotNull(), let(found, cut))

    return let(maybe_hex_decode(body), parts)


def parse_sip_text(raw) -> Column:
    """One SIP message text to a struct; ``error`` is set instead of raising."""
    raw = _c(raw)

    def message(x: Column) -> Column:
        start, headers, block, body = x["start"], x["headers"], x["block"], x["body"]
        is_status = start.rlike(STATUS_LINE)
        is_req = ~is_status & start.rlike(REQUEST_LINE)
        via = header_value(headers, "via", "v")
        return F.struct(
            header_value(headers, "call-id", "i").alias("call_id"),
            F.when(is_req, F.upper(F.regexp_extract(start, REQUEST_LINE, 1))).alias("method"),
            F.when(is_status, F.regexp_extract(start, STATUS_LINE, 1).try_cast("int")).alias("status_code"),
            F.when(is_status, blank_to_null(strip(F.regexp_extract(start, STATUS_LINE, 2)))).alias("reason_phrase"),
            header_value(headers, "cseq").alias("cseq"),
            header_value(headers, "from", "f").alias("from_header"),
            header_value(headers, "to", "t").alias("to_header"),
            header_value(headers, "contact", "m").alias("contact"),
            header_value(headers, "content-type", "c").alias("content_type"),
            block.alias("raw_headers"),
            F.when(strip(body) != "", body).alias("body"),
            header_value(headers, "user-agent").alias("user_agent"),
            header_value(headers, "server").alias("server"),
            via_branch(via).alias("via_branch"),
            via_sent_by(via).alias("via_sent_by"),
            F.when(strip(block) == "", F.lit("Empty SIP message."))
            .when(~is_status & ~is_req, F.concat(F.lit("Unrecognized SIP start line: "), start))
            .alias("error"),
        )

    def sections(unix: Column) -> Column:
        return let(F.split(_before_blank_line(unix), "\n"), lambda lines: let(
            F.struct(
                strip(F.element_at(lines, 1)).alias("start"),
                _name_values(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("headers"),
                _before_blank_line(unix).alias("block"),
                _after_blank_line(unix).alias("body"),
            ),
            message,
        ))

    return let(F.regexp_replace(raw, "\r\n|\r", "\n"), sections)
