"""Session descriptions: SDP text to a session struct with a media array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, strip

# Fixed values.
DIRECTIONS = ("sendrecv", "sendonly", "recvonly", "inactive")
ACTIVE_DIRECTIONS = ("sendrecv", "sendonly", "recvonly")
MEDIA_TYPES = ("audio", "video")

MEDIA_TYPE = (
    "struct<media_idx:int,media_type:string,port:int,protocol:string,payload_types:array<string>,"
    "connection_address:string,direction:string,label:string,mid:string,rtcp_port:int,"
    "rtcp_mux:boolean,rtpmap:map<string,string>,fmtp:map<string,string>,"
    "attributes:map<string,array<string>>>"
)


def _last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def _connection(value: Column) -> Column:
    return let(_words(value), lambda w: F.coalesce(F.try_element_at(w, F.lit(3)), _last(w)))


def _values_of(lines: Column, key: str) -> Column:
    return F.transform(
        F.filter(lines, lambda l: F.substring(l, 1, 1) == key),
        lambda l: strip(F.substring(l, 3, 1 << 30)),
    )


def _attributes(lines: Column) -> Column:
    return F.transform(
        _values_of(lines, "a"),
        lambda v: F.struct(
            strip(F.split_part(v, F.lit(":"), F.lit(1))).alias("name"),
            strip(F.regexp_extract(v, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )


def _named(attrs: Column, *names: str) -> Column:
    return F.filter(attrs, lambda a: a["name"].isin(*names))


def _last_value(attrs: Column, name: str) -> Column:
    return _last(F.filter(F.transform(_named(attrs, name), lambda a: a["value"]), lambda v: v != ""))


def _keyed_map(attrs: Column, name: str) -> Column:
    """First word of the value -> rest of the value; later lines overwrite."""
    named = F.filter(
        F.transform(
            _named(attrs, name),
            lambda a: F.struct(
                F.split_part(a["value"], F.lit(" "), F.lit(1)).alias("k"),
                strip(F.regexp_extract(a["value"], r"(?s)^[^ ]* (.*)$", 1)).alias("v"),
            ),
        ),
        lambda p: p["k"] != "",
    )

    def folded(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.map_from_entries(
            F.transform(keys, lambda k: F.struct(k, _last(F.filter(pairs, lambda p: p["k"] == k))["v"]))
        )

    return let(named, folded)


def _grouped(attrs: Column) -> Column:
    keys = F.array_distinct(F.transform(attrs, lambda a: a["name"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k, F.transform(F.filter(attrs, lambda a: a["name"] == k), lambda a: a["value"])
            ),
        )
    )


def _port(words: Column) -> Column:
    text = F.split_part(F.try_element_at(words, F.lit(2)), F.lit("/"), F.lit(1))
    return F.when((F.size(words) >= 3) & text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def _to_media(section: Column, idx: Column) -> Column:
    """Media struct of a section: its m= words, port and following lines."""
    w, port, lines = section["words"], section["port"], section["lines"]

    def built(attrs: Column) -> Column:
        rtcp = F.filter(
            F.transform(_named(attrs, "rtcp"), lambda a: F.split_part(a["value"], F.lit(" "), F.lit(1))),
            lambda t: t.rlike("^[0-9]+$"),
        )
        return F.struct(
            idx.alias("media_idx"),
            F.element_at(w, 1).alias("media_type"),
            port.alias("port"),
            F.element_at(w, 3).alias("protocol"),
            F.slice(w, F.lit(4), F.greatest(F.size(w) - 3, F.lit(0))).alias("payload_types"),
            _last(F.transform(_values_of(lines, "c"), _connection)).alias("connection_address"),
            _last(F.transform(_named(attrs, *DIRECTIONS), lambda a: a["name"])).alias("direction"),
            _last_value(attrs, "label").alias("label"),
            _last_value(attrs, "mid").alias("mid"),
            _last(rtcp).try_cast("int").alias("rtcp_port"),
            (F.size(_named(attrs, "rtcp-mux")) > 0).alias("rtcp_mux"),
            _keyed_map(attrs, "rtpmap").alias("rtpmap"),
            _keyed_map(attrs, "fmtp").alias("fmtp"),
            _grouped(attrs).alias("attributes"),
        )

    return let(_attributes(lines), built)


def parse_sdp(text) -> Column:
    """SDP text to struct(connection_address, origin, session_name, media).

    Lines are cut into sections at every m= line. A malformed m= line opens a
    section without media: its c= line counts for the session, its a= lines
    for nothing.
    """
    text = F.col(text) if isinstance(text, str) else text

    def session(x: Column) -> Column:
        lines, marks = x["lines"], x["marks"]
        stops = F.concat(F.filter(marks, lambda m, i: i > 0), F.array(F.size(lines) + 1))

        def section(m: Column, i: Column) -> Column:
            own = F.slice(lines, m, F.element_at(stops, i + 1) - m)
            words = _words(strip(F.substring(F.element_at(lines, m), 3, 1 << 30)))
            return let(words, lambda w: F.struct(own.alias("lines"), w.alias("words"), _port(w).alias("port")))

        head = F.slice(
            lines, F.lit(1), F.coalesce(F.try_element_at(marks, F.lit(1)) - 1, F.size(lines))
        )

        def built(sections: Column) -> Column:
            bad = F.transform(F.filter(sections, lambda s: s["port"].isNull()), lambda s: s["lines"])
            loose = F.concat(head, F.flatten(bad))
            return F.struct(
                _last(F.transform(_values_of(loose, "c"), _connection)).alias("connection_address"),
                _last(_values_of(lines, "o")).alias("origin"),
                _last(_values_of(lines, "s")).alias("session_name"),
                F.transform(F.filter(sections, lambda s: s["port"].isNotNull()), _to_media).alias("media"),
            )

        return let(F.transform(marks, section), built)

    def marked(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda l, i: F.when(F.substring(l, 1, 1) == "m", i + F.lit(1))),
            lambda i: i.isNotNull(),
        )
        return let(F.struct(lines.alias("lines"), marks.alias("marks")), session)

    lines = F.filter(
        F.transform(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n"), strip),
        lambda l: F.substring(l, 2, 1) == "=",
    )
    return F.when(text.isNotNull(), let(lines, marked))


def directions_of(media) -> Column:
    return F.filter(F.transform(media, lambda m: m["direction"]), lambda d: d.isNotNull())


def all_inactive(media) -> Column:
    """Some line has a direction, and every one that has is inactive."""
    media = F.col(media) if isinstance(media, str) else media
    d = directions_of(media)
    return F.coalesce((F.size(d) > 0) & F.forall(d, lambda x: x == "inactive"), F.lit(False))


def any_active(media) -> Column:
    media = F.col(media) if isinstance(media, str) else media
    return F.coalesce(F.exists(directions_of(media), lambda x: x.isin(*ACTIVE_DIRECTIONS)), F.lit(False))


def media_direction(media) -> Column:
    """Representative direction of a message: inactive, else its first active one."""
    media = F.col(media) if isinstance(media, str) else media
    d = directions_of(media)
    active = F.filter(d, lambda x: x.isin(*ACTIVE_DIRECTIONS))
    return (
        F.when(all_inactive(media), F.lit("inactive"))
        .when(F.size(active) > 0, F.element_at(active, 1))
        .when(F.size(d) > 0, F.element_at(d, 1))
    )


def offered_payloads(media) -> Column:
    """Payload types of the audio and video lines, in order."""
    media = F.col(media) if isinstance(media, str) else media
    real = F.filter(media, lambda m: m["media_type"].isin(*MEDIA_TYPES))
    return F.coalesce(
        F.flatten(F.transform(real, lambda m: m["payload_types"])), F.array().cast("array<string>")
    )
