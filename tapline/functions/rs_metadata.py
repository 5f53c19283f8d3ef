"""Recording metadata XML to typed structs, namespace- and spelling-tolerant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blank_to_null, let, strip
from .text import body_parts, is_rs_metadata, maybe_hex_decode

# Fixed values.
RECORDING_NAMESPACE = "urn:ietf:params:xml:ns:recording:1"
RECORDING_REGION = (
    r"(?is)<\s*([A-Za-z0-9_]*:)?recording\b.*?</\s*([A-Za-z0-9_]*:)?recording\s*>"
)

RECORDING_ROOT = r"(?i)<\s*([A-Za-z0-9_]*:)?recording\b"
CUT_REGION = r"(?is)<\s*([A-Za-z0-9_]*:)?recording\b.*"
_ELEMENTS = "participantsessionassoc|participantstreamassoc|participant|sessionrecordingassoc|session|stream"
# A whole child element: an empty tag, or everything up to its own end tag.
_WHOLE_CHILD = rf"(?s)<((?:[\w.\-]+:)?(?:{_ELEMENTS}))\b(?:[^>]*/>|[^>]*(?<!/)>.*?</\1\s*>)"

_XML_SCHEMA = (
    "struct<"
    "participant:array<struct<_participant_id:string,_participantid:string,"
    "nameID:array<struct<_aor:string,name:array<string>>>>>,"
    "stream:array<struct<_stream_id:string,_streamid:string,_session_id:string,"
    "label:array<string>,type:array<string>>>,"
    "session:array<struct<_session_id:string,_sessionid:string>>,"
    "participantstreamassoc:array<struct<_participant_id:string,_participantid:string,"
    "send:array<string>,recv:array<string>,sendrecv:array<string>>>,"
    "participantsessionassoc:array<struct<_participant_id:string,_participantid:string,"
    "_session_id:string,_sessionid:string>>"
    ">"
)


def _first_text(xs: Column) -> Column:
    return blank_to_null(strip(F.try_element_at(xs, F.lit(1))))


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(blank_to_null(a), b, F.lit(""))


def _or_empty(x: Column, sql_type: str) -> Column:
    return F.coalesce(x, F.array().cast(sql_type))


def metadata_version(xml: Column) -> Column:
    """"1" when the root element lies in the recording namespace."""
    root = r"(?s)^(?:\s++|<\?.*?\?>|<!--.*?-->)*+<(?:([A-Za-z_][\w.\-]*):)?[A-Za-z_][\w.\-]*([^>]*)>"
    prefix = F.regexp_extract(xml, root, 1)
    attrs = F.regexp_extract(xml, root, 2)
    name = F.when(prefix == "", F.lit("xmlns")).otherwise(F.concat(F.lit("xmlns:"), prefix))
    declared = F.concat(
        F.lit("(?s)(^|\\s)"), name, F.lit("\\s*=\\s*[\"']" + RECORDING_NAMESPACE + "[\"']")
    )
    return F.when(F.regexp_like(attrs, declared), F.lit("1"))


def _present(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def _participants(doc: Column) -> Column:
    def one(p: Column) -> Column:
        ident = F.try_element_at(p["nameID"], F.lit(1))
        return F.struct(
            _either(p["_participant_id"], p["_participantid"]).alias("participant_id"),
            _first_text(ident["name"]).alias("name"),
            ident["_aor"].alias("aor"),
        )

    return _or_empty(
        F.transform(_present(doc["participant"]), one),
        "array<struct<participant_id:string,name:string,aor:string>>",
    )


def _links(doc: Column) -> Column:
    """Participant and the streams it sends or receives, per association."""
    def refs(a: Column) -> Column:
        return F.concat(*[_or_empty(a[k], "array<string>") for k in ("send", "recv", "sendrecv")])

    return _or_empty(
        F.transform(
            _present(doc["participantstreamassoc"]),
            lambda a: F.struct(
                _either(a["_participant_id"], a["_participantid"]).alias("pid"),
                F.transform(refs(a), strip).alias("refs"),
            ),
        ),
        "array<struct<pid:string,refs:array<string>>>",
    )


def _streams(doc: Column) -> Column:
    def wired(links: Column) -> Column:
        def one(s: Column) -> Column:
            return let(
                _either(s["_stream_id"], s["_streamid"]),
                lambda sid: F.struct(
                    sid.alias("stream_id"),
                    s["_session_id"].alias("session_id"),
                    _first_text(s["type"]).alias("media_type"),
                    _first_text(s["label"]).alias("label"),
                    F.array_sort(
                        F.array_distinct(
                            F.transform(
                                F.filter(links, lambda l: (sid != "") & F.array_contains(l["refs"], sid)),
                                lambda l: l["pid"],
                            )
                        )
                    ).alias("participant_ids"),
                ),
            )

        return F.transform(_present(doc["stream"]), one)

    return _or_empty(
        let(_links(doc), wired),
        "array<struct<stream_id:string,session_id:string,media_type:string,label:string,participant_ids:array<string>>>",
    )


def _sessions(doc: Column, participants: Column, streams: Column) -> Column:
    known = F.transform(participants, lambda p: p["participant_id"])
    members = _or_empty(
        F.transform(
            _present(doc["participantsessionassoc"]),
            lambda a: F.struct(
                _either(a["_participant_id"], a["_participantid"]).alias("pid"),
                _either(a["_session_id"], a["_sessionid"]).alias("sid"),
            ),
        ),
        "array<struct<pid:string,sid:string>>",
    )
    ids = F.array_distinct(
        _or_empty(
            F.transform(_present(doc["session"]), lambda s: _either(s["_session_id"], s["_sessionid"])),
            "array<string>",
        )
    )

    def one(sid: Column) -> Column:
        mine = F.transform(F.filter(members, lambda m: (m["sid"] == sid) & (sid != "")), lambda m: m["pid"])
        return F.struct(
            sid.alias("session_id"),
            F.array_sort(F.array_distinct(F.filter(mine, lambda pid: F.array_contains(known, pid)))).alias("participant_ids"),
            F.transform(F.filter(streams, lambda s: s["session_id"] == sid), lambda s: s["stream_id"]).alias("stream_ids"),
        )

    return F.transform(ids, one)


def _parsed(text: Column) -> Column:
    return F.from_xml(text, _XML_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def _complete_children(text: Column) -> Column:
    """A document of the child elements that are whole, without prefixes.

    Text outside of elements and what follows the last whole element is left out.
    """
    children = F.array_join(F.regexp_extract_all(text, F.lit(_WHOLE_CHILD), F.lit(0)), "")
    plain = F.regexp_replace(F.regexp_replace(children, r"(</?)[\w.\-]+:", "$1"), r"(\s)[\w.\-]+:([\w.\-]+\s*=)", "$1$2")
    return F.concat(F.lit("<recording>"), plain, F.lit("</recording>"))


def _recovered(text: Column) -> Column:
    """The document; where it can't be read, the one of its complete elements."""
    def found(doc: Column) -> Column:
        lists = ("participant", "stream", "session", "participantstreamassoc", "participantsessionassoc")
        return F.when(F.coalesce(*[F.size(doc[c]) for c in lists]).isNull(), _parsed(_complete_children(text))).otherwise(doc)

    return let(_parsed(text), found)


def parse_rs_metadata(xml) -> Column:
    """XML text to struct(version, raw_xml, participants, streams, sessions).

    Of XML that can't be read, the elements that are complete count; raw_xml keeps the text.
    """
    xml = F.col(xml) if isinstance(xml, str) else xml

    def built(text: Column) -> Column:
        doc = _recovered(text)
        lists = let(
            doc, lambda d: F.struct(d.alias("doc"), _participants(d).alias("participants"), _streams(d).alias("streams"))
        )
        return let(
            lists,
            lambda x: F.struct(
                metadata_version(text).alias("version"),
                text.alias("raw_xml"),
                x["participants"].alias("participants"),
                x["streams"].alias("streams"),
                _sessions(x["doc"], x["participants"], x["streams"]).alias("sessions"),
            ),
        )

    return let(xml, lambda t: F.when(t.isNotNull(), built(t)))


def salvaged_xml(*texts) -> Column:
    """First recording element found in any of the texts; one that is cut off goes to the end of its text."""
    decoded = [maybe_hex_decode(t) for t in texts]
    found = [blank_to_null(F.regexp_extract(t, region, 0)) for region in (RECORDING_REGION, CUT_REGION) for t in decoded]
    return F.coalesce(*found)


def metadata_xml(body, content_type, raw_headers) -> Column:
    """Metadata document of a message: the first metadata part with a root element, else a salvaged region."""
    parts = F.filter(
        body_parts(body, content_type),
        lambda p: is_rs_metadata(p["content_type"]) & (strip(p["content"]) != ""),
    )
    rooted = F.filter(parts, lambda p: p["content"].rlike(RECORDING_ROOT))
    return F.coalesce(
        F.try_element_at(rooted, F.lit(1))["content"], salvaged_xml(body, raw_headers), F.try_element_at(parts, F.lit(1))["content"]
    )
