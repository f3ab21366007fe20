"""Payloads to cues: flat JSON, segmented JSON, SRT and VTT, told apart by how they begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.functions.names import let

_CUES = "array<struct<start:double,end:double,text:string>>"
_FLAT = "body array<struct<`from`:double,`to`:double,content:string>>"
_SEGMENTED = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def _or(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def flat_cues(payload: Column) -> Column:
    """array of cues from body[]{from,to,content}; missing times are 0; null without a body array."""
    body = F.from_json(payload, _FLAT)["body"]
    return F.transform(body, lambda x: _cue(_or(x["from"], 0.0), _or(x["to"], 0.0), _or(x["content"], "")))


def segmented_cues(payload: Column) -> Column:
    """array of cues from events[]{tStartMs,dDurationMs,segs[].utf8}; null without an events array."""
    events = F.from_json(payload, _SEGMENTED)["events"]
    text = lambda x: F.array_join(F.transform(F.coalesce(x["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: _or(s["utf8"], "")), "")
    return F.transform(events, lambda x: _cue(_or(x["tStartMs"], 0.0) / 1000, _or(x["tStartMs"], 0.0) / 1000 + _or(x["dDurationMs"], 0.0) / 1000, text(x)))


def timed_cues(payload: Column) -> Column:
    """array of cues from SRT or VTT, an entry for each block (null where no line opens one): in every block the first line
    with two readable times opens the cue, the lines after it are its text."""
    first = lambda side: F.try_element_at(F.filter(F.split(side, " "), lambda w: w != ""), F.lit(1))
    times = lambda line: F.when(line.contains("-->"), let(F.split(line, "-->"), lambda s: F.struct(T.parse_time(first(s[0])).alias("a"), T.parse_time(first(s[1])).alias("b"))))

    def cue(lines: Column) -> Column:
        body = lambda at: T.strip_tags(F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))
        opened = lambda ts, at: F.when(at > 0, let(F.element_at(ts, at), lambda t: _cue(t["a"], t["b"], body(at))))
        place = lambda ts: F.array_position(F.transform(ts, lambda t: t["a"].isNotNull() & t["b"].isNotNull()), F.lit(True)).cast("int")
        return let(F.transform(lines, times), lambda ts: let(place(ts), lambda at: opened(ts, at)))

    blocks = F.split(F.replace(payload, F.lit("\r"), F.lit("")), r"(?U)\n[\s&&[^\n]]*(?:\n[\s&&[^\n]]*)+")
    return F.transform(F.transform(blocks, lambda b: F.split(b, "\n")), cue)


def kind_of(payload: Column) -> Column:
    """json or timed, by the first character after a byte-order mark, blanks and ends of line."""
    return F.when(F.regexp_replace(payload, r"^[﻿ \t\r\n]+", "").rlike(r"^[\{\[]"), "json").otherwise("timed")


def _rows(payloads: DataFrame, cues: Column) -> DataFrame:
    """source_id, ord (place in the payload), start, end, text, without cues of no text."""
    rows = payloads.select("source_id", F.posexplode(cues.cast(_CUES)).alias("ord", "x")).select("source_id", "ord", "x.*")
    return rows.withColumn("text", T.clean_lines(F.col("text"))).filter("text <> ''")


def flat_json(payloads: DataFrame) -> DataFrame:
    return _rows(payloads, flat_cues(F.col("payload")))


def segmented_json(payloads: DataFrame) -> DataFrame:
    return _rows(payloads, segmented_cues(F.col("payload")))


def timed_text(payloads: DataFrame) -> DataFrame:
    return _rows(payloads, timed_cues(F.col("payload")))


def read_cues(payloads: DataFrame) -> DataFrame:
    """The cues of payloads (source_id, payload) of any kind, in one pass; what `rejected` lists has none."""
    start = F.regexp_replace("payload", r"^[﻿ \t\r\n]+", "")
    any_ = lambda p: F.when(kind_of(p) == "timed", timed_cues(p).cast(_CUES)).otherwise(F.coalesce(flat_cues(p), segmented_cues(p)).cast(_CUES))
    return _rows(payloads, let(start, any_))


def rejected(payloads: DataFrame) -> DataFrame:
    """source_id, reason of the payloads that are no subtitles: JSON without either array, or timed text without a cue."""
    some = lambda p: F.exists(timed_cues(p), lambda c: F.coalesce(T.clean_lines(c["text"]) != "", F.lit(False)))
    of_json = lambda p: F.when(flat_cues(p).isNull() & segmented_cues(p).isNull(), "no body or events")
    reason = lambda p: F.when(p.isNull(), "empty").when(kind_of(p) == "json", of_json(p)).when(~some(p), "no cue")
    start = F.regexp_replace("payload", r"^[﻿ \t\r\n]+", "")
    return payloads.select("source_id", F.explode(F.filter(F.array(let(start, reason)), lambda r: r.isNotNull())).alias("reason"))
