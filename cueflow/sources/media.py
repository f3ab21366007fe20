"""Payloads about media to rows: metadata, tracks, endpoints, probes, checkpoints, manifests, wire messages and frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.functions.names import let
from cueflow.operators import media

_NUMBERS = ("height", "fps", "quality", "filesize", "filesize_approx", "tbr", "abr")
_STRINGS = ("format_id", "url", "ext", "vcodec", "acodec")
_FORMAT = ", ".join(f"{c}: string" for c in (*_STRINGS, *_NUMBERS))
_SUBTITLE = "array<struct<ext: string, url: string, name: string>>"
_INFO = f"id string, title string, formats array<struct<{_FORMAT}>>, subtitles map<string, {_SUBTITLE}>, automatic_captions map<string, {_SUBTITLE}>"


def number(x: Column) -> Column:
    """A number that may stand in quotes; null if it is none."""
    return T.trimmed(x).try_cast("double")


def formats(payloads: DataFrame) -> DataFrame:
    """source_id, ord and the fields of formats[] in metadata JSON; missing strings are empty, numbers may be strings."""
    rows = payloads.select("source_id", F.posexplode(F.from_json("payload", _INFO)["formats"]).alias("ord", "f"))
    text = [F.coalesce(F.col("f")[c], F.lit("")).alias(c) for c in _STRINGS]
    return rows.select("source_id", "ord", *text, *[number(F.col("f")[c]).alias(c) for c in _NUMBERS])


def caption_entries(payloads: DataFrame, field: str, prefix: str, ai: bool = False) -> DataFrame:
    """source_id, id, language, ord, ext, url, name from the language map `field` (subtitles or automatic_captions)."""
    info = payloads.select("source_id", F.explode(F.from_json("payload", _INFO)[field]).alias("language", "list"))
    rows = info.select("source_id", "language", F.posexplode("list").alias("ord", "e")).select("source_id", "language", "ord", "e.*")
    own = F.when(F.lit(ai) & ~F.lower("language").startswith("ai-"), F.concat(F.lit("ai-"), "language")).otherwise(F.col("language"))
    return rows.withColumn("id", F.concat(F.lit(prefix), own))


def tracks(payloads: DataFrame, suffixes: tuple[str, str] = ("official", "AI")) -> DataFrame:
    """source_id, ord, id, label, official, ai, url of data.subtitle.subtitles[]: entries with a language and an http(s) url,
    the first of each id."""
    schema = "data struct<subtitle: struct<subtitles: array<struct<lan: string, lan_doc: string, subtitle_url: string, ai_type: string>>>>"
    rows = payloads.select("source_id", F.posexplode(F.from_json("payload", schema)["data"]["subtitle"]["subtitles"]).alias("ord", "t"))
    t = F.col("t")
    ai = (F.coalesce(t["ai_type"].try_cast("int"), F.lit(0)) != 0) | F.lower(t["lan"]).startswith("ai-") | F.coalesce(F.upper(t["lan_doc"]).contains("AI"), F.lit(False))
    rows = rows.filter((T.trimmed(t["lan"]) != "") & (T.trimmed(t["subtitle_url"]) != "")).select("source_id", "ord", *media.track_row(t["lan"], t["lan_doc"], t["subtitle_url"], ai, suffixes))
    return media.first_by(rows.filter("url is not null"), ["source_id", "id"], [F.col("ord")])


def endpoint_array(payload: Column) -> Column:
    """The items of dash.video[], dash.audio[], dash.dolby.audio[] and dash.flac.audio, in this order, as an array."""
    item = "struct<id: string, baseUrl: string, base_url: string, url: string, backupUrl: array<string>, backup_url: array<string>>"
    schema = f"dash struct<video: array<{item}>, audio: array<{item}>, dolby: struct<audio: array<{item}>>, flac: struct<audio: {item}>>"
    some = lambda x: F.coalesce(x, F.array().cast(f"array<{item}>"))
    single = lambda x: F.when(x.isNotNull(), F.array(x))
    every = lambda d: F.concat(some(d["video"]), some(d["audio"]), some(d["dolby"]["audio"]), some(single(d["flac"]["audio"])))
    return let(F.from_json(payload, schema)["dash"], lambda d: F.filter(every(d), lambda x: x.isNotNull()))


def endpoint_items(payloads: DataFrame) -> DataFrame:
    """source_id, ord, item: the same as rows."""
    return payloads.select("source_id", F.posexplode(endpoint_array(F.col("payload"))).alias("ord", "item"))


def probes(payloads: DataFrame) -> DataFrame:
    """source_id, width, height, duration (0 if unreadable), codec, container, direct of probe JSON: the first video stream
    with a width and a height; payloads (with ext) without one have no row."""
    schema = "format struct<duration: string, format_name: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int>>"

    def row(p: Column) -> Column:
        first = F.filter(p["streams"], lambda s: (s["codec_type"] == "video") & (s["width"] > 0) & (s["height"] > 0))
        one = lambda v: F.struct(v.alias("v"), F.coalesce(number(p["format"]["duration"]), F.lit(0.0)).alias("duration"), F.coalesce(p["format"]["format_name"], F.lit("")).alias("container"))
        return F.transform(F.slice(first, 1, 1), one)

    rows = payloads.select("source_id", "ext", F.explode(let(F.from_json("payload", schema), row)).alias("x")).select("source_id", "ext", "x.*")
    codec = F.lower(F.coalesce("v.codec_name", F.lit("")))
    return rows.select("source_id", "v.width", "v.height", "duration", codec.alias("codec"), "container", media.playable_directly(F.col("ext"), codec).alias("direct"))


_CUE = "struct<start: double, `end`: double, text: string, conf: double>"
CHECKPOINT = f"""parallelism int, duration double, lanes array<struct<index: int, core_start: double, core_end: double, scan_start: double,
  scan_end: double, media: double, frames: long, images: long, completed: boolean, cues: array<{_CUE}>, active: {_CUE}>>"""


def checkpoint_lanes(payloads: DataFrame) -> DataFrame:
    """source_id, parallelism, duration and the fields of lanes[] of checkpoint JSON; unreadable payloads have no rows."""
    lanes = let(F.from_json("payload", CHECKPOINT), lambda c: F.transform(c["lanes"], lambda l: F.struct(c["parallelism"].alias("parallelism"), c["duration"].alias("duration"), l.alias("l"))))
    return payloads.select("source_id", F.explode(lanes).alias("x")).select("source_id", "x.parallelism", "x.duration", "x.l.*")


def checkpoint_cues(lanes: DataFrame) -> DataFrame:
    """source_id, index, ord, active, start, end, text, conf: committed cues and then the active one of each lane."""
    active = F.when(F.col("active").isNotNull(), F.array("active"))
    none = F.array().cast(f"array<{_CUE}>")
    every = F.concat(F.transform(F.coalesce("cues", none), lambda c: F.struct(F.lit(False).alias("active"), c.alias("c"))), F.transform(F.coalesce(active, none), lambda c: F.struct(F.lit(True).alias("active"), c.alias("c"))))
    return lanes.select("source_id", "index", F.posexplode(every).alias("ord", "x")).select("source_id", "index", "ord", "x.active", "x.c.*")


def manifests(payloads: DataFrame, version: int) -> DataFrame:
    """source_id, version, total, chunk, completed of resume manifests of this version."""
    m = F.from_json("payload", "version int, total long, chunk long, completed array<int>")
    return payloads.select("source_id", m.alias("m")).select("source_id", "m.*").filter((F.col("version") == version) & F.col("completed").isNotNull())


def lines(text: DataFrame, name: str = "value") -> DataFrame:
    """Tab-separated lines of seven fields or more: the last two (name, value); blank lines and comments are skipped."""
    fields = F.split(name, "\t")
    rows = text.filter((T.trimmed(F.col(name)) != "") & ~F.col(name).startswith("#") & (F.size(fields) >= 7))
    return rows.select(F.element_at(fields, -2).alias("name"), F.element_at(fields, -1).alias("value"))


def wire_fields(data: bytes) -> list[tuple[int, int, int | None, bytes | None]]:
    """(field, wire type, number, bytes) of a protobuf message; ValueError for what is none."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = 0
        for shift in range(0, 64, 7):
            if at >= len(data):
                raise ValueError("a number is cut off")
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value & 0xFFFFFFFFFFFFFFFF
        raise ValueError("a number is too long")

    while at < len(data):
        field, wire = divmod(varint(), 8)
        if not field or wire not in (0, 1, 2, 5):
            raise ValueError("no such field or wire type")
        if wire == 0:
            out.append((field, wire, varint(), None))
            continue
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        if at + size > len(data):
            raise ValueError("a field is cut off")
        piece = data[at : at + size]
        at += size
        out.append((field, wire, None if wire == 2 else int.from_bytes(piece, "little"), piece if wire == 2 else None))
    return out


def wire_tracks(payloads: DataFrame) -> DataFrame:
    """source_id, ord, language, display, url from binary payloads: field 1 holds repeated fields 3 of {3 language, 4 display,
    5 url}. A payload that is no message has no rows."""

    def read(data: bytes | None) -> list[dict]:
        try:
            found = []
            for holder in (b for f, w, _, b in wire_fields(data or b"") if f == 1 and w == 2):
                for track in (b for f, w, _, b in wire_fields(holder) if f == 3 and w == 2):
                    one = {f: b.decode("utf-8", "replace") for f, w, _, b in wire_fields(track) if w == 2}
                    found.append({"language": one.get(3, ""), "display": one.get(4, ""), "url": one.get(5, "")})
            return found
        except ValueError:
            return []

    kind = pa.list_(pa.struct([("language", pa.string()), ("display", pa.string()), ("url", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(b) for b in batch.column(1).to_pylist()], kind)], names=["source_id", "tracks"])

    id_ = payloads.schema["source_id"].dataType.simpleString()
    rows = payloads.select("source_id", "payload").mapInArrow(run, f"source_id {id_}, tracks array<struct<language: string, display: string, url: string>>")
    return rows.select("source_id", F.posexplode("tracks").alias("ord", "t")).select("source_id", "ord", "t.*")


# Marks of a picture's begin and end, and the most that may wait for an end.
PICTURE, PICTURE_END, PENDING_MOST = b"\xff\xd8", b"\xff\xd9", 32 << 20


def frames(payloads: DataFrame) -> DataFrame:
    """source_id, frame (from 0), picture: the pictures in a byte stream; what stands before one is skipped, and one without
    an end is dropped (an error where more than PENDING_MOST bytes wait)."""

    def split(data: bytes) -> list[bytes]:
        out, at = [], data.find(PICTURE)
        while at >= 0:
            end = data.find(PICTURE_END, at + 2)
            if (len(data) if end < 0 else end) - at > PENDING_MOST:
                raise ValueError("a picture has no end")
            if end < 0:
                break
            out.append(data[at : end + 2])
            at = data.find(PICTURE, end + 2)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([split(b or b"") for b in batch.column(1).to_pylist()], pa.list_(pa.binary()))], names=["source_id", "pictures"])

    id_ = payloads.schema["source_id"].dataType.simpleString()
    rows = payloads.select("source_id", "payload").mapInArrow(run, f"source_id {id_}, pictures array<binary>")
    return rows.select("source_id", F.posexplode("pictures").alias("frame", "picture"))


def byte_ranges(payloads: DataFrame, size: int) -> DataFrame:
    """source_id, no (from 0), data: payloads cut into ranges of so many bytes."""
    starts = F.sequence(F.lit(0), F.octet_length("payload") - 1, F.lit(size))
    rows = payloads.filter(F.octet_length("payload") > 0).select("source_id", "payload", F.posexplode(starts).alias("no", "at"))
    return rows.select("source_id", "no", F.substring("payload", F.col("at") + 1, F.lit(size)).alias("data"))


def _marks(data: bytes) -> list[dict]:
    """Where begins and ends stand in a range, the first of each run of one sort only."""
    places, out, i = [PICTURE, PICTURE_END], [], data.find(b"\xff")
    while 0 <= i < len(data) - 1:
        if (mark := data[i : i + 2]) in places:
            begin = mark == PICTURE
            if not out or out[-1]["begin"] != begin:
                out.append({"at": i, "begin": begin})
        i = data.find(b"\xff", i + 1)
    return out


def frames_of_ranges(ranges: DataFrame) -> DataFrame:
    """The same as `frames` for streams of any size, given as ranges (source_id, no, data; no in order, empty ranges allowed).

    Of marks that follow each other and are alike only the first counts, so what a range must know of the ones before is their
    last mark and last byte: scans over a row a range without its bytes say which pieces of pictures it holds. A merge join
    brings them to the bytes (nothing is broadcast: Spark takes ranges for no larger than the table that they are made of), and
    the pieces are put together; no task holds more than a range and a picture."""
    c, v = F.col, Window.partitionBy("source_id").orderBy("no")
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.filter(F.octet_length("data") > 0).select("source_id", "no", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, second = pa.list_(pa.struct([("at", pa.int32()), ("begin", pa.bool_())])), {PICTURE[1]: True, PICTURE_END[1]: False}
        for b in batches:
            data = b.column(2).to_pylist()
            made = [pa.array([len(d) for d in data], pa.int64()), pa.array([second.get(d[0]) for d in data], pa.bool_()), pa.array([d[-1] == PICTURE[0] for d in data], pa.bool_()), pa.array([_marks(d) for d in data], kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["source_id", "no", "length", "head", "tail", "marks"])

    id_, no_ = (ranges.schema[x].dataType.simpleString() for x in ("source_id", "no"))
    m = rows.mapInArrow(run, f"source_id {id_}, no {no_}, length long, head boolean, tail boolean, marks array<struct<at: int, begin: boolean>>")
    # a mark that lies over a border belongs to the range after it, at -1
    over = F.lag("tail", 1, False).over(v) & c("head").isNotNull()
    ends_over = F.coalesce(c("tail") & ~F.lead("head").over(v), F.lit(False))
    m = m.select("source_id", "no", "length", "head", "marks", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), over.alias("over"), ends_over.cast("int").alias("ends_over"))
    changes = lambda marks, state: F.when(F.get(marks, F.lit(0))["begin"] == state, F.slice(marks, 2, F.size(marks))).otherwise(marks)
    first = F.array(F.struct(F.lit(-1).alias("at"), c("head").alias("begin")))
    m = m.withColumn("marks", F.when(c("over"), F.concat(first, changes(c("marks"), c("head")))).otherwise(c("marks")))
    inside = F.last(F.try_element_at("marks", F.lit(-1))["begin"], ignorenulls=True).over(before)
    m = m.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("marks", changes(c("marks"), c("inside")))
    begins, ends = F.size(F.filter("marks", lambda x: x["begin"])), F.size(F.filter("marks", lambda x: ~x["begin"]))
    at = c("offset") + F.try_element_at("marks", F.lit(-1))["at"]  # of a range's last begin, where it ends inside a picture
    m = m.withColumn("since", F.last(at, ignorenulls=True).over(before)).withColumn("begun", F.coalesce(F.sum(begins).over(before), F.lit(0)).cast("int"))
    m = m.withColumn("ended", F.sum(ends).over(Window.partitionBy("source_id")))

    def piece(frame: Column, since: Column, start: Column, i: Column) -> Column:
        end = F.get("marks", i)["at"]
        waits = c("offset") + F.coalesce(end, c("length") - c("ends_over")) - since > PENDING_MOST
        return F.struct(F.when(waits, F.raise_error(F.lit("a picture has no end")).cast("int")).otherwise(frame).alias("frame"), start.alias("start"), F.coalesce(end + 2, c("length").cast("int")).alias("end"))

    own = F.transform("marks", lambda x, i: F.when(x["begin"], piece(c("begun") + F.shiftright(i, 1), c("offset") + x["at"], x["at"], i + 1)))
    pieces = F.concat(F.array(F.when(c("inside"), piece(c("begun") - 1, c("since"), F.lit(0), F.lit(0)))), own)
    m = m.select(c("source_id").alias("id"), c("no").alias("n"), "ended", pieces.alias("pieces"))
    m = m.select("id", "n", F.filter("pieces", lambda x: x["frame"] < c("ended")).alias("pieces")).filter(F.size("pieces") > 0)
    held = rows.join(m.hint("merge"), c("source_id").eqNullSafe(c("id")) & (c("no") == c("n")))

    def cut(x: Column) -> Column:
        start = F.greatest(x["start"], F.lit(0))
        data = F.substring("data", start + 1, x["end"] - start)
        return F.struct(x["frame"].alias("frame"), F.when(x["start"] < 0, F.concat(F.lit(PICTURE[:1]), data)).otherwise(data).alias("bytes"))

    parts = held.select("source_id", "no", F.explode(F.transform("pieces", cut)).alias("x"))
    whole = parts.groupBy("source_id", "x.frame").agg(F.sort_array(F.collect_list(F.struct("no", "x.bytes"))).alias("ps"))
    return whole.select("source_id", "frame", F.aggregate("ps", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("picture"))
