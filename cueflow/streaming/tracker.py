"""The cue tracker: a confirmation state machine over a lane's ordered observations.

A lane knows a shown cue (active) and one that awaits confirmation (candidate). An observation is of one of five
classes, and each class is one row of the table below; `observe` finds the class and applies its row. The same code
serves batch (a lane's rows in order, in batches) and Structured Streaming (state kept per lane).

    class        candidate           active                      empty frames
    blank        dropped             ended by the second one     counted while a cue is active
    refused      dropped             as it is                    as they are
    the active   dropped             prolonged, text refined     none
    a new text   starts              as it is                    none
    the same     confirmed further   replaced once confirmed     none

Lengths of texts are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from cueflow.functions.distance import similarity
from cueflow.operators.folds import fold

# Likeness of texts; what makes a later reading the better one (confidence, length); bounds of a cue in
# seconds; empty frames that end a cue; readings that confirm one, and a doubtful one; seconds between them.
SAME, SURER, LONGER = 0.80, 0.035, 2
SHORTEST, LONGEST, EMPTY_ENDS = 0.12, 30.0, 2
READINGS, DOUBTFUL_READINGS, READING_GAP, READING_FRAMES = 2, 3, 0.75, 2.5
CUES = "lane long, start double, end double, text string, confidence double"


def start_state(active: dict | None = None, accept: Callable[[str], str | None] = lambda t: t) -> dict:
    """A new lane's state, or that of one restored with its active cue {start, end, text, conf} (its text accepted anew);
    candidates and empty frames are not restored."""
    text = accept(active["text"]) if active else None
    return {"cand": None, "active": {**active, "text": text} if text is not None else None, "empty": 0, "since": 0.0}


def safe_to_stop(s: dict) -> bool:
    """Whether nothing is under way that a restart would lose."""
    return s["cand"] is None and s["empty"] == 0


def _end_cue(s: dict, end: float, accept: Callable, out: list) -> None:
    """The active cue goes out, its length within bounds and its text accepted once more."""
    cue, s["active"] = s["active"], None
    if cue is not None and (text := accept(cue["text"])) is not None:
        out.append((cue["start"], min(max(end, cue["start"] + SHORTEST), cue["start"] + LONGEST), text, cue["conf"]))


def _refine(cue: dict, text: str, conf: float) -> None:
    better = conf > cue["conf"] + SURER or len(text) > len(cue["text"]) + LONGER
    cue.update(text=text if better else cue["text"], conf=max(cue["conf"], conf))


def _on_blank(s: dict, at: float, span: float, accept: Callable, out: list) -> None:
    s["cand"] = None
    if s["active"] is None:
        s["empty"] = 0
        return
    s.update(since=s["since"] if s["empty"] else at, empty=s["empty"] + 1)
    if s["empty"] >= EMPTY_ENDS:
        _end_cue(s, max(s["since"], s["active"]["start"] + span), accept, out)
        s["empty"] = 0


def _on_reading(s: dict, at: float, text: str, conf: float, span: float, low: float, accept: Callable, out: list) -> None:
    doubtful, seen = len(text) <= 1 or conf < low, s["cand"]
    needs = DOUBTFUL_READINGS if doubtful else READINGS
    s["empty"] = 0
    again = seen is not None and at - seen["last"] <= max(READING_GAP, READING_FRAMES * span) and similarity(text, seen["text"]) >= SAME
    if not again:
        s["cand"] = {"text": text, "start": at, "last": at, "conf": conf, "hits": 1, "need": needs}
        return
    _refine(seen, text, conf)
    seen.update(hits=seen["hits"] + 1, last=at, need=max(seen["need"], needs))
    if seen["hits"] >= seen["need"]:
        _end_cue(s, seen["start"], accept, out)
        s.update(cand=None, active={"start": seen["start"], "end": seen["last"] + span, "text": seen["text"], "conf": seen["conf"]})


def observe(s: dict, at: float, text: str | None, conf: float, fps: float, low: float, accept: Callable[[str], str | None], out: list) -> None:
    """One observation; text is None for an empty frame. Confirmed cues go to out."""
    span, active = 1 / max(0.25, fps), s["active"]
    if text is None or not text.strip():
        _on_blank(s, at, span, accept, out)
    elif (text := accept(text)) is None:
        s["cand"] = None
    elif active is not None and similarity(text, active["text"]) >= SAME:
        _refine(active, text, conf)
        active["end"] = max(active["end"], at + span)
        s.update(empty=0, cand=None)
    else:
        _on_reading(s, at, text, conf, span, low, accept, out)


def finish(s: dict, end: float, fps: float, out: list, accept: Callable[[str], str | None] = lambda t: t) -> None:
    """The lane's end: what is active goes out."""
    s["cand"] = None
    if s["active"] is not None:
        _end_cue(s, max(end, s["active"]["start"] + 1 / max(0.25, fps)), accept, out)


def track(observations: DataFrame, fps: float = 4.0, low: float = 0.68, accept: Callable[[str], str | None] = lambda t: t) -> DataFrame:
    """Confirmed cues of every lane, from (lane, ord, at, text, confidence); null text is an empty frame."""

    def begin() -> dict:
        return {"tracker": start_state(), "at": 0.0}

    def one(s: dict, row: list, out: list) -> None:
        at, text, confidence = row
        s["at"] = at
        observe(s["tracker"], at, text, float("nan") if confidence is None else confidence, fps, low, accept, out)

    def end(s: dict, out: list) -> None:
        finish(s["tracker"], s["at"] + 1 / max(0.25, fps), fps, out, accept)

    return fold(observations, "lane", ["at", "ord"], ["at", "text", "confidence"], begin, one, end, StructType.fromDDL(CUES))


#: Media time 0 as event time, so that it lies after the watermark that a stream starts with.
_ZERO = 86400.0
_CANDIDATE = {"text": "string", "start": "double", "last": "double", "conf": "double", "hits": "int", "need": "int"}
_ACTIVE = {"start": "double", "end": "double", "text": "string", "conf": "double"}
STATE = ", ".join([*(f"cand_{k} {t}" for k, t in _CANDIDATE.items()), *(f"active_{k} {t}" for k, t in _ACTIVE.items()), "empty int, since double, last double"])
WAITING = "at double, ord long, text string, confidence double"


def _pack(s: dict, last: float | None) -> tuple:
    cand, active = s["cand"] or {}, s["active"] or {}
    return (*(cand.get(k) for k in _CANDIDATE), *(active.get(k) for k in _ACTIVE), s["empty"], s["since"], last)


def _unpack(row: tuple) -> tuple[dict, float | None]:
    n = len(_CANDIDATE)
    cand, active = dict(zip(_CANDIDATE, row[:n])), dict(zip(_ACTIVE, row[n : n + len(_ACTIVE)]))
    empty, since, last = row[n + len(_ACTIVE) :]
    return {"cand": cand if cand["text"] is not None else None, "active": active if active["text"] is not None else None, "empty": empty, "since": since}, last


class _Lane(StatefulProcessor):
    """A lane's tracker (a value), the rows that wait for the watermark (a list, added to as they come) and one timer for
    when the next of them is due or the lane has been idle for long enough to end."""

    def __init__(self, fps: float, low: float, accept: Callable[[str], str | None], idle: float):
        self.fps, self.low, self.accept, self.idle, self.span = fps, low, accept, idle, 1 / max(0.25, fps)

    def init(self, handle) -> None:
        self.handle = handle
        self.tracker, self.waiting = handle.getValueState("tracker", STATE), handle.getListState("waiting", WAITING)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A restored lane: its active cue, if any, and the media time that it had been looked at until."""
        cue = initialState.asDict()
        active = {"start": cue["start"], "end": cue["end"], "text": cue["text"], "conf": cue["confidence"]} if cue["text"] is not None else None
        last = cue.get("last") if cue.get("last") is not None else cue["end"]
        self.tracker.update(_pack(start_state(active, self.accept), last))
        self._wake(0.0 if last is None else last + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(float(r["at"]), int(r["ord"]), r["text"], float("nan") if r["confidence"] is None else float(r["confidence"])) for r in rows])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() / 1000 - _ZERO)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() / 1000 - _ZERO)

    def _wake(self, at: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((at + _ZERO) * 1000))

    def _advance(self, key, mark: float) -> Iterator[Row]:
        s, last = _unpack(self.tracker.get()) if self.tracker.exists() else (start_state(), None)
        rows, out = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], []
        due, rest = sorted((r for r in rows if r[0] <= mark), key=lambda r: r[:2]), [r for r in rows if r[0] > mark]
        for at, _, text, confidence in due:
            observe(s, at, text, confidence, self.fps, self.low, self.accept, out)
            last = at
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if not rest and last is not None and mark >= last + self.idle:
            finish(s, last + self.span, self.fps, out, self.accept)
            self.tracker.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            self.tracker.update(_pack(s, last))
            self._wake(max(min(r[0] for r in rest) if rest else (last or 0.0) + self.idle, mark + 0.001))
        for start, end, text, confidence in out:
            yield Row(lane=key[0], start=start, end=end, text=text, confidence=confidence)

    def close(self) -> None:
        pass


def track_stream(observations: DataFrame, fps: float = 4.0, low: float = 0.68, accept: Callable[[str], str | None] = lambda t: t, delay: str = "5 seconds", idle: float = 60.0, initial: DataFrame | None = None) -> DataFrame:
    """The same over a stream (append mode): rows may come unordered within the delay. A lane's rows wait until the
    watermark has passed them and are then folded in order; a lane ends when the watermark is `idle` seconds of
    media past its last row. What a lane keeps is its tracker and the rows that wait. Media times are 0 or more.

    initial: lanes to go on with (lane, start, end, text, confidence of the active cue, all null if none; last, the media time
    of the last row that was folded), as `lane_states` reads them from an earlier stream. Candidates and empty frames are
    not restored, so stop where `safe_to_stop` holds. The session needs the RocksDB state store."""
    timed = observations.withColumn("_time", F.timestamp_seconds(F.col("at") + _ZERO)).withWatermark("_time", delay)
    known = {} if initial is None else {"initialState": initial.groupBy("lane")}
    return timed.groupBy("lane").transformWithState(_Lane(fps, low, accept, idle), CUES, "append", "EventTime", **known)


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lane_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream's checkpoint folder holds of each lane: lane, start, end, text, confidence of the active cue, last (media
    time of the last row folded), pending (whether a candidate or empty frames are under way), waiting (rows not yet folded)."""
    of = lambda v: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", v)
    v = of("tracker").load().select("key.lane", "value.*")
    waiting = of("waiting").option("flattenCollectionTypes", True).load().groupBy("key.lane").agg(F.count("*").alias("waiting"))
    cue = [F.col(f"active_{a}").alias(b) for a, b in (("start", "start"), ("end", "end"), ("text", "text"), ("conf", "confidence"))]
    pending = (F.col("cand_text").isNotNull() | (F.col("empty") > 0)).alias("pending")
    return v.select("lane", *cue, "last", pending).join(waiting, "lane", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))


def lane_summary(states: DataFrame, emitted: DataFrame) -> DataFrame:
    """lane, cues (those given out and the active one), frontier (how far the lane was looked at), of a stopped stream."""
    active = states.select("lane", F.col("text").isNotNull().cast("long").alias("n"), "last")
    done = emitted.select("lane", F.lit(1).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))
    return active.unionByName(done).groupBy("lane").agg(F.sum("n").alias("cues"), F.max("last").alias("frontier"))
