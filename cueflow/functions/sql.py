"""The functions of timed text for SQL: temporary functions of a session, each a plain SQL expression."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import SparkSession

from cueflow.functions import text as T

_SPACE = r"(?U)\s+"
_LONE = rf"(?U)(?:^|\s)[A-Za-z]+(?=\s|[{T.MARKS}…]|$)"
_FOREIGN = rf"[{T.OTHER_SCRIPTS}]|[\p{{L}}&&[^A-Za-z{T.HAN}]]"
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_TRIM = r"(?U)^\s+|\s+$"

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"
_CUES = "ARRAY<STRUCT<start: DOUBLE, `end`: DOUBLE, text: STRING>>"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _time(x: str) -> str:
    """Seconds of a time; within a lambda, where no function of a session can stand."""
    whole = lambda c: f"CASE WHEN {c} RLIKE '^[0-9]+$' THEN try_cast({c} AS INT) END"
    decimal = lambda c: f"CASE WHEN {c} RLIKE r'{_DECIMAL}' THEN try_cast({c} AS DOUBLE) END"
    parts = f"split(replace(regexp_replace({x}, r'{_TRIM}', ''), ',', '.'), ':')"
    last = f"regexp_replace(element_at(tp, -1), r'{_TRIM}', '')"
    fields = f"named_struct('h', CASE WHEN size(tp) = 3 THEN {whole('tp[0]')} WHEN size(tp) = 2 THEN 0 END, 'm', {whole('try_element_at(tp, -2)')}, 's', {decimal(last)})"
    return _let(_let(parts, "tp", fields), "tf", "CASE WHEN tf.h IS NOT NULL AND tf.m < 60 AND tf.s >= 0 AND tf.s < 60 THEN tf.h * 3600D + tf.m * 60D + tf.s END")


def _timed() -> str:
    side = lambda i: _time(f"get(filter(split(ls[{i}], ' '), w -> w <> ''), 0)")
    both = f"named_struct('a', {side(0)}, 'b', {side(1)})"
    times = f"transform(li, l -> CASE WHEN contains(l, '-->') THEN {_let("split(l, '-->')", 'ls', both)} END)"
    text = r"regexp_replace(array_join(slice(li, n + 1, size(li)), '\n'), '<[^>]*>', '')"
    opened = _let("CAST(array_position(transform(ts, t -> t.a IS NOT NULL AND t.b IS NOT NULL), true) AS INT)", "n", f"CASE WHEN n > 0 THEN named_struct('start', ts[n - 1].a, 'end', ts[n - 1].b, 'text', {text}) END")
    blocks = r"split(replace(p, '\r', ''), r'(?U)\n[\s&&[^\n]]*(?:\n[\s&&[^\n]]*)+')"
    return rf"transform(transform({blocks}, b -> split(b, '\n')), li -> {_let(times, 'ts', opened)})"


def _clean(x: str) -> str:
    names = ", ".join(f"'{name}', '{chr(92) if code == 39 else ''}{chr(code)}'" for name, code in sorted({**name2codepoint, "apos": 39}.items()))
    code = "try_cast(CASE WHEN startswith(lower(i), '#x') THEN conv(substring(i, 3, 9), 16, 10) ELSE substring(i, 2, 9) END AS INT)"
    character = _let(code, "u", "CASE WHEN u BETWEEN 0 AND 1114111 AND NOT u BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex(u), 8, '0')), 'UTF-32') ELSE e END")
    one = _let("regexp_replace(e, '^&|;$', '')", "i", f"CASE WHEN startswith(i, '#') THEN {character} ELSE coalesce(try_element_at(map({names}), i), e) END")
    joined = f"array_join(flatten(zip_with(split(x, r'{_ENTITY}', -1), concat(transform(regexp_extract_all(x, r'{_ENTITY}', 0), e -> {one}), array('')), (y, z) -> array(y, z))), '')"
    lines = rf"split(replace(CASE WHEN contains(x, '&') THEN {joined} ELSE x END, '\r', ''), '\n')"
    return _let(x, "x", rf"array_join(filter(transform({lines}, s -> regexp_replace(s, r'{_TRIM}', '')), s -> s <> ''), '\n')")


_SEGMENT_TIMES = "coalesce(e.tStartMs, 0D) / 1000"

#: name -> (parameters, type, body); those with a _ before them are steps of the ones below
FUNCTIONS = {
    "cue_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1D - levenshtein(a, b) / greatest(length(a), length(b)) END"),
    "_srt_of": ("ms BIGINT", "STRING", "format_string('%02d:%02d:%02d,%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, ms % 1000)"),
    "srt_time": ("seconds DOUBLE", "STRING", "_srt_of(CAST(bround(greatest(seconds, 0D) * 1000) AS BIGINT))"),
    "_whole": ("x STRING", "INT", "CASE WHEN x RLIKE '^[0-9]+$' THEN try_cast(x AS INT) END"),
    "_decimal": ("x STRING", "DOUBLE", f"CASE WHEN x RLIKE r'{_DECIMAL}' THEN try_cast(x AS DOUBLE) END"),
    "_hms": ("h INT, m INT, s DOUBLE", "DOUBLE", "CASE WHEN h IS NOT NULL AND m < 60 AND s >= 0 AND s < 60 THEN h * 3600D + m * 60D + s END"),
    "_seconds": ("p ARRAY<STRING>", "DOUBLE", f"CASE size(p) WHEN 3 THEN _hms(_whole(get(p, 0)), _whole(get(p, 1)), _decimal(regexp_replace(get(p, 2), r'{_TRIM}', ''))) WHEN 2 THEN _hms(0, _whole(get(p, 0)), _decimal(regexp_replace(get(p, 1), r'{_TRIM}', ''))) END"),
    "cue_seconds": ("x STRING", "DOUBLE", f"_seconds(split(replace(regexp_replace(x, r'{_TRIM}', ''), ',', '.'), ':'))"),
    "_script": ("x STRING", "STRING", f"CASE WHEN regexp_count(x, r'[{T.HAN}]') > 0 AND NOT x RLIKE r'{_FOREIGN}' AND NOT x RLIKE r'{_LONE}' AND regexp_count(x, '[A-Za-z]') <= greatest(6, 2 * regexp_count(x, r'[{T.HAN}]')) THEN x END"),
    "script_line": ("x STRING", "STRING", rf"_script(regexp_replace(trim(regexp_replace(x, r'{_SPACE}', ' ')), r'([{T.MARKS}])(?:\s*\1)+', '$1'))"),
    "_flat_cues": ("p STRING", _CUES, "transform(from_json(p, 'body array<struct<`from`:double,`to`:double,content:string>>').body, c -> named_struct('start', coalesce(c.`from`, 0D), 'end', coalesce(c.`to`, 0D), 'text', coalesce(c.content, '')))"),
    "_segmented_cues": ("p STRING", _CUES, f"transform(from_json(p, 'events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>').events, e -> named_struct('start', {_SEGMENT_TIMES}, 'end', {_SEGMENT_TIMES} + coalesce(e.dDurationMs, 0D) / 1000, 'text', coalesce(array_join(transform(e.segs, g -> coalesce(g.utf8, '')), ''), '')))"),
    "_timed_cues": ("p STRING", _CUES, _timed()),
    "_cues_of": ("p STRING", _CUES, r"CASE WHEN p RLIKE r'^[\{\[]' THEN coalesce(_flat_cues(p), _segmented_cues(p)) ELSE _timed_cues(p) END"),
    "_filled": ("cues " + _CUES, "ARRAY<STRUCT<ord: INT, start: DOUBLE, `end`: DOUBLE, text: STRING>>", f"filter(transform(cues, (c, k) -> named_struct('ord', k, 'start', c.start, 'end', c.`end`, 'text', {_clean('c.text')})), c -> c.text <> '')"),
    "cue_list": ("payload STRING", "ARRAY<STRUCT<ord: INT, start: DOUBLE, `end`: DOUBLE, text: STRING>>", r"_filled(_cues_of(regexp_replace(payload, r'^[\x{FEFF} \t\r\n]+', '')))"),
}


def register(spark: SparkSession) -> None:
    """Creates cue_similarity, srt_time, cue_seconds, script_line and cue_list (and their steps) in this session. A payload's
    cues as a table: FROM (SELECT *, cue_list(payload) AS cues FROM payloads), LATERAL inline(cues), which needs no shuffle."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
