"""Scalar functions of timed text as Column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions.names import let

# Han ranges and scripts that disqualify a line.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
OTHER_SCRIPTS = r"\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0400}-\x{052F}"
MARKS = "，。！？、；：,.!?"


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def script_normalize(x: Column) -> Column:
    """The cleaned line, or null where it is not Han text: repeated marks collapse; other scripts, lone Latin
    words and a surplus of Latin letters are refused."""
    clean = F.regexp_replace(collapse_space(x), rf"([{MARKS}])(?:\s*\1)+", "$1")
    han, latin = F.regexp_count(clean, F.lit(f"[{HAN}]")), F.regexp_count(clean, F.lit("[A-Za-z]"))
    foreign = clean.rlike(f"[{OTHER_SCRIPTS}]") | clean.rlike(rf"[\p{{L}}&&[^A-Za-z{HAN}]]")
    lone = clean.rlike(rf"(?U)(?:^|\s)[A-Za-z]+(?=\s|[{MARKS}…]|$)")
    return F.when((han > 0) & ~foreign & ~lone & (latin <= F.greatest(F.lit(6), 2 * han)), clean)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>", "")


def trimmed(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(x: Column) -> Column:
    """&name; (those of HTML 4, and apos) and &#n; as characters, once from left to right; what is none stays."""
    return let(x, _decoded)


def _decoded(x: Column) -> Column:
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"
    named = {**name2codepoint, "apos": 39}
    table = F.create_map(*[F.lit(y) for name, code in sorted(named.items()) for y in (name, chr(code))])

    def numbered(e: Column, inner: Column) -> Column:
        code = F.when(F.lower(inner).startswith("#x"), F.conv(F.substring(inner, 3, 9), 16, 10)).otherwise(F.substring(inner, 2, 9)).try_cast("int")
        return let(code, lambda n: F.when(n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), _character(n)).otherwise(e))

    def one(e: Column) -> Column:
        inner = F.regexp_replace(e, "^&|;$", "")
        return let(inner, lambda i: F.when(i.startswith("#"), numbered(e, i)).otherwise(F.coalesce(F.try_element_at(table, i), e)))

    # a piece without entities follows every entity, and one comes first
    pieces, found = F.split(x, pattern, -1), F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), one)
    joined = lambda p, f: F.array_join(F.flatten(F.zip_with(p, F.concat(f, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.when(x.contains("&"), joined(pieces, found)).otherwise(x)


def clean_lines(x: Column) -> Column:
    """Entities decoded, CR dropped, lines trimmed, empty ones gone."""
    lines = F.transform(F.split(F.replace(decode_entities(x), F.lit("\r"), F.lit("")), "\n"), trimmed)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, by code points."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def parse_time(x: Column) -> Column:
    """Seconds of [H:]MM:SS[.,]fff, null if it is none: hours and minutes are plain digits, seconds any decimal number."""
    whole = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    decimal = lambda c: F.when(c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), c.try_cast("double"))

    def read(p: Column) -> Column:
        at, n = lambda i: F.try_element_at(p, F.lit(i)), F.size(p)
        return F.struct(n.between(2, 3).alias("ok"), F.when(n == 3, whole(at(1))).otherwise(0).alias("h"), whole(at(-2)).alias("m"), decimal(trimmed(at(-1))).alias("s"))

    fine = lambda t: t["ok"] & (t["m"] < 60) & (t["s"] >= 0) & (t["s"] < 60) & t["h"].isNotNull()
    return let(let(F.split(F.replace(trimmed(x), F.lit(","), F.lit(".")), ":"), read), lambda t: F.when(fine(t), t["h"] * 3600.0 + t["m"] * 60.0 + t["s"]))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds rounded half to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


# The mark, names of secret keys, and those in query strings.
HIDDEN = "[ĐÃ ẨN]"
SECRET_KEYS = r"SESSDATA|bili_jct|buvid\d*|DedeUserID|authorization|token|cookie"
SECRET_PARAMETERS = "token|auth|cookie|sessdata"


def redact(x: Column) -> Column:
    """Values of secret keys (up to a blank, & or ;), users in paths and secrets in query strings; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?i)({SECRET_KEYS})\s*[:=]\s*([^\s;&]+)", f"$1={HIDDEN}")
    x = F.regexp_replace(x, r"(?i)C:\\Users\\[^\\\s]+", rf"C:\\Users\\{HIDDEN}")
    return F.regexp_replace(x, rf"(?i)([?&](?:{SECRET_PARAMETERS})=)[^&#\s]+", f"$1{HIDDEN}")


def tail(x: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(x, F.lit(n))


def compact(x: Column, n: int) -> Column:
    """White space collapsed; what is longer than n is cut and marked."""
    plain = collapse_space(F.coalesce(x, F.lit("")))
    return F.when(F.length(plain) > n, F.concat(F.left(plain, F.lit(n)), F.lit("…"))).otherwise(plain)


def log_message(x: Column, blank: str = "(không có nội dung)") -> Column:
    """One line: CRLF as a mark, other ends of line as blanks; a blank message gets a placeholder."""
    plain = trimmed(F.coalesce(x, F.lit("")))
    line = F.replace(F.replace(F.replace(plain, F.lit("\r\n"), F.lit(" ⏎ ")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.when(plain == "", F.lit(blank)).otherwise(line)


# Words that make an informational message a warning.
WARNING_WORDS = ("cảnh báo", "bỏ qua", "thất bại; chuyển yt-dlp fallback")


def promote_level(level: Column, message: Column, words: tuple[str, ...] = WARNING_WORDS) -> Column:
    """Info becomes Warning where the message has one of the words, whatever its case."""
    marked = F.lit(False)
    for w in words:
        marked = marked | F.lower(message).contains(w.lower())
    return F.when((level == "Info") & F.coalesce(marked, F.lit(False)), F.lit("Warning")).otherwise(level)


def raw_language(x: Column) -> Column:
    """What follows the first colon; all if there is none."""
    at = F.instr(F.coalesce(x, F.lit("")), ":")
    return F.substr(F.coalesce(x, F.lit("")), at + 1)


def codec_rank(x: Column) -> Column:
    """0 AVC, 1 HEVC, 2 AV1, 3 any other."""
    v = F.lower(F.coalesce(x, F.lit("")))
    avc = v.startswith("avc1") | v.contains("h264") | v.contains("h.264")
    hevc = v.startswith("hev1") | v.startswith("hvc1") | v.contains("hevc") | v.contains("h265")
    return F.when(avc, 0).when(hevc, 1).when(v.contains("av1") | v.startswith("av01"), 2).otherwise(3)


def has_codec(x: Column) -> Column:
    """Neither null, blank nor "none"."""
    return F.coalesce((collapse_space(x) != "") & (F.lower(x) != "none"), F.lit(False))


def encode_parameter(x: Column) -> Column:
    """A query parameter: !'()* dropped, the rest percent-encoded with + for blanks."""
    return F.replace(F.url_encode(F.translate(x, "!'()*", "")), F.lit("%7E"), F.lit("~"))


def clock(seconds: Column) -> Column:
    """mm:ss, from an hour on hh:mm:ss (of the day); fractions are cut."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    short, long = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60), F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
    return F.when(seconds >= 3600, long).otherwise(short)


def url_parts(x: Column) -> Column:
    """struct<scheme, host, port, path, query> of a url; no port is null, as is what a text that is no url lacks."""
    part = lambda p: F.try_parse_url(x, F.lit(p))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1).try_cast("int")
    return F.struct(F.lower(part("PROTOCOL")).alias("scheme"), part("HOST").alias("host"), port.alias("port"), part("PATH").alias("path"), part("QUERY").alias("query"))


def video_id(x: Column) -> Column:
    """The first BV id in a text, null if there is none."""
    found = F.regexp_extract(x, "BV[0-9A-Za-z]+", 0)
    return F.when(found != "", found)


def part_number(id_: Column, url: Column) -> Column:
    """A part from an id that ends in _p and digits, else from the url's parameter p, the first that is a number above 0; else 1."""
    positive = lambda c: F.when(c.try_cast("int") > 0, c.try_cast("int"))
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)) == "p")
    values = F.filter(F.transform(pairs, lambda p: positive(F.try_url_decode(F.substr(p, F.instr(p, "=") + 1)))), lambda n: n.isNotNull())
    return F.coalesce(positive(F.regexp_extract(F.coalesce(id_, F.lit("")), r"(?i)_p(\d+)$", 1)), F.try_element_at(values, F.lit(1)), F.lit(1))


def human_bytes(x: Column) -> Column:
    """In steps of 1024 up to TB, with two decimals at most."""
    n = F.greatest(x.cast("double"), F.lit(0.0))
    out = F.format_string("%d B", n.cast("long"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = F.round(n / 1024.0**i, 2)
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
        out = F.when(n >= 1024.0**i, F.concat(plain, F.lit(f" {unit}"))).otherwise(out)
    return out


def speed_label(x: Column) -> Column:
    """Bytes a second in B/s, KiB/s or, with a decimal, MiB/s."""
    x = x.cast("double")
    mega, kilo = F.format_string("%.1f MiB/s", F.round(x / 1048576.0, 1)), F.format_string("%.0f KiB/s", F.round(x / 1024.0))
    return F.when(x >= 1048576, mega).when(x >= 1024, kilo).otherwise(F.format_string("%.0f B/s", F.round(x)))


def pick(items: Column, offset: Column) -> Column:
    """The item at a rotating index; null of an empty array."""
    return F.get(items, F.when(F.size(items) > 0, F.pmod(F.abs(offset), F.size(items))).cast("int"))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, as it stands."""
    return F.coalesce(*[F.when(collapse_space(v) != "", v) for v in values])


def lower_keys(m: Column) -> Column:
    """A map whose keys don't depend on case; of equal ones the last in order stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda es, e, i: F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(let(entries, lambda es: F.filter(es, lambda e, i: ~later(es, e, i))))


def identity_key(*parts: Column, length: int = 64) -> Column:
    """SHA-256 of the trimmed parts, joined by NUL (null is empty), in lower hex."""
    return F.left(F.sha2(F.concat_ws("\0", *[trimmed(F.coalesce(p, F.lit(""))) for p in parts]), 256), F.lit(length))


def intact(content: Column, size: Column, digest: Column) -> Column:
    """Whether a binary has this size and SHA-256."""
    return F.coalesce((F.octet_length(content) == size) & (F.sha2(content, 256) == F.lower(digest)), F.lit(False))


def key_values(x: Column) -> Column:
    """array<struct<name,value>> of a "k=v; k=v" list: the first of each name in any case; what is no valid name or value is dropped."""
    plain = F.regexp_replace(trimmed(F.coalesce(x, F.lit(""))), r"(?i)^cookie:\s*", "")
    split = lambda p: F.struct(trimmed(F.substring_index(p, "=", 1)).alias("name"), trimmed(F.substr(p, F.instr(p, "=") + 1)).alias("value"))
    fine = lambda e: e["name"].rlike(r"^[a-zA-Z0-9!#$%&'*+.^_`|~-]+$") & e["value"].rlike(r"^[^\x00-\x1F\x7F;]*$")
    parts = F.filter(F.transform(F.filter(F.split(plain, ";"), lambda p: p.contains("=")), split), fine)
    seen = lambda ps, e, i: F.exists(F.slice(ps, F.lit(1), i), lambda y: F.lower(y["name"]) == F.lower(e["name"]))
    return let(parts, lambda ps: F.filter(ps, lambda e, i: ~seen(ps, e, i)))


# File names that the system keeps for itself.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def safe_filename(x: Column, fallback: str = "file") -> Column:
    """Trimmed, characters that no name may have as _, blanks and dots at the ends gone, 150 characters at most; null or
    blank is the fallback. A name that is reserved up to its last dot gets a _ before it."""
    clean = F.regexp_replace(trimmed(F.coalesce(x, F.lit(""))), r'[<>:"/\\|?*\x00-\x1F]', "_")
    clean = F.substring(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), 1, 150)
    named = lambda c: F.when(trimmed(c) == "", fallback).when(F.upper(F.regexp_replace(c, r"\.[^.]*$", "")).isin(*RESERVED), F.concat(F.lit("_"), c)).otherwise(c)
    return let(clean, named)
