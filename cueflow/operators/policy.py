"""Planning tables as expressions: scan modes, numbers of lanes, the disk needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (mode, frames a second, guard, guard while a cue is active, difference, low confidence).
MODES = (("accurate", 4.0, 3.0, 12.0, 0.10, 0.68), ("balanced", 2.5, 5.0, 16.0, 0.16, 0.62), ("fast", 1.5, 8.0, 24.0, 0.22, 0.58))
LEVELS = (2, 4, 8, 16)
VRAM_STEPS = ((3.5, 1), (7.0, 2), (14.0, 4), (28.0, 8))
LANE_BYTES, SPARE_BYTES = 768 << 20, 512 << 20


def scan_modes(spark: SparkSession, sensitivity: float = 1.0) -> DataFrame:
    """mode, fps, difference (scaled by the sensitivity, 0.6 to 1.5, or 1 if not positive), low, overlap."""
    scale = 1.0 if sensitivity <= 0 else min(1.5, max(0.6, sensitivity))
    return spark.createDataFrame([(m, fps, d * scale, low, max(g, a)) for m, fps, g, a, d, low in MODES], "mode string, fps double, difference double, low double, overlap double")


def scan_mode(mode: Column, sensitivity: Column) -> Column:
    """The struct of a mode's fps, difference, low and overlap, balanced for any other name; as in `scan_modes`."""
    scale = F.when(sensitivity > 0, F.least(F.lit(1.5), F.greatest(F.lit(0.6), sensitivity))).otherwise(1.0)
    of = {m: F.struct(F.lit(fps).alias("fps"), (F.lit(d) * scale).alias("difference"), F.lit(low).alias("low"), F.lit(max(g, a)).alias("overlap")) for m, fps, g, a, d, low in MODES}
    return F.when(mode == "accurate", of["accurate"]).when(mode == "fast", of["fast"]).otherwise(of["balanced"])


def _largest(limit: Column) -> Column:
    """The largest level that is not above the limit, 1 at least."""
    return F.greatest(F.lit(1), *[F.when(limit >= n, n).otherwise(1) for n in LEVELS])


def cpu_lanes(cores: Column, memory: Column) -> Column:
    return F.greatest(F.lit(1), *[F.when((cores >= 2 * n) & (memory >= n * LANE_BYTES), n).otherwise(1) for n in LEVELS])


def gpu_lanes(vram_gib: Column) -> Column:
    out = F.lit(16)
    for top, n in reversed(VRAM_STEPS):
        out = F.when(vram_gib < top, n).otherwise(out)
    return out


def lanes(mode: Column, cores: Column, memory: Column, vram_gib: Column) -> Column:
    """Lanes of a device mode (case and outer spaces ignored, null: auto); null vram: no such device."""
    mode, base = F.lower(F.trim(F.coalesce(mode, F.lit("auto")))), cpu_lanes(cores, memory)
    gpu = gpu_lanes(vram_gib)
    none = F.when(mode == "auto", F.least(base, F.lit(4))).otherwise(1)
    return F.when(mode == "cpu", base).when(vram_gib.isNull(), none).when(mode == "hybrid", _largest(F.least(base, F.lit(16), gpu + 1))).otherwise(F.least(base, gpu))


def probe_ceiling(mode: Column, cores: Column, memory: Column, vram_gib: Column) -> Column:
    """One level above the lanes where a device can be probed, but no more than the processor carries."""
    n = lanes(mode, cores, memory, vram_gib)
    fixed = (F.lower(F.trim(F.coalesce(mode, F.lit("auto")))) == "cpu") | vram_gib.isNull()
    return F.when(fixed, n).otherwise(F.least(cpu_lanes(cores, memory), F.least(F.lit(16), 2 * n)))


def disk_needed(size: Column) -> Column:
    """Twice the size and 512 MiB to spare; null where that is beyond a long."""
    return F.try_add(F.try_multiply(size.cast("long"), F.lit(2).cast("long")), F.lit(SPARE_BYTES).cast("long"))


# Connections of a speed as shown and as used (any other name: the last).
CONNECTIONS = {"stable": (1, 1), "turbo": (16, 8), None: (8, 4)}


def connections(speed: Column) -> Column:
    """struct<shown, used, video, audio>: connections of a speed (case and outer spaces ignored); where both streams are
    fetched, sound takes one of those used and pictures the rest, or one each in turn."""
    name = F.lower(F.trim(F.coalesce(speed, F.lit(""))))
    of = lambda i: F.when(name == "stable", CONNECTIONS["stable"][i]).when(name == "turbo", CONNECTIONS["turbo"][i]).otherwise(CONNECTIONS[None][i])
    return F.struct(of(0).alias("shown"), of(1).alias("used"), F.greatest(F.lit(1), of(1) - 1).alias("video"), F.lit(1).alias("audio"))


def explicit_lanes(asked: Column, duration: Column, ceiling: Column) -> Column:
    """1 to 16 lanes, no more than one for every two minutes nor than the ceiling."""
    return F.greatest(F.lit(1), F.least(asked, F.lit(16), F.greatest(F.lit(1), F.floor(duration / 120).cast("int")), ceiling))


# Settings, what they may be, and what they are otherwise (None: the caller's).
CHOICES = {"theme": (("light", "dark"), "dark"), "subtitle_format": (("srt", "txt", "json"), "srt"), "video_speed": (("stable", "fast", "turbo"), "fast"), "video_container": (("mkv", "mp4"), "mp4"),
           "video_mode": (("video+audio", "video-only", "audio-only"), "video+audio"), "ocr_device": (("cpu", "gpu", "hybrid", "auto"), "auto")}
MARGINS = {"ocr_top": (1, 65), "ocr_bottom": (1, 94), "ocr_left": (0, 5), "ocr_right": (1, 95)}


def normal_settings(df: DataFrame) -> DataFrame:
    """df with every setting that it has as one of its choices, margins as positive numbers (left: 0 or more), else the default.
    Names count as written, but for ocr_device, where case and outer spaces don't."""
    out = {}
    for name, (choices, default) in CHOICES.items():
        if name in df.columns:
            value = F.lower(F.trim(name)) if name == "ocr_device" else F.col(name)
            out[name] = F.when(value.isin(*choices), value).otherwise(default)
    out |= {name: F.when(F.col(name) >= least, F.col(name)).otherwise(default) for name, (least, default) in MARGINS.items() if name in df.columns}
    return df.withColumns(out)


def valid_release(version: Column, url: Column, size: Column, sha256: Column) -> Column:
    filled = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    return filled(version) & filled(url) & F.coalesce((size > 0) & sha256.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def http_only(url: Column) -> Column:
    """The url if it is an absolute one of http or https."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), url)


def valid_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Within the unit square (tolerance: 0.000001), and not empty."""
    return F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x < 1) & (y < 1) & (x + w <= 1.000001) & (y + h <= 1.000001), F.lit(False))


def canonical_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x,y,w,h> in whole percents: outwards, one at least; null where the region is not valid."""
    clip = lambda v, a, b: F.greatest(F.lit(a), F.least(F.lit(b), v))
    left, top = clip(F.floor(x * 100).cast("int"), 0, 99), clip(F.floor(y * 100).cast("int"), 0, 99)
    right, bottom = clip(F.greatest(left + 1, F.ceil((x + w) * 100).cast("int")), 1, 100), clip(F.greatest(top + 1, F.ceil((y + h) * 100).cast("int")), 1, 100)
    return F.when(valid_region(x, y, w, h), F.struct((left / 100.0).alias("x"), (top / 100.0).alias("y"), ((right - left) / 100.0).alias("w"), ((bottom - top) / 100.0).alias("h")))


def pixel_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct<x,y,w,h> in pixels, cut towards zero; null where it begins outside or is less than two pixels wide or high."""
    px, py = (x * width).cast("int"), (y * height).cast("int")
    pw, ph = (F.least(F.lit(1.0), x + w) * width).cast("int") - px, (F.least(F.lit(1.0), y + h) * height).cast("int") - py
    fine = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x < 1) & (y < 1) & (pw >= 2) & (ph >= 2)
    return F.when(fine, F.struct(px.alias("x"), py.alias("y"), pw.alias("w"), ph.alias("h")))


def time_guard(start: Column, end: Column, duration: Column, whole: Column) -> Column:
    """between(t,start,end) with three decimals, empty for the whole length; null where nothing lies between."""
    a, b = F.greatest(F.lit(0.0), start), F.when(duration > 0, F.least(duration, end)).otherwise(end)
    return F.when(whole, "").when(b > a, F.format_string("between(t,%.3f,%.3f)", a, b))
