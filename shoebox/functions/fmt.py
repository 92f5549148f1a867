"""Texts, ratios and rates of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB, MIB, KIB = 1 << 30, 1 << 20, 1 << 10


def format_size(size: Column) -> Column:
    """the unit is picked before rounding."""
    d = size.cast("double")
    return (
        F.when(size < 0, F.lit("0 B"))
        .when(size >= GIB, F.format_string("%.2f GB", d / GIB))
        .when(size >= MIB, F.format_string("%.1f MB", d / MIB))
        .when(size >= KIB, F.format_string("%.0f KB", d / KIB))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def format_compact_size(size: Column) -> Column:
    """no space; zeros behind a decimal point go."""
    text = format_size(size)
    number, unit = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    short = F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")
    return F.concat(F.when(F.contains(number, F.lit(".")), short).otherwise(number), unit)


def format_count(n: Column) -> Column:
    """F15."""
    return F.format_string("%,d", n)


def format_date_time(ms: Column) -> Column:
    """F16: in the session's time zone; not positive is unknown."""
    return F.when(ms <= 0, F.lit("UNKNOWN")).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm"))


def days_left(deadline_ms: Column, now_ms: int) -> Column:
    """truncated toward zero; negative only a whole day past the deadline."""
    ms = deadline_ms - F.lit(now_ms)
    return ((ms - F.try_mod(ms, F.lit(86_400_000))) / 86_400_000).cast("long")


def enumerate_counts(photo: Column, live: Column, video: Column) -> Column:
    """kinds in fixed order, only those present."""
    part = lambda name, n: F.when(n > 0, F.concat(F.lit(name + " "), n.cast("string")))
    text = F.concat_ws(", ", part("photo", photo), part("live", live), part("video", video))
    return F.when(text == "", "none").otherwise(text)


def comparison_ratios(left: Column, right: Column) -> tuple[Column, Column]:
    """Single-precision shares between .0001 and .9999."""
    total = left + right
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = (total > 0) & finite(left) & finite(right)
    share = F.greatest(F.least((left / total).cast("float"), F.lit(0.9999).cast("float")), F.lit(0.0001).cast("float"))
    half = F.lit(0.5).cast("float")
    return F.when(ok, share).otherwise(half), F.when(ok, (F.lit(1.0).cast("float") - share).cast("float")).otherwise(half)


def estimated_saving(size: Column) -> Column:
    """37 % of the bytes, cut off."""
    return F.floor(size * F.lit(0.37)).cast("long")


# Encoder qualities by tier.
QUALITY = {"JPEG": {"HIGH": 92, "BALANCED": 85, "COMPACT": 76}, "HEIC": {"HIGH": 75, "BALANCED": 55, "COMPACT": 35}}


def quality(fmt: Column, tier: Column) -> Column:
    """F21."""
    table = F.create_map(*[x for f, q in QUALITY.items() for t, v in q.items() for x in (F.lit(f"{f}/{t}"), F.lit(v))])
    return F.try_element_at(table, F.concat_ws("/", fmt, tier))


def estimate_bitrate(width: Column, height: Column, fps: Column) -> Column:
    """F22."""
    raw = F.floor(width.cast("double") * height * F.lit(0.09) * F.greatest(F.least(fps, F.lit(60)), F.lit(24)))
    return F.greatest(F.least(raw, F.lit(40_000_000)), F.lit(300_000)).cast("int")


def memory_estimate_heic(width: Column, height: Column, size: Column) -> Column:
    """F30 (HEIC)."""
    return width.cast("long") * height * 4 + size * 6 + 64 * MIB


def savings_line(count: Column, saved: Column, known_before: Column, all_skipped: Column) -> Column:
    """a dash where nothing is known about the size before."""
    cut = F.when((known_before > 0) | all_skipped, F.concat(F.lit("-"), format_compact_size(saved))).otherwise("—")
    return F.concat(format_count(count), F.lit(" items · "), cut)


def size_line(count: Column, before: Column, after: Column, known_before: Column) -> Column:
    sizes = F.when(known_before == 0, format_size(after)).otherwise(F.concat(format_size(before), F.lit(" → "), format_size(after)))
    return F.concat(format_count(count), F.lit(" items · "), sizes)


def status_line(restorable: Column) -> Column:
    return F.when(restorable > 0, F.concat(F.lit("restorable "), format_count(restorable))).otherwise("not restorable")


# Bitrate factors by profile and tier.
FACTORS = {
    "HDR": {"HIGH": 0.85, "BALANCED": 0.62, "COMPACT": 0.45},
    "STANDARD": {"HIGH": 0.72, "BALANCED": 0.50, "COMPACT": 0.34},
    "AGGRESSIVE": {"HIGH": 0.50, "BALANCED": 0.30, "COMPACT": 0.18},
}


def choose_bitrate(source: Column, width: Column, height: Column, fps: Column, tier: Column, profile: Column, hdr: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """a share of the source's rate, or of the estimate where the source's is implausible."""
    estimate = estimate_bitrate(width, height, fps)
    table = F.create_map(*[x for p, t in FACTORS.items() for k, v in t.items() for x in (F.lit(f"{p}/{k}"), F.lit(v))])
    factor = F.element_at(table, F.concat_ws("/", F.when(hdr, "HDR").otherwise(profile), tier))
    target = F.floor(F.when(source.between(100_000, 200_000_000), source).otherwise(estimate) * factor)
    least = F.when((profile == "AGGRESSIVE") & ~hdr, F.floor(estimate * F.lit(0.20))).otherwise(0)
    target = F.greatest(target, least)
    if lower is not None and upper is not None:
        target = F.when(lower.isNull() | upper.isNull(), target).otherwise(F.least(F.greatest(target, lower), upper))
    return target.cast("int")


def memory_estimate_png(width: Column, height: Column, depth: Column, channels: Column, size: Column, metadata: Column) -> Column:
    """F30 (PNG): a bitmap of aligned rows, two rows, the file twice, its metadata, and a reserve."""
    pixel = F.when(depth == 16, 8).otherwise(4)
    row = F.floor((width * pixel + 63) / 64) * 64
    rows = F.greatest(width * channels * F.floor(depth / 8) * 2, width * 4)
    return (row * height + size * 2 + rows + metadata * 4 + 32 * MIB).cast("long")


def codec_text(fmt: Column, number: Column, depth: Column | None = None, kept: Column | None = None) -> Column:
    """what an item was encoded with, and what of it was kept."""
    deep = F.when(depth == 16, F.lit("from 16 bit")) if depth is not None else F.lit(None).cast("string")
    parts = F.concat_ws(", ", F.concat(F.lit("q"), number.cast("string")), deep, kept if kept is not None else F.lit(None).cast("string"))
    return F.concat(fmt, F.lit(" "), parts)


def outcome_text(done: Column, skipped: Column, failed: Column, saved: Column, reasons: Column) -> Column:
    """one line for a batch; parts that are 0 are left out."""
    part = lambda n, name: F.when(n > 0, F.concat(format_count(n), F.lit(name)))
    return F.concat_ws(", ", part(done, " done"), F.when(saved > 0, F.concat(F.lit("saved "), format_compact_size(saved))), part(skipped, " skipped"), part(failed, " failed"), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")))


def progress(done: Column, total: Column) -> Column:
    """0 where the total is unknown."""
    return F.when(total > 0, (done / total).cast("float")).otherwise(F.lit(0).cast("float"))
