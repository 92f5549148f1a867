"""Classification of catalog rows: format, kind, support, HDR; all JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas

# Mime types and extensions of each format, first match wins.
IMAGE_RULES = (
    ("JPEG", ("image/jpeg",), ("jpg", "jpeg")),
    ("HEIC", ("image/heic", "image/heif"), ("heic", "heif")),
    ("PNG", ("image/png",), ("png",)),
    ("WEBP", ("image/webp",), ("webp",)),
    ("BMP", ("image/bmp", "image/x-ms-bmp"), ("bmp",)),
    ("GIF", ("image/gif",), ("gif",)),
    ("AVIF", ("image/avif",), ("avif",)),
    ("DNG", (), ("dng", "raw", "arw", "cr2", "nef", "orf", "rw2")),
)
VIDEO_EXTENSIONS = (("MP4", ("mp4", "m4v")), ("MOV", ("mov",)), ("MKV", ("mkv",)), ("WEBM", ("webm",)), ("THREE_GP", ("3gp", "3gpp")), ("TS", ("ts", "m2ts")))
VIDEO_MIMES = (("MP4", "video/mp4"), ("MOV", "video/quicktime"), ("WEBM", "video/webm"), ("MKV", "video/x-matroska"))
MAIN10_PROFILES = (2, 4096, 8192)
PQ, HLG, BT2020 = (6, 16), (7, 18), 6
CODEC_LABELS = {"video/avc": "H.264", "video/hevc": "HEVC", "video/av01": "AV1", "video/x-vnd.on2.vp9": "VP9"}


def _cases(rules: list[tuple[Column, object]], otherwise) -> Column:
    first, *rest = rules
    chain = reduce(lambda w, r: w.when(r[0], r[1]), rest, F.when(first[0], first[1]))
    return chain.otherwise(otherwise)


def is_blank(c: Column) -> Column:
    return c.rlike(r"^\s*$")


def extension_of(name: Column) -> Column:
    """text behind the last dot, lower case; without a dot, empty."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def _first_rule(names: list[str], *keys: tuple[Column, dict[str, int]]) -> Column:
    """The name with the smallest number that any key has in its table. Tables keep the expression small:
    a chain of cases over all names outgrows what the JVM compiles in one method."""
    table = lambda t: F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(v))])
    numbers = [F.coalesce(F.try_element_at(table(t), c), F.lit(len(names) + 1)) for c, t in keys]
    number = F.least(*numbers) if len(numbers) > 1 else numbers[0]
    return F.element_at(F.array(*[F.lit(n) for n in [*names, "UNKNOWN"]]), number)


def image_format(mime: Column, name: Column) -> Column:
    """F2."""
    numbered = list(enumerate(IMAGE_RULES, 1))
    by_mime, by_ext = ({x: i for i, rule in numbered for x in rule[k]} for k in (1, 2))
    return _first_rule([r[0] for r in IMAGE_RULES], (mime, by_mime), (extension_of(name), by_ext))


def video_format(mime: Column, name: Column) -> Column:
    """extensions first."""
    names = [f for f, _ in VIDEO_EXTENSIONS] + [f for f, _ in VIDEO_MIMES]
    by_ext = {x: i for i, (_, e) in enumerate(VIDEO_EXTENSIONS, 1) for x in e}
    by_mime = {m: i for i, (_, m) in enumerate(VIDEO_MIMES, len(VIDEO_EXTENSIONS) + 1)}
    return _first_rule(names, (extension_of(name), by_ext), (mime, by_mime))


def image_reason(fmt: Column) -> Column:
    """null where supported."""
    codes = {"BMP": "BMP_UNSUPPORTED", "WEBP": "WEBP_UNSUPPORTED", "GIF": "GIF_UNSUPPORTED", "AVIF": "AVIF_UNSUPPORTED", "DNG": "RAW_UNSUPPORTED"}
    return _cases([(fmt.isin("JPEG", "HEIC", "PNG"), F.lit(None).cast("string")), *[(fmt == f, F.lit(c)) for f, c in codes.items()]], F.lit("IMAGE_UNKNOWN"))


def hdr_kind(transfer: Column, ten_bit: Column) -> Column:
    """F8."""
    return F.when(transfer.isin(*PQ), "PQ").when(transfer.isin(*HLG), "HLG").when(ten_bit, "OTHER").otherwise("NONE")


def is_hdr(transfer: Column, ten_bit: Column) -> Column:
    return ten_bit | (hdr_kind(transfer, ten_bit) != "NONE")


def is_main10(profile: Column, depth: Column) -> Column:
    return profile.isin(*MAIN10_PROFILES) | (depth >= 10)


def ten_bit_flag(transfer: Column, standard: Column, codec: Column, profile: Column, depth: Column) -> Column:
    """HDR flag at probe time."""
    hevc = F.coalesce(codec == "video/hevc", F.lit(False))
    return transfer.isin(*PQ, *HLG) | (standard == BT2020) | (hevc & profile.isin(*MAIN10_PROFILES)) | (depth >= 10)


def merge_colr(fmt: Column, codec: Column, probe: Column, colr: Column) -> Column:
    """an MP4's own colour box fills in where the probe named no transfer."""
    use = (fmt == "MP4") & codec.isNotNull() & (probe["transfer"] < 0) & F.coalesce(colr["transfer"] >= 0, F.lit(False))
    flag = probe["ten_bit"] | colr["transfer"].isin(*PQ, *HLG) | (colr["primaries"] == 9)
    standard = F.when(colr["primaries"] == 9, F.lit(BT2020)).otherwise(probe["standard"])
    patched = F.struct(flag.alias("ten_bit"), colr["transfer"].alias("transfer"), standard.alias("standard"))
    return F.when(use, patched).otherwise(F.struct(probe["ten_bit"].alias("ten_bit"), probe["transfer"].alias("transfer"), probe["standard"].alias("standard")))


def video_reason(fmt: Column, codec: Column, transfer: Column, ten_bit: Column, can_preserve_hdr: bool) -> Column:
    """null where supported."""
    rules = [(fmt != "MP4", F.concat(F.lit("CONTAINER_"), fmt)), (codec.isNull(), F.lit("NO_VIDEO_TRACK"))]
    if not can_preserve_hdr:
        rules.append((is_hdr(transfer, ten_bit), F.concat(F.lit("HDR_NO_ENCODER_"), hdr_kind(transfer, ten_bit))))
    return _cases(rules, F.lit(None).cast("string"))


def compare_hdr(source: Column, output: Column) -> tuple[Column, Column]:
    """(fidelity, issue codes) of structs (transfer, ten_bit, profile, depth, standard)."""
    s_kind, o_kind = hdr_kind(source["transfer"], source["ten_bit"]), hdr_kind(output["transfer"], output["ten_bit"])
    issues = F.array_compact(
        F.array(
            F.when((s_kind != "NONE") & (s_kind != o_kind), F.concat(F.lit("TRANSFER_"), s_kind, F.lit("_"), o_kind)),
            F.when(is_main10(source["profile"], source["depth"]) & ~is_main10(output["profile"], output["depth"]), F.lit("MAIN10_LOST")),
            F.when((source["standard"] == BT2020) & (output["standard"] != BT2020), F.lit("BT2020_LOST")),
        )
    )
    plain = ~is_hdr(source["transfer"], source["ten_bit"])
    fidelity = F.when(plain, "PRESERVED").when(o_kind == "NONE", "LOST").when(F.size(issues) == 0, "PRESERVED").otherwise("DEGRADED")
    return fidelity, F.when(plain, F.array().cast("array<string>")).otherwise(issues)


def codec_label(codec: Column) -> Column:
    """null is unknown; a codec without a label is its own."""
    return _cases([(codec == k, F.lit(v)) for k, v in CODEC_LABELS.items()] + [(codec.isNull(), F.lit("UNKNOWN"))], codec)


def kind_of(is_video: Column, has_motion: Column, fmt: Column) -> Column:
    """only a JPEG can be a live photo."""
    return F.when(is_video, "VIDEO").when((fmt == "JPEG") & F.coalesce(has_motion, F.lit(False)), "LIVE_PHOTO").otherwise("PHOTO")


def parse_tier(c: Column) -> Column:
    """P29."""
    return F.when(c.isin(*schemas.TIERS), c).otherwise("BALANCED")


def parse_kind(c: Column) -> Column:
    return F.when(c.isin(*schemas.KINDS), c).otherwise("PHOTO")


def parse_format(c: Column) -> Column:
    return F.when(c.isin(*schemas.FORMATS), c).otherwise("UNKNOWN")
