"""Queries over bytes and XMP texts that are made from columns; oracles return the generator's
parameters, so a parser is held against the truth and not against another parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containers as C
from ..functions import fmt
from ..functions import xmp as X
from ..sources.driver import Driver
from .registry import query


def u(c: Column | int, width: int) -> Column:
    """Big-endian bytes of a number."""
    c = c if isinstance(c, Column) else F.lit(c)
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * width, "0"))


def raw(b: bytes) -> Column:
    return F.lit(bytearray(b))


def join(*parts: Column) -> Column:
    return F.concat(*parts)


def box(kind: str, body: Column) -> Column:
    return join(u(F.octet_length(body) + 8, 4), raw(kind.encode()), body)


def chunk(kind: str, body: Column, spoil: Column | None = None) -> Column:
    crc = F.crc32(join(raw(kind.encode()), body))
    if spoil is not None:
        crc = F.when(spoil, F.pmod(crc + 1, F.lit(1 << 32))).otherwise(crc)
    return join(u(F.octet_length(body), 4), raw(kind.encode()), body, u(crc, 4))


def pngs(d: Driver) -> DataFrame:
    k = F.col("k")
    rows = d.table("orders").select(F.col("o_orderkey").alias("k"))
    depth = F.when(k % 3 == 0, 8).when(k % 3 == 1, 16).otherwise(4)
    colour = F.element_at(F.array(*[F.lit(x) for x in (0, 2, 3, 4, 6, 5)]), (k % 6 + 1).cast("int"))
    header = join(u(k % 3000, 4), u(1 + k % 2000, 4), u(depth, 1), u(colour, 1), raw(b"\0\0"), F.when(k % 13 == 5, raw(b"\1")).otherwise(raw(b"\0")))
    middle = F.when(k % 11 == 3, chunk("acTL", raw(b"\0" * 8))).when(k % 11 == 4, chunk("abCd", raw(b"xy"))).when(k % 11 == 5, chunk("ABCD", raw(b"xy"))).otherwise(chunk("tEXt", raw(b"a\0b")))
    pixels = F.when(k % 17 == 2, raw(b"")).otherwise(chunk("IDAT", raw(b"pixels")))
    after = F.when(k % 19 == 7, raw(b"tail")).otherwise(raw(b""))
    return rows.withColumn("content", join(raw(C.PNG_SIGNATURE), chunk("IHDR", header, k % 23 == 6), middle, pixels, chunk("IEND", raw(b"")), after))


query(
    "b26_b27_png_probe",
    """SELECT o_orderkey AS k, CASE WHEN k % 23 = 6 THEN 'PNG_HEADER_CRC' WHEN k % 3000 = 0 THEN 'PNG_DIMENSIONS' WHEN k % 3 = 2 THEN 'PNG_LOW_DEPTH' WHEN k % 6 = 5 THEN 'PNG_COLOUR' WHEN k % 3 = 1 AND k % 6 = 2 THEN 'PNG_DEPTH_COLOUR'
    WHEN k % 13 = 5 THEN 'PNG_INTERLACED' WHEN k % 11 = 3 THEN 'PNG_APNG' WHEN k % 11 = 5 THEN 'PNG_UNKNOWN_CHUNK' WHEN k % 17 = 2 OR k % 19 = 7 THEN 'PNG_TRAILING' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
)(lambda d: pngs(d).select("k", C.column(C.png_probe, "string")(F.col("content")).alias("reason")))


def mp4s(d: Driver) -> DataFrame:
    k = F.col("k")
    rows = d.table("orders").select(F.col("o_orderkey").alias("k"))
    mvhd = F.when(k % 2 == 0, join(raw(b"\0\0\0\0"), u(k + 100, 4), u(k + 200, 4), raw(b"\0" * 12))).otherwise(join(raw(b"\1\0\0\0"), u(k + 100, 8), u(k + 200, 8), raw(b"\0" * 12)))
    stco = box("stco", join(raw(b"\0\0\0\0"), u(2, 4), u(k + 1000, 4), u(k + 2000, 4)))
    trak = box("trak", box("mdia", box("minf", box("stbl", stco))))
    moov = box("moov", join(box("mvhd", mvhd), trak, box("udta", F.repeat(F.lit("m"), (k % 9).cast("int")).cast("binary"))))
    media = F.when(k % 5 == 3, raw(b"")).otherwise(box("mdat", F.repeat(F.lit("v"), (k % 50).cast("int")).cast("binary")))
    vendor = F.when(k % 7 == 1, raw(b"\0\0vendor-tail")).otherwise(raw(b""))
    return rows.withColumn("content", join(box("ftyp", raw(b"isom\0\0\0\1")), moov, media, vendor))


query("b21_plain_mp4", "SELECT o_orderkey AS k, o_orderkey % 5 <> 3 AND o_orderkey % 7 <> 1 AS plain FROM orders")(lambda d: mp4s(d).select("k", C.column(C.is_plain_mp4, "boolean")(F.col("content")).alias("plain")))
query("b37_boxes", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 3 THEN 'ftyp,moov' ELSE 'ftyp,moov,mdat' END AS types FROM orders")(
    lambda d: mp4s(d).select("k", C.boxes_column(F.col("content")).alias("b")).select("k", F.array_join(F.col("b.type"), ",").alias("types"))
)
query("b38_meta_boxes", "SELECT o_orderkey AS k, 1 AS n, 8 + o_orderkey % 9 AS size FROM orders")(
    lambda d: mp4s(d).select("k", C.boxes_column(F.col("content"), children_of_moov=True).alias("b")).select("k", F.size("b").alias("n"), F.try_element_at("b", F.lit(1))["size"].alias("size"))
)
query("b39_mvhd_times", "SELECT o_orderkey AS k, o_orderkey + 100 AS created, o_orderkey + 200 AS modified FROM orders")(
    lambda d: mp4s(d).select("k", C.column(C.mvhd_times, "struct<created:long,modified:long>")(F.col("content")).alias("t")).select("k", "t.created", "t.modified")
)
query("b15_embedded_video", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 5 + o_orderkey % 300 END AS at FROM orders")(
    lambda d: mp4s(d)
    .withColumn("content", join(F.repeat(F.lit("p"), (F.col("k") % 300 + 5).cast("int")).cast("binary"), F.when(F.col("k") % 4 == 0, raw(b"none")).otherwise(F.col("content"))))
    .select("k", C.column(C.find_mp4_start, "long")(F.col("content")).alias("at"))
)
query("b20_split_motion", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 3 OR o_orderkey % 7 = 1 THEN NULL ELSE 4 END AS tail FROM orders")(
    lambda d: mp4s(d)
    .withColumn("whole", join(F.col("content"), raw(b"tail")))
    .select("k", C.column(lambda b: len(s[1]) if (s := C.split_motion(b, len(b) - 4)) else None, "int")(F.col("whole")).alias("tail"))
)


def jpegs(d: Driver) -> DataFrame:
    k = F.col("k")
    rows = d.table("orders").select(F.col("o_orderkey").alias("k"))
    segment = lambda marker, payload: join(raw(bytes([0xFF, marker])), u(F.octet_length(payload) + 2, 2), payload)
    entry = lambda attributes, size, offset: join(u(attributes, 4), u(size, 4), u(offset, 4), raw(b"\0\0\0\0"))
    mpf = join(raw(C.MPF + b"MM\0\x2a"), u(8, 4), u(2, 2), raw(b"\xb0\x01\0\4\0\0\0\1"), u(2, 4), raw(b"\xb0\x02\0\7"), u(32, 4), u(38, 4), u(0, 4), entry(F.lit(3), k + 10, F.lit(0)), entry(F.lit(0), k + 20, k + 30))
    exif = segment(C.APP1, join(raw(C.EXIF), F.repeat(F.lit("e"), (k % 40).cast("int")).cast("binary")))
    xmp = segment(C.APP1, join(raw(C.XMP), F.concat(F.lit("<x id="), k.cast("string"), F.lit("/>")).cast("binary")))
    head = join(raw(b"\xff\xd8"), exif, F.when(k % 3 == 0, xmp).otherwise(raw(b"")), F.when(k % 5 == 0, segment(C.APP2, mpf)).otherwise(raw(b"")), segment(C.COM, raw(b"hi")))
    scan = join(raw(b"\xff\xda\0\3z"), F.repeat(F.lit("s"), (k % 70).cast("int")).cast("binary"), raw(b"\xff\0\xff\xd1ab\xff\xd9"))
    body = join(head, F.when(k % 8 == 1, raw(b"\xff\xda\0\3zcut")).otherwise(scan))
    return rows.withColumn("content", join(body, raw(b"trailer"))).withColumn("end", F.octet_length(body))


query("b1_is_jpeg", "SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS jpeg FROM orders")(
    lambda d: jpegs(d).select("k", F.when(F.col("k") % 2 == 0, F.col("content")).otherwise(raw(b"\xff\xd8\xff\xe0")).alias("c")).select("k", C.is_jpeg(F.col("c")).alias("jpeg"))
)
query("b2_b4_segments", "SELECT o_orderkey AS k, 'EXIF' || CASE WHEN o_orderkey % 3 = 0 THEN ',XMP' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',MPF' ELSE '' END || ',254' AS kinds FROM orders")(
    lambda d: jpegs(d).select("k", C.segments_column(F.col("content")).alias("s")).select("k", F.array_join(F.transform("s", lambda x: F.coalesce(x["kind"], x["marker"].cast("string"))), ",").alias("kinds"))
)
query(
    "b3_image_end",
    "SELECT k, CASE WHEN k % 8 <> 1 THEN 2 + 10 + k % 40 + CASE WHEN k % 3 = 0 THEN 33 + 6 + length(k::VARCHAR) + 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 78 ELSE 0 END + 6 + 5 + k % 70 + 8 END AS at FROM (SELECT o_orderkey AS k FROM orders)",
)(lambda d: jpegs(d).select("k", C.column(C.image_end, "long")(F.col("content")).alias("at")))
query("b5_xmp_text", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '<x id=' || o_orderkey || '/>' END AS xmp FROM orders")(lambda d: jpegs(d).select("k", C.column(C.xmp_text, "string")(F.col("content")).alias("xmp")))
query("b8_mpf_entries", "SELECT o_orderkey AS k, i, CASE i WHEN 0 THEN 3 ELSE 0 END AS attributes, o_orderkey + 10 * (i + 1) AS size, CASE i WHEN 0 THEN 0 ELSE o_orderkey + 30 END AS offset FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 5 = 0")(
    lambda d: jpegs(d).select("k", F.posexplode(C.entries_column(F.col("content"))).alias("i", "e")).select("k", "i", "e.attributes", "e.size", "e.offset")
)
query("b7_rebuild", "SELECT o_orderkey AS k, '<new/>' AS xmp, true AS same_tail FROM orders")(
    lambda d: jpegs(d)
    .select("k", C.column(lambda b: (lambda out: (C.xmp_text(out), out.endswith(b"abtrailer"[-7:])))(C.rebuild(b"\xff\xd8\xff\xda\0\3zab\xff\xd9trailer", b, "<new/>")), "struct<xmp:string,same_tail:boolean>")(F.col("content")).alias("r"))
    .select("k", "r.xmp", "r.same_tail")
)
query("b32_crc", "SELECT n AS k, crc FROM (VALUES (0, 2923585666), (1, 4236614536), (2, 900662814)) t(n, crc)")(
    # Checksums of fixed bodies, as any CRC-32 gives them.
    lambda d: d.spark.createDataFrame([(0, "IEND", ""), (1, "tEXt", "abc"), (2, "IDAT", "")], "k int, kind string, body string").select("k", C.chunk_crc(F.col("kind").cast("binary"), F.col("body").cast("binary")).alias("crc"))
)
query("b44_b45_codec_boxes", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey % 32 END AS profile, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 8 + o_orderkey % 8 END AS depth, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 + o_orderkey % 20 END AS transfer FROM orders")(
    lambda d: d.table("orders")
    .select(F.col("o_orderkey").alias("k"))
    .withColumn("c", join(raw(b"head"), F.when(F.col("k") % 3 == 0, raw(b"")).otherwise(join(raw(b"hvcC\1"), u(F.col("k") % 32, 1), raw(b"\0" * 15), u(F.col("k") % 8, 1))), F.when(F.col("k") % 4 == 0, raw(b"")).otherwise(join(raw(b"colrnclx\0\1"), u(1 + F.col("k") % 20, 2), raw(b"\0\1\0")))))
    .select("k", C.column(C.hevc_config, "struct<profile:int,depth:int>")(F.col("c")).alias("h"), C.column(C.colour_info, "struct<p:int,transfer:int,m:int>")(F.col("c")).alias("o"))
    .select("k", "h.profile", "h.depth", "o.transfer")
)
query("b41_b42_trailing_marker", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'packet ' || o_orderkey END AS packet FROM orders")(
    lambda d: mp4s(d)
    .withColumn("packet", F.concat(F.lit("packet "), F.col("k").cast("string")).cast("binary"))
    .withColumn("whole", F.when(F.col("k") % 2 == 0, join(F.col("content"), u(F.octet_length("packet") + 24, 4), raw(b"uuid" + C.XMP_UUID), F.col("packet"))).otherwise(F.col("content")))
    .select("k", C.column(C.marker_packet, "string")(F.col("whole")).alias("packet"))
)


def packets(d: Driver) -> DataFrame:
    """XMP texts with container items and, in some, a marker."""
    k = F.col("k").cast("string")
    rows = d.table("orders").select(F.col("o_orderkey").alias("k"))
    item = lambda semantic, *more: F.concat(F.lit(f'<Container:Item Item:Mime="image/jpeg" Item:Semantic="{semantic}"'), *more, F.lit("/>"))
    motion = F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(item("MotionPhoto", F.lit(' Item:Length="1" Item:Length="'), k, F.lit('" Item:Padding="'), F.when(F.col("k") % 3 == 0, "x").otherwise("8"), F.lit('"')))
    marker = F.when(F.col("k") % 5 == 0, F.concat(F.lit(f' xmlns:{X.PREFIX}="{X.URI}" {X.PREFIX}:{X.FIELDS["id"]}="id-'), k, F.lit(f'" {X.PREFIX}:{X.FIELDS["time_ms"]}="'), k, F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(F.lit('<rdf:Description note="a>b"'), marker, F.lit(' OpCamera:VideoLength="'), k, F.lit('"><Container:Directory>'), item("Primary"), item("GainMap", F.lit(' Item:Length="50"')), motion, F.lit("</Container:Directory></rdf:Description>"))
    return rows.withColumn("text", text)


query("b12_container_items", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS motion, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 8 END END AS padding FROM orders")(
    lambda d: packets(d).select("k", X.container_items(F.col("text")).alias("i")).select("k", F.size("i").alias("n"), X.first_item(F.col("i"), "MotionPhoto")["length"].alias("motion"), X.first_item(F.col("i"), "MotionPhoto")["padding"].alias("padding"))
)
query("b13_video_length", "SELECT o_orderkey AS k, o_orderkey AS n FROM orders")(lambda d: packets(d).select("k", X.video_length(F.col("text")).alias("n")))
_PAD = "CASE WHEN k % 3 = 0 THEN 0 ELSE 8 END"
query("b14_motion_photo", f"SELECT k, CASE WHEN k % 4 <> 0 AND k BETWEEN 1 AND 6999 AND 7000 - k - {_PAD} > 0 THEN 7000 - k - {_PAD} END AS motion_offset FROM (SELECT o_orderkey AS k FROM orders)")(
    lambda d: packets(d).select("k", X.detect_motion(F.col("text"), F.lit(7000).cast("long")).alias("m")).select("k", "m.motion_offset")
)
query("b16_primary_end", f"SELECT k, CASE WHEN e > 0 THEN e END AS e FROM (SELECT k, CASE WHEN k % 4 = 0 THEN 6950 ELSE 6950 - k - {_PAD} END AS e FROM (SELECT o_orderkey AS k FROM orders))")(
    lambda d: packets(d).select("k", X.primary_end(X.container_items(F.col("text")), F.lit(7000).cast("long")).alias("e"))
)
query("b18_b19_rewrite", "SELECT o_orderkey AS k, 77 AS gain, 88 AS prim, 99 AS video, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS motion FROM orders")(
    lambda d: packets(d)
    .withColumn("text", X.rewrite_video_length(X.rewrite_item_length(X.rewrite_item_length(F.col("text"), "GainMap", F.lit(77)), "Primary", F.lit(88)), F.lit(99)))
    .select("k", X.container_items(F.col("text")).alias("i"), X.video_length(F.col("text")).alias("video"))
    .select("k", X.first_item(F.col("i"), "GainMap")["length"].alias("gain"), X.first_item(F.col("i"), "Primary")["length"].alias("prim"), "video", X.first_item(F.col("i"), "MotionPhoto")["length"].alias("motion"))
)
query("b22_verify", "SELECT o_orderkey AS k, CASE WHEN o_orderkey = 0 AND o_orderkey % 4 <> 0 THEN 'EMPTY_ITEM' END AS reason FROM orders")(lambda d: packets(d).select("k", X.verify_items(X.container_items(F.col("text"))).alias("reason")))
query("b23_marker", "SELECT o_orderkey AS k, 'id-' || o_orderkey AS id, '' AS version, o_orderkey AS time_ms FROM orders WHERE o_orderkey % 5 = 0")(
    lambda d: packets(d).select("k", X.read_marker(F.col("text")).alias("m")).filter("m IS NOT NULL").select("k", "m.id", "m.version", "m.time_ms")
)
query("b24_b25_inject_remove", "SELECT o_orderkey AS k, 'new' AS id, 5 AS time_ms, true AS clean, true AS again FROM orders")(
    lambda d: packets(d)
    .withColumn("marker", X.marker(F.lit("new"), F.lit("1"), F.lit(5)))
    .withColumn("once", X.inject_marker(F.col("text"), F.col("marker")))
    .select("k", X.read_marker(F.col("once")).alias("m"), (X.strip_marker(F.col("once")) == X.strip_marker(F.col("text"))).alias("clean"), (X.inject_marker(F.col("once"), F.col("marker")) == F.col("once")).alias("again"))
    .select("k", "m.id", "m.time_ms", "clean", "again")
)
query(
    "f23_choose_bitrate",
    """, q AS (SELECT id, CASE WHEN id % 6 = 0 THEN 50000 ELSE 100000 + size % 30000000 END AS src, CASE id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.18::DOUBLE END AS f,
      CAST(greatest(least(floor(width::DOUBLE * height * 0.09::DOUBLE * 30), 40000000), 300000) AS INT) AS est FROM media)
    SELECT id, CAST(least(greatest(floor(CASE WHEN src >= 100000 THEN src ELSE est END * f), floor(est * 0.2::DOUBLE), 400000), 9000000) AS INT) AS bitrate FROM q""",
)(
    lambda d: d.media().select(
        "id",
        fmt.choose_bitrate(
            F.when(F.col("id") % 6 == 0, 50_000).otherwise(100_000 + F.col("size") % 30_000_000), F.col("width"), F.col("height"), F.lit(30), F.when(F.col("id") % 3 == 0, "HIGH").when(F.col("id") % 3 == 1, "BALANCED").otherwise("COMPACT"), F.lit("AGGRESSIVE"), F.lit(False), F.lit(400_000), F.lit(9_000_000)
        ).alias("bitrate"),
    )
)
