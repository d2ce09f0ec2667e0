"""Headers of JPEG and PNG files against a plain reader of the same bytes."""

import random
import struct

from pyspark.sql import functions as F

from folio.sources import image_headers as H

FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def frame(width, height, marker=0xC0):
    return segment(marker, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")


def exif(turn, order=">", tag=0x0112, kind=3, before=0, at=8):
    mark = b"MM\x00*" if order == ">" else b"II*\x00"
    entry = lambda t, k, v: struct.pack(order + "HHIHH", t, k, 1, v, 0)
    directory = struct.pack(order + "H", before + 1) + b"".join(entry(0x100 + i, 3, 5) for i in range(before)) + entry(tag, kind, turn)
    return segment(0xE1, b"Exif\x00\x00" + mark + struct.pack(order + "I", at) + b"\x00" * (at - 8) + directory)


def plain(data):
    """The same by a loop."""
    if data[:2] != b"\xff\xd8":
        return None
    at, size, block = 2, None, None
    while at + 1 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if at + 4 > len(data):
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2 or at + 2 + n > len(data):
            break
        if marker in FRAMES and n >= 8 and size is None:
            height, width = struct.unpack_from(">HH", data, at + 5)
            size = (width, height) if width else None
        if marker == 0xE1 and block is None and data[at + 4 : at + 10] == b"Exif\x00\x00":
            block = at + 10
        at += 2 + n
    if size is None or not size[1]:
        return None
    turn = None
    if block is not None and data[block : block + 4] in (b"II*\x00", b"MM\x00*"):
        order = "<" if data[block : block + 1] == b"I" else ">"
        try:
            place = block + struct.unpack_from(order + "I", data, block + 4)[0]
            for i in range(struct.unpack_from(order + "H", data, place)[0]):
                if place + 2 + 12 * i + 8 > len(data):
                    break
                t, k, c = struct.unpack_from(order + "HHI", data, place + 2 + 12 * i)
                if (t, k, c) == (0x0112, 3, 1):
                    turn = struct.unpack_from(order + "H", data, place + 2 + 12 * i + 8)[0]
                    break
        except struct.error:
            pass
    return (*size, turn if turn in range(1, 9) else 1)


def read(spark, files):
    rows = spark.createDataFrame(list(enumerate(files)), "i int, c binary").select("i", H.image_header(F.col("c")).alias("h")).orderBy("i").collect()
    return [tuple(r.h) if r.h else None for r in rows]


def test_known_headers(spark):
    start, scan = b"\xff\xd8", segment(0xDA, b"\x00" * 6)
    note = segment(0xFE, b"\xff\xc0" * 30000)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 200)
    cases = [
        (start + frame(640, 480) + scan, (640, 480, 1)), (start + exif(6) + frame(640, 480), (640, 480, 6)), (start + exif(8, "<", before=3, at=20) + frame(65535, 1, 0xC2), (65535, 1, 8)),
        (start + note * 90 + b"\xff" * 100 + frame(7, 9) + exif(3) + scan, (7, 9, 3)), (start + exif(9) + frame(3, 4), (3, 4, 1)), (start + exif(6, kind=4) + frame(3, 4), (3, 4, 1)),
        (start + segment(0xE1, b"http://ns") + exif(2) + exif(5) + frame(3, 4), (3, 4, 2)), (start + scan + frame(3, 4), None), (start + frame(3, 4)[:-1], None), (start + frame(0, 4), None),
        (start + segment(0xC4, b"\x08" * 20) + b"\xff\xd0" + frame(3, 4) + b"junk", (3, 4, 1)), (start + b"\x00" + frame(3, 4), None), (start, None), (b"\xff", None), (b"", None), (None, None),
        (start + segment(0xE1, b"Exif\x00\x00MM\x00*\xff\xff\xff\xff") + frame(3, 4), (3, 4, 1)), (png, (300, 200, 1)), (png[:20], None), (b"%PDF-1.7", None),
    ]
    assert read(spark, [c for c, _ in cases]) == [want for _, want in cases]
    shown = spark.createDataFrame([(start + exif(6) + frame(640, 480),)], "c binary").select(H.oriented(H.image_header(F.col("c"))).alias("s")).first().s
    assert tuple(shown) == (480, 640)


def test_damaged_headers_equal_a_plain_reader(spark):
    rnd = random.Random(5)
    files = []
    for _ in range(300):
        parts = [rnd.choice([exif(rnd.randrange(10), rnd.choice("<>"), before=rnd.randrange(3)), frame(rnd.randrange(3), rnd.randrange(3)), frame(20, 30), segment(0xFE, rnd.randbytes(rnd.randrange(9))), b"\xff", b"\xff\xd3"]) for _ in range(rnd.randrange(6))]
        data = bytearray(b"\xff\xd8" + b"".join(parts))
        for _ in range(rnd.randrange(3)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        files.append(bytes(data[: rnd.randrange(len(data) + 1)] if rnd.random() < 0.3 else data))
    assert read(spark, files) == [plain(x) for x in files]
