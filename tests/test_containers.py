"""Container walks on built bytes."""

import struct

from pyspark.sql import functions as F

from marlstone.sources import containers


def gif(frames, width=30, height=20, table=4, comment=b""):
    """``frames``: a delay in hundredths or None, and a local palette's bits or None."""
    bits = table.bit_length() - 2
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits if table else 0, 0, 0) + b"\1\2\3" * table
    for delay, local in frames:
        out += b"\x21\xfe" + b"".join(bytes([len(c)]) + c for c in (comment[i : i + 255] for i in range(0, len(comment), 255))) + b"\0"
        if delay is not None:
            out += b"\x21\xf9\x04\x05" + struct.pack("<H", delay) + b"\0\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x80 | local if local is not None else 0)
        out += b"\0\0\0" * (2 << local if local is not None else 0) + b"\x02" + b"\x03abc" + b"\x01,\0"
    return out + b"\x3b"


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def webp(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def u24(n):
    return n.to_bytes(3, "little")


CANVAS = chunk(b"VP8X", b"\x02\0\0\0" + u24(99) + u24(49))


def anmf(duration, extra=b"x"):
    return chunk(b"ANMF", u24(0) * 2 + u24(9) * 2 + u24(duration) + b"\0" + extra)


FILES = {
    1: (gif([(5, None), (None, 1), (0, None)], comment=b"c" * 700), [("gif", 30, 20, 4, 0, 50), ("gif", 30, 20, 4, 1, 100), ("gif", 30, 20, 4, 2, 0)]),
    2: (gif([(7, 7)], width=65535, table=0), [("gif", 65535, 20, 0, 0, 70)]),
    3: (gif([(5, None)] * 3)[:-20], [("gif", 30, 20, 4, i, 50) for i in range(2)]),
    4: (gif([]), []),
    5: (webp(CANVAS, chunk(b"ANIM", b"\0" * 6), anmf(40), chunk(b"EXIF", b"odd"), anmf(70000, b"xy")), [("webp", 100, 50, 0, 0, 40), ("webp", 100, 50, 0, 1, 70000)]),
    6: (webp(chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 640, 480) + b"..")), [("webp", 640, 480, 0, 0, 100)]),
    7: (webp(chunk(b"VP8L", b"\x2f" + struct.pack("<I", 319 | 239 << 14))), [("webp", 320, 240, 0, 0, 100)]),
    8: (webp(CANVAS, anmf(40), anmf(50))[:-3], [("webp", 100, 50, 0, 0, 40)]),
    9: (b"GIF89a\x01", []),
    10: (b"", []),
    11: (None, []),
    12: (b"\x89PNG\r\n\x1a\n", []),
    13: (webp(), []),
}


def test_walks():
    for content, want in FILES.values():
        assert list(containers.frames_of(content)) == want


def test_table_function(spark):
    files = spark.createDataFrame([(i, c and bytearray(c), "k") for i, (c, _) in FILES.items()], "id int, content binary, note string")
    got = containers.with_frames(files)
    assert sorted(map(tuple, got.drop("note").collect())) == sorted((i, *r) for i, (_, rows) in FILES.items() for r in rows)
    every = containers.with_frames(files, all_files=True)
    assert every.select("id").distinct().count() == len(FILES) and every.filter("frame is null").count() == 6
    whole = {r["id"]: tuple(r)[1:] for r in containers.summaries(got, ["id"]).collect()}
    assert whole[1] == ("gif", 30, 20, 4, 3, 150, 100) and whole[5] == ("webp", 100, 50, 0, 2, 70040, 70000)
    assert containers.with_frames(files.filter(F.lit(False))).count() == 0
