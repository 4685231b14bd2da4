"""Images that are whole, and what is cut off, changed or empty."""

import struct
import zlib

from foliant.functions import images


def _png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(b"\0\1\2" * 2)) + chunk(b"IEND", b"")


def _jpeg():
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xC0, b"\x08" + b"\0\2" * 2 + b"\1\1\x11\0") + seg(0xC4, b"\0" * 17) + seg(0xDA, b"\1\1\0\0?\0") + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"


def test_whole_images():
    for good in (_png(), _jpeg()):
        assert images.whole_image(good) and images.whole_image(good + b"behind it")
        assert not any(images.whole_image(good[:n]) for n in range(len(good)))
    flipped = bytearray(_png())
    flipped[45] ^= 1
    assert not images.whole_image(bytes(flipped)) and not images.whole_image(None) and not images.whole_image(b"GIF89a")


def test_in_a_table(spark):
    rows = [(1, bytearray(_png())), (2, bytearray(_jpeg()[:-2])), (3, None), (4, bytearray())]
    df = spark.createDataFrame(rows, "i int, content binary")
    assert {r["i"]: r["ok"] for r in df.select("i", images.whole_image_udf("content").alias("ok")).collect()} == {1: True, 2: False, 3: False, 4: False}
