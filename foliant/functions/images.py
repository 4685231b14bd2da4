"""Whether the bytes of an image are whole: chunks and markers are walked to the end, as a decoder would, without the pixels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd

from .lazy import vectorised

# How PNG files begin; markers of JPEG without a length, and those that begin a scan and end the image.
_PNG = b"\x89PNG\r\n\x1a\n"
_ALONE, _SCAN, _END = {0x01, *range(0xD0, 0xD8)}, 0xDA, 0xD9


def whole_png(data: bytes) -> bool:
    """Chunks fit, their sums are right, the head comes first, some image data follows and the end chunk is there."""
    if not data.startswith(_PNG):
        return False
    at, n, seen = len(_PNG), 0, False
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 4 : at + 8 + size]
        if len(body) != 4 + size or zlib.crc32(body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return False
        if n == 0 and (kind != b"IHDR" or size != 13 or not any(body[4:8]) or not any(body[8:12])):
            return False
        seen |= kind == b"IDAT"
        if kind == b"IEND":
            return seen
        at, n = at + 12 + size, n + 1
    return False


def whole_jpeg(data: bytes) -> bool:
    """Segments fit, a frame comes before a scan, and the end marker is reached behind it."""
    if data[:2] != b"\xff\xd8":
        return False
    at, frame, scan = 2, False, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            if not scan:
                return False
            at = data.find(b"\xff", at)  # entropy-coded data
            if at < 0:
                return False
            continue
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
        elif mark == _END:
            return scan
        elif mark in _ALONE or (mark == 0 and scan):
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                return False
            frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
            if mark == _SCAN:
                if not frame:
                    return False
                scan = True
            at += 2 + size
    return False


def whole_image(data: bytes | None) -> bool:
    return bool(data) and (whole_png(data) or whole_jpeg(data))


@vectorised("boolean")
def whole_image_udf(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(whole_image).astype(bool)
