"""What image containers say of themselves: size, palette length, frames and their durations, without decoding a pixel.

A container is a chain of blocks of unknown number, each of which says where the next one starts, so it is walked by a table
function: one row for each frame.  A file cut short gives the frames that are whole; bytes of another kind, or null, none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = "kind string, width int, height int, palette int, frame int, duration int"
#: Fixed value: milliseconds of a frame that states no duration.
DURATION = 100


def number(data: bytes, at: int, size: int) -> int:
    """A little-endian number; IndexError past the end."""
    if at + size > len(data):
        raise IndexError(at)
    return int.from_bytes(data[at : at + size], "little")


def gif_frames(data: bytes) -> Iterator[tuple]:
    """Frames of a GIF file: the delay, in hundredths of a second, stands in a control block before the image."""
    width, height, packed = number(data, 6, 2), number(data, 8, 2), number(data, 10, 1)
    palette = 2 << (packed & 7) if packed & 0x80 else 0
    at, frame, delay = 13 + 3 * palette, 0, None

    def after_blocks(at: int) -> int:
        while size := number(data, at, 1):
            at += 1 + size
        return at + 1

    while True:
        mark = number(data, at, 1)
        if mark == 0x21:  # an extension
            if number(data, at + 1, 1) == 0xF9 and number(data, at + 2, 1) >= 4:
                delay = number(data, at + 4, 2) * 10
            at = after_blocks(at + 2)
        elif mark == 0x2C:  # an image
            local = number(data, at + 9, 1)
            at = after_blocks(at + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
            yield "gif", width, height, palette, frame, DURATION if delay is None else delay
            frame, delay = frame + 1, None
        else:  # the end, or no block
            return


def webp_frames(data: bytes) -> Iterator[tuple]:
    """Frames of a RIFF/WEBP file: one for each animation chunk, or one if there is none."""
    at, frame, size = 12, 0, None
    while at + 8 <= len(data):
        name, length, body = data[at : at + 4], number(data, at + 4, 4), at + 8
        if name == b"VP8X":
            size = size or (number(data, body + 4, 3) + 1, number(data, body + 7, 3) + 1)
        elif name == b"ANMF" and size:
            duration = number(data, body + 12, 3)
            if body + length > len(data):
                return
            yield "webp", *size, 0, frame, duration
            frame += 1
        elif name == b"VP8 " and data[body + 3 : body + 6] == b"\x9d\x01\x2a":
            size = size or (number(data, body + 6, 2) & 0x3FFF, number(data, body + 8, 2) & 0x3FFF)
        elif name == b"VP8L" and data[body : body + 1] == b"\x2f":
            bits = number(data, body + 1, 4)
            size = size or ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        at = body + length + length % 2
    if not frame and size:
        yield "webp", *size, 0, 0, DURATION


def frames_of(data: bytes | None) -> Iterator[tuple]:
    """``FRAMES`` rows of a file's bytes."""
    data = bytes(data or b"")
    found = gif_frames(data) if data[:6] in (b"GIF87a", b"GIF89a") else webp_frames(data) if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else iter(())
    try:
        yield from found
    except IndexError:
        return


class Frames:
    """The table function."""

    def eval(self, content: bytes, always: bool) -> Iterator[tuple]:
        found = False
        for row in frames_of(content):
            found = True
            yield row
        if always and not found:
            yield (None,) * 6


def with_frames(files: DataFrame, content: str = "content", all_files: bool = False) -> DataFrame:
    """``files`` without their content, once for each frame, with ``FRAMES``; ``all_files``: those without a frame, too."""
    walk = F.udtf(Frames, returnType=FRAMES)
    rest = [c for c in files.columns if c != content]
    return files.lateralJoin(walk(F.col(content).outer(), F.lit(all_files))).select(*rest, "kind", "width", "height", "palette", "frame", "duration")


def summaries(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each file of :func:`with_frames`: size, palette, number of frames, whole and longest duration."""
    return frames.groupBy(*keys, "kind", "width", "height", "palette").agg(F.count("frame").alias("frames"), F.sum("duration").alias("total_ms"), F.max("duration").alias("longest_ms"))
