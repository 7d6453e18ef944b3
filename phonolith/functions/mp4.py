"""MP4 boxes: listing, metadata injection and checks on binary columns (SNK2, SNK3, SC21, FLT6, FLT7, SRC14).

The tree is walked by its sizes: 64-bit sizes and sizes to the end of the file
are understood, media data is never searched, and chunk offsets move when the
movie box stands before the media data.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# Boxes that hold boxes, and the metadata of the five-stream container with its keys.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"edts", b"dinf"}
SLOTS = ("master", "drums", "bass", "other", "vocals")
METADATA = {
    "mastering_dsp": {
        "compressor": {
            "attack": 0.003000000026077032,
            "dry_wet": 50,
            "enabled": False,
            "hp_cutoff": 300,
            "input_gain": 6,
            "output_gain": 0,
            "ratio": 3,
            "release": 0.300000011920929,
            "threshold": 0,
        },
        "limiter": {"ceiling": 0, "enabled": False, "release": 0.001000000047497451, "threshold": 0},
    },
    "offset": 0,
    "stems": [
        {"color": "#FD6C38", "name": "Drums"},
        {"color": "#D232F4", "name": "Bass"},
        {"color": "#00FFAC", "name": "Other"},
        {"color": "#45DAFD", "name": "Vocals"},
    ],
    "version": 2,
}


def metadata_json() -> str:
    return json.dumps(METADATA, separators=(",", ":"), ensure_ascii=False)


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, int, str, int, int]]:
    """(offset, size, type, depth, header bytes) of each box, parents before children. A broken size ends its level."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield start, size, kind.decode("latin-1"), depth, head
        if kind in PARENTS:
            yield from boxes(data, start + head, start + size, depth + 1)
        start += size


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def inject(data: bytes, metadata: str) -> bytes:
    """The file with its movie box's user data replaced by the metadata, and alternate groups cleared."""
    found = list(boxes(data))
    movie = next((b for b in found if b[2] == "moov" and b[3] == 0), None)
    if movie is None:
        raise ValueError("no moov box")
    at, size, _, _, head = movie
    out, kept = bytearray(data), b""
    for start, _, kind, _, header in found:
        if kind == "tkhd" and at < start < at + size:
            group = start + header + (46 if out[start + header] == 1 else 34)
            out[group : group + 2] = b"\0\0"
    for start, length, kind, depth, _ in found:
        if depth == 1 and at < start < at + size and kind != "udta":
            kept += bytes(out[start : start + length])
    body = kept + box(b"udta", box(b"stem", metadata.encode()))
    moved = len(body) + 8 - size
    new = box(b"moov", body)
    if moved:
        new = _moved(new, at + size, moved)
    return bytes(out[:at]) + new + bytes(out[at + size :])


def _moved(movie: bytes, after: int, by: int) -> bytes:
    """Chunk offsets behind the movie box follow the media data."""
    out = bytearray(movie)
    for start, _, kind, _, head in boxes(movie):
        if kind in ("stco", "co64"):
            form, width = (">I", 4) if kind == "stco" else (">Q", 8)
            n = struct.unpack_from(">I", out, start + head + 4)[0]
            for i in range(n):
                at = start + head + 8 + width * i
                value = struct.unpack_from(form, out, at)[0]
                if value >= after:
                    struct.pack_into(form, out, at, value + by)
    return bytes(out)


@udtf(returnType=T.StructType().add("offset", T.LongType()).add("size", T.LongType()).add("type", T.StringType()).add("depth", T.IntegerType()))
class BoxList:
    """``select * from files, lateral box_list(content)``."""

    def eval(self, data: bytes):
        for start, size, kind, depth, _ in boxes(data or b""):
            yield start, size, kind, depth


def injected(content: Column, metadata: Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or t is None else inject(bytes(d), t) for d, t in zip(data, text)], dtype=object)

    return run(content, metadata)


def five_audio_streams(probe: Column) -> Column:
    """Struct (ok, message) of a stream probe's JSON."""
    streams = F.from_json(probe, "streams array<struct<codec_type:string>>")["streams"]
    n = F.coalesce(F.size(F.filter(streams, lambda s: s["codec_type"] == "audio")), F.lit(0))
    n = F.when(streams.isNull(), 0).otherwise(n)
    return F.struct(
        (n == 5).alias("ok"),
        F.when(n == 5, F.lit("5 audio streams")).otherwise(F.concat(F.lit("expected 5 audio streams, found "), n.cast("string"))).alias("message"),
    )


def checks(info: Column) -> Column:
    """What a container's description lacks or has too much, one text for each failed test, in order."""
    # The texts that the describing program writes.
    need = {"brand is not mp42": ["Major Brand mp42"], "no slot metadata box": ["UDTA types:", "\tstem:"], "metadata is not of version 2": ['"version":2'], "last slot has no name": ['"name":"Vocals"']}
    bar = {"a track is off": "Disabled In Movie", "tracks are alternates": "Alternate Group ID", "an object descriptor is at the root": "File has root IOD"}
    holds = {label: reduce(and_, (info.contains(t) for t in texts)) for label, texts in need.items()}
    holds |= {label: ~info.contains(t) for label, t in bar.items()}
    return F.filter(F.array(*[F.when(~ok, F.lit(label)) for label, ok in holds.items()]), lambda n: n.isNotNull())


def plan_json(output: Column, path: Column, codec: str, bitrate: int, sample_rate: int, backend: str) -> Column:
    """The dry-run plan: the master by path, the other slots by source."""
    streams = [F.struct(F.lit("master").alias("slot"), path.alias("path"), F.lit(None).cast("string").alias("source"))]
    streams += [F.struct(F.lit(s).alias("slot"), F.lit(None).cast("string").alias("path"), F.lit(f"{backend}:{s}").alias("source")) for s in SLOTS[1:]]
    return F.to_json(
        F.struct(
            output.alias("output"),
            F.lit(codec).alias("codec"),
            F.lit(bitrate).alias("bitrate"),
            F.lit(sample_rate).alias("sample_rate"),
            F.lit(True).alias("native"),
            F.array(*streams).alias("streams"),
        )
    )
