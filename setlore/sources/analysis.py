"""Tagged big-endian analysis files: sections, three-band waveforms, beat grids. And pages with a playlist inside."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sections(data: bytes) -> list[tuple[str, int, int, int]]:
    """(name, offset, header length, length) of every section; reading stops at the first that does not fit."""
    found: list[tuple[str, int, int, int]] = []
    if len(data) < 8:
        return found
    (at,) = struct.unpack_from(">I", data, 4)
    while at + 12 <= len(data):
        header, length = struct.unpack_from(">II", data, at + 4)
        if length <= 0 or at + length > len(data):
            break
        found.append((data[at : at + 4].decode("ascii", "replace"), at, header, length))
        at += length
    return found


def three_bands(data: bytes, name: str = "PWV6") -> tuple[list[int], list[int], list[int]] | None:
    """(low, mid, high) of a waveform section whose header declares three bytes a column."""
    for section, at, header, length in sections(data):
        if section == name and at + 20 <= len(data):
            width, columns = struct.unpack_from(">II", data, at + 12)
            body = np.frombuffer(data[at + header : at + length], np.uint8)
            columns = min(columns, len(body) // 3)
            if width == 3 and columns > 0:
                return tuple(body[: columns * 3].reshape(-1, 3).T.astype(int).tolist())
    return None


def beat_grid(data: bytes, name: str = "PQTZ") -> list[dict]:
    """Beats (at in seconds, bpm, beat) of a grid section: 8 bytes each, beat, tempo times 100, milliseconds."""
    for section, at, header, length in sections(data):
        if section == name:
            rows = np.frombuffer(data[at + header : at + length - (length - header) % 8], np.dtype([("beat", ">u2"), ("bpm", ">u2"), ("ms", ">u4")]))
            return [{"at": r["ms"] / 1000.0, "bpm": r["bpm"] / 100.0, "beat": int(r["beat"])} for r in rows]
    return []


def phrase_entries(data: bytes, name: str = "PSSI") -> tuple[int, list[tuple[int, int]]] | None:
    """(mood, [(kind, beat)]) of a phrase section, entries in order; null without one. Masked sections are not read."""
    for section, at, header, length in sections(data):
        if section == name and header >= 20:
            width, count, mood = struct.unpack_from(">IHH", data, at + 12)
            starts = range(at + header, min(at + length, at + header + width * count) - 5, width) if width >= 6 else ()
            return mood, [(kind, beat) for beat, kind in (struct.unpack_from(">HH", data, i + 2) for i in starts)]
    return None


FILE = pa.struct([("at", pa.float64()), ("bpm", pa.float64()), ("beat", pa.int32())])


def read_analysis(files: DataFrame) -> DataFrame:
    """(path, low, mid, high, beats) of binary files (path, content), as spark.read.format('binaryFile') gives them; absent parts are null or empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            contents = [c or b"" for c in batch["content"].to_pylist()]
            bands = [three_bands(c) for c in contents]
            columns = [pa.array([b[i] if b else None for b in bands], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch["path"], *columns, pa.array([beat_grid(c) for c in contents], pa.list_(FILE))], names=["path", "low", "mid", "high", "beats"])

    return files.select("path", "content").mapInArrow(run, "path string, low array<int>, mid array<int>, high array<int>, beats array<struct<at:double,bpm:double,beat:int>>")


def audio_files(spark, folder: str, extensions: tuple[str, ...] = ("flac", "wav", "aif", "aiff", "mp3", "m4a", "ogg", "alac")) -> DataFrame:
    """(path, size, modified) of the audio files below a folder; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(folder)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def page_songs(pages: DataFrame, html: str, pattern: str = r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>') -> DataFrame:
    """(page_id, pos, title, artist, url) of the track list in the JSON that a page carries; malformed or absent JSON gives no row."""
    schema = "struct<tracks:array<struct<title:string,artist:string,url:string>>>"
    parsed = pages.select("page_id", F.from_json(F.regexp_extract(F.col(html), pattern, 1), schema[7:-1].replace("tracks:", "tracks ")).alias("j"))
    return parsed.select("page_id", F.posexplode("j.tracks").alias("pos", "t")).select("page_id", "pos", "t.title", "t.artist", "t.url")
