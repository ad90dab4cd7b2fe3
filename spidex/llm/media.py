"""Media columns: ISO base media files in a binary column.

``encode`` stores bytes losslessly as access units of 64 8-bit samples (codec ``raw ``, one channel), ``probe`` walks
the nested boxes of any such file, decodes the sample tables and gives codec, duration and the byte ranges
of the keyframes without touching a payload, ``payload`` reads the stored samples back through those tables.

Defined results: a null text is stored as an empty one, which is 64 zero bytes; ``probe`` of null, of bytes that are not such a file or
of a file whose tables contradict themselves or reach past its end gives nulls and a message in ``error``, and takes memory in
proportion to the file; of several tracks the first video track stands for the file, else the first, and all are in ``tracks``; equal
payloads give equal files (no times, no names); a text of any length is one file, written whole; an empty table gives an empty result;
``with_probe`` keeps all other columns and replaces one that has the name of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spidex.llm.common import text_or_empty

UNIT, RATE, UNITS_A_CHUNK = 64, 8000, 16
DEEPEST = 64  # levels of boxes; files in use have eight or so
_HOLDS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def padded(data: bytes) -> bytes:
    return data + bytes(UNIT if not data else -len(data) % UNIT)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def encode(data: bytes) -> bytes:
    """A file of one track with ``data`` as it is; its length is a positive multiple of UNIT."""
    units = len(data) // UNIT
    chunks, last = -(-units // UNITS_A_CHUNK), (units - 1) % UNITS_A_CHUNK + 1
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    spans = [(1, UNITS_A_CHUNK, 1)] * (chunks > 1 or last == UNITS_A_CHUNK) + [(chunks, last, 1)] * (last < UNITS_A_CHUNK)
    wide = len(data) + 65536 + 16 * chunks >= 1 << 32

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_A_CHUNK)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * UNITS_A_CHUNK + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(spans)), *(struct.pack(">III", *s) for s in spans)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        length = units * UNIT
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(13)),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl),
        )
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    to_data = len(head) + len(moov(0)) + (16 if len(data) + 8 >= 1 << 32 else 8)
    return head + moov(to_data) + _box(b"mdat", data)


def boxes(file: bytes, start: int = 0, end: int | None = None):
    """(path, first, last) of the body of each box, outer ones first; bodies of media data are stepped over."""
    open_ = [(start, len(file) if end is None else end, ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", file, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut short")
            (size,), body = struct.unpack_from(">Q", file, body), start + 16
        size = size or end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes doesn't fit")
        yield (*path, kind), body, start + size
        open_.append((start + size, end, path))
        if kind in _HOLDS:
            if len(path) == DEEPEST:
                raise ValueError("boxes nest too deep")
            open_.append((body, start + size, (*path, kind)))


def _numbers(body: bytes, kind: str, width: int, n: int | None = None, offset: int = 8) -> np.ndarray:
    """The rows of a table in a box, of which its own count says how many there are."""
    n = struct.unpack_from(">I", body, 4)[0] if n is None else n
    if offset + n * width * np.dtype(kind).itemsize > len(body):
        raise ValueError("a table is cut short")
    rows = np.frombuffer(body, kind, n * width, offset).astype(np.int64)
    if len(rows) and rows.min() < 0:
        raise ValueError("a number is too large")
    return rows.reshape(n, width) if width > 1 else rows


def _table(t: dict, file: bytes) -> None:
    """Offsets, sizes and keyframes of a track's samples from the tables of its moov."""
    first, each, n = t["stsc"][:, 0], t["stsc"][:, 1], len(t["sizes"])
    runs = np.diff(np.append(first, len(t["chunks"]) + 1))
    if len(first) and (first[0] != 1 or runs.min() < 0):
        raise ValueError("chunks are out of order")
    if sum(a * b for a, b in zip(each.tolist(), runs.tolist())) != n:
        raise ValueError("chunks and samples differ")
    if sum(t["stts"][:, 0].tolist()) != n:
        raise ValueError("durations and samples differ")
    each = np.repeat(each, runs)
    chunk = np.repeat(np.arange(len(each)), each)
    begins = np.cumsum(each) - each  # the first sample of each chunk
    before = np.cumsum(t["sizes"]) - t["sizes"]
    t["offsets"] = t["chunks"][chunk] + before - (before[np.minimum(begins, max(0, n - 1))][chunk] if n else 0)
    t["keys"] = t.get("stss", np.arange(n))
    if len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= n):
        raise ValueError("a keyframe is no sample")


def _fragment(t: dict, head: dict, body: bytes, at: int | None) -> int:
    """Adds the samples of one run; where the next one starts that says nothing else."""
    flags, n = struct.unpack_from(">I", body)[0] & 0xFFFFFF, struct.unpack_from(">I", body, 4)[0]
    place, start = 8, head["base"] if at is None else at
    if flags & 1:
        start, place = head["base"] + struct.unpack_from(">i", body, place)[0], place + 4
    first_flags = None
    if flags & 4:
        first_flags, place = struct.unpack_from(">I", body, place)[0], place + 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if not fields and n * max(1, head["size"]) > t["bytes"]:
        raise ValueError("samples reach past the end")
    rows = _numbers(body, ">u4", len(fields), n, place).reshape(n, len(fields)) if fields else np.zeros((n, 0), np.int64)
    column = lambda name: rows[:, fields.index(name)] if name in fields else np.full(n, head[name], np.int64)
    size, kinds = column("size"), column("flags").copy()
    if first_flags is not None and n:
        kinds[0] = first_flags
    t["parts"].append((start + np.cumsum(size) - size, size, (kinds & 0x10000) == 0))
    t["duration_of_parts"] += int(column("duration").sum())
    return start + int(size.sum())


def tracks(file: bytes) -> list[dict]:
    """Codec, time scale, duration and samples of each track: offset and size of each sample, and keyframes. Fragments follow what moov says."""
    found: list[dict] = []
    defaults: dict[int, dict] = {}
    t = head = at = None
    for path, a, b in boxes(file):
        kind, above = path[-1], path[-2] if len(path) > 1 else b""
        body = b"" if kind in _HOLDS or kind == b"mdat" else file[a:b]
        if kind == b"trak":
            t = {"bytes": len(file), "parts": [], "duration_of_parts": 0}
            found.append(t)
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", body, 4)
            defaults[number] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            moof = a - 8
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">I", body)[0] & 0xFFFFFF, struct.unpack_from(">I", body, 4)[0]
            t = next((x for x in found if x.get("number") == number), None)
            if t is None or above != b"traf":
                raise ValueError("a fragment has no track")
            head, at, place = {"duration": 0, "size": 0, "flags": 0, **defaults.get(number, {}), "base": moof}, None, 8
            for bit, name, form in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
                if flags & bit:
                    head[name] = struct.unpack_from(form, body, place)[0]
                    place += struct.calcsize(form)
        elif kind == b"trun":
            if head is None:
                raise ValueError("a fragment has no track")
            at = _fragment(t, head, body, at)
        elif t is None:
            continue
        elif kind == b"tkhd":
            t["number"] = struct.unpack_from(">I", body, 20 if body[0] else 12)[0]
        elif kind == b"mdhd":
            t["rate"], t["duration"] = struct.unpack_from(">IQ" if body[0] else ">II", body, 20 if body[0] else 12)
        elif kind == b"hdlr" and above == b"mdia":
            t["handler"] = body[8:12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = body[12:16].decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _numbers(body, ">u4", 2)
        elif kind == b"stsc":
            t["stsc"] = _numbers(body, ">u4", 3)
        elif kind == b"stss":
            t["stss"] = _numbers(body, ">u4", 1) - 1
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _numbers(body, ">u4" if kind == b"stco" else ">i8", 1)
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", body, 4)
            if each * n > len(file):
                raise ValueError("samples reach past the end")
            t["sizes"] = np.full(n, each, np.int64) if each else _numbers(body, ">u4", 1, n, 12)
    for t in found:
        if not {"stsc", "chunks", "sizes", "stts", "rate", "codec"} <= t.keys():
            raise ValueError("a track has no sample table")
        if not t["rate"]:
            raise ValueError("a track has no time scale")
        _table(t, file)
        if t["parts"]:
            n = len(t["sizes"])
            keys = np.flatnonzero(np.concatenate([p[2] for p in t["parts"]])) + n
            t["offsets"], t["sizes"], t["keys"] = np.concatenate([t["offsets"], *(p[0] for p in t["parts"])]), np.concatenate([t["sizes"], *(p[1] for p in t["parts"])]), np.concatenate([t["keys"], keys])
            t["duration"] += t["duration_of_parts"]
        if len(t["sizes"]) and (t["offsets"].min() < 0 or (t["offsets"] + t["sizes"]).max() > len(file)):
            raise ValueError("samples reach past the end")
    return found


def payload(file: bytes, track: dict) -> bytes:
    """The samples of a track as they are stored; neighbours are read at once."""
    at, size = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    gap = np.flatnonzero(at[1:] != (at + size)[:-1]) + 1
    first, last = np.append(0, gap), np.append(gap, len(at)) - 1
    return b"".join(file[a:b] for a, b in zip(at[first].tolist(), (at + size)[last].tolist()))


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACK = [("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", _RANGES)]
_PROBE = pa.struct([*_TRACK, ("tracks", pa.list_(pa.struct([("handler", pa.string()), *_TRACK]))), ("error", pa.string())])
_TRACK_SQL = "codec:string,duration_s:double,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>"


def _told(t: dict) -> dict:
    keys = [{"offset": a, "length": n} for a, n in zip(t["offsets"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist())]
    return {"codec": t["codec"], "duration_s": t["duration"] / t["rate"], "samples": len(t["sizes"]), "keyframes": keys}


def probe_bytes(file: bytes | None) -> dict:
    """Of the first video track, else of the first; and of all tracks."""
    try:
        found = tracks(file or b"")
        if not found:
            raise ValueError("no track")
        shown = next((t for t in found if t.get("handler") == "vide"), found[0])
        return {**_told(shown), "tracks": [{"handler": t.get("handler"), **_told(t)} for t in found], "error": None}
    except (ValueError, IndexError, KeyError, OverflowError, struct.error) as e:
        return {"codec": None, "duration_s": None, "samples": None, "keyframes": None, "tracks": None, "error": str(e) or "no track"}


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a media file."""

    def run(batches_):
        for batch in batches_:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                raw = [t.encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_probe(media: DataFrame, column: str = "media", into: str = "probe") -> DataFrame:
    """``media`` with a struct<codec, duration_s, samples, keyframes array<struct<offset, length>>, tracks, error>; payloads stay as they are."""
    schema = media.withColumn(into, F.lit(None).cast(f"struct<{_TRACK_SQL},tracks:array<struct<handler:string,{_TRACK_SQL}>>,error:string>")).schema

    def run(batches_):
        for batch in batches_:
            found = [probe_bytes(x.as_py()) for x in batch.column(batch.schema.get_field_index(column))]
            kept = [(c, batch.column(k)) for k, c in enumerate(batch.schema.names) if c != into]
            yield pa.RecordBatch.from_arrays([*(v for _, v in kept), pa.array(found, _PROBE)], names=[*(c for c, _ in kept), into])

    return media.mapInArrow(run, schema)


def digests(media: DataFrame) -> DataFrame:
    """What can be told from the stored bytes: sums of the payload and of the file, and the probe as one string."""

    def run(batches_):
        for batch in batches_:
            rows = []
            for d, n, m in zip(batch.column(0), batch.column(1), batch.column(2)):
                file = m.as_py()
                data, p = payload(file, tracks(file)[0]), probe_bytes(file)
                keys = ",".join(f"{k['offset']}+{k['length']}" for k in p["keyframes"])
                feature = f"{p['codec'].strip()};duration={p['duration_s']:.6f};samples={p['samples']};keyframes={len(p['keyframes'])};ranges={hashlib.sha256(keys.encode()).hexdigest()[:16]};first={keys.split(',')[0]}"
                rows.append((d.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
