"""ISO base media containers: write, walk the boxes, decode the sample tables, index key frames.

`pack` stores bytes as frames of 24 x 24 8-bit samples in one raw video track; `probe` reads any container: it walks
nested boxes (also 64-bit sizes and boxes up to the end), decodes the sample tables of every track and the runs of
movie fragments, and gives codec, duration and the byte ranges of key frames. It seeks over media data and never decodes it.

Edge cases: null text is the empty text; its payload is one frame of bytes 255. Equal texts give equal files. Bytes
that are no container give a null codec and an error text. A track without a table of key frames has only key frames;
tracks without samples have no key ranges. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import short_batches

FRAME, WIDTH, HEIGHT = 576, 24, 24
TIMESCALE, TICKS = 25_000, 1_000
CHUNK_FRAMES, KEY_EVERY = 16, 12
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join([struct.pack(">I", size), kind, *parts])


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (FRAME - len(data) if not data else -len(data) % FRAME)


def pack(payload: bytes) -> bytes:
    """A container whose frames hold payload, a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, min(n, CHUNK_FRAMES), 1)] + ([(chunks, last, 1)] if chunks > 1 and last != CHUNK_FRAMES else [])
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(start: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, TICKS)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(start + k * CHUNK_FRAMES * FRAME for k in range(chunks)))),
        )
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * TICKS, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), data, table),
        )
        head = struct.pack(">IIIII", 0, 0, 1, 0, n * TICKS) + bytes(8) + struct.pack(">HHHH", 0, 0, 0, 0) + _MATRIX + struct.pack(">II", WIDTH << 16, HEIGHT << 16)
        movie = struct.pack(">IIII", 0, 0, TIMESCALE, n * TICKS) + struct.pack(">IH", 0x10000, 0x100) + bytes(10) + _MATRIX + bytes(24) + struct.pack(">I", 2)
        return _box(b"moov", _full(b"mvhd", movie), _box(b"trak", _full(b"tkhd", head, flags=7), media))

    start = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(start) + _box(b"mdat", payload)


def boxes(f, start: int, end: int):
    """(kind, begin and end of the content) of each box in a part of a seekable file."""
    while start + 8 <= end:
        f.seek(start)
        size, kind = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, start + size
        start += size


_TABLES = frozenset((b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"trex", b"tfhd"))


def _walk(f, start: int, end: int, into: dict, movie: dict, moof: int = 0):
    """Gathers the tables of tracks, the defaults of fragments and their runs below `into` and `movie`."""
    for kind, a, b in boxes(f, start, end):
        own = into
        if kind == b"trak":
            movie["tracks"].append(own := {})
        elif kind == b"traf":
            movie["fragments"].append(own := {"moof": moof, "runs": []})
        if kind in CONTAINERS:
            _walk(f, a, b, own, movie, a - 8 if kind == b"moof" else moof)
        elif kind in _TABLES or kind == b"trun":
            f.seek(a)
            data = f.read(b - a)
            if kind == b"trun":
                own["runs"].append(data)
            elif kind == b"trex":
                movie["defaults"][struct.unpack_from(">I", data, 4)[0]] = struct.unpack_from(">IIII", data, 8)
            else:
                own[kind] = data


def _sizes(track: dict) -> list[int]:
    if b"stsz" in track:
        fixed, n = struct.unpack_from(">II", track[b"stsz"], 4)
        return [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", track[b"stsz"], 12))
    bits, n = struct.unpack_from(">4xI", track[b"stz2"], 0)[0] & 255, struct.unpack_from(">I", track[b"stz2"], 8)[0]
    raw = track[b"stz2"][12:]
    if bits == 4:
        return [x >> 4 if k % 2 == 0 else x & 15 for k, x in ((k, raw[k // 2]) for k in range(n))]
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", raw, 0))


def samples(track: dict) -> list[tuple[int, int]]:
    """(offset, size) of every sample of a track, from its sizes, chunks and samples to a chunk."""
    sizes = _sizes(track)
    n, wide = len(sizes), b"co64" in track
    raw = track[b"co64" if wide else b"stco"]
    offsets = struct.unpack_from(f">{struct.unpack_from('>I', raw, 4)[0]}{'Q' if wide else 'I'}", raw, 8)
    runs = list(struct.iter_unpack(">III", track[b"stsc"][8 : 8 + 12 * struct.unpack_from(">I", track[b"stsc"], 4)[0]]))
    out, k, run = [], 0, 0
    for c, at in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= c:
            run += 1
        for _ in range(min(runs[run][1], n - k)):
            out.append((at, sizes[k]))
            at += sizes[k]
            k += 1
    if k != n:
        raise ValueError(f"the chunks hold {k} of {n} samples")
    return out


def _fragment_samples(fragment: dict, defaults: dict, base: int) -> tuple[int, list[tuple[int, int, int, bool]], int]:
    """(track, [(offset, size, ticks, key)], end of the data) of a track fragment; base: where data start that say nothing else."""
    head = fragment[b"tfhd"]
    flags, track = struct.unpack_from(">II", head, 0)
    flags &= 0xFFFFFF
    _, ticks, size, marks = defaults.get(track, (1, 0, 0, 0))
    at, given = 8, {}
    for bit, form in ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")):
        if flags & bit:
            given[bit] = struct.unpack_from(form, head, at)[0]
            at += struct.calcsize(form)
    ticks, size, marks = given.get(0x8, ticks), given.get(0x10, size), given.get(0x20, marks)
    base = given.get(0x1, fragment["moof"] if flags & 0x20000 else base)
    out, place = [], base
    for run in fragment["runs"]:
        own, n = struct.unpack_from(">II", run, 0)
        own, at, first = own & 0xFFFFFF, 8, None
        if own & 0x1:
            place = base + struct.unpack_from(">i", run, at)[0]
            at += 4
        if own & 0x4:
            first = struct.unpack_from(">I", run, at)[0]
            at += 4
        for k in range(n):
            values = [ticks, size, marks]
            for nth, bit in enumerate((0x100, 0x200, 0x400)):
                if own & bit:
                    values[nth] = struct.unpack_from(">I", run, at)[0]
                    at += 4
            at += 4 if own & 0x800 else 0
            if k == 0 and first is not None:
                values[2] = first
            out.append((place, values[1], values[0], not values[2] & 0x10000))
            place += values[1]
    return track, out, place


def tracks(f, length: int) -> list[dict]:
    """id, kind, codec, seconds, samples and key_ranges [begin, end) of every track of a seekable container."""
    movie: dict = {"tracks": [], "fragments": [], "defaults": {}}
    _walk(f, 0, length, {}, movie)
    more: dict[int, list] = {}
    last, end = None, 0
    for x in movie["fragments"]:
        base, last = (end if x["moof"] == last else x["moof"]), x["moof"]
        track, found, end = _fragment_samples(x, movie["defaults"], base)
        more.setdefault(track, []).extend(found)
    out = []
    for t in movie["tracks"]:
        wide = t[b"mdhd"][0] == 1
        scale, duration = struct.unpack_from(">IQ", t[b"mdhd"], 20) if wide else struct.unpack_from(">II", t[b"mdhd"], 12)
        number = struct.unpack_from(">I", t[b"tkhd"], 20 if t[b"tkhd"][0] == 1 else 12)[0]
        at = samples(t) if b"stsc" in t and (b"stsz" in t or b"stz2" in t) and (b"stco" in t or b"co64" in t) else []
        keys = range(1, len(at) + 1)
        if b"stss" in t:
            keys = struct.unpack_from(f">{struct.unpack_from('>I', t[b'stss'], 4)[0]}I", t[b"stss"], 8)
        ranges = [(at[k - 1][0], sum(at[k - 1])) for k in keys]
        found = more.get(number, [])
        ticks = sum(x[2] for x in found)
        out.append({
            "id": number, "kind": t[b"hdlr"][8:12].decode("latin-1") if b"hdlr" in t else None, "codec": t[b"stsd"][12:16].decode("latin-1").strip(),
            "seconds": (duration + ticks if at else max(duration, ticks)) / scale if scale else None,
            "samples": at + [x[:2] for x in found], "key_ranges": ranges + [(x[0], x[0] + x[1]) for x in found if x[3]],
        })
    return out


def probe(f, length: int) -> dict:
    """The first track with samples of a seekable container, as `tracks` gives it."""
    track = next((t for t in tracks(f, length) if t["samples"]), None)
    if track is None:
        raise ValueError("no track with samples")
    return track


_RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_TRACK = pa.struct([("id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("frames", pa.int64()), ("key_ranges", _RANGES)])
_INDEX = pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("frames", pa.int64()), ("key_ranges", _RANGES), ("tracks", pa.list_(_TRACK)), ("error", pa.string())])
INDEX_SCHEMA = (
    "codec string, seconds double, frames long, key_ranges array<struct<begin:long,end:long>>, "
    "tracks array<struct<id:long,kind:string,codec:string,seconds:double,frames:long,key_ranges:array<struct<begin:long,end:long>>>>, error string"
)


def _index(content: pa.Scalar) -> dict:
    """INDEX_SCHEMA of a container; its bytes are read in place, media data never."""
    try:
        if not content.is_valid:
            raise ValueError("no bytes")
        ranges = lambda x: [{"begin": a, "end": b} for a, b in x]
        found = tracks(pa.BufferReader(content.as_buffer()), len(content.as_buffer()))
        first = next((t for t in found if t["samples"]), None)
        if first is None:
            raise ValueError("no track with samples")
        row = [{**{k: t[k] for k in ("id", "kind", "codec", "seconds")}, "frames": len(t["samples"]), "key_ranges": ranges(t["key_ranges"])} for t in found]
        return {"codec": first["codec"], "seconds": first["seconds"], "frames": len(first["samples"]), "key_ranges": ranges(first["key_ranges"]), "tracks": row, "error": None}
    except (ValueError, KeyError, TypeError, IndexError, struct.error) as e:
        return {"error": str(e) or type(e).__name__}


def index_containers(df: DataFrame, content: str = "content") -> DataFrame:
    """df with a column `media` (INDEX_SCHEMA) read from the container bytes in `content`, in place of one of that name;
    null bytes give an error text."""
    short_batches(df.sparkSession)
    names = [k for k in df.columns if k != "media"]
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "media"), T.StructField("media", T.StructType.fromDDL(INDEX_SCHEMA))])
    at = names.index(content)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_index(x) for x in b.column(at)], _INDEX)], [*names, "media"])

    return df.select(*names).mapInArrow(run, schema)


STORED_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_STORED = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _store(text) -> tuple:
    data = text.as_buffer().to_pybytes() if text.is_valid else b""
    media = pack(padded(data))
    x = probe(io.BytesIO(media), len(media))
    back = b"".join(media[a : a + n] for a, n in x["samples"])
    feature = f"{x['codec']} {WIDTH}x{HEIGHT} {x['seconds']:.2f}s {len(x['samples'])} frames keys " + ",".join(f"{a}-{b}" for a, b in x["key_ranges"])
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and STORED_SCHEMA for documents (doc_id, text): each text stored in a container and read back from it."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [_store(x) for x in b.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_STORED)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *_STORED])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {STORED_SCHEMA}")
