"""Matroska media columns: a binary column holds whole files, parsed to packet tables.

A file is a tree of EBML elements, each a variable-length id, a
variable-length size and its data.  The reader walks Segment, Info, Tracks,
Clusters (SimpleBlock and BlockGroup, with no, Xiph, EBML or fixed-size
lacing) and Cues; it also takes segments and clusters of unknown size.  Every
frame becomes a packet: track, timestamp in ns, byte range in the file, flags.
The writer makes files of one 8-bit PCM track, so any bytes can be stored as
samples without loss.

Defined results: a null file gives null; bytes that are no Matroska file, or
end early, give what was read before and ``error`` set.  An empty payload
makes a file without packets.  Rows are parsed one by one, so repeated rows
are equal and extra columns never read.
"""

from __future__ import annotations

from collections.abc import Iterator
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element ids of EBML and Matroska.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements at the segment's level; one of them ends a cluster of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
_PARENTS = {SEGMENT, CLUSTER, TRACKS, CUES}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576  # bytes of a frame; at 8000 samples a second this is 72 ms
RATE = 8000
_FRAMES_A_BLOCK, _BLOCKS_A_CLUSTER = 8, 32

TRACK_TYPE_SQL = "struct<track:bigint,type:bigint,codec:string,sampling_hz:double,channels:bigint,bit_depth:bigint,lacing:boolean>"
PACKET_TYPE_SQL = "struct<track:bigint,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:string,cluster:bigint>"
CUE_TYPE_SQL = "struct<timestamp_ns:bigint,track:bigint,cluster:bigint>"
FILE_TYPE_SQL = f"struct<doc_type:string,duration_ns:bigint,tracks:array<{TRACK_TYPE_SQL}>,packets:array<{PACKET_TYPE_SQL}>,cues:array<{CUE_TYPE_SQL}>,error:string>"

_PACKETS = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("track", pa.int64()), ("type", pa.int64()), ("codec", pa.string()), ("sampling_hz", pa.float64()), ("channels", pa.int64()), ("bit_depth", pa.int64()), ("lacing", pa.bool_())]))
_CUES = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster", pa.int64())]))
_FILE = pa.struct([("doc_type", pa.string()), ("duration_ns", pa.int64()), ("tracks", _TRACKS), ("packets", _PACKETS), ("cues", _CUES), ("error", pa.string())])


class Truncated(ValueError):
    """The bytes end within an element."""


# --- writing -----------------------------------------------------------------


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as the shortest variable-length integer, or of ``width`` bytes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width)


def element(key: int, data: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8) + size_bytes(len(data)) + data


def _number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8)))


def _float(key: int, x: float) -> bytes:
    return element(key, struct.pack(">d", x))


def block_data(track: int, relative: int, frames: list[bytes], lacing: str, flags: int = 0x80) -> bytes:
    """A block's data: track, relative timestamp, flags, lace sizes, frames."""
    if len(frames) == 1:
        lacing = "none"
    head = size_bytes(track) + struct.pack(">hB", relative, flags | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing])
    if lacing == "none":
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += size_bytes(sizes[0])
        for last, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - last) < (1 << 7 * w - 1))
            head += size_bytes(n - last + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_pcm(payload: bytes, lacing: str = "ebml") -> bytes:
    """A file with the payload as the samples of one mono 8-bit track."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    step, per_cluster = FRAME * 1000 // RATE, _FRAMES_A_BLOCK * _BLOCKS_A_CLUSTER
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"scrubjay") + element(WRITING_APP, b"scrubjay"))
    audio = element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, int(lacing != "none")) + _number(DEFAULT_DURATION, step * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, len(frames), per_cluster):
        body = [_number(TIMESTAMP, first * step)]
        size = 1 if lacing == "none" else _FRAMES_A_BLOCK
        for i in range(first, min(first + per_cluster, len(frames)), size):
            body.append(element(SIMPLE_BLOCK, block_data(1, (i - first) * step, frames[i : min(i + size, first + per_cluster)], lacing)))
        cues.append(element(CUE_POINT, _number(CUE_TIME, first * step) + element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(MAX_ID_LENGTH, 4) + _number(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(parts))


# --- reading -----------------------------------------------------------------


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, width and place after a variable-length integer."""
    if at >= end:
        raise Truncated(f"an element ends at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > end:
        raise Truncated(f"no variable-length integer at byte {at}")
    value = int.from_bytes(data[at : at + width])
    return (value if keep_marker else value & ((1 << 7 * width) - 1)), width, at + width


def _children(data: bytes, at: int, end: int):
    """(id, place of the id, first byte, byte after the last, size known) of each element in a range."""
    while at < end:
        start = at
        key, _, at = _vint(data, at, end, True)
        size, width, at = _vint(data, at, end, False)
        known = size != (1 << 7 * width) - 1
        stop = at + size if known else end
        if stop > end:
            if key in _PARENTS:  # what is whole in it still counts
                yield key, start, at, end, False
            raise Truncated(f"the element at byte {start} ends after byte {end}")
        until = yield key, start, at, stop, known
        at = stop if until is None else until


def _lace(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """First byte of the frames and their sizes."""
    if not kind:
        return at, [end - at]
    if at >= end:
        raise Truncated(f"a lace ends at byte {at}")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:  # fixed
        if (end - at) % n:
            raise ValueError(f"a fixed lace of {n} frames has {end - at} bytes")
        return at, [(end - at) // n] * n
    if kind == 1:  # Xiph
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Truncated(f"a lace ends at byte {at}")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, width, at = _vint(data, at, end, False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"a lace of the block that ends at byte {end} is longer than the block")
    return at, sizes


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.scale = data, 1_000_000
        self.tracks: list[tuple] = []
        self.packets: list[tuple] = []
        self.cues: list[tuple] = []
        self.step: dict[int, int] = {}
        self.doc_type = self.error = None
        self.duration: float | None = None
        try:
            for key, _, at, end, _ in _children(data, 0, len(data)):
                if key == EBML:
                    self.doc_type = next((bytes(data[a:e]).rstrip(b"\0").decode("latin-1") for k, _, a, e, _ in _children(data, at, end) if k == DOC_TYPE), None)
                elif key == SEGMENT:
                    self._segment(at, end)
            if self.doc_type is None:
                self.error = "no EBML head"
        except ValueError as e:
            self.error = str(e)

    def _int(self, at: int, end: int) -> int:
        return int.from_bytes(self.data[at:end])

    def _real(self, at: int, end: int) -> float:
        return {0: lambda b: 0.0, 4: lambda b: struct.unpack(">f", b)[0], 8: lambda b: struct.unpack(">d", b)[0]}.get(end - at, lambda b: float("nan"))(bytes(self.data[at:end]))

    def _segment(self, base: int, end: int) -> None:
        walk = _children(self.data, base, end)
        item = next(walk, None)
        while item:
            key, start, at, stop, known = item
            until = None
            if key == INFO:
                for k, _, a, e, _ in _children(self.data, at, stop):
                    if k == TIMESTAMP_SCALE:
                        self.scale = self._int(a, e)
                    elif k == DURATION:
                        self.duration = self._real(a, e)
            elif key == TRACKS:
                for k, _, a, e, _ in _children(self.data, at, stop):
                    if k == TRACK_ENTRY:
                        self._track(a, e)
            elif key == CLUSTER:
                until = self._cluster(start - base, at, stop, known)
            elif key == CUES:
                for k, _, a, e, _ in _children(self.data, at, stop):
                    if k == CUE_POINT:
                        self._cue(a, e)
            try:
                item = walk.send(None if known else until)
            except StopIteration:
                break

    def _track(self, at: int, end: int) -> None:
        x = {"codec": None, TRACK_NUMBER: None, TRACK_TYPE: None, FLAG_LACING: 1, SAMPLING_FREQUENCY: None, CHANNELS: None, BIT_DEPTH: None, DEFAULT_DURATION: 0}
        for k, _, a, e, _ in _children(self.data, at, end):
            if k == CODEC_ID:
                x["codec"] = bytes(self.data[a:e]).decode("latin-1")
            elif k == AUDIO:
                for k2, _, a2, e2, _ in _children(self.data, a, e):
                    x[k2] = self._real(a2, e2) if k2 == SAMPLING_FREQUENCY else self._int(a2, e2)
            else:
                x[k] = self._int(a, e) if e - a <= 8 else None
        self.step[x[TRACK_NUMBER]] = x[DEFAULT_DURATION]
        self.tracks.append((x[TRACK_NUMBER], x[TRACK_TYPE], x["codec"], x[SAMPLING_FREQUENCY], x[CHANNELS], x[BIT_DEPTH], bool(x[FLAG_LACING])))

    def _cluster(self, place: int, at: int, end: int, known: bool) -> int:
        clock = 0
        for k, start, a, e, _ in _children(self.data, at, end):
            if not known and k in _TOP:
                return start
            if k == TIMESTAMP:
                clock = self._int(a, e)
            elif k == SIMPLE_BLOCK:
                self._block(a, e, clock, place, None)
            elif k == BLOCK_GROUP:
                inner = [(k2, a2, e2) for k2, _, a2, e2, _ in _children(self.data, a, e)]
                refers = any(k2 == REFERENCE_BLOCK for k2, _, _ in inner)
                for k2, a2, e2 in inner:
                    if k2 == BLOCK:
                        self._block(a2, e2, clock, place, not refers)
        return end

    def _block(self, at: int, end: int, clock: int, place: int, keyframe: bool | None) -> None:
        track, _, at = _vint(self.data, at, end, False)
        if at + 3 > end:
            raise Truncated(f"a block ends at byte {end}")
        relative, flags = struct.unpack_from(">hB", self.data, at)
        kind = (flags >> 1) & 3
        at, sizes = _lace(self.data, at + 3, end, kind)
        when, step = (clock + relative) * self.scale, self.step.get(track, 0)
        keyframe = bool(flags & 0x80) if keyframe is None else keyframe
        for i, size in enumerate(sizes):
            self.packets.append((track, when + i * step, at, size, keyframe, LACINGS[kind], place))
            at += size

    def _cue(self, at: int, end: int) -> None:
        when, found = 0, []
        for k, _, a, e, _ in _children(self.data, at, end):
            if k == CUE_TIME:
                when = self._int(a, e)
            elif k == CUE_TRACK_POSITIONS:
                x = {k2: self._int(a2, e2) for k2, _, a2, e2, _ in _children(self.data, a, e)}
                found.append((x.get(CUE_TRACK), x.get(CUE_CLUSTER_POSITION)))
        self.cues += [(when * self.scale, track, place) for track, place in found]


def read_file(data: bytes) -> dict:
    """All that the packet table is made of."""
    r = _Reader(data)
    duration = None if r.duration is None or r.duration != r.duration else round(r.duration * r.scale)
    return {"doc_type": r.doc_type, "duration_ns": duration, "tracks": r.tracks, "packets": r.packets, "cues": r.cues, "error": r.error}


# --- columns -----------------------------------------------------------------


def _lists(rows: list[list[tuple] | None], kind: pa.ListType) -> pa.Array:
    """A list column of structs, built field by field."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x or ()) for x in rows], out=offsets[1:])
    flat = [x for row in rows for x in row or ()]
    columns = list(zip(*flat, strict=True)) or [()] * kind.value_type.num_fields
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))


def pcm_media(payload: Column, lacing: str = "ebml") -> Column:
    """A binary column stored as 8-bit samples of Matroska files."""

    @F.arrow_udf("binary")
    def store(payloads: pa.Array) -> pa.Array:
        return pa.array((None if (x := v.as_py()) is None else write_pcm(x, lacing) for v in payloads), pa.binary())

    return store(payload)


def store_pcm(rows: DataFrame, payload: str, media: str, lacing: str = "ebml") -> DataFrame:
    """The frame with its payload column replaced by the files that store it.

    As a step of its own, so that files which are both kept and parsed are
    made once.
    """
    schema = T.StructType([T.StructField(media, T.BinaryType()) if f.name == payload else f for f in rows.schema.fields])
    at = rows.columns.index(payload)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array((None if (x := v.as_py()) is None else write_pcm(x, lacing) for v in columns[at]), pa.binary())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(store, schema)


def _table_of(found: list[dict | None]) -> list[pa.Array]:
    """The columns of FILE_TYPE_SQL."""
    get = lambda k: [f and f[k] for f in found]
    return [pa.array(get("doc_type"), pa.string()), pa.array(get("duration_ns"), pa.int64()), _lists(get("tracks"), _TRACKS), _lists(get("packets"), _PACKETS), _lists(get("cues"), _CUES), pa.array(get("error"), pa.string())]


def parse(media: Column) -> Column:
    """Tracks, packets, cues and error of each file of a binary column."""

    @F.arrow_udf(FILE_TYPE_SQL)
    def read(files: pa.Array) -> pa.Array:
        found = [None if (x := v.as_py()) is None else read_file(x) for v in files]
        return pa.StructArray.from_arrays(_table_of(found), fields=list(_FILE), mask=pa.array([f is None for f in found], pa.bool_()))

    return read(media)


def parse_with_track(media: Column, track: int = 1) -> Column:
    """What parse gives, and ``payload``: the bytes of one track, cut out by its packets' byte ranges in their order."""
    fields = [*_FILE, pa.field("payload", pa.binary())]

    @F.arrow_udf(FILE_TYPE_SQL[:-1] + ",payload:binary>")
    def read(files: pa.Array) -> pa.Array:
        found, payloads = [], []
        for v in files:
            data = v.as_py()
            file = None if data is None else read_file(data)
            found.append(file)
            payloads.append(file and b"".join([data[at : at + size] for own, _, at, size, *_ in file["packets"] if own == track]))
        return pa.StructArray.from_arrays([*_table_of(found), pa.array(payloads, pa.binary())], fields=fields, mask=pa.array([f is None for f in found], pa.bool_()))

    return read(media)


def packet_digest(file: Column) -> Column:
    """SHA-1 of a file's packet table: track, timestamp, place and size of every packet in order."""
    parts = F.transform(file["packets"], lambda p: F.concat_ws(":", p["track"], p["timestamp_ns"], p["offset"], p["size"]))
    return F.sha1(F.array_join(parts, ","))


def clusters_cued(file: Column) -> Column:
    """How many clusters with packets the file's cues lead to."""
    return F.size(F.array_intersect(file["cues"]["cluster"], file["packets"]["cluster"]))


def packet_table(files: DataFrame, file_id: str, media: str) -> DataFrame:
    """One row per packet: ``file_id``, the packet's fields and the file's error; a file without packets has one row without them."""
    parsed = files.select(F.col(file_id).alias(file_id), parse(F.col(media)).alias("file"))
    return parsed.select(file_id, F.col("file.error").alias("error"), F.posexplode_outer("file.packets").alias("packet_no", "packet")).select(file_id, "packet_no", "packet.*", "error")


def cue_table(files: DataFrame, file_id: str, media: str) -> DataFrame:
    """One row per cue: ``file_id``, its time, track and cluster, and how many of the track's packets that cluster has."""
    parsed = files.select(F.col(file_id).alias(file_id), parse(F.col(media)).alias("file"))
    cues = parsed.select(file_id, "file.packets", F.posexplode("file.cues").alias("cue_no", "cue"))
    own = F.filter("packets", lambda p: (p["cluster"] == F.col("cue.cluster")) & (p["track"] == F.col("cue.track")))
    return cues.select(file_id, "cue_no", "cue.*", F.size(own).alias("n_packets"))
