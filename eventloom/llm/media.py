"""ISO media containers (MP4, MOV): write one, walk its boxes, decode its sample tables.

`media_columns` probes a binary column without decoding payloads: codec, size, duration, samples and keyframe byte
ranges come from the sample tables, and from those of fragments, alone. `container_of` stores a payload losslessly as uncompressed 8-bit grey
frames; `stored_columns` stores texts so, reads the stored bytes back and reports digests and the probe's feature.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.common import with_columns_from_text

#: A frame of the stored form: 24 x 24 pixels of one byte.
SIDE, FRAME = 24, 576
FRAMES_PER_CHUNK, TIMESCALE, TICKS = 8, 25_000, 1000
#: Bit of a sample's flags in fragments: it needs other samples, so that it is no keyframe.
DEPENDS = 0x10000
#: Boxes that hold nothing but boxes.
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 16


@dataclass
class Track:
    """What the boxes say of one track; samples are (offset, size, is keyframe) in decoding order.

    duration, in units of timescale: the sum of the samples' own; what the header says, where there are none.
    """

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    samples: list[tuple[int, int, bool]] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        return [(at, size) for at, size, key in self.samples if key]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container_of(payload: bytes) -> bytes:
    """A file with one video track whose samples are the payload's frames, uncompressed; every chunk starts on a keyframe.

    payload must be a positive multiple of FRAME bytes. The same payload gives the same bytes.
    """
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes, not {len(payload)}")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    start = len(ftyp) + (16 if len(payload) > 0xFFFF_FF00 else 8)
    wide = start + len(payload) > 0xFFFF_FFFF
    offsets = [start + c * FRAMES_PER_CHUNK * FRAME for c in range(chunks)]
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK)] * (chunks > 1 or last == FRAMES_PER_CHUNK) + [(chunks, last)] * (last != FRAMES_PER_CHUNK)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, TICKS)),
        _full(b"stss", struct.pack(">I", chunks), struct.pack(f">{chunks}I", *(1 + c * FRAMES_PER_CHUNK for c in range(chunks)))),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
    )
    long = frames * TICKS
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, long, 0x55C4, 0), version=1)
    hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, long), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), version=1, flags=7)
    mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, long), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    moov = _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))
    head = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", len(payload) + 16) if len(payload) > 0xFFFF_FF00 else struct.pack(">I", len(payload) + 8) + b"mdat"
    return b"".join((ftyp, head, payload, moov))


def _boxes(data: bytes, at: int, end: int):
    """(kind, start of body, end, start) of the boxes in data[at:end]; ValueError where sizes don't fit."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a long box is cut off")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes doesn't fit")
        yield kind, at + head, at + size, at
        at += size
    if at != end and data[at:end].strip(b"\0"):
        raise ValueError("bytes after the last box")


def _numbers(data: bytes, at: int, end: int, count: int, form: str) -> tuple:
    if at + count * struct.calcsize(f">{form}") > end:
        raise ValueError("a table is cut off")
    return struct.unpack_from(f">{form * count}" if len(form) > 1 else f">{count}{form}", data, at)


def _table(data: bytes, place: tuple[int, int], form: str, at: int = 4) -> tuple:
    """The entries of a table box, each of the fields in form, flat; their number stands `at` bytes into the box."""
    lo, hi = place
    (n,) = _numbers(data, lo + at, hi, 1, "I")
    return _numbers(data, lo + at + 4, hi, n, form)


def _sizes(data: bytes, tables: dict[bytes, tuple[int, int]]) -> tuple[int, ...]:
    if b"stsz" in tables:
        at, end = tables[b"stsz"]
        same, count = _numbers(data, at + 4, end, 2, "I")
        if same and count > len(data):
            raise ValueError("more samples than bytes")
        return (same,) * count if same else _numbers(data, at + 12, end, count, "I")
    at, end = tables[b"stz2"]  # compact sizes, of 4, 8 or 16 bits
    bits, count = (_numbers(data, at + 4, end, 1, "I")[0] & 0xFF), _numbers(data, at + 8, end, 1, "I")[0]
    if bits == 4:
        packed = _numbers(data, at + 12, end, -(-count // 2), "B")
        return tuple(x for b in packed for x in (b >> 4, b & 15))[:count]
    if bits not in (8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    return _numbers(data, at + 12, end, count, "B" if bits == 8 else "H")


def _samples(data: bytes, tables: dict[bytes, tuple[int, int]]) -> tuple[list[tuple[int, int, bool]], int]:
    """The samples that the tables of one track name, and the sum of their durations."""
    if not {b"stsz", b"stz2"} & tables.keys():
        return [], 0
    sizes = _sizes(data, tables)
    if not sizes:
        return [], 0
    if missing := {b"stsc", b"stts"} - tables.keys():
        raise ValueError(f"samples without {min(missing).decode()}")
    if not {b"stco", b"co64"} & tables.keys():
        raise ValueError("samples without offsets")
    offsets = _table(data, tables[b"stco"], "I") if b"stco" in tables else _table(data, tables[b"co64"], "Q")
    flat = _table(data, tables[b"stsc"], "III")
    firsts = [*flat[::3], len(offsets) + 1]
    keys = set(_table(data, tables[b"stss"], "I")) if b"stss" in tables else None
    found, i = [], 0
    for run, per_chunk in enumerate(flat[1::3]):
        for chunk in range(firsts[run], firsts[run + 1]):
            if not 1 <= chunk <= len(offsets):
                raise ValueError("a run names a chunk that isn't there")
            place = offsets[chunk - 1]
            for _ in range(per_chunk):
                if i >= len(sizes):
                    break
                if place + sizes[i] > len(data):
                    raise ValueError("a sample lies outside the file")
                found.append((place, sizes[i], keys is None or i + 1 in keys))
                place, i = place + sizes[i], i + 1
    if i != len(sizes):
        raise ValueError(f"{len(sizes) - i} samples have no chunk")
    times = _table(data, tables[b"stts"], "II")
    if sum(times[::2]) != len(sizes):
        raise ValueError(f"{sum(times[::2])} durations for {len(sizes)} samples")
    return found, sum(n * ticks for n, ticks in zip(times[::2], times[1::2], strict=True))


class _Fragments:
    """What track fragments (moof, traf) add to tracks, whose defaults (trex) stand in the movie's header."""

    def __init__(self, data: bytes, tracks: list[Track]):
        self.data, self.tracks = data, tracks
        self.defaults: dict[int, tuple[int, int, int]] = {}
        self.at: dict[int, int] = {}  # where a track's last run ended

    def extends(self, lo: int, hi: int) -> None:
        number, _, ticks, size, flags = _numbers(self.data, lo + 4, hi, 5, "I")
        self.defaults[number] = ticks, size, flags

    def fragment(self, start: int, lo: int, hi: int, last: int | None) -> int | None:
        """One traf, of the moof that starts at `start`; last: the end of the data of the traf before in it. The end of its own."""
        data, runs, head = self.data, [], None
        for kind, a, b, _ in _boxes(data, lo, hi):
            if kind == b"tfhd":
                head = a, b
            elif kind == b"trun":
                runs.append((a, b))
        if head is None:
            raise ValueError("a track fragment without a header")
        at, end = head
        flags = _numbers(data, at, end, 1, "I")[0] & 0xFFFFFF
        (number,) = _numbers(data, at + 4, end, 1, "I")
        track = next((t for t in self.tracks if t.number == number), None)
        if track is None:
            raise ValueError(f"a fragment of track {number}, which isn't there")
        ticks, size, bits = self.defaults.get(number, (0, 0, 0))
        at += 8
        base = start if flags & 0x20000 or last is None else last
        if flags & 1:
            base = _numbers(data, at, end, 1, "Q")[0]
            at += 8
        at += 4 * bool(flags & 2)
        for bit in (8, 0x10, 0x20):
            if flags & bit:
                (value,) = _numbers(data, at, end, 1, "I")
                ticks, size, bits = (value if bit == 8 else ticks), (value if bit == 0x10 else size), (value if bit == 0x20 else bits)
                at += 4
        place = base
        for a, b in runs:
            place = self.run(track, a, b, base, place, ticks, size, bits)
        return place

    def run(self, track: Track, at: int, end: int, base: int, place: int, ticks: int, size: int, bits: int) -> int:
        data = self.data
        flags, count = _numbers(data, at, end, 2, "I")
        flags &= 0xFFFFFF
        at += 8
        if flags & 1:
            place = base + _numbers(data, at, end, 1, "i")[0]
            at += 4
        first = bits
        if flags & 4:
            (first,) = _numbers(data, at, end, 1, "I")
            at += 4
        fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        if not fields and count > len(data):
            raise ValueError("more samples than bytes")
        rows = _numbers(data, at, end, count * len(fields), "I")
        for i in range(count):
            own = dict(zip(fields, rows[i * len(fields) : (i + 1) * len(fields)], strict=True))
            n = own.get(0x200, size)
            if place < 0 or place + n > len(data):
                raise ValueError("a sample lies outside the file")
            track.samples.append((place, n, not own.get(0x400, bits if i else first) & DEPENDS))
            track.duration += own.get(0x100, ticks)
            place += n
        return place


def probe(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, in file order. ValueError if the boxes or tables are broken; no media box: [].

    What can't be read as a whole is an error, never a part: samples without durations, offsets or chunks, tables of
    unequal length, samples outside the file, fragments of unknown tracks, boxes nested deeper than DEEPEST.
    """
    tracks: list[Track] = []
    tables: list[dict[bytes, tuple[int, int]]] = []
    fragments = _Fragments(data, tracks)
    moofs: list[tuple[int, int, int]] = []

    def walk(at: int, end: int, depth: int) -> None:
        if depth > DEEPEST:
            raise ValueError("boxes are nested too deep")
        for kind, lo, hi, start in _boxes(data, at, end):
            if kind == b"trak":
                tracks.append(Track())
                tables.append({})
            if kind == b"moof":
                moofs.append((start, lo, hi))
            elif kind == b"trex":
                fragments.extends(lo, hi)
            elif kind in NESTING:
                walk(lo, hi, depth + 1)
            elif not tracks:
                continue
            elif kind == b"tkhd":
                (tracks[-1].number,) = _numbers(data, lo + (20 if data[lo] == 1 else 12), hi, 1, "I")
            elif kind == b"mdhd":
                wide = data[lo] == 1
                tracks[-1].timescale, tracks[-1].duration = _numbers(data, lo + (20 if wide else 12), hi, 1, "IQ" if wide else "II")
            elif kind == b"hdlr" and not tracks[-1].handler:
                tracks[-1].handler = data[lo + 8 : lo + 12].decode("latin-1")
            elif kind == b"stsd" and hi - lo >= 16:
                tracks[-1].codec = data[lo + 12 : lo + 16].decode("latin-1").strip()
                if tracks[-1].handler == "vide" and hi - lo >= 44:
                    tracks[-1].width, tracks[-1].height = struct.unpack_from(">HH", data, lo + 40)
            elif kind in (b"stsz", b"stz2", b"stco", b"co64", b"stsc", b"stss", b"stts"):
                tables[-1][kind] = lo, hi

    walk(0, len(data), 0)
    stated = [t.duration for t in tracks]
    for track, own in zip(tracks, tables, strict=True):
        track.samples, track.duration = _samples(data, own)
    for start, lo, hi in moofs:
        last = None
        for kind, a, b, _ in _boxes(data, lo, hi):
            if kind == b"traf":
                last = fragments.fragment(start, a, b, last)
    for track, said in zip(tracks, stated, strict=True):
        if not track.samples:
            track.duration = said
    return tracks


KEYFRAMES = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())]))
TRACK = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("handler", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("keyframes", KEYFRAMES),
    ]
)
PROBED = [
    T.StructField("codec", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", KEYFRAMES),
    T.StructField("tracks", T.ArrayType(TRACK)),
    T.StructField("media_error", T.StringType()),
]


def _ranges(track: Track) -> list[dict[str, int]]:
    return [{"offset": a, "size": n} for a, n in track.keyframes()]


def media_columns(df: DataFrame, content: str, keep: list[str] | None = None) -> DataFrame:
    """Adds codec, width, height, duration_s, n_samples, keyframes, tracks and media_error.

    content: a binary column. tracks has an entry for each track, in file order; the columns before it are those of the
    first video track, or of the first track where there is no video. Null content: all null. Content that is no ISO
    media file or is broken, or that can't be read as a whole: the reason in media_error, the rest null. A file without
    tracks: media_error "no track". Equal bytes give equal values; repeated rows stay; an empty table stays empty; these
    columns replace columns of the same names.
    """
    nothing = (None,) * (len(PROBED) - 1)

    def of(data: bytes | None) -> tuple:
        if data is None:
            return *nothing, None
        try:
            if not (tracks := probe(data)):
                return *nothing, "no track"
        except (ValueError, struct.error, IndexError) as error:
            return *nothing, str(error)
        t = next((x for x in tracks if x.handler == "vide"), tracks[0])
        every = [
            {"number": x.number, "handler": x.handler, "codec": x.codec, "duration_s": x.seconds, "n_samples": len(x.samples), "keyframes": _ranges(x)} for x in tracks
        ]
        return t.codec, t.width, t.height, t.seconds, len(t.samples), _ranges(t), every, None

    def make():
        return lambda values: list(zip(*map(of, values.to_pylist()), strict=True)) or [[]] * len(PROBED)

    return with_columns_from_text(df, content, PROBED, make, keep)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


STORED = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def stored_columns(df: DataFrame, text: str, keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Stores each text as an ISO media file, reads it back through its sample tables and adds what was read.

    The payload is the text in UTF-8 (null: empty), filled up with bytes 255 to a positive multiple of 576. feature:
    codec, frame size, duration in milliseconds, samples, keyframes and a CRC of the keyframes' byte ranges.
    with_media: also the file itself, as binary column `media`. Equal texts give equal values; very long texts use
    64-bit boxes; repeated rows stay; an empty table stays empty; columns of these names are replaced.
    """
    fields = STORED + [T.StructField("media", T.BinaryType())] * with_media

    def of(raw: bytes | None) -> tuple:
        raw = raw or b""
        media = container_of(padded(raw))
        (track,) = probe(media)
        payload = b"".join([media[at : at + n] for at, n, _ in track.samples])
        keys = track.keyframes()
        ranges = zlib.crc32(",".join(f"{a}+{n}" for a, n in keys).encode())
        feature = f"{track.codec} {track.width}x{track.height} {round(1000 * track.seconds)}ms {len(track.samples)} samples {len(keys)} keyframes {ranges:08x}"
        row = len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature
        return (*row, media) if with_media else row

    def make():
        return lambda values: list(zip(*map(of, values.cast(pa.binary()).to_pylist()), strict=True)) or [[]] * len(fields)

    return with_columns_from_text(df, text, fields, make, keep)
