"""Media columns of MPEG audio.

`probe` reads any MPEG audio stream (MPEG 1, 2 and 2.5, layers I to III): it passes an ID3v2 tag, resynchronises to
frame headers (a header counts once the next one follows where it says), parses an ID3v1 tag and the Xing, Info or
VBRI table of variable bit rates, verifies the CRC-16 of protected frames, and stores the exact duration (samples
over sample rate) and the byte offset of every frame. `store` writes a byte payload losslessly into such a stream:
the frames' main data is free space where a frame's side information says that no bits of it are sound, so layer III
frames of silence carry it, at the smallest bit rate that holds what is left. `payload` reads it back.

Cases: a null text counts as empty and still has 64 zero bytes; a null or broken stream probes to no frames,
zero duration and an empty payload; other columns stay; equal texts give equal bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.llm.bpe import pieces_of

# Fixed values of the MPEG audio header, in the order of its bit fields.
VERSIONS = {0: 2.5, 2: 2, 3: 1}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
OWNER = b"fleetseries.payload\0"


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The CRC of MPEG audio: x^16 + x^15 + x^2 + 1, highest bit first, from all ones."""
    for byte in data:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ byte]) & 0xFFFF
    return crc


def _crc_row(v: int) -> int:
    v <<= 8
    for _ in range(8):
        v = (v << 1 ^ (0x8005 if v & 0x8000 else 0)) & 0xFFFF
    return v


_CRC = [_crc_row(v) for v in range(256)]
_HEADERS: dict[bytes, tuple | None] = {}


def header(four: bytes) -> tuple | None:
    """(version, layer, protected, kbps, rate, samples, frame bytes, side information bytes, channels) of a frame header, or None."""
    if four in _HEADERS:
        return _HEADERS[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
        rate_at, padding, kbps_at = four[2] >> 2 & 3, four[2] >> 1 & 1, four[2] >> 4
        if version and layer < 4 and rate_at < 3 and 0 < kbps_at < 15:
            kbps = KBPS[1 if version == 1 else 2, layer][kbps_at - 1]
            rate = RATES[version][rate_at]
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
            size = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
            mono = four[3] >> 6 == 3
            side = ((17 if mono else 32) if version == 1 else (9 if mono else 17)) if layer == 3 else 0
            found = (version, layer, not four[1] & 1, kbps, rate, samples, size, side, 1 if mono else 2)
    if len(_HEADERS) < 65536:
        _HEADERS[four] = found
    return found


def syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def tag(data: bytes) -> tuple[int, dict[str, bytes]]:
    """(bytes of a leading ID3v2 tag, its frames by name)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = 10 + sum((b & 127) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    frames, at = {}, 10
    while at + 10 <= min(size, len(data)) and data[at] != 0:
        raw = data[at + 4 : at + 8]
        n = sum((b & 127) << 7 * (3 - k) for k, b in enumerate(raw)) if data[3] >= 4 else int.from_bytes(raw, "big")
        frames[data[at : at + 4].decode("latin-1")] = data[at + 10 : at + 10 + n]
        at += 10 + n
    return size, frames


def vbr_table(data: bytes, start: int, side: int) -> dict | None:
    """The Xing, Info or VBRI table in the frame at start: its name, frames, bytes and seek table."""
    at = start + 4 + side
    for skip in (0, 2):  # a CRC may stand before it
        name = data[at + skip : at + skip + 4]
        if name in (b"Xing", b"Info"):
            flags, at = int.from_bytes(data[at + skip + 4 : at + skip + 8], "big"), at + skip + 8
            out: dict = {"kind": name.decode(), "frames": None, "bytes": None, "toc": []}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(data[at : at + 4], "big")
                    at += 4
            if flags & 4:
                out["toc"] = list(data[at : at + 100])
            return out
    if data[start + 36 : start + 40] == b"VBRI" and len(data) >= start + 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[start + 46 : start + 60])
        raw = data[start + 62 : start + 62 + entries * width]
        toc = [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw), max(width, 1))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def probe_bytes(data: bytes | None) -> dict:
    """All features of one stream. offsets are those of sound frames; a table's own frame is not one of them."""
    data = data or b""
    at, frames = tag(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    out = {"rate": 0, "channels": 0, "samples": 0, "offsets": [], "crc_checked": 0, "crc_bad": 0, "skipped": 0, "table": None, "tags": frames, "version": 0.0, "layer": 0}
    first, synced = None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and at + h[6] <= end and (first is None or (h[0], h[1], h[4]) == first):
            after = at + h[6]
            follows = header(data[after : after + 4]) if after + 4 <= end else None
            if synced or after >= end or (follows is not None and (follows[0], follows[1], follows[4]) == (h[0], h[1], h[4])):
                if first is None:
                    first = (h[0], h[1], h[4])
                    out |= {"version": float(h[0]), "layer": h[1], "rate": h[4], "channels": h[8]}
                table = vbr_table(data, at, h[7]) if not out["offsets"] and out["table"] is None else None
                if h[2] and h[1] == 3:
                    out["crc_checked"] += 1
                    wanted = int.from_bytes(data[at + 4 : at + 6], "big")
                    out["crc_bad"] += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h[7]]) != wanted
                if table:
                    out["table"] = table
                else:
                    out["offsets"].append(at)
                    out["samples"] += h[5]
                at, synced = after, True
                continue
        at, synced = data.find(b"\xff", at + 1) if data.find(b"\xff", at + 1) >= 0 else end, False
        out["skipped"] += 1
    return out


# -- a payload in layer III frames of silence -----------------------------------------------------------

RATE = 48000
#: (bytes of main data, header, the header's CRC with empty side information) of each frame size, mono with CRC at 48 kHz.
SIDE = bytes(17)
SIZES = [(144 * kbps * 1000 // RATE - 4 - 2 - len(SIDE), k + 1) for k, kbps in enumerate(KBPS[1, 3])]


def frame(kbps_at: int, room: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, kbps_at << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + SIDE).to_bytes(2, "big") + SIDE + body.ljust(room, b"\0")


_EMPTY = {k: frame(k, 0, b"") for _, k in SIZES}


def store_bytes(content: bytes) -> bytes:
    """content in a stream: an ID3v2 tag with its size and CRC-32, a Xing frame with a seek table, and frames that carry it."""
    most, top = SIZES[-1]
    parts, sizes = [], []
    for at in range(0, len(content), most):
        body = content[at : at + most]
        room, k = (most, top) if len(body) == most else next(x for x in SIZES if x[0] >= len(body))
        parts += [_EMPTY[k], body if len(body) == room else body.ljust(room, b"\0")]
        sizes.append(room + 4 + 2 + len(SIDE))
    private = OWNER + struct.pack("<QI", len(content), zlib.crc32(content))
    tags = b"PRIV" + len(private).to_bytes(4, "big") + b"\0\0" + private
    total, toc, reached = sum(sizes), bytearray(), 0
    ends = iter(sizes)
    place = 0
    for percent in range(100):
        while place < percent * len(sizes) // 100:
            reached += next(ends)
            place += 1
        toc.append(min(255, 256 * reached // max(total, 1)))
    room, k = next(x for x in SIZES if x[0] >= 120)
    xing = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + (total + room + 23).to_bytes(4, "big") + bytes(toc)
    return b"".join([b"ID3\x03\0\0" + syncsafe(len(tags)) + tags, _EMPTY[k], xing.ljust(room, b"\0"), *parts])


def payload_of(data: bytes | None, found: dict) -> bytes:
    """The bytes that store_bytes put into a stream; empty where its tag is missing or its CRC-32 differs."""
    private = found["tags"].get("PRIV", b"")
    if not data or not private.startswith(OWNER):
        return b""
    size, crc = struct.unpack("<QI", private[len(OWNER) : len(OWNER) + 12])
    bodies = [data[at + 6 + len(SIDE) : at + header(data[at : at + 4])[6]] for at in found["offsets"]]
    content = b"".join(bodies)[:size]
    return content if len(content) == size and zlib.crc32(content) == crc else b""


def padded(text: str | None) -> bytes:
    """The text's UTF-8, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


FEATURES = (
    T.StructType()
    .add("payload", T.BinaryType())
    .add("version", T.DoubleType())
    .add("layer", T.IntegerType())
    .add("sample_rate", T.IntegerType())
    .add("channels", T.IntegerType())
    .add("n_frames", T.IntegerType())
    .add("samples", T.LongType())
    .add("duration_s", T.DoubleType())
    .add("table", T.StringType())
    .add("table_frames", T.LongType())
    .add("crc_checked", T.IntegerType())
    .add("crc_bad", T.IntegerType())
    .add("skipped", T.IntegerType())
    .add("frame_offsets", T.ArrayType(T.LongType()))
)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the media column in the text column's place: the text, padded, in an MPEG stream."""
    schema = T.StructType([f for f in docs.schema if f.name not in (text, media)] + [T.StructField(media, T.BinaryType())])
    rest = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text):
                made = pa.array([store_bytes(padded(x)) for x in part.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], names=[*rest, media])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text)).mapInArrow(run, schema)


def probe(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored with the features of its media column, and the payload where it carries one."""
    own = {f.name for f in FEATURES}
    schema = T.StructType([f for f in stored.schema if f.name not in own] + list(FEATURES))
    rest = [f.name for f in schema if f.name not in own]
    kinds = [pa.binary(), pa.float64(), *[pa.int32()] * 4, pa.int64(), pa.float64(), pa.string(), pa.int64(), *[pa.int32()] * 3, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, media):
                rows = []
                for data in part.column(media).to_pylist():
                    x = probe_bytes(data)
                    t = x["table"] or {"kind": None, "frames": None}
                    rows.append((payload_of(data, x), x["version"], x["layer"], x["rate"], x["channels"], len(x["offsets"]), x["samples"], x["samples"] / x["rate"] if x["rate"] else 0.0, t["kind"], t["frames"], x["crc_checked"], x["crc_bad"], x["skipped"], x["offsets"]))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *arrays], names=[*rest, *(f.name for f in FEATURES)])

    return stored.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """What was stored and read back for every document, as digests, with the stream's features in one string."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    read = probe(store(base))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.format_string("mpeg%.1f", "version"), F.format_string("layer%d", "layer"), F.format_string("rate%d", "sample_rate"),
            F.format_string("channels%d", "channels"), F.format_string("frames%d", "n_frames"), F.format_string("samples%d", "samples"),
            F.format_string("table=%s:%d", "table", "table_frames"), F.format_string("crc%d/%d", F.col("crc_checked") - F.col("crc_bad"), "crc_checked"),
        ).alias("feature"),
        "duration_s",
        "frame_offsets",
    )
