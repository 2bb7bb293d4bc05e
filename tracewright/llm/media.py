"""Media columns: MPEG audio.

``encode_texts`` stores payload bytes losslessly in MPEG-1 Layer III streams; ``probe`` parses any column of MPEG
audio: it resynchronises on frame headers, reads ID3v2 and ID3v1 tags and Xing, Info and VBRI tables, verifies
the checksums of protected frames, and gives exact durations and the byte offset of every frame.

A stored stream is an ID3v2.3 tag, a Xing frame with a 100-entry seek table, and silent 32 kHz mono frames whose
ancillary bytes carry the payload; the last frame takes the lowest bit rate that holds the rest, so that the
stream has a variable bit rate.  The tag holds the payload's length.

Defined results: a null or empty text is the 64 zero bytes of an empty payload; a null media value gives a row of
nulls and zero counts; bytes without any frame give 0 frames and duration 0.  Rows are independent, so ties and
repeated rows give equal rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from ._frames import BATCH_BYTES, id_and_text, map_documents, to_batch

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index, samples per frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

#: Of the frames written here: header, checksum and side information come before the carried bytes.
SIDE = 17
ROOM = {index: 9 * kbps // 2 - 4 - 2 - SIDE for index, kbps in enumerate(KBPS[1, 3]) if index}
FULL = max(ROOM)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 8005, started at FFFF, most significant bit first."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC[value >> 8 ^ byte]
    return value


def _header(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 2 << 2, 0xC0))


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


_FRONT = {i: (h := _header(i, True)) + struct.pack(">H", crc16(h[2:4] + bytes(SIDE))) + bytes(SIDE) for i in ROOM}


def encode(payload: bytes) -> bytes:
    """An MPEG-1 Layer III stream that carries ``payload`` in its frames' ancillary bytes."""
    frames, offsets, at = [], [], 0
    first = 144  # the table's frame: 32 kbit/s at 32 kHz
    for start in range(0, len(payload), ROOM[FULL]):
        chunk = payload[start : start + ROOM[FULL]]
        index = FULL if len(chunk) == ROOM[FULL] else next(i for i, room in ROOM.items() if room >= len(chunk))
        offsets.append(at)
        frames.append(_FRONT[index] + chunk.ljust(ROOM[index], b"\0"))
        at += len(frames[-1])
    total = first + at
    # an entry of the seek table: the byte position, in 256ths, of that hundredth of the duration
    toc = bytes(min(255, (first + offsets[p * len(offsets) // 100]) * 256 // total) if offsets else 0 for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    table = (_header(1, False) + bytes(SIDE) + xing).ljust(first, b"\0")
    body = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + table + b"".join(frames)


def parse_header(data: bytes, at: int) -> tuple | None:
    """(version 1, 2 or 25, layer, rate, kbps, frame bytes, samples, protected, mono) of a valid header, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    kind, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if kind == 1 or layer == 4 or index in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    family = 1 if kind == 3 else 2
    hertz, kbps, samples = HERTZ[kind][rate], KBPS[family, layer][index], SAMPLES[family, layer]
    pad = b2 >> 1 & 1
    size = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    return {3: 1, 2: 2, 0: 25}[kind], layer, hertz, kbps, size, samples, not b1 & 1, b3 >> 6 == 3


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.2 to 2.4 tag, and the tag's length."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4) or max(data[6:10]) > 127:
        return {}, 0
    major, size = data[3], data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, tags = min(len(data), 10 + size), {"id3v2": str(major)}
    at, head = 10, 6 if major == 2 else 10
    while at + head <= end and data[at]:
        name = data[at : at + head // 3 + (major != 2)]
        if major == 2:
            length = int.from_bytes(data[at + 3 : at + 6], "big")
        elif major == 3:
            length = int.from_bytes(data[at + 4 : at + 8], "big")
        else:
            length = data[at + 4] << 21 | data[at + 5] << 14 | data[at + 6] << 7 | data[at + 7]
        body = data[at + head : min(end, at + head + length)]
        if name[:1] == b"T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(coding, "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name in (b"TXXX", b"TXX") else (name.decode("latin-1"), "", text)
            tags.setdefault(key, value)
        at += head + length
    return tags, 10 + size + (10 if major == 4 and data[5] & 16 else 0)


def _id3v1(data: bytes) -> dict[str, str]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    fields = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}
    last = data[-128:]
    return {"id3v1": "1"} | {k: v for k, (a, b) in fields.items() if (v := last[a:b].split(b"\0")[0].decode("latin-1").strip())}


def _table(data: bytes, at: int, head: tuple) -> dict | None:
    """The Xing, Info or VBRI table that the frame at ``at`` holds."""
    version, layer, *_, protected, mono = head
    if layer != 3:
        return None
    x = at + 4 + ((9, 17)[not mono] if version != 1 else (17, 32)[not mono])
    for start in (x, x + 2) if protected else (x,):
        if data[start : start + 4] in (b"Xing", b"Info") and start + 8 <= len(data):
            found, flags = {"kind": data[start : start + 4].decode()}, int.from_bytes(data[start + 4 : start + 8], "big")
            p = start + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[key] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                found["toc"] = list(data[p : p + 100])
            return found
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, n, scale, width = struct.unpack(">IIHHH", data[at + 46 : at + 60])
        p = at + 62
        toc = [scale * int.from_bytes(data[p + i * width : p + (i + 1) * width], "big") for i in range(n)] if width in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def parse(data: bytes) -> dict:
    """Everything that ``probe`` reports of one stream, and the spans of its frames' main data.

    A header counts where the next frame's header follows with the same version, layer and rate, or where the
    frame ends the stream; otherwise the search goes on at the next sync byte, and the bytes passed over are
    counted in ``skipped``.
    """
    tags, at = _id3v2(data)
    tail = _id3v1(data)
    end = len(data) - (128 if tail else 0)
    out = {"tags": tags | tail, "offsets": [], "spans": [], "skipped": 0, "crc_ok": 0, "crc_bad": 0, "crc_unread": 0, "table": None, "kbps": {}}
    duration, samples, first, known = Fraction(0), 0, None, {}
    while at < end:
        head = parse_header(data, at)
        if head:
            after = at + head[4]
            follower = parse_header(data, after) if after + 4 <= end else None
            if not (after == end or follower and follower[:3] == head[:3]) and not (out["offsets"] and after <= end and head[:3] == first[:3] and after + 4 > end):
                head = None
        if head is None:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out["skipped"] += step - at
            at = step
            continue
        version, layer, hertz, kbps, size, n, protected, mono = head
        if first is None and (table := _table(data, at, head)) is not None and out["table"] is None:
            out["table"], at = table, at + size
            continue
        first = first or head
        side = ((9, 17)[not mono] if version != 1 else (17, 32)[not mono]) if layer == 3 else 0
        if protected:
            # layer I covers the bit allocation of up to two channels, layer III the side information
            covered = side if layer == 3 else 16 if layer == 1 and mono else 32 if layer == 1 and data[at + 3] >> 6 != 1 else None
            if covered is None:
                out["crc_unread"] += 1
            else:
                part = data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered]
                if part not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[part] = crc16(part)
                out["crc_ok" if known[part] == data[at + 4] << 8 | data[at + 5] else "crc_bad"] += 1
        out["offsets"].append(at)
        out["spans"].append((at + 4 + 2 * protected + side, at + size))
        out["kbps"][kbps] = out["kbps"].get(kbps, 0) + 1
        duration += Fraction(n, hertz)
        samples += n
        at += size
    return out | {"duration": duration, "samples": samples, "first": first}


def decode(data: bytes) -> bytes:
    """The payload that ``encode`` stored."""
    found = parse(data)
    joined = b"".join(data[a:b] for a, b in found["spans"])
    return joined[: int(found["tags"].get("payload_bytes", len(joined)))]


def feature(found: dict) -> str:
    """A line that tells one parsed stream from another: rates, exact duration, tables, checksums, offsets."""
    first, table = found["first"], found["table"] or {}
    offsets = found["offsets"]
    return ";".join(
        (
            f"mpeg{first[0]}.{first[1]}@{first[2]}" if first else "none",
            f"frames={len(offsets)}",
            f"duration={found['duration'].numerator}/{found['duration'].denominator}",
            "kbps=" + ",".join(f"{k}x{v}" for k, v in sorted(found["kbps"].items())),
            f"table={table.get('kind', '-')}:{table.get('frames', '-')}:{table.get('bytes', '-')}",
            f"crc={found['crc_ok']}/{found['crc_ok'] + found['crc_bad'] + found['crc_unread']}",
            f"seek={zlib.crc32(struct.pack(f'>{len(offsets)}Q', *offsets)):08x}",
        )
    )


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zero bytes to a positive multiple of 64, as audio."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def make():
        def each(doc_id, text):
            raw = (text or "").encode()
            return doc_id, len(raw), encode(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))

        return each

    return map_documents(id_and_text(df, id_col, text_col), "doc_id long, n_bytes long, media binary", make, arrow)


PROBE = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, n_samples long, sample_rate int, duration_us long, skipped_bytes long, crc_ok long, crc_bad long, "
    "vbr_kind string, vbr_frames long, tags map<string,string>, frame_offsets array<long>"
)


def probe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", length_col: str | None = None) -> DataFrame:
    """One row per media value: digests of it and of its main data, exact duration, tags, tables, checksums, frame offsets."""
    ship(df.sparkSession)
    length = F.col(length_col) if length_col else F.lit(None)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n_bytes"), F.col(media_col).cast("binary").alias("media"))
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
        + [("feature", pa.string()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int32()), ("duration_us", pa.int64()), ("skipped_bytes", pa.int64()), ("crc_ok", pa.int64()), ("crc_bad", pa.int64())]
        + [("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("frame_offsets", pa.list_(pa.int64()))]
    )

    def row(doc_id, n_bytes, media):
        if media is None:
            return doc_id, n_bytes, None, None, None, None, None, None, 0, 0, None, 0, 0, 0, 0, None, None, None, None
        found = parse(media)
        joined = b"".join(media[a:b] for a, b in found["spans"])
        payload = joined[: int(n)] if (n := found["tags"].get("payload_bytes", "")).isdigit() else joined
        table, us = found["table"] or {}, found["duration"] * 1_000_000
        return (
            (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found))
            + (len(found["offsets"]), found["samples"], found["first"] and found["first"][2], us.numerator // us.denominator, found["skipped"], found["crc_ok"], found["crc_bad"])
            + (table.get("kind"), table.get("frames"), list(found["tags"].items()), found["offsets"])
        )

    def run(batches):
        for batch in batches:
            rows, used = [], 0
            for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows.append(row(doc_id, n_bytes, value := media.as_py()))
                used += len(value or b"")
                if used > BATCH_BYTES:
                    yield to_batch(rows, arrow)
                    rows, used = [], 0
            if rows:
                yield to_batch(rows, arrow)

    return source.mapInArrow(run, PROBE)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts stored as audio and read back: the digest columns of ``probe``."""
    return probe(encode_texts(df, id_col, text_col), length_col="n_bytes")
