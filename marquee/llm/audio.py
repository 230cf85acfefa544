"""Media columns: MPEG-1 Layer III audio whose frames carry a payload.

Storage. A stream is an ID3v2 tag, an information frame with the variable-bitrate
table, and silent mono 48 kHz frames with CRC. A silent frame's side information is all
zero, so no main data is used and the rest of the frame is ancillary data, which every
decoder skips: there the payload lies. The frame size is chosen per frame (full frames
at 320 kbit/s, the last one as small as fits), so the stream has a variable bitrate.

Reading is for any MPEG-1, 2 or 2.5 stream of Layer I, II or III with stated bitrates
(free format isn't read). Tags are skipped and parsed, frame headers are resynchronised (a header counts
if its checksum holds, or if the next header or the end of the data is at the distance it
states), checksums are verified (of Layer III; Layers I and II guard a part whose length
depends on their bit allocation, which isn't read), the variable-bitrate table (Xing, Info
or VBRI) is parsed, and the exact duration and the byte offset of every frame are stored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marquee.llm.common import table

# Fixed values of the format: kbit/s by index for (MPEG-1?, layer), and Hz by index of MPEG-1; MPEG-2 has half, 2.5 a quarter of it.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_KBITS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): KBITS,
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): LOW_KBITS,
    (False, 3): LOW_KBITS,
}
HERTZ = (44100, 48000, 32000)
SIDE = 17  # bytes of side information of a mono frame of MPEG-1
BLOCK = 64
TABLE = 100  # entries of the seek table


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF, high bit first."""
    c = 0xFFFF
    for x in data:
        c ^= x << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


@lru_cache(4096)
def _crc(data: bytes) -> bytes:
    return crc16(data).to_bytes(2, "big")


def header(kbits: int) -> bytes:
    """MPEG-1 Layer III, protected, 48 kHz, mono."""
    return bytes([0xFF, 0xFA, KBITS.index(kbits) << 4 | 1 << 2, 0xC0])


class Frame(NamedTuple):
    """What a header states: the frame's bytes, samples, Hz, kbit/s, layer, and bytes of side information (Layer III)."""

    bytes: int
    samples: int
    hertz: int
    kbits: int
    layer: int
    side: int


@lru_cache(4096)
def frame_of(head: bytes) -> Frame | None:
    """The frame that four bytes are the header of, if they are one."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate, at = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < rate < 15 or at == 3:
        return None
    first = version == 3
    kbits, hertz, padded = RATES[first, layer][rate], HERTZ[at] >> {3: 0, 2: 1, 0: 2}[version], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12_000 * kbits // hertz + padded) * 4 if layer == 1 else samples * 125 * kbits // hertz + padded
    mono = head[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Frame(size, samples, hertz, kbits, layer, side)


def seek_table(media: bytes, at: int, frame: Frame, start: int) -> dict | None:
    """The variable-bitrate table of an information frame, if the frame at `at` is one: frames, bytes, seek."""
    end = at + frame.bytes
    data = media[start + frame.side:end]
    if data[:4] in (b"Xing", b"Info"):
        found, flags, p = {}, int.from_bytes(data[4:8], "big"), 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name], p = int.from_bytes(data[p:p + 4], "big"), p + 4
        if flags & 4:
            found["seek"] = list(data[p:p + TABLE])
        return found
    data = media[at + 36:end]
    if data[:4] != b"VBRI" or len(data) < 26:
        return None
    number = lambda p, n: int.from_bytes(data[p:p + n], "big")
    entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
    seek = [0]
    for k in range(entries):
        seek.append(seek[-1] + scale * number(26 + k * width, width))
    return {"bytes": number(10, 4), "frames": number(14, 4), "seek": seek[:-1]}


FRAME = {k: 144_000 * k // 48_000 for k in KBITS[1:]}
ROOM = {k: n - 4 - 2 - SIDE for k, n in FRAME.items()}


def _frame(kbits: int, body: bytes) -> bytes:
    head = header(kbits)
    return b"".join((head, _crc(head[2:] + bytes(SIDE)), bytes(SIDE), body, bytes(ROOM[kbits] - len(body))))


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def tag(texts: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of user-defined text frames."""
    body = b"".join(
        b"TXXX" + len(x).to_bytes(4, "big") + b"\0\0" + x
        for x in (b"\0" + k.encode() + b"\0" + v.encode() for k, v in texts.items()))
    return b"ID3\x03\0\0" + syncsafe(len(body)) + body


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def encode(payload: bytes) -> bytes:
    """The stored form of a payload."""
    room = ROOM[320]
    frames = [_frame(320, payload[i:i + room]) for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(frames) * room:]:
        frames.append(_frame(next(k for k in KBITS[1:] if ROOM[k] >= len(rest)), rest))
    total = FRAME[320] + sum(map(len, frames))
    offsets = [FRAME[320]]
    for f in frames:
        offsets.append(offsets[-1] + len(f))
    seek = bytes(min(255, offsets[len(frames) * k // TABLE] * 256 // total) for k in range(TABLE))
    info = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    return b"".join((tag({"payload": str(len(payload))}), _frame(320, info), *frames))


def read_tags(media: bytes) -> tuple[dict[str, str], int]:
    """User-defined texts of leading ID3v2 tags, and where they end."""
    at, found = 0, {}
    while media[at:at + 3] == b"ID3" and len(media) >= at + 10 and max(media[at + 6:at + 10]) < 128:
        size = sum(x << s for x, s in zip(media[at + 6:at + 10], (21, 14, 7, 0)))
        p, end = at + 10, min(len(media), at + 10 + size)
        while p + 10 <= end and media[p:p + 4].isalnum():
            n = int.from_bytes(media[p + 4:p + 8], "big")
            if media[p:p + 4] == b"TXXX" and media[p + 10:p + 11] == b"\0":
                k, _, v = media[p + 11:min(end, p + 10 + n)].partition(b"\0")
                found[k.decode("latin-1")] = v.decode("latin-1")
            p += 10 + n
        at = end
    return found, at


def parse(media: bytes | None) -> dict:
    """What a stream holds: frames, offsets, duration, checksums, table, payload.

    Bytes between frames are skipped until the next header that is confirmed; bad
    checksums are counted and their frames kept. Null or foreign bytes give 0 frames.
    """
    media = media or b""
    tags, at = read_tags(media)
    offsets, kbits, bad, skipped, body, table, samples_at = [], [], 0, 0, [], None, {}
    first = True
    end = len(media)
    while at + 4 <= end:
        frame = frame_of(media[at:at + 4])
        fits = frame is not None and at + frame.bytes <= end
        good = checked = False
        if fits:
            guarded = not media[at + 1] & 1
            start = at + 4 + 2 * guarded
            checked = guarded and frame.layer == 3
            good = checked and _crc(media[at + 2:at + 4] + media[start:start + frame.side]) == media[at + 4:at + 6]
        # a header counts if its checksum holds, or if the next frame or the end is where it says
        after = at + frame.bytes if fits else 0
        if not fits or not good and after + 4 <= end and not frame_of(media[after:after + 4]):
            found = media.find(b"\xff", at + 1)
            skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        bad += checked and not good
        table = seek_table(media, at, frame, start) if first else table
        if not first or table is None:
            offsets.append(at)
            kbits.append(frame.kbits)
            samples_at[frame.hertz] = samples_at.get(frame.hertz, 0) + frame.samples
            body.append(media[start + frame.side:after])
        first = False
        at = after
    skipped += end - at
    payload = b"".join(body)
    size = tags.get("payload", "")
    return {
        "payload": payload[:int(size)] if size.isdigit() else payload, "offsets": offsets, "bad": bad, "skipped": skipped,
        "micros": sum(n * 1_000_000 // hz for hz, n in samples_at.items()), "samples": sum(samples_at.values()), "kbits": kbits,
        "frames": len(offsets), "table": table or {}, "table_ok": bool(table) and table.get("frames") == len(offsets),
    }


def store_audio(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes, padded with 0 to a multiple of 64, as an MPEG stream.

    Null is stored as empty text. Equal texts have equal media; other columns are left out.
    """
    schema = df.select(F.col(id_col)).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())],
                names=[id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def index_audio(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """df without its media, with what parse() finds: the exact duration, seek offsets and digests.

    Works for the streams that parse() reads; null and foreign bytes give 0 frames, and
    repeated rows come out once each. Columns: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, n_frames, duration_us, n_bad_crc, n_skipped, table_ok,
    seek_offsets (one byte offset a frame), feature. Columns of df with these names are
    replaced. An empty table gives an empty one.
    """
    added = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_us", "n_bad_crc", "n_skipped", "table_ok", "seek_offsets", "feature")
    keep = [c for c in df.columns if c != media_col and c not in added]
    schema = df.select(*keep).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"),
                       ("media_sha256", "string"), ("n_frames", "long"), ("duration_us", "long"), ("n_bad_crc", "long"),
                       ("n_skipped", "long"), ("table_ok", "boolean"), ("seek_offsets", ArrayType(LongType())), ("feature", "string")):
        schema = schema.add(name, kind)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for b in batches:
            out = []
            for media in b.column(len(keep)).to_pylist():
                x = parse(media)
                p = x["payload"]
                mean = round(sum(x["kbits"]) / max(1, x["frames"]), 1)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(),
                            x["frames"], x["micros"], x["bad"], x["skipped"], x["table_ok"], x["offsets"],
                            f"frames={x['frames']};us={x['micros']};kbps={mean};bad={x['bad']};skipped={x['skipped']}"))
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return df.select(*keep, media_col).mapInArrow(run, schema)


def op4_media_columns(spark, sf_dir):
    return index_audio(store_audio(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "n_frames", "duration_us", "n_bad_crc", "table_ok", "seek_offsets")
