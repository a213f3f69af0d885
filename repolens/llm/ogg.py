"""Ogg media columns: pages with checksums, packets by lacing, logical streams, granule times.

A media value is one physical Ogg stream (RFC 3533) in a binary column. ``mux`` interleaves logical
streams into pages; ``pages``, ``demultiplex`` and ``read_streams`` take it apart again, verifying every
page checksum, joining packets across pages from their lacing values, and turning granule positions into
times with the sample rate that a stream's first packet declares.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, per_slice, utf8

#: Fixed values of the container (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = 0xFFFFFFFFFFFFFFFF
HEADER = struct.Struct("<4sBBQIIIB")

#: Our own payload mapping: a head packet names the kind, the rate in samples a second and a version.
HEAD = struct.Struct("<8sIB")
SAMPLES, MARKS = b"rlPCMu8\0", b"rlMarks\0"
SAMPLES_SERIAL, MARKS_SERIAL = 0x52454C31, 0x52454C32

UNIT = 192
RATE = 8000
PACKET = 20 * UNIT
MARK_EVERY = 16

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's page checksum: polynomial 0x04C11DB7, most significant bit first, zero start, no final xor.

    zlib's crc32 has the same polynomial with bits in the other order, so bytes go in mirrored, its start
    value is chosen to cancel its own, and the result is mirrored back.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    valid: bool


@dataclass
class Stream:
    """One logical stream: whole packets, the granule position at which each one's page ends (None where
    its page has a later packet's end), and what was wrong."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    bad_pages: int = 0
    gaps: int = 0
    ended: bool = False
    rate: int = 0

    @property
    def seconds(self) -> list[float | None]:
        return [None if g is None or not self.rate else g / self.rate for g in self.granules]

    @property
    def duration(self) -> float:
        ends = [g for g in self.granules if g is not None]
        return ends[-1] / self.rate if ends and self.rate else 0.0


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    def head(crc: int) -> bytes:
        return HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, crc, len(lacing))

    return head(checksum(head(0) + lacing + body)) + lacing + body


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream as (granule to interleave by, bytes). ``packets``: bytes and the granule
    position after each. The head packet has a page of its own; others fill pages of 255 segments and go on
    in the next page where they don't fit."""
    sequence = 0
    lacing, body, granule, open_packet = bytearray(), bytearray(), NO_PACKET_ENDS, False
    order = 0
    for i, (data, after) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1
        started = False
        while left:
            room = min(left, 255 - len(lacing))
            if room == 0:
                yield order, _page(CONTINUED * open_packet, granule, serial, sequence, bytes(lacing), bytes(body))
                sequence += 1
                lacing, body, granule, open_packet = bytearray(), bytearray(), NO_PACKET_ENDS, started
                continue
            whole = room == left
            take = data[at:] if whole else data[at : at + 255 * room]
            lacing += b"\xff" * (room - whole) + (bytes([len(data) % 255]) if whole else b"")
            body += take
            at, left, started = at + len(take), left - room, True
        granule = order = after
        if i == 0 or i == len(packets) - 1:
            flags = CONTINUED * open_packet | FIRST * (i == 0) | LAST * (i == len(packets) - 1)
            yield order, _page(flags, granule, serial, sequence, bytes(lacing), bytes(body))
            sequence += 1
            lacing, body, granule, open_packet = bytearray(), bytearray(), NO_PACKET_ENDS, False


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: first pages of all logical streams, then pages in order of granule position."""
    made = {serial: list(paginate(serial, packets)) for serial, packets in streams.items()}
    first = [p[0][1] for p in made.values()]
    rest = sorted(((g, k, n, data) for k, p in enumerate(made.values()) for n, (g, data) in enumerate(p[1:])), key=lambda x: x[:3])
    return b"".join(first + [x[3] for x in rest])


def pages(data: bytes) -> Iterator[Page]:
    """Pages in order; after junk or a damaged header the next capture pattern is sought. A page whose
    checksum is wrong is given with ``valid`` false and never used for packets."""
    at = 0
    while (at := data.find(CAPTURE, at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            at += 1
            continue
        raw = data[at:end]
        valid = checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) == crc
        yield Page(flags, granule, serial, sequence, lacing, raw[27 + n :], valid)
        at = end if valid else at + 4


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, packets joined from lacing values. A packet with a missing or
    damaged part is dropped and counted in ``gaps``."""
    streams: dict[int, Stream] = {}
    parts: dict[int, bytearray | None] = {}
    last: dict[int, int] = {}
    for page in pages(data):
        s = streams.setdefault(page.serial, Stream(page.serial))
        if not page.valid:
            s.bad_pages += 1
            continue
        s.pages += 1
        held = parts.get(page.serial)
        missing = page.serial in last and page.sequence != last[page.serial] + 1
        last[page.serial] = page.sequence
        if missing or bool(held is not None) != bool(page.flags & CONTINUED):
            s.gaps += missing or held is not None
            held = None
        skip = bool(page.flags & CONTINUED) and held is None
        at, run, done = 0, 0, 0
        for value in page.lacing:
            run += value
            if value < 255:
                chunk = page.body[at : at + run]
                if skip:
                    skip = False
                else:
                    s.packets.append(bytes(held) + chunk if held is not None else chunk)
                    s.granules.append(None)
                    done += 1
                at, run, held = at + run, 0, None
        if page.lacing and page.lacing[-1] == 255 and not skip:
            held = (held if held is not None else bytearray()) + page.body[at:]
        if done and page.granule != NO_PACKET_ENDS:
            s.granules[-1] = page.granule
        parts[page.serial] = held
        s.ended |= bool(page.flags & LAST)
    for s in streams.values():
        if s.packets and len(s.packets[0]) == HEAD.size:
            s.rate = HEAD.unpack(s.packets[0])[1]
    return streams


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """A payload as 8-bit samples in one logical stream, and a second one with a mark (sample position,
    crc32 of the samples since the last mark) every ``MARK_EVERY`` packets."""
    samples, marks = [(HEAD.pack(SAMPLES, rate, 1), 0)], [(HEAD.pack(MARKS, rate, 1), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    span = PACKET * MARK_EVERY
    marks += [(struct.pack("<QI", i, zlib.crc32(payload[i : i + span])), min(i + span, len(payload))) for i in range(0, len(payload), span)]
    return mux({SAMPLES_SERIAL: samples, MARKS_SERIAL: marks})


def decode(media: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """The payload, the logical streams, and how many marks don't agree with the samples read."""
    streams = demultiplex(media)
    if SAMPLES_SERIAL not in streams:
        return b"", streams, 0
    payload, wrong, span = b"".join(streams[SAMPLES_SERIAL].packets[1:]), 0, PACKET * MARK_EVERY
    for mark in streams[MARKS_SERIAL].packets[1:] if MARKS_SERIAL in streams else []:
        at, crc = struct.unpack("<QI", mark)
        wrong += zlib.crc32(payload[at : at + span]) != crc
    return payload, streams, wrong


def text_payload(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of ``UNIT``."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def text_to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as an Ogg value. Null text is empty; an empty text is one
    unit of spaces; null ids stay null; repeated rows give repeated values; other columns are not read."""

    def fn(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": [encode(text_payload(t)) for t in texts]}

    return per_slice(id_and_text(docs), fn, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored Ogg values (columns ``doc_id, n_bytes, media``) back: payload digests, and a feature text
    with streams, pages, packets, duration, damage and sample levels. Null media has no streams."""

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages", "duration_s")}
        for value in utf8(batch.column("media")):
            payload, streams, wrong = decode(value)
            s = streams.get(SAMPLES_SERIAL, Stream(0))
            bad = sum(x.bad_pages + x.gaps for x in streams.values()) + wrong
            half = len(payload) // 2
            levels = f"sum={sum(payload)};low={min(payload, default=0)};high={max(payload, default=0)};halves={zlib.crc32(payload[:half]):08x}.{zlib.crc32(payload[half:]):08x}"
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(value))
            out["media_sha256"].append(hashlib.sha256(value).hexdigest())
            out["feature"].append(f"ogg;streams={len(streams)};pages={sum(x.pages for x in streams.values())};packets={len(s.packets)};ms={round(1000 * s.duration)};bad={bad};{levels}")
            out["bad_pages"].append(bad)
            out["duration_s"].append(s.duration)
        return out | {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long, duration_s double"
    return per_slice(media.select("doc_id", "n_bytes", "media"), fn, schema, "media")


def media_packets(media: DataFrame) -> DataFrame:
    """One row per packet of each logical stream: ``doc_id, serial, packet, n_bytes, granule, seconds``.
    ``granule`` and ``seconds`` are null for packets that are not the last to end on their page."""

    def fn(batch: pa.RecordBatch) -> dict:
        rows = [
            (i, serial, k, len(p), s.granules[k], s.seconds[k])
            for i, value in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("media")), strict=True)
            for serial, s in sorted(demultiplex(value).items())
            for k, p in enumerate(s.packets)
        ]
        names = ("doc_id", "serial", "packet", "n_bytes", "granule", "seconds")
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return per_slice(media.select("doc_id", "media"), fn, "doc_id long, serial long, packet long, n_bytes long, granule long, seconds double", "media")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as Ogg, read back, with digests and features."""
    return media_features(text_to_media(documents(spark, sf_dir))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("duration_s")
    )
