"""Media columns: Ogg physical streams stored in a binary column and read back.

A payload of 8-bit mono samples is cut into packets which two logical streams carry in turn, so that the
reader has to demultiplex. Reading verifies every page's checksum and sequence number, reassembles packets from
the lacing values (also over page borders), and derives times from the granule positions.

Edge cases: a null payload is an empty one; an empty payload gives two header pages and no packet; payloads of any
length are stored whole; equal payloads give equal media (serial numbers come from the payload); damaged media raise
ValueError in read(), which names the fault, and give nulls and that name in tables; repeated rows and null doc_ids are
rows like others; a table without rows gives none; other columns of a table, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, give_back, table

RATE = 8000
PACKET = 4096
STREAMS = 2
_PAGE = struct.Struct("<4sBBqIIIB")
#: After the mark RAW8: rate, stream, streams, samples.
_HEAD = struct.Struct("<IBBQ")
#: Each byte with its bits in reverse: with it, zlib's reflected CRC-32 yields the plain one that Ogg uses.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, not reflected, start 0: that of an Ogg page whose checksum field is 0."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing + body
    return head[:22] + page_checksum(head).to_bytes(4, "little") + head[26:]


def _pages(packets: list[bytes], serial: int) -> Iterator[tuple[int, bytes]]:
    """(samples before the page's end, page) of one logical stream after its header page."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, done, seq, at, open_ = b"".join(packets), 0, 1, 0, False
    ends = np.cumsum([len(p) for p in packets])
    for i in range(0, len(lacing), 255):
        part = lacing[i : i + 255]
        size = sum(part)
        last = i + 255 >= len(lacing)
        closed = sum(v < 255 for v in part)
        done += closed
        granule = int(ends[done - 1]) if closed else -1
        yield at + size, _page((1 if open_ else 0) | (4 if last else 0), granule, serial, seq, part, body[at : at + size])
        at, seq, open_ = at + size, seq + 1, part[-1] == 255


def write(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg physical stream that holds the payload as 8-bit samples."""
    cuts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    serial = zlib.crc32(payload)
    heads, bodies = [], []
    for s in range(STREAMS):
        mine = cuts[s::STREAMS]
        head = b"RAW8" + _HEAD.pack(rate, s, STREAMS, sum(map(len, mine)))
        own = (serial + s) & 0xFFFFFFFF
        heads.append(_page(2 if mine else 6, 0, own, 0, bytes([len(head)]), head))
        bodies += [(at, s, page) for at, page in _pages(mine, own)]
    return b"".join(heads) + b"".join(page for _, _, page in sorted(bodies, key=lambda x: x[:2]))


def read(media: bytes) -> tuple[bytes, list[tuple[int, int, float, bytes]]]:
    """(payload, packets as (stream, number in it, start in ms or nan where no granule tells, data)). The first packet of a
    stream tells its codec. Streams of raw samples, in the order that they give, make the payload; packets of other
    codecs have no samples and hence no times. Raises ValueError for damaged media."""
    streams = _demultiplexed(media)
    raw = sorted((s for s in streams if s["codec"] == "raw"), key=lambda s: s["packets"][0][8])
    out = []
    for k, s in enumerate([*raw, *(s for s in streams if s["codec"] != "raw")]):
        starts = np.full(len(s["packets"]), np.nan)
        rate = struct.unpack_from("<I", s["packets"][0], 4)[0] if s["codec"] == "raw" else 0
        # A page's granule position counts the samples up to its last packet's end; earlier ends follow backwards.
        for upto, granule in s["ends"] if rate else []:
            back = granule
            for i in range(upto - 1, 0, -1):
                if not np.isnan(starts[i]):
                    break
                back -= len(s["packets"][i])
                starts[i] = back * 1000 / rate
        out += [(k, i - 1, float(starts[i]), p) for i, p in enumerate(s["packets"]) if i]
    out.sort(key=lambda x: (x[1], x[0]))
    return b"".join(x[3] for x in out if x[0] < len(raw)), out


def _demultiplexed(media: bytes) -> list[dict]:
    """Logical streams as they begin: packets (the first one tells the codec), ends (packets so far and granule position of
    each page that ends one), codec ("raw" or "other")."""
    at, streams = 0, {}
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, seq, crc, n = _PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page at a page's border")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("page checksum differs")
        if bool(flags & 2) != (serial not in streams):
            raise ValueError("a stream's first page has to say so, and no other")
        s = streams.setdefault(serial, {"seq": seq, "part": b"", "packets": [], "ends": [], "open": False})
        if seq != s["seq"] or bool(flags & 1) != s["open"]:
            raise ValueError("page lost")
        s["seq"] += 1
        pos, body, first = 0, page[27 + n :], len(s["packets"])
        parts = [s["part"]]
        for v in lacing:
            parts.append(body[pos : pos + v])
            pos += v
            if v < 255:
                s["packets"].append(b"".join(parts))
                parts = []
        s["part"] = b"".join(parts)
        s["open"] = bool(lacing) and lacing[-1] == 255
        if len(s["packets"]) > first:
            s["ends"].append((len(s["packets"]), granule))
        at = end
    for s in streams.values():
        if s["open"] or not s["packets"]:
            raise ValueError("last packet is incomplete")
        s["codec"] = "raw" if s["packets"][0][:4] == b"RAW8" and len(s["packets"][0]) == _HEAD.size + 4 else "other"
    return list(streams.values())


def features(payload: bytes, packets: list[tuple[int, int, float, bytes]]) -> str:
    """Integers only, so that equal samples give equal strings anywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = max((round(t + len(p) * 1000 / RATE) for _, _, t, p in packets if t == t), default=0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) > 1 else 0
    mean, power = (int(x.sum() * 1000 // len(x)), int((x * x).sum() * 1000 // len(x))) if len(x) else (0, 0)
    return f"packets={len(packets)};end_ms={last};mean={mean};power={power};crossings={crossings}"


def _store(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in payloads:
        yield part.map(lambda p: write(bytes(p) if p is not None else b""))


def _read_or_fault(media: bytes | None, strict: bool) -> tuple[bytes | None, list, str | None]:
    """read(), with the fault of damaged media as its third part; with strict it is raised."""
    if media is None:
        return None, [], None
    try:
        return *read(bytes(media)), None
    except ValueError as fault:
        if strict:
            raise
        return None, [], str(fault)


def ogg_media(payload: Column) -> Column:
    """The payload column as Ogg media (binary)."""
    return F.pandas_udf(_store, "binary")(payload)


def ogg_samples(media: Column, strict: bool = False) -> Column:
    """struct(payload, feature, n_packets, end_ms, error) read back from Ogg media. Damaged media give nulls and the fault
    in error, or end the job where strict; null media give nulls."""

    def load(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for m in part:
                payload, packets, fault = _read_or_fault(m, strict)
                text = features(payload, packets) if payload is not None else None
                rows.append((payload, text, len(packets) if text else None, int(text.split("end_ms=")[1].split(";")[0]) if text else None, fault))
            yield pd.DataFrame(rows, columns=["payload", "feature", "n_packets", "end_ms", "error"]).astype({"n_packets": "Int64", "end_ms": "Int64"})
        give_back()

    return F.pandas_udf(load, "payload binary, feature string, n_packets long, end_ms long, error string")(media)


def ogg_packets(df: DataFrame, media: str = "media", strict: bool = False) -> DataFrame:
    """One row per packet: the table's other columns, stream, packet, start_ms, data, under names that the table doesn't have
    (with underscores after them where it does). Damaged and null media have no rows, unless strict."""

    @F.pandas_udf("array<struct<stream:int,packet:int,start_ms:double,data:binary>>")
    def split(parts: pd.Series) -> pd.Series:
        return parts.map(lambda m: [dict(zip(("stream", "packet", "start_ms", "data"), x, strict=True)) for x in _read_or_fault(m, strict)[1]])

    rest, one = [c for c in df.columns if c != media], free(df, "packet_")
    out = df.select(*rest, F.explode(split(media)).alias(one))
    return out.select(*rest, *[F.col(one)[c].alias(free(df, c)) for c in ("stream", "packet", "start_ms", "data")])


def padded(text: Column) -> Column:
    """UTF-8 bytes with zeros up to the next positive multiple of 64; null counts as empty."""
    raw = F.coalesce(text, F.lit(""))
    n = F.octet_length(raw)
    size = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64)
    return F.concat(raw.cast("binary"), F.unhex(F.repeat(F.lit("00"), size - n)))


def op8_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    media = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), ogg_media(padded(F.col("text"))).alias("media"))
    return _digests(media)


def _digest(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "end_ms"]
    for part in media:
        rows = []
        for m in map(bytes, part):
            payload, packets = read(m)
            text = features(payload, packets)
            end = int(text.split("end_ms=")[1].split(";")[0])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), text, len(packets), end))
        yield pd.DataFrame(rows, columns=names)


def _digests(media: DataFrame) -> DataFrame:
    digest = F.pandas_udf(_digest, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, end_ms long")
    return media.select("doc_id", "n_bytes", digest("media").alias("d")).select("doc_id", "n_bytes", "d.*")
