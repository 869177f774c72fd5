"""Media columns: signature sniffing with Aho-Corasick, structural validation, corrected types and carving.

``FIXED`` below holds the public magic bytes of each format. A signature only makes a candidate: the format's validator walks
its structure (chunks, segments, headers) and gives the length, or rejects it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shared_dir, slices, written

# Media type, magic bytes, offset of the magic bytes from the start of the file.
FIXED = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"BM", 0),
    ("image/webp", b"WEBP", 8),
    ("audio/wav", b"WAVE", 8),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS", 0),
    ("video/mp4", b"ftyp", 4),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
]

RATE = 8000
UNIT = 64
_XREF = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
_TABLE = re.compile(rb"xref\s|\d+\s+\d+\s+obj")


def _png(b, at):
    end, seen = at + 8, False
    while end + 12 <= len(b):
        n = int.from_bytes(b[end : end + 4], "big")
        kind = bytes(b[end + 4 : end + 8])
        if end + 12 + n > len(b) or (kind == b"IHDR") == seen or zlib.crc32(b[end + 4 : end + 8 + n]) != int.from_bytes(b[end + 8 + n : end + 12 + n], "big"):
            return None
        seen, end = True, end + 12 + n
        if kind == b"IEND":
            return end - at
    return None


def _jpeg(b, at):
    end = at + 2
    while end + 4 <= len(b) and b[end] == 0xFF:
        mark, n = b[end + 1], int.from_bytes(b[end + 2 : end + 4], "big")
        if mark in (0xD8, 0xD9, 0x00) or n < 2:
            return None
        end += 2 + n
        if mark == 0xDA:
            while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b):
                if b[end + 1] == 0xD9:
                    return end + 2 - at
                if b[end + 1] and not 0xD0 <= b[end + 1] <= 0xD7:
                    break
                end += 2
            if end < 0:
                return None
    return None


def _gif(b, at):
    def blocks(p):
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return None
    end = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while end < len(b):
        if b[end] == 0x3B:
            return end + 1 - at
        if b[end] == 0x21:
            end = blocks(end + 2)
        elif b[end] == 0x2C and end + 10 <= len(b):
            end = blocks(end + 11 + (3 << (b[end + 9] & 7) + 1 if b[end + 9] & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b, at):
    if at + 30 > len(b):
        return None
    n, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= n <= len(b) - at and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return n if good else None


def _riff(needs):
    def check(b, at):
        if b[at : at + 4] != b"RIFF" or at + 12 > len(b):
            return None
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        p, seen = at + 12, set()
        if end > len(b):
            return None
        while p + 8 <= end:
            seen.add(bytes(b[p : p + 4]))
            n = int.from_bytes(b[p + 4 : p + 8], "little")
            p += 8 + n + n % 2
        return end - at if p in (end, end + 1) and any(s <= seen for s in needs) else None

    return check


# Block sizes and the bytes that follow a frame's number for them; bits a sample by their code.
_FLAC_BLOCK = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}
_FLAC_DEPTH = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(polynomial: int, bits: int) -> list[int]:
    table = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> bits - 1 else x << 1) & (1 << bits) - 1
        table.append(x)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


class _Bits:
    """Bits of b from byte p on."""

    def __init__(self, b, p):
        self.b, self.p, self.end = b, 8 * p, 8 * len(b)

    def take(self, n: int) -> int:
        first, last = self.p >> 3, self.p + n + 7 >> 3
        self.p += n
        if self.p > self.end:
            raise EOFError
        return int.from_bytes(self.b[first:last], "big") >> (-self.p & 7) & (1 << n) - 1

    def zeros(self) -> int:
        """The number of bits 0 before the next 1, which is taken too."""
        n = 0
        while True:
            left = min(32, self.end - self.p)
            if left <= 0:
                raise EOFError
            x = self.take(left)
            if x:
                self.p -= x.bit_length() - 1
                return n + left - x.bit_length()
            n += left


def _flac_frame(b, p, depth):
    """(end, samples) of the frame at p by its header and subframes, both crcs right; None if there is none."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] >> 1 != 0x7C:
        return None
    size, rate, channels, bits = b[p + 2] >> 4, b[p + 2] & 15, b[p + 3] >> 4, b[p + 3] >> 1 & 7
    q = p + 4 + max(1, 8 - (~b[p + 4] & 255).bit_length())  # the number is in the manner of UTF-8
    samples = _FLAC_BLOCK.get(size)
    if size in (6, 7):
        samples, q = int.from_bytes(b[q : q + size - 5], "big") + 1, q + size - 5
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if samples is None or rate == 15 or channels > 10 or bits == 3 or b[p + 3] & 1 or q >= len(b):
        return None
    crc = 0
    for x in b[p:q]:
        crc = _CRC8[crc ^ x]
    if crc != b[q]:
        return None
    depth, read = _FLAC_DEPTH.get(bits, depth), _Bits(b, q + 1)
    try:
        for c in range(channels + 1 if channels < 8 else 2):
            own = depth + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)
            head = read.take(8)
            kind = head >> 1 & 63
            if head >> 7:
                return None
            if head & 1:
                own -= read.zeros() + 1
            if kind == 0:
                read.take(own)
            elif kind == 1:
                read.p += own * samples
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                read.p += own * order
                if kind >= 32:
                    precision = read.take(4) + 1
                    read.p += 5 + precision * order
                method, parts = read.take(2), read.take(4)
                if method > 1 or samples % (1 << parts):
                    return None
                for k in range(1 << parts):
                    n, rice = (samples >> parts) - (0 if k else order), read.take(4 + method)
                    if rice == (31 if method else 15):
                        read.p += read.take(5) * n
                    else:
                        for _ in range(n):
                            read.zeros()
                            read.p += rice
            else:
                return None
    except EOFError:
        return None
    end, crc = (read.p + 7 >> 3) + 2, 0
    if end > len(b):
        return None
    for x in b[p:end]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
    return None if crc else (end, samples)


def _flac(b, at):
    p = at + 4
    while p + 4 <= len(b):
        head, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if (p == at + 4) != (head & 127 == 0) or p == at + 4 and n != 34 or p + 4 + n > len(b):
            return None
        p += 4 + n
        if head & 128:
            break
    else:
        return None
    told = int.from_bytes(b[at + 18 : at + 26], "big")  # rate, channels, bits a sample, samples (0: not known)
    depth, left, first = (told >> 36 & 31) + 1, told & (1 << 36) - 1, p
    whole = left
    while (not whole or left > 0) and (frame := _flac_frame(b, p, depth)):
        p, left = frame[0], left - frame[1]
    return p - at if p > first and (not whole or left == 0) else None


def _ogg(b, at):
    """Ends where the last of the streams ends that begin at the front; a page inside a stream begins no file."""
    p, open_, front = at, set(), True
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0 and p + 27 + b[p + 26] <= len(b):
        flags, stream, n = b[p + 5], bytes(b[p + 14 : p + 18]), b[p + 26]
        front = front and bool(flags & 2)
        if front:
            open_.add(stream)
        elif stream not in open_:
            return None
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if flags & 4:
            open_.discard(stream)
            if not open_:
                return p - at
    return None


def _ogg_pages(b, at, end):
    while at < end:
        yield at
        at += 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])


def _mp4(b, at):
    p, kinds = at, []
    while p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"wide", b"udta"):
            break
        if n == 1 and p + 16 <= len(b):
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        if n < 8 or p + n > len(b):
            return None
        kinds.append(kind)
        p += n
    return p - at if kinds[:1] == [b"ftyp"] and (b"moov" in kinds or b"moof" in kinds) else None


def _places(b, mark: bytes, memo: dict) -> list[int]:
    """Where mark stands in b; looked up once for a buffer, whose memo it is kept in."""
    if mark not in memo:
        memo[mark] = [m.start() for m in re.finditer(re.escape(mark), b)]
    return memo[mark]


def _pdf(b, at, memo):
    """Ends at the last end mark whose startxref leads to a cross-reference table of this file (one within it has its own), or
    if there is none, at the last before the next file."""
    ends, said, heads = (_places(b, x, memo) for x in (b"%%EOF", b"startxref", b"%PDF-"))
    k, j = bisect.bisect_left(ends, at), bisect.bisect_left(said, at)
    if k == len(ends) or j == len(said) or said[j] >= ends[k]:
        return None
    if "trailers" not in memo:
        found = [(m.start(), m.end(), int(m[1])) for m in _XREF.finditer(b)]
        memo["trailers"] = np.array(found, np.int64).reshape(-1, 3)
        memo["bytes"] = np.append(np.frombuffer(b, np.uint8), np.uint8(0))
    own = memo["trailers"][np.searchsorted(memo["trailers"][:, 0], at) :]
    first = memo["bytes"][np.minimum(at + own[:, 2], len(b))]  # a table begins with a figure or the x of xref
    for i in np.flatnonzero((first == ord("x")) | (first >= ord("0")) & (first <= ord("9")))[::-1].tolist():
        if _TABLE.match(b, at + int(own[i, 2])):
            return int(own[i, 1]) - at
    following = bisect.bisect_left(heads, ends[k])
    last = bisect.bisect_left(ends, heads[following]) if following < len(heads) else len(ends)
    return ends[last - 1] + 5 - at


def _zip(b, at, memo):
    """Ends with the end-of-directory record that fits the start; those of files stored within don't."""
    if "zips" not in memo:
        memo["zips"] = {}
        for end in _places(b, b"PK\x05\x06", memo):
            if end <= len(b) - 22:
                n, size, start = struct.unpack_from("<HII", b, end + 10)
                whole = end + 22 + int.from_bytes(b[end + 20 : end + 22], "little")
                if whole <= len(b) and (not n or size <= end and b[end - size : end - size + 4] == b"PK\x01\x02"):
                    memo["zips"].setdefault(end - size - start, whole)
    whole = memo["zips"].get(at)
    return whole - at if whole else None


def _gzip(b, at):
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                part = b[p : p + 65536]
                p += len(part)
            if not part:
                return None
            d.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return p - len(d.unused_data) - at


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp,
    "image/webp": _riff([{b"VP8 "}, {b"VP8L"}, {b"VP8X"}]), "audio/wav": _riff([{b"fmt ", b"data"}]),
    "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4, "application/gzip": _gzip,
}
#: Validators that look for marks of the whole buffer, which are listed once.
LISTED = {"application/pdf": _pdf, "application/zip": _zip}


class Sniffer:
    """Finds, checks and carves media in byte strings."""

    def __init__(self):
        self.magic = ahocorasick.Automaton()
        for kind, magic, offset in FIXED:
            self.magic.add_word(magic.decode("latin-1"), (kind, offset + len(magic) - 1))
        self.magic.make_automaton()

    def __call__(self, data: bytes) -> list[tuple[str, int, int, int | None]]:
        """(type, start, length, within) of each medium that is valid, by start; those within another are found too, whole in
        its bytes, and ``within`` is the start of the innermost that holds it (None: none)."""
        found, around = [], [(None, None, len(data), data, 0, {})]  # with the bytes of the medium, where they begin, what is listed of them
        for at, kind in sorted({(end - back, kind) for end, (kind, back) in self.magic.iter(data.decode("latin-1"))}):
            if at < 0:
                continue
            while len(around) > 1 and at >= around[-1][2]:
                around.pop()
            outer, start, end, own, base, memo = around[-1]
            if outer == kind == "audio/ogg":
                if "pages" not in memo:
                    memo["pages"] = set(_ogg_pages(own, 0, len(own)))
                if at - base in memo["pages"]:
                    continue
            n = LISTED[kind](own, at - base, memo) if kind in LISTED else VALIDATORS[kind](own, at - base)
            if n:
                found.append((kind, at, n, start))
                around.append((kind, at, at + n, data[at : at + n], at, {}))
        return found


def sniff(media: DataFrame, column: str = "media", declared: str = "declared") -> DataFrame:
    """media with what its binary column holds, beside its other columns: detected (type of the medium at byte 0, null if
    none is valid), corrected (detected, else application/octet-stream), mismatch (declared differs), embedded (array of
    type, start, length, within of the media that start later, whole in the bytes; within: the start of the innermost medium
    around, null if none). Null or empty bytes hold nothing.
    """
    names = media.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("within", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Sniffer()
        for batch in slices(batches, column):
            found = [look(b or b"") for b in batch.column(names.index(column)).to_pylist()]
            first = [next((k for k, at, *_ in own if at == 0), None) for own in found]
            fixed = [k or "application/octet-stream" for k in first]
            said = batch.column(names.index(declared)).to_pylist() if declared in names else fixed
            rest = [[dict(zip(("type", "start", "length", "within"), x)) for x in own if x[1]] for own in found]
            new = [pa.array(first, pa.string()), pa.array(fixed, pa.string()), pa.array([a != b for a, b in zip(fixed, said)], pa.bool_()), pa.array(rest, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "detected", "corrected", "mismatch", "embedded"])

    return media.mapInArrow(run, f"{schema}, detected string, corrected string, mismatch boolean, embedded array<struct<type: string, start: long, length: long, within: long>>")


def carve(sniffed: DataFrame, column: str = "media") -> DataFrame:
    """One row per embedded medium of sniff()'s rows: their other columns, type, and the bytes as column."""
    rest = [c for c in sniffed.columns if c not in (column, "embedded", "detected", "corrected", "mismatch")]
    cut = F.expr(f"substring(`{column}`, CAST(e.start + 1 AS INT), CAST(e.length AS INT))")
    return sniffed.withColumn("e", F.explode("embedded")).select(*rest, F.col("e.type").alias("type"), cut.alias(column))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(data):
        n = int.from_bytes(data[p + 4 : p + 8], "little")
        if data[p : p + 4] == b"data":
            return bytes(data[p + 8 : p + 8 + n])
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's UTF-8 bytes (null: none), filled with bytes 0 to a positive multiple of
    64, as a WAV file of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            media = [wav(r + b"\0" * (-len(r) % UNIT or UNIT * (not r))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def features(sniffed: DataFrame) -> DataFrame:
    """Features of stored audio/wav media: lengths, hashes and a text of sample statistics and of what is carved: how many
    media, and of each its type, start and length in the stored bytes, and crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, kind, inner in zip(*(batch.column(c).to_pylist() for c in ("media", "corrected", "embedded"))):
                if kind != "audio/wav":
                    raise ValueError(f"stored media read back as {kind}")
                payload = wav_samples(media)
                x = np.frombuffer(payload, np.uint8)
                level = x.astype(np.float32) - 128
                crossed = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                said = f"{kind};rate={RATE};samples={len(x)};mean={level.mean(dtype=np.float64):.4f};rms={np.sqrt((level * level).mean(dtype=np.float64)):.4f};crossings={crossed};embedded={len(inner)}"
                said += "".join(f";{e['type']}@{e['start']}+{e['length']}:{zlib.crc32(media[e['start'] : e['start'] + e['length']]):08x}" for e in inner)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return sniffed.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_media(docs: DataFrame) -> DataFrame:
    """Stores each text of docs as a medium in the shared folder, reads the table back, sniffs and measures it.

    A null text counts as empty, which is stored as 64 bytes 0; equal texts give equal values; a null doc_id stays null and
    rows that repeat a doc_id stay; an empty table gives an empty result; other columns of docs are not read.
    """
    shared_dir(docs.sparkSession)
    return features(sniff(written(text_media(docs), "media")))


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    return stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
