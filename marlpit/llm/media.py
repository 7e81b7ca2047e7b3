"""Media columns: signature sniffing with validation, type correction and carving.

An Aho-Corasick automaton over the magic strings of common formats runs once over a
blob's bytes. A hit counts only if the format's validator can walk the structure from
there and says where it ends: chunk lengths, checksums and end marks must agree. The
first valid hit at the front gives the blob's true type, which corrects a declared one;
every other valid hit outside an earlier one is embedded media and can be carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import arrow_slices, modest_batches, worker_state

# Fixed values: (format, offset of the magic in the file, magic bytes).
MAGIC: list[tuple[str, int, bytes]] = [
    ("audio/wav", 0, b"RIFF"),
    ("image/png", 0, b"\x89PNG\r\n\x1a\n"),
    ("image/gif", 0, b"GIF87a"),
    ("image/gif", 0, b"GIF89a"),
    ("image/jpeg", 0, b"\xff\xd8\xff"),
    ("image/bmp", 0, b"BM"),
    ("image/x-portable-graymap", 0, b"P5\n"),
    ("application/gzip", 0, b"\x1f\x8b\x08"),
    ("application/pdf", 0, b"%PDF-"),
    ("application/zip", 0, b"PK\x03\x04"),
    ("audio/ogg", 0, b"OggS"),
    ("audio/flac", 0, b"fLaC"),
    ("video/mp4", 4, b"ftyp"),
]
RATE = 8000


def wav_8bit(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as the samples of a mono 8-bit PCM wave file; the samples are padded to even length as RIFF asks."""
    pad = b"\0" * (len(payload) & 1)
    head = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI", b"RIFF", len(head) + len(payload) + len(pad)) + head + payload + pad


def wav_samples(blob: bytes) -> bytes:
    """The samples of a wave file, from its data chunk."""
    at, end = 12, 8 + struct.unpack_from("<I", blob, 4)[0]
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", blob, at)
        if name == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if name == b"fmt ":
            if size < 16:
                return None
            _, channels, _, _, align, bits = struct.unpack_from("<HHIIHH", b, pos + 8)
            if not channels or align != channels * ((bits + 7) // 8):
                return None
        seen.add(name)
        pos += 8 + size + (size & 1)
    return end if {b"fmt ", b"data"} <= seen and pos in (end, end + 1) else None


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 11 <= len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 if scanned else None
        if not 0xC0 <= mark <= 0xFE:
            return None
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            scanned = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
    return pos + 2 if scanned and b[pos : pos + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 26:
        return None
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not spare and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(b) else None


def _pgm(b: bytes, at: int) -> int | None:
    if (m := re.compile(rb"P5\n(\d{1,9}) (\d{1,9})\n255\n").match(b, at)) is None:
        return None
    end = m.end() + int(m[1]) * int(m[2])
    return end if m.end() < end <= len(b) else None


def _gzip(b: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):
            unpack.decompress(b[i : i + (1 << 16)])
            if unpack.eof:
                return min(len(b), i + (1 << 16)) - len(unpack.unused_data)
    except zlib.error:
        pass
    return None


class Blob(bytes):
    """Bytes that remember where a mark occurs, so that many hits in one blob don't search it again and again."""

    def __init__(self, *_: object):
        self.found: dict[bytes, list[int]] = {}
        self.archives: dict[int, int] | None = None
        self.chains: dict[int, int | None] = {}

    def where(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        return self.found[mark]

    def last(self, mark: bytes, start: int, end: int) -> int:
        """The last place of the mark between two places, -1 without one."""
        at = bisect_left(self.where(mark), end) - 1
        return self.where(mark)[at] if at >= 0 and self.where(mark)[at] > start else -1


def _pdf(b: Blob, at: int) -> int | None:
    """Up to the last end mark before the next header: files may have been saved in several sections, each with a mark."""
    if not re.compile(rb"%PDF-\d\.\d").match(b, at):
        return None
    heads = b.where(b"%PDF-")
    after = bisect_right(heads, at)
    end = b.last(b"%%EOF", at, heads[after] if after < len(heads) else len(b))
    return end + 5 if end > 0 and b.last(b"startxref", at, end) > 0 else None


def _zip(b: Blob, at: int) -> int | None:
    """Each end record says where its directory and so its archive begins; the last one that begins here counts."""
    if b.archives is None:
        b.archives = {}
        for end in b.where(b"PK\x05\x06"):
            if len(b) >= end + 22:
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                first = end - size - start
                if first >= 0 and b[first + start : first + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                    b.archives[first] = end + 22 + note
    return b.archives.get(at)


def _ogg(b: Blob, at: int) -> int | None:
    """Pages up to where they stop, the last of them an end page. A page's end of stream holds for all pages of its chain, so it is kept."""
    chain, pos, last, end = [], at, 0, None
    while b[pos : pos + 4] == b"OggS" and len(b) >= pos + 27 and b[pos + 4] == 0:
        if pos in b.chains:
            end = b.chains[pos]
            break
        chain.append(pos)
        n = b[pos + 26]
        body = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if body > len(b):
            last = 0
            break
        last, pos = b[pos + 5] & 4, body
    else:
        end = pos if last else None
    b.chains.update(dict.fromkeys(chain, end))
    return end


def _flac(b: bytes, at: int) -> int | None:
    """A stream has no length: valid if its metadata blocks chain, then it runs to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first != (kind == 0) or (first and size != 34):
            return None
        last, pos, first = b[pos] & 0x80, pos + 4 + size, False
        if last:
            return len(b) if pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xFC == 0xF8 else None
    return None


def _mp4(b: bytes, at: int) -> int | None:
    if at < 0:
        return None
    pos, seen = at, set()
    while pos + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if size < 8 or pos + size > len(b) or not name.isalnum():
            break
        seen.add(name)
        pos += size
    return pos if b"ftyp" in seen and b"moov" in seen else None


VALIDATORS: dict[str, Callable[[Blob, int], int | None]] = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/x-portable-graymap": _pgm,
    "application/gzip": _gzip, "application/pdf": _pdf, "application/zip": _zip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}


class Sniffer:
    """Finds the valid media in a blob."""

    def __init__(self) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        grouped: dict[bytes, list[tuple[str, int]]] = {}
        for kind, offset, magic in MAGIC:
            grouped.setdefault(magic, []).append((kind, offset))
        for magic, kinds in grouped.items():
            self.find.add_word(magic.decode("latin-1"), (len(magic), kinds))
        self.find.make_automaton()

    def media(self, blob: bytes) -> list[tuple[str, int, int]]:
        """(type, start, end) of the outermost valid media, by start; a hit inside an earlier valid one is part of it."""
        found, until, blob = [], 0, Blob(blob)
        hits = sorted((end + 1 - size - offset, kind) for end, (size, kinds) in self.find.iter(blob.decode("latin-1")) for kind, offset in kinds)
        for at, kind in hits:
            if at >= until and (end := VALIDATORS[kind](blob, at)) is not None:
                found.append((kind, at, end))
                until = end
        return found


SNIFFED = "detected string, corrected boolean, media array<struct<type:string,start:long,end:long>>"


def sniff(blobs: DataFrame, id_column: str, blob_column: str, declared_column: str | None = None, carve: bool = False) -> DataFrame:
    """For each blob: id, declared, detected, corrected, media (type, start, end) and, with ``carve``, the embedded media's bytes.

    ``detected`` is the type of valid media that starts the blob, else ``application/octet-stream``
    if something is embedded later or nothing is found. ``corrected`` tells that a declared
    type differs. A null blob counts as empty; a null declared type is never corrected.
    Only the named columns are read. Rows are independent, so nothing is shuffled.
    """
    kind = blobs.schema[id_column].dataType.simpleString()
    declared = F.col(declared_column) if declared_column else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = worker_state(Sniffer)
        for part in arrow_slices(batches, "blob", 512, 4 << 20):
            detected, corrected, media, carved = [], [], [], []
            for blob, said in zip(part.column("blob").to_pylist(), part.column("declared").to_pylist(), strict=True):
                blob = blob or b""
                found = sniffer.media(blob)
                true = found[0][0] if found and found[0][1] == 0 else "application/octet-stream"
                detected.append(true)
                corrected.append(said is not None and said != true)
                media.append([{"type": k, "start": s, "end": e} for k, s, e in found])
                carved.append([blob[s:e] for _, s, e in found if s] if carve else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("declared"), pa.array(detected, pa.string()), pa.array(corrected, pa.bool_()),
                 pa.array(media, pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), pa.array(carved, pa.list_(pa.binary()))],
                names=["id", "declared", "detected", "corrected", "media", "carved"],
            )

    out = blobs.select(F.col(id_column).alias("id"), F.col(blob_column).cast("binary").alias("blob"), declared.alias("declared")).mapInArrow(run, f"id {kind}, declared string, {SNIFFED}, carved array<binary>")
    return out.withColumnRenamed("id", id_column)


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = 64, declared: str = "text/plain") -> DataFrame:
    """Store each text as 8-bit samples, find it again by sniffing the stored bytes and describe what was read back.

    The payload is the text's UTF-8, filled with bytes 0 up to a positive multiple of
    ``block``; a null text counts as empty. The column's ``declared`` type is what a table of texts
    would say of the stored form; the validated signature corrects it, and a stored form that fails
    its validator raises. Media embedded in the payload are carved: ``carved`` lists type, length and
    SHA-256 of each. Equal texts give equal rows; only the two named columns are read, and an empty
    table gives no rows. A text of any length is one blob.
    """
    modest_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = worker_state(Sniffer)
        for part in arrow_slices(batches, "text", 512, 4 << 20):
            cols: list[list] = [[] for _ in range(10)]
            for text in part.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                stored = wav_8bit(raw + b"\0" * (max(block, -(-len(raw) // block) * block) - len(raw)))
                found = sniffer.media(stored)
                if not found or found[0][:2] != ("audio/wav", 0) or found[0][2] != len(stored):
                    raise ValueError("the stored form is no valid wave file")
                back = wav_samples(stored)
                inner = sniffer.media(back)
                counts = ",".join(f"{k}@{s}+{e - s}" for k, s, e in inner)
                feature = f"audio/wav;8bit;mono;{RATE}Hz;samples={len(back)};rms={_rms(back):.3f};zero={back.count(0)};embedded={counts or 'none'}"
                cut = [f"{k};{e - s};{hashlib.sha256(back[s:e]).hexdigest()}" for k, s, e in inner]
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, found[0][0], found[0][0] != declared, cut)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected", "carved"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean, carved array<string>")
    return out.withColumnRenamed("id", id_column)


def _rms(samples: bytes) -> float:
    """Loudness of 8-bit samples around their middle, 128."""
    import numpy as np

    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return float(np.sqrt(np.dot(wave, wave) / len(wave)))
