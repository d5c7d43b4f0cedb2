"""Media columns: texts stored as 8-bit sound, and signature sniffing of any bytes.

``store_texts`` pads a text's UTF-8 bytes with zeros to a positive multiple of 64 and writes them as
samples of a WAV file. ``sniff`` finds magic bytes with an Aho-Corasick automaton in one pass over the
bytes, confirms each hit by a validator of that format's structure and lengths, corrects the declared
type by the format that spans the whole, and carves media embedded behind the start. The stored
samples are read back from the place where the validator found them.

Cases: a null text is empty and is stored as 64 zero bytes; null media has no bytes and the type
application/octet-stream; equal bytes give equal results; rows are independent, so repeated rows and
hot groups need nothing; long texts are handled in bounded slices; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import only, slices, text_bytes

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


def wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file with ``payload`` as samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def _png(b: memoryview, i: int) -> int:
    at = i + 8
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (at == i + 8) != (kind == b"IHDR"):
            return 0
        if kind == b"IEND":
            return end - i
        at = end
    return 0


def _gif(b: memoryview, i: int) -> int:
    if i + 13 > len(b):
        return 0
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            at = blocks(at + 10 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: memoryview, i: int) -> int:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2 - i
        at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        if kind == 0xDA:
            while at + 1 < len(b) and not (b[at] == 0xFF and b[at + 1] not in (0, *range(0xD0, 0xD8))):
                at += 1
    return at + 2 - i if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] == 0xD9 else 0


def _bmp(b: memoryview, i: int) -> int:
    if i + 18 > len(b):
        return 0
    n, zero, start, head = struct.unpack_from("<IIII", b, i + 2)
    return n if not zero and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start < n <= len(b) - i else 0


def _riff(form: bytes, needs: tuple[bytes, ...]) -> Callable[[memoryview, int], int]:
    def check(b: memoryview, i: int) -> int:
        if i + 12 > len(b) or bytes(b[i + 8 : i + 12]) != form:
            return 0
        end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
        at, seen = i + 12, set()
        while at + 8 <= min(end, len(b)):
            seen.add(bytes(b[at : at + 4]))
            at += 8 + (n := struct.unpack_from("<I", b, at + 4)[0]) + n % 2
        return end - i if at == end <= len(b) and (not needs or seen & set(needs)) else 0

    return check


class _Seen:
    """What validators found out about one buffer, so that its next hits needn't look again."""

    view: memoryview | None = None
    places: dict = {}
    chains: dict = {}

    @classmethod
    def of(cls, b: memoryview) -> type[_Seen]:
        if cls.view is not b:
            cls.view, cls.places, cls.chains = b, {}, {}
        return cls


def _after(b: memoryview, pattern: re.Pattern, at: int) -> tuple[int, int, bytes] | None:
    """Start, end and first group of the first match of ``pattern`` that begins at ``at`` or behind; all are looked for once."""
    seen = _Seen.of(b).places
    if pattern not in seen:
        seen[pattern] = [(m.start(), m.end(), m[1]) for m in pattern.finditer(b)]
    found = seen[pattern]
    k = bisect.bisect_left(found, (at,))
    return found[k] if k < len(found) else None


#: The end of a PDF's part: where its cross-reference table is, counted from the start of the PDF.
_PDF_END = re.compile(rb"startxref\s+([0-9]{1,10})\s+%%EOF")
_PDF_OBJECT = re.compile(rb"[0-9]{1,10}\s+[0-9]{1,5}\s+obj")


def _pdf(b: memoryview, i: int) -> int:
    """Up to the last of the ends whose tables lie in the PDF, which follow each other as it was changed."""
    out, at = 0, i + 5
    while m := _after(b, _PDF_END, at):
        start, end, x = m[0], m[1], i + int(m[2])
        # a table is named so or is an object
        if not i < x < start or not (bytes(b[x : x + 4]) == b"xref" or _PDF_OBJECT.match(b, x)):
            break
        out, at = end - i, end
    return out


def _gzip(b: memoryview, i: int) -> int:
    z, at = zlib.decompressobj(31), i
    try:
        while not z.eof:
            rest = z.unconsumed_tail or bytes(b[at : at + 65536])
            at += 0 if z.unconsumed_tail else len(rest)
            if not rest:
                return 0
            z.decompress(rest, 1 << 20)
    except zlib.error:
        return 0
    return at - len(z.unused_data) - i


_ZIP_NEXT = re.compile(rb"(PK(?:\x03\x04|\x01\x02))")


def _zip(b: memoryview, i: int) -> int:
    """Local entries one after another, then the directory and its end, which tell their own lengths."""
    chains, path, at = _Seen.of(b).chains, [], i
    while at not in chains and at + 30 <= len(b) and bytes(b[at : at + 4]) == b"PK\3\4":
        path.append(at)
        flags, size = struct.unpack_from("<H", b, at + 6)[0], struct.unpack_from("<I", b, at + 18)[0]
        name, more = struct.unpack_from("<HH", b, at + 26)
        if flags & 8 and not size:  # the length follows the data, so the next signature is looked for
            m = _after(b, _ZIP_NEXT, at + 30 + name + more)
            at = m[0] if m else len(b)
        else:
            at += 30 + name + more + size
    begin = chains.get(at, at)
    chains |= dict.fromkeys(path, begin)
    at = begin
    while at + 46 <= len(b) and bytes(b[at : at + 4]) == b"PK\1\2":
        at += 46 + sum(struct.unpack_from("<HHH", b, at + 28))
    if at + 22 > len(b) or bytes(b[at : at + 4]) != b"PK\5\6":
        return 0
    size, start, note = struct.unpack_from("<IIH", b, at + 12)
    return at + 22 + note - i if start == begin - i and size == at - begin and at + 22 + note <= len(b) else 0


def _ogg(b: memoryview, i: int) -> int:
    at = i
    while at + 27 <= len(b) and bytes(b[at : at + 5]) == b"OggS\0":
        last, n = b[at + 5] & 4, b[at + 26]
        if at + 27 + n > len(b):
            return 0
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
        if last:
            return at - i
    return 0


#: Magic bytes, where they stand in the file, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[memoryview, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE", (b"data",))),
    (b"RIFF", "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", "video/avi", _riff(b"AVI ", (b"LIST",))),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\3\4", "application/zip", _zip),
    (b"OggS\0", "audio/ogg", _ogg),
)


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in {m for m, _, _ in FORMATS}:
        a.add_word(magic.decode("latin-1"), (len(magic), [(kind, f) for m, kind, f in FORMATS if m == magic]))
    a.make_automaton()
    return a


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of each confirmed medium, by start; what lies inside another found medium but the first is left out."""
    found, view, free = [], memoryview(data), 0
    for end, (n, kinds) in _automaton().iter(data.decode("latin-1")):
        start = end - n + 1
        if start < free:
            continue
        for kind, validate in kinds:
            if length := validate(view, start):
                found.append((start, length, kind))
                free = start + length if start else 0
                break
    return found


def samples(data: bytes) -> tuple[int, int]:
    """Start and length of a confirmed WAV file's samples."""
    at = 12
    while data[at : at + 4] != b"data":
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + n % 2
    return at + 8, struct.unpack_from("<I", data, at + 4)[0]


def store_texts(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text as a WAV file, declared as of an unknown type."""
    rows = only(docs, doc_id="long", text="string")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 16 << 20):
            raw, at = text_bytes(part.column(1))
            data = raw.tobytes()
            media = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                n = max(UNIT, (b - a + UNIT - 1) // UNIT * UNIT)
                media.append(wav(data[a:b].ljust(n, b"\0")))
            yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(put, "doc_id long, n_bytes long, media binary").withColumn("declared", F.lit(declared))


def sniff(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media, declared) with what its bytes are.

    type: of the medium that spans all bytes, else unknown; corrected: it differs from the declared
    one; embedded: array of (start, length, type, content) carved from behind the start; payload: the
    samples of a WAV file, else the bytes themselves.
    """
    rows = only(media, doc_id="long", n_bytes="long", media="binary", declared="string")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 8 << 20):
            kinds, embedded, payload = [], [], []
            for data in part.column(2).to_pylist():
                data = data or b""
                found = find_media(data)
                whole = next((k for s, n, k in found if s == 0 and n == len(data)), UNKNOWN)
                start, n = samples(data) if whole == "audio/wav" else (0, len(data))
                kinds.append(whole)
                embedded.append([{"start": s, "length": k, "type": t, "content": data[s : s + k]} for s, k, t in found if s])
                payload.append(data[start : start + n])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))
            corrected = pa.array([a != b for a, b in zip(kinds, part.column(3).to_pylist())])
            yield pa.record_batch(
                [part.column(0), part.column(1), part.column(2), pa.array(kinds), corrected, pa.array(embedded, kind), pa.array(payload, pa.binary())],
                ["doc_id", "n_bytes", "media", "type", "corrected", "embedded", "payload"],
            )

    return rows.mapInArrow(
        look, "doc_id long, n_bytes long, media binary, type string, corrected boolean, embedded array<struct<start:bigint,length:bigint,type:string,content:binary>>, payload binary"
    )


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns from ``sniff``."""
    carved = F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["length"].cast("string"))), ",")
    n = F.octet_length("payload")
    return found.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.greatest(n - 63, F.lit(1)), F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("type"), F.lit(";corrected="), F.col("corrected").cast("string"), F.lit(";embedded="), carved).alias("feature"),
    )
