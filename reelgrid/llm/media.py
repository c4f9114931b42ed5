"""Media columns typed by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the bytes. Each hit is
put to the validator of its format, which checks the structure and returns the true length. What
stands at offset 0 corrects the declared type; what stands further in is carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

BLOCK = 64

# Magic bytes of each format, and how far into the file they stand.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "audio/wav": (b"WAVEfmt ", 8),
    "image/webp": (b"WEBPVP8", 8),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/pdf": (b"%PDF-", 0),
    "video/mp4": (b"ftyp", 4),
}


# Marks that end a file or lead to its end.
ENDS = ("PK\x05\x06", "%%EOF", "startxref")


def _color_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


class Places:
    """Where marks stand in a file, ascending, and what they lead to.

    Ends of archives and of GIF block chains are found once for all starts, so that a file made of
    nothing but marks still takes time linear in its size.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.marks = {kind: [] for kind in (*MAGIC, *ENDS)}
        for end, (kind, back) in _automaton().iter(data.decode("latin-1")):
            self.marks[kind].append(end - back)

    @cached_property
    def archives(self) -> dict[int, int]:
        """Length of the archive by its start. An end record names the directory's size and place, and so the start."""
        data, out = self.data, {}
        for p in self.marks[ENDS[0]]:
            if p + 22 > len(data):
                break
            size, offset, comment = struct.unpack_from("<IIH", data, p + 12)
            start = p - size - offset
            if start >= 0 and data[start + offset : start + offset + 4] == b"PK\x01\x02" and p + 22 + comment <= len(data):
                out.setdefault(start, p + 22 + comment - start)
        return out

    @cached_property
    def _known(self) -> tuple[memoryview, memoryview]:
        """By place: end of the GIF whose block starts there (-1: none), end of the sub-block chain; 0: not known."""
        return tuple(memoryview(bytearray(4 * len(self.data) + 4)).cast("i") for _ in range(2))

    def _chain_end(self, p: int) -> int:
        data, known, path = self.data, self._known[1], []
        while p < len(data) and data[p] and not known[p]:
            path.append(p)
            p += data[p] + 1
        end = len(data) if p >= len(data) else known[p] or p
        for q in path:
            known[q] = end
        return end

    def gif_end(self, p: int) -> int:
        """Where the GIF ends whose next block starts at ``p``; -1 if it does not."""
        data, known, path, end = self.data, self._known[0], [], -1
        while p < len(data):
            if known[p]:
                end = known[p]
                break
            path.append(p)
            if data[p] == 0x3B:
                end = p + 1
                break
            if data[p] == 0x2C and p + 10 < len(data):
                p = self._chain_end(p + 11 + _color_table(data[p + 9])) + 1
            elif data[p] == 0x21:
                p = self._chain_end(p + 2) + 1
            else:
                break
        for q in path:
            known[q] = end
        return end


def _png(data: bytes, at: int, places: Places) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, p)
        end = p + 12 + size
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[p + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return None


def _jpeg(data: bytes, at: int, places: Places) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF:
        mark = data[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        size = int.from_bytes(data[p + 2 : p + 4], "big")
        if mark < 0xC0 or size < 2 or 0xD0 <= mark <= 0xD9:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is no restart or stuffing
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(data):
                return None
            if data[p + 1] == 0xD9:
                return p + 2 - at if frame else None
    return None


def _gif(data: bytes, at: int, places: Places) -> int | None:
    if data[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(data):
        return None
    end = places.gif_end(at + 13 + _color_table(data[at + 10]))
    return end - at if end > 0 else None


def _bmp(data: bytes, at: int, places: Places) -> int | None:
    if at + 54 > len(data):
        return None
    size, reserved, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    fits = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    fits = fits and 14 + header <= start <= size and width > 0 and height != 0
    packed = fits and struct.unpack_from("<I", data, at + 30)[0] not in (0, 3)
    return size if fits and (packed or start + rows <= size) and at + size <= len(data) else None


def _riff(data: bytes, at: int, places: Places) -> int | None:
    if data[at : at + 4] != b"RIFF" or at + 12 > len(data):
        return None
    end, p, chunks = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12, []
    if end > len(data):
        return None
    while p + 8 <= end:
        size = int.from_bytes(data[p + 4 : p + 8], "little")
        chunks.append(data[p : p + 4])
        p += 8 + size + (size & 1)
    wanted = b"data" if data[at + 8 : at + 12] == b"WAVE" else b"VP8"
    return end - at if p in (end, end + 1) and any(c.startswith(wanted) for c in chunks) else None


def _gzip(data: bytes, at: int, places: Places) -> int | None:
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        for p in range(at, len(data), 1 << 16):
            piece = data[p : p + (1 << 16)]
            inflate.decompress(piece)
            if inflate.eof:
                return p + len(piece) - len(inflate.unused_data) - at
    except zlib.error:
        pass
    return None


def _zip(data: bytes, at: int, places: Places) -> int | None:
    return places.archives.get(at)


def _pdf(data: bytes, at: int, places: Places) -> int | None:
    if not data[at + 5 : at + 6].isdigit():
        return None
    ends, tables, heads = (places.marks[k] for k in ("%%EOF", "startxref", "application/pdf"))
    first, table, later = bisect_left(ends, at), bisect_left(tables, at), bisect_left(heads, at + 5)
    if first == len(ends) or table == len(tables) or tables[table] + 9 > ends[first]:
        return None
    # The last end mark before the next document counts.
    stop = heads[later] if later < len(heads) and heads[later] > ends[first] else len(data)
    return ends[bisect_right(ends, stop - 5) - 1] + 5 - at


def _mp4(data: bytes, at: int, places: Places) -> int | None:
    p, kinds = at, []
    while p + 8 <= len(data):
        size, kind = int.from_bytes(data[p : p + 4], "big"), data[p + 4 : p + 8]
        head = 8
        if size == 1:
            size, head = int.from_bytes(data[p + 8 : p + 16], "big"), 16
        if size < head or p + size > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        p += size
    return p - at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff,
    "image/webp": _riff, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf, "video/mp4": _mp4,
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (magic, before) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, before + len(magic) - 1))
    for mark in ENDS:
        found.add_word(mark, (mark, len(mark) - 1))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Validated media in the bytes: (start, length, type), leftmost first, none inside another."""
    places, out, free = Places(data), [], 0
    for start, kind in sorted((start, kind) for kind in MAGIC for start in places.marks[kind]):
        if start >= free and (size := VALIDATORS[kind](data, start, places)) is not None:
            out.append((start, size, kind))
            free = start + size
    return out


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Lossless mono audio of 8-bit samples; an odd number of bytes is padded as RIFF asks."""
    pad = b"\0" * (len(payload) & 1)
    form = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(form) + len(payload) + len(pad)) + b"WAVE" + form + payload + pad


def from_wav(data: bytes) -> bytes | None:
    """The samples of the data chunk; None without one."""
    p = 12
    while p + 8 <= len(data):
        size = int.from_bytes(data[p + 4 : p + 8], "little")
        if data[p : p + 4] == b"data":
            return data[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    return None


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * ((-len(raw)) % BLOCK if raw else BLOCK)


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as a media column: ``doc_id, n_bytes, declared, media``.

    A text's UTF-8 bytes (none if null), with zeros up to a positive multiple of 64, are the 8-bit
    samples of a WAV file. ``declared`` is the type a careless source would give. One row per input
    row, repeated rows included; a null id stays null; other columns are left out. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([to_wav(padded(r)) for r in raw], pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def correct_types(df: DataFrame, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sniffed types of a media column: columns of ``keep``, then ``declared, media_type, corrected, media, found``.

    ``media_type`` is the validated type at offset 0, else the declared one; ``corrected`` says
    whether they differ; ``found`` lists (start, length, media_type) of everything validated, so
    embedded media can be carved with ``carve``. Null media has the declared type and nothing found.
    """
    rows = pick(df, **{k: k for k in keep}, declared=declared_col, media=media_col)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            declared = part.column("declared").to_pylist()
            found = [sniff(m) if m else [] for m in part.column("media").to_pylist()]
            types = [f[0][2] if f and f[0][0] == 0 else d for f, d in zip(found, declared)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(k) for k in keep], part.column("declared"), pa.array(types, pa.string()),
                    pa.array([t != d for t, d in zip(types, declared)]), part.column("media"),
                    pa.array([[{"start": s, "length": n, "media_type": k} for s, n, k in f] for f in found], spans),
                ],
                [*keep, "declared", "media_type", "corrected", "media", "found"],
            )

    return rows.mapInArrow(run, f"{kept}declared string, media_type string, corrected boolean, media binary, found array<struct<start:bigint,length:bigint,media_type:string>>")


def carve(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per embedded medium (not at offset 0) of ``correct_types``: ``keep``, start, media_type, media.

    Null media, and media with nothing inside, give no row; repeated rows give repeated media; other columns are left out.
    """
    return df.selectExpr(*keep, "media AS _whole", "inline(found)").filter("start > 0").selectExpr(
        *keep, "start", "media_type", "substring(_whole, CAST(start + 1 AS INT), CAST(length AS INT)) AS media"
    )


def audio_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Read the stored WAV bytes back: ``keep``, then payload and media sizes and hashes, and ``feature``.

    ``feature`` holds the sniffed type, whether the declared type was corrected, the number of media
    inside the samples or behind the audio, and of the samples the count, mean absolute level, peak and zero crossings around 128.
    Null media, and media without a data chunk, have nulls for all of them; no samples have level, peak and
    crossings 0. One row per input row, repeated rows included; an empty table gives an empty one.
    """
    rows = pick(df, **{k: k for k in keep}, media="media", media_type="media_type", corrected="corrected", found="found")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)

    def row(media: bytes | None, kind: str, corrected: bool, found: list | None) -> tuple:
        payload = from_wav(media) if media else None
        if payload is None:
            return (None,) * 6
        level = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
        mean = int(np.abs(level).sum(dtype=np.int64)) * 1000 // max(len(level), 1)
        crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
        feature = f"type={kind};corrected={int(corrected)};embedded={len(sniff(payload)) + sum(f['start'] > 0 for f in found or [])};samples={len(level)};level={mean};peak={int(np.abs(level).max(initial=0))};crossings={crossings}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            made = [row(*r) for r in zip(*(part.column(c).to_pylist() for c in ("media", "media_type", "corrected", "found")))]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in keep], *[pa.array(c, t) for c, t in zip(zip(*made), types)]],
                [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return rows.mapInArrow(run, f"{kept}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
