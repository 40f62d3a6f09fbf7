"""Archives as rows of bytes: a walk along the central directory with a checksum of every member, and removal of macros.

Members are found by the directory's records and read at the places these name; nothing is unpacked as a whole. A member that is taken out leaves the others' bytes as they
are: their places and the directory's are counted anew.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signatures and layouts of the records that end a directory, stand in it, and begin a member; methods of members.
END, ENTRY, MEMBER = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, ENTRY_LAYOUT, MEMBER_LAYOUT = "<4s4H2IH", "<4s6H3I5H2I", "<4s5H3I2H"
STORED, DEFLATED = 0, 8
# The member that holds macros, the one that lists kinds of content, and kinds with macros beside those without.
MACROS, KINDS = "vbaproject.bin", "[Content_Types].xml"
PLAIN_KINDS = (
    (b"application/vnd.ms-word.document.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"),
    (b"application/vnd.ms-excel.sheet.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"),
    (b"application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"),
)
#: Bytes that are unpacked at once.
PIECE = 1 << 20


class Broken(ValueError):
    """What is wrong with an archive: truncated, no archive, unsupported, or corrupt with the member's name."""


class Entry(NamedTuple):
    name: str
    flags: int
    method: int
    checksum: int
    packed: int
    size: int
    at: int
    record: bytes


def directory(data: bytes) -> list[Entry]:
    """Records of the central directory in their order."""
    if not data.startswith((MEMBER, END)):
        raise Broken("no archive")
    end = data.rfind(END, max(0, len(data) - 65_557))
    if end < 0 or end + 22 > len(data):
        raise Broken("truncated")
    _, disk, _, _, count, size, start, comment = struct.unpack_from(END_LAYOUT, data, end)
    if disk or count == 0xFFFF or start == 0xFFFFFFFF:
        raise Broken("unsupported")
    if start + size > end or end + 22 + comment > len(data):
        raise Broken("truncated")
    out, at = [], start
    for _ in range(count):
        if at + 46 > start + size or data[at : at + 4] != ENTRY:
            raise Broken("corrupt directory")
        _, _, _, flags, method, _, _, checksum, packed, plain, name, extra, note, _, _, _, place = struct.unpack_from(ENTRY_LAYOUT, data, at)
        if 0xFFFFFFFF in (packed, plain, place):
            raise Broken("unsupported")
        length = 46 + name + extra + note
        label = data[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        out.append(Entry(label, flags, method, checksum, packed, plain, place, data[at : at + length]))
        at += length
    return out


def _body(data: bytes, e: Entry) -> tuple[int, int]:
    """Where a member's packed bytes begin and end."""
    if data[e.at : e.at + 4] != MEMBER or e.at + 30 > len(data):
        raise Broken(f"corrupt {e.name}")
    *_, name, extra = struct.unpack_from(MEMBER_LAYOUT, data, e.at)
    begin = e.at + 30 + name + extra
    if begin + e.packed > len(data):
        raise Broken("truncated")
    return begin, begin + e.packed


def _pieces(data: bytes, e: Entry) -> Iterator[bytes]:
    begin, end = _body(data, e)
    if e.flags & 1 or e.method not in (STORED, DEFLATED):
        raise Broken("unsupported")
    if e.method == STORED:
        for at in range(begin, end, PIECE):
            yield data[at : min(end, at + PIECE)]
        return
    packer, rest = zlib.decompressobj(-15), data[begin:end]
    try:
        while rest and not packer.eof:
            yield packer.decompress(rest, PIECE)
            rest = packer.unconsumed_tail
        yield packer.flush()
    except zlib.error as wrong:
        raise Broken(f"corrupt {e.name}") from wrong
    if not packer.eof:
        raise Broken(f"corrupt {e.name}")


def check(data: bytes) -> list[Entry]:
    """The directory of an archive all of whose members have the sizes and checksums that it states."""
    entries = directory(data)
    for e in entries:
        checksum = size = 0
        for piece in _pieces(data, e):
            checksum, size = zlib.crc32(piece, checksum), size + len(piece)
            if size > e.size:  # more than the directory states: nothing of it is kept
                break
        if (checksum, size) != (e.checksum, e.size):
            raise Broken(f"corrupt {e.name}")
    return entries


def _is_macro(e: Entry) -> bool:
    return e.name.lower().rsplit("/", 1)[-1] == MACROS


def without_macros(data: bytes) -> bytes:
    """The archive without its macros, and with kinds of content that need none; one that has none comes back byte by byte."""
    entries = directory(data)
    if not any(map(_is_macro, entries)):
        return data
    body, records = bytearray(), bytearray()
    for e in entries:
        if _is_macro(e):
            continue
        begin, end = _body(data, e)
        head, packed, record = bytearray(data[e.at : begin]), data[begin:end], bytearray(e.record)
        flags, checksum, size = e.flags & ~8, e.checksum, e.size  # sizes stand before the member, not behind it
        if e.name == KINDS:
            text = b"".join(_pieces(data, e))
            for old, new in PLAIN_KINDS:
                text = text.replace(old, new)
            packer = zlib.compressobj(9, zlib.DEFLATED, -15)
            packed = packer.compress(text) + packer.flush() if e.method == DEFLATED else text
            checksum, size = zlib.crc32(text), len(text)
        struct.pack_into("<H", head, 6, flags)
        struct.pack_into("<3I", head, 14, checksum, len(packed), size)
        struct.pack_into("<H", record, 8, flags)
        struct.pack_into("<3I", record, 16, checksum, len(packed), size)
        struct.pack_into("<I", record, 42, len(body))
        body += head + packed
        records += record
    kept = sum(not _is_macro(e) for e in entries)
    return bytes(body + records + struct.pack(END_LAYOUT, END, 0, 0, kept, kept, len(records), len(body), 0))


def _told(content: bytes | None) -> dict:
    out = {"members": None, "macros": None, "problem": None}
    try:
        entries = check(content or b"")
        out |= {"members": len(entries), "macros": any(map(_is_macro, entries))}
    except Broken as wrong:
        out["problem"] = str(wrong)
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = [_told(x.as_py()) for x in b.column("content")]
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([t[n] for t in told], k) for n, k in (("members", pa.int64()), ("macros", pa.bool_()), ("problem", pa.string())))], names=["id", "members", "macros", "problem"])


def judged(files: DataFrame, content: str, row_id: str) -> DataFrame:
    """id, members, macros, problem of each file: no archive (also null and empty), truncated, unsupported (encrypted, split, 64-bit or an unknown method), corrupt with the member's name, or null."""
    kind = files.schema[row_id].dataType.simpleString()
    return files.select(F.col(row_id).alias("id"), F.col(content).alias("content")).mapInArrow(_judged, f"id {kind}, members long, macros boolean, problem string")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x in b.column("content"):
            content = x.as_py()
            try:
                out.append(without_macros(content or b""))
            except Broken:
                out.append(content)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "content"])


def cleaned(files: DataFrame, content: str, row_id: str) -> DataFrame:
    """id, content of each file without macros; what is no archive or broken comes back as it is."""
    kind = files.schema[row_id].dataType.simpleString()
    return files.select(F.col(row_id).alias("id"), F.col(content).alias("content")).mapInArrow(_cleaned, f"id {kind}, content binary")
