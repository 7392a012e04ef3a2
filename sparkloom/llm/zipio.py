"""ZIP packages with stored members: a streaming writer and a reader that needs the directory only.

The reader finds the end-of-directory record from the file's tail, follows the
ZIP64 locator where there is one, parses the central directory with its ZIP64
extra fields, and turns a member's name into the place of its bytes, so parts of a stored
member are read by range, without extraction.

Nulls do not come this far (``warc`` makes them empty payloads). Empty members and packages without members are
fine, members may be longer than memory, and of two members with one name the last counts.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from . import common

LOCAL = struct.Struct("<IHHHHHIIIHH")
CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
END = struct.Struct("<IHHHHIIH")
END64 = struct.Struct("<IQHHIIQQQQ")
LOCATOR = struct.Struct("<IIQI")
LOCAL_SIGN, CENTRAL_SIGN, END_SIGN, END64_SIGN, LOCATOR_SIGN, DESCRIPTOR_SIGN = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
UTF8_AND_DESCRIPTOR = 0x0808
DATE_1980 = 0x21


@dataclass
class Member:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    header: int


class ZipWriter:
    """Members are written one after another; sizes follow the data, so nothing is held or rewritten."""

    def __init__(self, path: str, zip64: bool | None = None):
        """zip64: force the 64-bit records (True), or use them where sizes need them (None)."""
        self.file, self.force = common.SharedWriter(path), bool(zip64)
        self.members: list[Member] = []

    def open(self, name: str) -> None:
        raw = name.encode()
        self.members.append(Member(name, 0, 0, 0, 0, self.file.tell()))
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.file.write(LOCAL.pack(LOCAL_SIGN, 45, UTF8_AND_DESCRIPTOR, 0, 0, DATE_1980, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Append to the open member; the place of the data inside it."""
        m = self.members[-1]
        at, m.size = m.size, m.size + len(data)
        m.crc = zlib.crc32(data, m.crc)
        self.file.write(data)
        return at

    def end_member(self) -> None:
        m = self.members[-1]
        m.stored = m.size
        self.file.write(struct.pack("<IIQQ", DESCRIPTOR_SIGN, m.crc, m.stored, m.size))

    def close(self) -> None:
        begin = self.file.tell()
        for m in self.members:
            raw, big = m.name.encode(), self.force or max(m.size, m.header) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.stored, m.header) if big else b""
            size, header = (FULL32, FULL32) if big else (m.size, m.header)
            self.file.write(CENTRAL.pack(CENTRAL_SIGN, 45, 45, UTF8_AND_DESCRIPTOR, 0, 0, DATE_1980, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, header) + raw + extra)
        end, n = self.file.tell(), len(self.members)
        if self.force or end >= FULL32 or n >= FULL16:
            self.file.write(END64.pack(END64_SIGN, END64.size - 12, 45, 45, 0, 0, n, n, end - begin, begin))
            self.file.write(LOCATOR.pack(LOCATOR_SIGN, 0, end, 1))
            self.file.write(END.pack(END_SIGN, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self.file.write(END.pack(END_SIGN, 0, 0, n, n, end - begin, begin, 0))
        self.file.commit()


class ZipReader:
    def __init__(self, path: str):
        self.path, self.file = path, common.SharedReader(path)
        self.members = {m.name: m for m in self.directory()}
        self.begin: dict[str, int] = {}

    def directory(self) -> list[Member]:
        size = self.file.size
        tail_at = max(0, size - END.size - FULL16 - LOCATOR.size)
        tail = self.file.read(tail_at, size - tail_at)
        at = tail.rfind(struct.pack("<I", END_SIGN))
        while at >= 0 and (at + END.size > len(tail) or tail_at + at + END.size + END.unpack_from(tail, at)[7] != size):
            at = tail.rfind(struct.pack("<I", END_SIGN), 0, at)  # the signature may occur inside the comment
        if at < 0:
            raise ValueError(f"{self.path}: no end of directory")
        _, _, _, _, n, length, begin, _ = END.unpack_from(tail, at)
        if at >= LOCATOR.size and tail[at - LOCATOR.size : at - LOCATOR.size + 4] == struct.pack("<I", LOCATOR_SIGN):
            record = LOCATOR.unpack_from(tail, at - LOCATOR.size)[2]
            sign, _, _, _, _, _, _, n, length, begin = END64.unpack(self.file.read(record, END64.size))
            if sign != END64_SIGN:
                raise ValueError(f"{self.path}: damaged ZIP64 record")
        data, out, at = self.file.read(begin, length), [], 0
        for _ in range(n):
            sign, _, _, _, method, _, _, crc, stored, full, name_n, extra_n, note_n, _, _, _, header = CENTRAL.unpack_from(data, at)
            if sign != CENTRAL_SIGN:
                raise ValueError(f"{self.path}: damaged directory")
            at += CENTRAL.size
            name, extra = data[at : at + name_n].decode(), data[at + name_n : at + name_n + extra_n]
            at += name_n + extra_n + note_n
            wide, k = [], 0
            while k + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{size // 8}Q", extra, k + 4))
                k += 4 + size
            # the 64-bit field has only what does not fit, in this order
            full = wide.pop(0) if full == FULL32 else full
            stored = wide.pop(0) if stored == FULL32 else stored
            header = wide.pop(0) if header == FULL32 else header
            out.append(Member(name, method, crc, stored, full, header))
        return out

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, by range."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name}: only stored members can be read by range")
        if name not in self.begin:
            fields = LOCAL.unpack(self.file.read(m.header, LOCAL.size))
            self.begin[name] = m.header + LOCAL.size + fields[9] + fields[10]
        length = m.size - start if length is None else length
        if start < 0 or start + length > m.size:
            raise ValueError(f"{name}: range outside the member")
        return self.file.read(self.begin[name] + start, length)

    def close(self) -> None:
        self.file.close()
