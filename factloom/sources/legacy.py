"""Readers of binary Office files of before 2007: sheets (.xls) and texts (.doc) in compound files.

A compound file is a small file system: sectors in chains, a directory of named streams, and short streams in a stream of their own. Each
reader follows the published formats as far as text and cell values go. What is encrypted, truncated or of an older version raises, and
documents.parsed turns that into the file's error row.
"""

from __future__ import annotations

import struct

from factloom.sources.documents import cell_text, trimmed

# The signature of a compound file, marks in place of sector numbers (ends of chains, unused sectors), types of records.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR = 0xFFFFFFFA
FORMULA, EOF, FILE_PASS, CONTINUE, BOUND_SHEET, MULTIPLE_RK, SHARED_STRINGS, LABEL_SHARED = 0x0006, 0x000A, 0x002F, 0x003C, 0x0085, 0x00BD, 0x00FC, 0x00FD
NUMBER, LABEL, BOOL_ERROR, STRING, RK, BOF = 0x0203, 0x0204, 0x0205, 0x0207, 0x027E, 0x0809


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise ValueError("no compound file")
    size, short = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, _, cutoff, short_table, _, more, _ = struct.unpack_from("<7I", data, 48)

    def sector(n: int) -> bytes:
        found = data[(n + 1) * size : (n + 2) * size]
        if not found:
            raise ValueError("a sector is missing")
        return found

    def numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def chain(first: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while first < LAST_SECTOR:
            if first in seen or first >= len(table):
                raise ValueError("a chain of sectors is broken")
            seen.add(first)
            out.append(first)
            first = table[first]
        return out

    places, seen = numbers(data[76:512]), set()
    while more < LAST_SECTOR:
        if more in seen:
            raise ValueError("a chain of sectors is broken")
        seen.add(more)
        *listed, more = numbers(sector(more))
        places += listed
    table = [x for n in places if n < LAST_SECTOR for x in numbers(sector(n))]
    whole = lambda first: b"".join(map(sector, chain(first, table)))
    entries = whole(directory)
    shorts = numbers(whole(short_table)) if short_table < LAST_SECTOR else []
    small, out = b"", {}
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        first, n = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            small = whole(first)
        elif kind == 2:
            body = b"".join(small[i * short : (i + 1) * short] for i in chain(first, shorts)) if n < cutoff else whole(first)
            out[entries[at : at + max(length - 2, 0)].decode("utf-16-le")] = body[:n]
    return out


def _records(book: bytes, at: int = 0):
    """(type, parts) of the records from a place on: a record and what continues it."""
    kind, parts = None, []
    while at + 4 <= len(book):
        k, n = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + n]
        at += 4 + n
        if k == CONTINUE and kind is not None:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = k, [body]
    if kind is not None:
        yield kind, parts


class _Strings:
    """Reads strings that may go on in a further part, where their characters begin with a new flag of their width."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("strings are cut off")
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                flags = self.take(1)[0]
            width = 1 + (flags & 1)
            fits = min(n, (len(self.parts[self.part]) - self.at) // width)
            if not fits:
                raise ValueError("strings are cut off")
            piece = self.take(fits * width)
            out += piece if width == 2 else piece.decode("latin-1").encode("utf-16-le")
            n -= fits
        self.take(4 * runs + extra)
        return out.decode("utf-16-le", "replace")


def _packed_number(v: int) -> float:
    """A number of 30 bits: an integer, or the upper bits of a double; a hundredth of it where the lowest bit is set."""
    x = float((v ^ 0x80000000) - 0x80000000 >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def xls_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of all sheets as text, like documents.xlsx_rows: shared and plain strings, numbers, truth values and errors by
    their codes, and what formulas have come to. Blank rows at the end are cut. Dates are their numbers."""
    found = streams(data)
    book = found.get("Workbook")
    if book is None:
        raise ValueError("no workbook of this version")
    shared, sheets = [], []
    for kind, parts in _records(book):
        if kind == FILE_PASS:
            raise PermissionError("encrypted")
        if kind == SHARED_STRINGS:
            reader = _Strings(parts, 8)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
        elif kind == BOUND_SHEET and parts[0][5] == 0:
            n, wide = parts[0][6:8]
            sheets.append((parts[0][8 : 8 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1"), struct.unpack_from("<I", parts[0])[0]))
        elif kind == EOF:
            break
    out = []
    for name, at in sheets:
        grid: dict[int, dict[int, str]] = {}
        waits, depth = None, 0
        for kind, parts in _records(book, at):
            body = parts[0]
            # A chart within a sheet has a beginning and an end of its own.
            depth += (kind == BOF) - (kind == EOF)
            if depth == 0:
                break
            if depth > 1:
                continue
            if kind == STRING and waits:
                grid.setdefault(waits[0], {})[waits[1]] = _Strings(parts, 0).string()
                waits = None
                continue
            if kind not in (LABEL_SHARED, LABEL, NUMBER, RK, MULTIPLE_RK, BOOL_ERROR, FORMULA):
                continue
            row, column = struct.unpack_from("<HH", body)
            cells = grid.setdefault(row, {})
            if kind == LABEL_SHARED:
                cells[column] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == LABEL:
                cells[column] = _Strings(parts, 6).string()
            elif kind == NUMBER:
                cells[column] = cell_text(repr(struct.unpack_from("<d", body, 6)[0]))
            elif kind == RK:
                cells[column] = cell_text(repr(_packed_number(struct.unpack_from("<I", body, 6)[0])))
            elif kind == MULTIPLE_RK:
                for i in range((len(body) - 6) // 6):
                    cells[column + i] = cell_text(repr(_packed_number(struct.unpack_from("<I", body, 6 + 6 * i)[0])))
            elif kind == BOOL_ERROR:
                cells[column] = str(body[6])
            elif body[12:14] != b"\xff\xff":
                cells[column] = cell_text(repr(struct.unpack_from("<d", body, 6)[0]))
            elif body[6] == 0:
                waits = (row, column)
            else:
                cells[column] = str(body[8]) if body[6] in (1, 2) else ""
        rows = trimmed([[grid.get(r, {}).get(k, "") for k in range(max(grid.get(r, {}), default=-1) + 1)] for r in range(max(grid, default=-1) + 1)])
        out += [(name, n, cells) for n, cells in enumerate(rows, 1)]
    return out


def doc_text(data: bytes) -> str:
    """The main text of a Word file: the pieces of its text in order, either wide or of one byte a character, without field codes; paragraphs
    and rows of tables end in a line feed, cells in a tab."""
    found = streams(data)
    word = found.get("WordDocument")
    if word is None or struct.unpack_from("<H", word)[0] != 0xA5EC:
        raise ValueError("no Word file of this version")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise PermissionError("encrypted")
    table = found["1Table" if flags & 0x200 else "0Table"]
    letters = struct.unpack_from("<I", word, 76)[0]
    at, n = struct.unpack_from("<II", word, 418)
    pieces, end = table[at : at + n], 0
    while pieces[end : end + 1] == b"\x01":
        end += 3 + struct.unpack_from("<H", pieces, end + 1)[0]
    if pieces[end : end + 1] != b"\x02":
        raise ValueError("no table of pieces")
    pieces = pieces[end + 5 : end + 5 + struct.unpack_from("<I", pieces, end + 1)[0]]
    count = (len(pieces) - 4) // 12
    bounds = struct.unpack_from(f"<{count + 1}I", pieces)
    out = []
    for i in range(count):
        where = struct.unpack_from("<I", pieces, 4 * (count + 1) + 8 * i + 2)[0]
        many = bounds[i + 1] - bounds[i]
        if where & 0x40000000:
            begin = (where & 0x3FFFFFFF) // 2
            out.append(word[begin : begin + many].decode("cp1252", "replace"))
        else:
            out.append(word[where : where + 2 * many].decode("utf-16-le", "surrogatepass"))
    # Places count halves of a pair of surrogates, which may lie in two pieces. A field is its code, then its result: codes go, results stay.
    kept, fields = [], []
    for c in "".join(out).encode("utf-16-le", "surrogatepass")[: 2 * letters].decode("utf-16-le", "replace"):
        if c == "\x13":
            fields.append(True)
        elif c == "\x14" and fields:
            fields[-1] = False
        elif c == "\x15" and fields:
            fields.pop()
        elif not any(fields):
            kept.append({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-"}.get(c, c if c >= " " or c in "\t\n" else ""))
    return "".join(kept).strip()
