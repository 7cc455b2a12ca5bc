"""Media columns: progressive JPEG files decoded to full-resolution RGB tensors.

Decoding accumulates every scan of a file, by spectral selection and successive approximation, into one
coefficient array per component; numpy then inverts the transform of all blocks at once, repeats the chroma
planes to full resolution and converts to RGB. Scans whose codes all have the same length, as those written
here, are read as whole arrays; all others go symbol by symbol through the general decoder.

Storing: a payload becomes the quantised AC coefficients of a 4:2:0 picture, one byte in one coefficient of
the eight-bit size category (-255..-128 and 128..255), so the file holds it without loss and standard
decoders can open it. A comment segment keeps the payload's length. Null texts count as empty, and
the empty text's payload is one unit of filler; a text of any length is stored whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches

#: Fixed values of the format: the order in which a block's coefficients are stored.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
#: The payload is filled to a multiple of this many bytes.
UNIT = 576
AC = 63
#: Payload bytes of an MCU: four luma blocks and two chroma blocks.
MCU = 6 * AC
#: Widest picture written, in MCUs.
MOST_ACROSS = 4080
#: Bands of the AC coefficients: component, first, last.
BANDS = ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63))
LONGEST_RUN = 32767


def _basis() -> np.ndarray:
    """Zigzag coefficients to the samples of a block, as one 64 x 64 matrix."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, slot: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | slot]) + counts + bytes(s for n in sorted(by_length) for s in by_length[n]))


def _scan(components: list[int], first: int, last: int, high: int, low: int, slot: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c + 1, slot if first else 0]) for c in components)
    return _segment(0xDA, head + bytes([first, last, high << 4 | low])) + data


def _runs(blocks: int, bits: np.ndarray, width: int) -> bytes:
    """A refinement scan: end-of-band runs over all blocks, each with the correction bits of its blocks."""
    parts = []
    for at in range(0, blocks, LONGEST_RUN):
        run = min(LONGEST_RUN, blocks - at)
        n = run.bit_length() - 1
        head = n << n | (run - (1 << n))  # a code of 4 bits equal to n, then n bits
        parts += [np.array([head >> (3 + n - i) & 1 for i in range(4 + n)], np.uint8), bits[at * width : (at + run) * width]]
    every = np.concatenate(parts)
    if short := -len(every) % 8:
        every = np.concatenate([every, np.ones(short, np.uint8)])
    return np.packbits(every).tobytes().replace(b"\xff", b"\xff\x00")


#: The tables of every file written here.
TABLES = _segment(0xDB, bytes([0]) + bytes([1]) * 64) + b"".join(_huffman(*x) for x in ((0, 0, {1: [0]}), (1, 0, {1: [0x07], 2: [0x00]}), (1, 1, {4: [n << 4 for n in range(15)]})))


def store(payload: bytes) -> bytes:
    """A progressive JPEG file that holds the payload in its AC coefficients."""
    mcus = max(1, -(-len(payload) // MCU))
    across = min(MOST_ACROSS, int(np.ceil(np.sqrt(mcus))))
    down = -(-mcus // across)
    data = np.full(across * down * MCU, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    y = across * down * 4 * AC
    c = across * down * AC
    planes = [data[:y].reshape(-1, AC), data[y : y + c].reshape(-1, AC), data[y + c :].reshape(-1, AC)]
    out = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", len(payload))),
        TABLES,
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
    ]
    blocks = across * down * 6
    dc = b"\x00" * (blocks // 8) + (bytes([0xFF >> (blocks % 8)]) if blocks % 8 else b"")
    out.append(_scan([0, 1, 2], 0, 0, 0, 0, 0, dc))
    for k, first, last in BANDS:
        out.append(_scan([k], first, last, 0, 1, 0, (planes[k][:, first - 1 : last] >> 1).tobytes()))
    for k, first, last in BANDS:
        band = planes[k][:, first - 1 : last]
        out.append(_scan([k], first, last, 1, 0, 1, _runs(len(band), ((band & 1) ^ (band < 128)).ravel(), last - first + 1)))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading


class _Bits:
    """Reads bits of an entropy-coded segment; beyond its end come zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        got = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return got

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("not a code of the table")

    def signed(self, size: int) -> int:
        bits = self.take(size) if size else 0
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


@lru_cache(256)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            table[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


#: What ends an entropy-coded segment: a marker that is neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class Picture:
    """The coefficient arrays and tables of a progressive file."""

    def __init__(self, file: bytes) -> None:
        self.file, self.comment, self.interval = file, b"", 0
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, dict[tuple[int, int], int]] = {}
        self.parts: list[dict] = []
        self._read()

    def _read(self) -> None:
        file, at = self.file, 2
        if file[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while file[at + 1] != 0xD9:
            marker, n = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
            body = file[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.huffman[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                at = self._entropy(body, at)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive file of Huffman codes")

    def _tables(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else "u1").astype(np.float32)
            body = body[1 + 64 * (wide + 1) :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        self.h, self.v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p["cols"], p["rows"] = self.across * p["h"], self.down * p["v"]
            p["c"] = np.zeros((p["rows"] * p["cols"], 64), np.int16)

    def _entropy(self, body: bytes, at: int) -> int:
        """Reads a scan and gives the place of the next marker."""
        end = MARKER.search(self.file, at).start()
        data = self.file[at:end]
        named = [(next(p for p in self.parts if p["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
        first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        if first == high == 0 and not self.interval and self._flat(data, named):
            return end
        for pieces, blocks in self._restarts(data, named):
            if first == 0:
                self._dc(pieces, blocks, high, low)
            else:
                (p, tables), = named
                rows = [row for _, row, _ in blocks] if isinstance(blocks, list) else blocks
                table = self.huffman[0x10 | tables & 15]
                step = self._first if high == 0 else self._refine
                step(pieces, p["c"], rows, table, first, last, low)
        return end

    def _flat(self, data: bytes, named: list) -> bool:
        """Whether a DC scan has a zero bit for each block: no difference anywhere, all arrays stay as they are."""
        blocks = sum(len(p["c"]) for p, _ in named)
        filler = (1 << (-blocks % 8)) - 1
        return len(named) == len(self.parts) > 1 and len(data) == -(-blocks // 8) and data[-1] == filler and not data[:-1].strip(b"\0") and all(self.huffman[t >> 4].get((1, 0)) == 0 for _, t in named)

    def _restarts(self, data: bytes, named: list) -> Iterator[tuple[bytes, list]]:
        """The bytes of each restart interval with (component, block, DC table) in the order of the scan."""
        if len(named) == 1:
            p, tables = named[0]
            cols, rows = -(-(-(-self.width * p["h"] // self.h)) // 8), -(-(-(-self.height * p["v"] // self.v)) // 8)
            if not self.interval and cols == p["cols"] and rows == p["rows"]:
                yield data.replace(b"\xff\x00", b"\xff"), _Span(p, range(cols * rows), tables >> 4)
                return
            mcus = [[(p, r * p["cols"] + c, tables >> 4)] for r in range(rows) for c in range(cols)]
        else:
            mcus = [
                [(p, (m // self.across * p["v"] + y) * p["cols"] + m % self.across * p["h"] + x, t >> 4) for p, t in named for y in range(p["v"]) for x in range(p["h"])]
                for m in range(self.across * self.down)
            ]
        step = self.interval or len(mcus)
        pieces = [data]
        if self.interval:
            pieces, start, i = [], 0, 0
            while i < len(data) - 1:
                if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                    pieces.append(data[start:i])
                    start = i = i + 2
                else:
                    i += 1
            pieces.append(data[start:])
        for k, piece in enumerate(pieces):
            yield piece.replace(b"\xff\x00", b"\xff"), [u for m in mcus[k * step : (k + 1) * step] for u in m]

    def _dc(self, data: bytes, blocks, high: int, low: int) -> None:
        bits, before = _Bits(data), {}
        if high:
            flags = np.unpackbits(np.frombuffer(data, np.uint8))
            for flag, (p, row, _) in zip(flags, blocks, strict=False):
                p["c"][row, 0] |= int(flag) << low
            return
        for p, row, t in blocks:
            before[p["id"]] = before.get(p["id"], 0) + bits.signed(bits.symbol(self.huffman[t]))
            p["c"][row, 0] = before[p["id"]] << low

    @staticmethod
    def _first(data: bytes, c: np.ndarray, rows, table: dict, first: int, last: int, low: int) -> None:
        width, n = last - first + 1, len(rows)
        if table.get((1, 0)) == 7 and len(data) == n * width and isinstance(rows, _Span):
            every = np.frombuffer(data, np.uint8)
            if not (every & 0x80).any():  # a one-bit code and seven bits for each coefficient
                v = every.astype(np.int16)
                c[:, first : last + 1] = (np.where(v < 64, v - 127, v) << low).reshape(n, width)
                return
        bits, run = _Bits(data), 0
        for row in _numbers(rows):
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                zeros, size = divmod(bits.symbol(table), 16)
                if size:
                    k += zeros
                    c[row, k] = bits.signed(size) << low
                elif zeros == 15:
                    k += 15
                else:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
                    break
                k += 1

    @staticmethod
    def _refine(data: bytes, c: np.ndarray, rows, table: dict, first: int, last: int, low: int) -> None:
        width, n = last - first + 1, len(rows)
        step = 1 << low
        band = c[:, first : last + 1]
        if isinstance(rows, _Span) and all(k[0] == 4 for k in table) and band.all():
            every, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
            while done < n:
                zeros, size = divmod(table[4, int(every[at : at + 4] @ (8, 4, 2, 1))], 16)
                if size or zeros == 15:
                    break
                run = 1 << zeros
                for bit in every[at + 4 : at + 4 + zeros]:
                    zeros -= 1
                    run += int(bit) << zeros
                at += 3 + run.bit_length()
                part = band[done : done + run]
                more = every[at : at + run * width].reshape(run, width).astype(np.int16) * step
                part += np.where(part < 0, -more, more)
                at, done = at + run * width, done + run
            if done == n:
                return
            # Whatever else comes is read bit by bit, from here on.
            data, rows = np.packbits(every[at:]).tobytes(), range(done, n)
        bits, run = _Bits(data), 0

        def correct(row: int, k: int) -> None:
            if bits.take(1) and not abs(int(c[row, k])) & step:
                c[row, k] += step if c[row, k] > 0 else -step

        for row in _numbers(rows):
            k = first
            while not run and k <= last:
                zeros, size = divmod(bits.symbol(table), 16)
                value = 0
                if size:
                    value = step if bits.take(1) else -step
                elif zeros < 15:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                while k <= last:
                    if c[row, k]:
                        correct(row, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        c[row, k] = value
                        k += 1
                        break
                    k += 1
            if run:
                for j in range(k, last + 1):
                    if c[row, j]:
                        correct(row, j)
                run -= 1

    def _samples(self, p: dict) -> np.ndarray:
        """A component's samples around zero at its own resolution."""
        c = p["c"].astype(np.float32)
        quant = self.quant[p["q"]]
        if (quant != 1).any():
            c *= quant
        return (c @ BASIS).reshape(p["rows"], p["cols"], 8, 8).swapaxes(1, 2).reshape(p["rows"] * 8, p["cols"] * 8)

    def _full(self, p: dict, plane: np.ndarray) -> np.ndarray:
        """A plane with its samples repeated to full resolution."""
        plane = plane.repeat(self.h // p["h"], 1) if p["h"] < self.h else plane
        plane = plane.repeat(self.v // p["v"], 0) if p["v"] < self.v else plane
        return plane[: self.height, : self.width]

    def rgb(self) -> np.ndarray:
        """The picture as a tensor of 3 x height x width bytes: red, green, blue."""
        out = np.empty((3, self.height, self.width), np.uint8)
        y = self._full(self.parts[0], self._samples(self.parts[0])) + np.float32(128.5)
        if len(self.parts) == 1:
            out[:] = y.clip(0, 255)
            return out
        p = self.parts[1]
        b, r = (self._samples(x).clip(-128, 127) for x in self.parts[1:3])
        y = y.clip(0.5, 255.5)
        for k, shift in enumerate((np.float32(1.402) * r, np.float32(-0.344136) * b - np.float32(0.714136) * r, np.float32(1.772) * b)):
            plane = self._full(p, shift) + y
            out[k] = plane.clip(0, 255, out=plane)
        return out

    def payload(self) -> bytes:
        """The stored bytes, from the coefficients."""
        values = np.concatenate([p["c"][:, 1:].ravel() for p in self.parts])
        return np.where(values < 0, values + 255, values).astype(np.uint8)[: struct.unpack(">Q", self.comment)[0]].tobytes()


class _Span:
    """All blocks of one component in order."""

    def __init__(self, part: dict, rows: range, table: int) -> None:
        self.part, self.rows, self.table = part, rows, table

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        return ((self.part, row, self.table) for row in self.rows)


def _numbers(rows):
    return rows.rows if isinstance(rows, _Span) else rows


# ---- columns


def as_payload(text: str | None) -> bytes:
    """A text's UTF-8 bytes and bytes 255 up to a positive multiple of the unit."""
    data = (text or "").encode()
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def _stored(texts: pd.Series) -> pd.Series:
    return pd.Series([store(as_payload(x)) for x in texts], dtype=object)


def stored(text: str) -> Column:
    """The progressive JPEG file of a text column, binary."""
    return F.pandas_udf(_stored, "binary")(text)


def _tensors(files: pd.Series) -> pd.DataFrame:
    rows = []
    for file in files:
        if file is None:
            rows.append((None, None, None))
        else:
            rgb = Picture(bytes(file)).rgb()
            rows.append((rgb.shape[1], rgb.shape[2], rgb.tobytes()))
    return pd.DataFrame(rows, columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})


def tensors(file: str) -> Column:
    """The full-resolution RGB tensor of a column of progressive JPEG files; null files give nulls."""
    return F.pandas_udf(_tensors, "height int, width int, rgb binary")(file)


def feature(rgb: np.ndarray) -> str:
    """Shape and means of a tensor: of each channel, and of its top and bottom halves, in hundredths."""
    rows = rgb.sum(2, dtype=np.int64)
    half = rgb.shape[1] // 2
    top, every = rows[:, :half].sum(1), rows.sum(1)
    n = rgb.shape[2]
    means = [*(every * 100 // (n * rgb.shape[1])), *(top * 100 // (n * half)), *((every - top) * 100 // (n * (rgb.shape[1] - half)))]
    return "x".join(map(str, rgb.shape)) + "|" + ",".join(map(str, means))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Stores each text, reads the file back and gives digests of file, payload and tensor."""
    for batch in batches:
        rows = []
        for text in batch:
            file = store(as_payload(text))
            picture = Picture(file)
            back = picture.payload()
            rows.append((len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(picture.rgb())))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id with the digests of its text's media form; the files and tensors stay in their task."""
    bound_batches(docs.sparkSession)
    digested = F.pandas_udf(_digested, DIGEST)
    return docs.select("doc_id", digested("text").alias("d")).select("doc_id", "d.*")
