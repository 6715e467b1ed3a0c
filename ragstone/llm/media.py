"""Operator 10: media columns as progressive JPEG.

decode() reads 8-bit Huffman-coded progressive JPEGs: it accumulates all
spectral-selection and successive-approximation scans into coefficient arrays,
and rgb() inverse-transforms them in numpy, upsamples the chroma planes and
returns a full-resolution tensor.

encode() stores bytes losslessly, one for each quantised coefficient, 64 to a
block in zigzag order, over the blocks of Y, Cb and Cr (4:2:0).  The DC
coefficient is the byte itself; an AC coefficient has the byte's high bit as its
sign and 128 plus the other bits as its magnitude.  DC values come in nine scans
from bit 8 (always 0) down, AC values in two bands of two scans from bit 1
down.  As every AC coefficient has one size and no block has zeros, each scan's
code words have one length, so both sides of it are array operations; decode()
takes any scan of that kind so and walks the others bit by bit.

The query stores the JPEGs as a media column in the shared folder and takes its
digests from the bytes that it reads back.  tensors() gives the full-resolution RGB
column of a media column; its cells are twice the payload, so the query, which has to
keep within one and a half times its input, derives the feature from each tensor and
doesn't write that column as well.

Edge cases: null counts as empty, an empty text is one block of zeros; long
texts are stored whole; equal texts give equal files and features; rows that
repeat a doc_id each get their row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.llm.common import slices, table, utf8_values, written

BLOCK = 64
#: bands of AC coefficients and the bit that their first scan starts from
BANDS, AC_FROM, DC_FROM = ((1, 5), (6, 63)), 1, 8
#: components as (id, horizontal and vertical sampling)
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: along anti-diagonals, turning."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: orthonormal DCT-II basis, a row for each frequency
DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * math.pi / 16) / 2 * np.where(_K[:, None] == 0, math.sqrt(0.5), 1)).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table whose code words are 0, 10, 110 and so on."""
    lengths = [1 if i < len(symbols) else 0 for i in range(16)]
    return _segment(0xC4, bytes([kind << 4, *lengths, *symbols]))


def _scan(components: list[int], band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    """A start-of-scan segment and its entropy-coded bits."""
    spare = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes().replace(b"\xff", b"\xff\0")
    body = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([*band, high << 4 | low])
    return _segment(0xDA, body) + data


def _in_mcus(grid: np.ndarray, h: int, v: int) -> np.ndarray:
    """Blocks of a component, an MCU's own beside each other: (mcus, h * v)."""
    rows, cols = grid.shape
    return grid.reshape(rows // v, v, cols // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v)


def encode(payload: bytes) -> bytes:
    """The progressive JPEG that stores payload, whose length is a multiple of 64."""
    blocks = len(payload) // BLOCK
    if not blocks or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    mcus = -(-blocks // 6)
    wide = min(mcus, 4095)  # one row of them, as long as a file can state: hardly any is empty
    tall = -(-mcus // wide)
    data = np.zeros((6 * wide * tall, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes, at = [], 0
    for _, h, v in COMPONENTS:
        planes.append(data[at: at + h * v * wide * tall])
        at += h * v * wide * tall
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0]) + b"\x01" * 64),
           _segment(0xC2, struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in COMPONENTS)), _dht(0, [0])]
    dc = np.concatenate([_in_mcus(p[:, 0].reshape(v * tall, h * wide), h, v) for p, (_, h, v) in zip(planes, COMPONENTS, strict=True)], axis=1).ravel()
    names = [c for c, _, _ in COMPONENTS]
    out.append(_scan(names, (0, 0), 0, DC_FROM, np.zeros(len(dc), np.uint8)))
    for low in range(DC_FROM - 1, -1, -1):
        out.append(_scan(names, (0, 0), low + 1, low, dc >> low & 1))
    size = 8 - AC_FROM
    out.append(_dht(1, [size]))
    for name, p in zip(names, planes, strict=True):
        for band in BANDS:
            out.append(_scan([name], band, 0, AC_FROM, _first_bits(p[:, band[0]: band[1] + 1])))
    runs = {min(0x7FFF, n - a) for p in planes for n in (len(p),) for a in range(0, n, 0x7FFF)}
    orders = sorted({r.bit_length() - 1 for r in runs})
    out.append(_dht(1, [o << 4 for o in orders]))
    for low in range(AC_FROM - 1, -1, -1):
        for name, p in zip(names, planes, strict=True):
            for band in BANDS:
                part = p[:, band[0]: band[1] + 1] >> low & 1
                bits = []
                for a in range(0, len(part), 0x7FFF):
                    run = part[a: a + 0x7FFF]
                    order = len(run).bit_length() - 1
                    code = [1] * orders.index(order) + [0]
                    bits += [np.array([*code, *(len(run) - (1 << order) >> k & 1 for k in range(order - 1, -1, -1))], np.uint8), run.ravel()]
                out.append(_scan([name], band, low + 1, low, np.concatenate(bits)))
    return b"".join([*out, b"\xff\xd9"])


def _first_bits(part: np.ndarray) -> np.ndarray:
    """Code word 0 and the sign and magnitude bits above AC_FROM of each value."""
    size = 8 - AC_FROM
    top = (part & 0x7F | 0x80) >> AC_FROM
    top = np.where(part & 0x80, (1 << size) - 1 - top, top).astype(np.uint8)
    return np.unpackbits(top.reshape(-1, 1), axis=1)[:, 8 - size - 1:].ravel()  # the bit above the value is 0: the code word


class _Bits:
    """A reader of single bits, for scans without a fixed length of code words."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def read(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, codes: dict) -> int:
        value = length = 0
        while True:
            value, length = value << 1 | self.bit(), length + 1
            if (length, value) in codes:
                return codes[length, value]
            if length > 16:
                raise ValueError("no such code word")

    def signed(self, size: int) -> int:
        value = self.read(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Image:
    """Coefficients (zigzag order) and what else a file states."""

    def __init__(self):
        self.width = self.height = self.restart = 0
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], dict] = {}
        self.parts: list[dict] = []

    def frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.height:
            raise ValueError("only 8-bit frames with a stated height are read")
        self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        self.hmax, self.vmax = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p["cols"], p["rows"] = (-(-(-(-self.width * p["h"] // self.hmax)) // 8), -(-(-(-self.height * p["v"] // self.vmax)) // 8))
            p["coef"] = np.zeros((self.mcus_y * p["v"], self.mcus_x * p["h"], 64), np.int32)

    def tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, lengths = body[at], body[at + 1: at + 17]
            at += 17
            codes, code = {}, 0
            for length, n in enumerate(lengths, 1):
                for _ in range(n):
                    codes[length, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[kind >> 4, kind & 15] = codes

    def quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, n = body[at] >> 4, body[at] & 15
            self.quant[n] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float32)
            at += 65 + 64 * wide

    def scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [(next(p for p in self.parts if p["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, approx = body[1 + 2 * n: 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        pieces = [x.replace(b"\xff\0", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)]
        if first == 0:
            if len(pieces) > 1 or not self._dc_at_once(chosen, high, low, pieces[0]):
                self._dc(chosen, high, low, pieces)
        else:
            part, tables = chosen[0]
            codes = self.codes.get((1, tables & 15), {})
            fast = self._ac_first_at_once if high == 0 else self._ac_more_at_once
            if len(pieces) > 1 or not fast(part, codes, first, last, low, pieces[0]):
                (self._ac_first if high == 0 else self._ac_more)(part, codes, first, last, low, pieces)

    # blocks of a scan: of one component those that the image needs, else whole MCUs

    def _order(self, chosen: list) -> tuple[list[tuple[dict, int, int]], int]:
        """(component, row, column) of the blocks in coded order, and blocks to an MCU."""
        if len(chosen) == 1:
            p = chosen[0][0]
            return [(p, r, c) for r in range(p["rows"]) for c in range(p["cols"])], 1
        return [(p, y * p["v"] + r, x * p["h"] + c) for y in range(self.mcus_y) for x in range(self.mcus_x) for p, _ in chosen for r in range(p["v"]) for c in range(p["h"])], sum(p["h"] * p["v"] for p, _ in chosen)

    def _dc_at_once(self, chosen: list, high: int, low: int, data: bytes) -> bool:
        if high == 0 and any(self.codes[0, t >> 4] != {(1, 0): 0} for _, t in chosen):
            return False
        single = len(chosen) == 1
        shapes = [(p["rows"] * p["cols"],) if single else (self.mcus_y * self.mcus_x, p["h"] * p["v"]) for p, _ in chosen]
        total = sum(math.prod(s) for s in shapes)
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=total)
        if high == 0:
            return not bits.any()  # every difference is 0, as the coefficients are already
        if single:
            p = chosen[0][0]
            p["coef"][: p["rows"], : p["cols"], 0] |= bits.reshape(p["rows"], p["cols"]).astype(np.int32) << low
            return True
        bits, at = bits.reshape(self.mcus_y * self.mcus_x, -1), 0
        for p, _ in chosen:
            h, v = p["h"], p["v"]
            own = bits[:, at: at + h * v].reshape(self.mcus_y, self.mcus_x, v, h).transpose(0, 2, 1, 3).reshape(self.mcus_y * v, self.mcus_x * h)
            p["coef"][:, :, 0] |= own.astype(np.int32) << low
            at += h * v
        return True

    def _dc(self, chosen: list, high: int, low: int, pieces: list[bytes]) -> None:
        order, each = self._order(chosen)
        tables = {id(p): t >> 4 for p, t in chosen}
        step = each * self.restart or len(order)
        for k, piece in enumerate(pieces):
            bits, before = _Bits(piece), dict.fromkeys(tables, 0)
            for p, r, c in order[k * step: (k + 1) * step]:
                if high:
                    p["coef"][r, c, 0] |= bits.bit() << low
                else:
                    before[id(p)] += bits.signed(bits.symbol(self.codes[0, tables[id(p)]]))
                    p["coef"][r, c, 0] = before[id(p)] << low

    def _ac_first_at_once(self, part: dict, codes: dict, first: int, last: int, low: int, data: bytes) -> bool:
        if len(codes) != 1 or (1, 0) not in codes or not 0 < codes[1, 0] < 16:
            return False
        size, n = codes[1, 0], part["rows"] * part["cols"] * (last - first + 1)
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (size + 1)).reshape(n, size + 1)
        if bits[:, 0].any():
            raise ValueError("no such code word")
        if size < 8:
            value = np.packbits(bits[:, 1:], axis=1).ravel().astype(np.int32) >> (8 - size)
        else:
            value = bits[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        value = np.where(bits[:, 1], value, value - (1 << size) + 1)
        part["coef"][: part["rows"], : part["cols"], first: last + 1] = value.reshape(part["rows"], part["cols"], -1) * (1 << low)
        return True

    def _ac_first(self, part: dict, codes: dict, first: int, last: int, low: int, pieces: list[bytes]) -> None:
        order, _ = self._order([(part, 0)])
        step = self.restart or len(order)
        for k, piece in enumerate(pieces):
            bits, run = _Bits(piece), 0
            for p, r, c in order[k * step: (k + 1) * step]:
                if run:
                    run -= 1
                    continue
                at = first
                while at <= last:
                    zeros, size = divmod(bits.symbol(codes), 16)
                    if size:
                        at += zeros
                        p["coef"][r, c, at] = bits.signed(size) * (1 << low)
                        at += 1
                    elif zeros == 15:
                        at += 16
                    else:
                        run = (1 << zeros) + bits.read(zeros) - 1
                        break

    def _ac_more_at_once(self, part: dict, codes: dict, first: int, last: int, low: int, data: bytes) -> bool:
        own = part["coef"][: part["rows"], : part["cols"], first: last + 1]
        if not own.all():
            return False
        raw, at, got, n, width = np.frombuffer(data, np.uint8), 0, [], part["rows"] * part["cols"], last - first + 1
        done = 0
        while done < n:
            head = _Bits(raw[at // 8: at // 8 + 8].tobytes())
            head.at = at % 8
            order, size = divmod(head.symbol(codes), 16)
            if size or order == 15:
                return False
            run = min((1 << order) + head.read(order), n - done)
            at += head.at - at % 8
            bits = np.unpackbits(raw[at // 8: (at + run * width + 7) // 8])
            got.append(bits[at % 8: at % 8 + run * width])
            at += run * width
            done += run
        more = (np.concatenate(got) if len(got) > 1 else got[0]).reshape(own.shape).astype(np.int32) << low
        own += np.where(own < 0, -more, more)
        return True

    def _ac_more(self, part: dict, codes: dict, first: int, last: int, low: int, pieces: list[bytes]) -> None:
        order, _ = self._order([(part, 0)])
        step = self.restart or len(order)
        one = 1 << low
        for k, piece in enumerate(pieces):
            bits, run = _Bits(piece), 0
            for p, r, c in order[k * step: (k + 1) * step]:
                own, at = p["coef"][r, c], first
                while at <= last and not run:
                    zeros, size = divmod(bits.symbol(codes), 16)
                    value = 0
                    if size:
                        value = one if bits.bit() else -one
                    elif zeros < 15:
                        run = (1 << zeros) + bits.read(zeros)
                        break
                    while at <= last:  # pass over zeros, correcting what isn't
                        if own[at]:
                            own[at] += (one if own[at] > 0 else -one) * bits.bit()
                        elif zeros:
                            zeros -= 1
                        else:
                            own[at] = value
                            at += 1
                            break
                        at += 1
                if run:
                    for i in range(at, last + 1):
                        if own[i]:
                            own[i] += (one if own[i] > 0 else -one) * bits.bit()
                    run -= 1


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        if marker == 0xD9:
            return image
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4: at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            image.frame(body)
        elif marker == 0xC4:
            image.tables(body)
        elif marker == 0xDB:
            image.quantisers(body)
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            end = _MARKER.search(data, at).start()
            image.scan(body, data[at:end])
            at = end
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive Huffman-coded frames are read")


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def payload_of(image: Image) -> bytes:
    """The bytes that encode() stored."""
    planes = [p["coef"].reshape(-1, 64) for p in image.parts]
    coef = np.concatenate(planes)
    data = (np.abs(coef) & 0x7F | (coef < 0).astype(np.int32) << 7).astype(np.uint8)
    data[:, 0] = coef[:, 0]
    return data.tobytes()[: int(image.comment.split()[1])]


def rgb(image: Image) -> np.ndarray:
    """The image as (height, width, 3) bytes: dequantised, inverse-transformed, chroma
    repeated to full resolution, converted."""
    planes = []
    for p in image.parts:
        coef = np.empty(p["coef"].shape, np.float32)
        coef[..., ZIGZAG] = p["coef"] * image.quant[p["q"]]
        blocks = DCT.T @ coef.reshape(*coef.shape[:2], 8, 8) @ DCT
        plane = blocks.transpose(0, 2, 1, 3).reshape(coef.shape[0] * 8, coef.shape[1] * 8) + np.float32(128)
        for axis, k in ((0, image.vmax // p["v"]), (1, image.hmax // p["h"])):
            plane = np.repeat(plane, k, axis=axis) if k > 1 else plane
        planes.append(np.clip(plane[: image.height, : image.width], 0, 255))
    if len(planes) == 1:
        planes = [planes[0]] * 3
    else:
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, p in enumerate(planes):
        out[..., i] = np.clip(np.rint(p), 0, 255)
    return out


def features(tensor: np.ndarray) -> str:
    """Size, mean of each channel and a coarse brightness histogram."""
    flat = tensor.reshape(-1, 3)
    means = flat.sum(axis=0, dtype=np.int64) * 1000 // len(flat)
    bins = np.bincount(flat[:, 1] >> 5, minlength=8) * 1000 // len(flat)
    return f"{tensor.shape[0]}x{tensor.shape[1]} rgb " + " ".join(map(str, means.tolist())) + " g " + " ".join(map(str, bins.tolist()))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG that stores the text's UTF-8 bytes, filled
    up with zeros to a positive multiple of 64."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raw = utf8_values(batch.column("text"))
            made = {r: encode(r + bytes(-len(r) % BLOCK if r else BLOCK)) for r in set(raw)}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([made[r] for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (height * width * 3 bytes) of a media column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            made = [rgb(decode(m)) for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.shape[0] for t in made], pa.int32()), pa.array([t.shape[1] for t in made], pa.int32()), pa.array([t.tobytes() for t in made], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.mapInArrow(rows, "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What a media column holds, read back from its bytes: DIGEST, a row each."""

    def one(stored: bytes) -> tuple:
        image = decode(stored)
        payload = payload_of(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(rgb(image))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches, "media", 1 << 20):
            stored = batch.column("media").to_pylist()
            made = {m: one(m) for m in set(stored)}
            cols = zip(*(made[m] for m in stored), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return media.mapInArrow(rows, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents stored as progressive JPEGs and read back."""
    return digests(written(to_media(table(spark, sf_dir, "documents")), "media", options={"compression": "zstd", "parquet.compression.codec.zstd.level": 6}))
