"""Media columns: bytes in baseline JPEG files, read back as DC-only luminance thumbnails.

A payload of 64 k bytes becomes grey images of 64 blocks a row: each byte is one 8 x 8 block, all of whose AC
coefficients are zero and whose DC coefficient, under a quantiser of 8, is the byte's level less 128, so any viewer
shows a flat block of just that level. A byte's level is its place in a fixed order that puts common text bytes
side by side, which keeps the differences from block to block short. The DC table is the cheapest of PROFILES for
the file's own counts of difference categories; a restart marker follows every STRETCH blocks. A payload longer
than one image may be high takes several images.

The reader parses markers (fill bytes, several scans, restart intervals), undoes byte stuffing and Huffman-decodes
codes of any length: symbol after symbol in numpy, side by side for all restart intervals of all files of a batch that
share their tables. Of each file it reads the scan that holds the luminance and keeps the DC values: the thumbnail,
one pixel a block. Dimensions and two thumbnail hashes are the feature.

Defined cases: null texts count as empty; the payload of an empty text is 64 zero bytes; whole texts count,
however long; rows are independent, so ties, repeated rows and extra columns do not matter, and equal texts
give equal files; an empty table gives none. A file that is cut short, not baseline, not of 8-bit samples, or that
holds a code no table has, raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import name_of, ship_package, with_fields, written

UNIT, WIDTH, HEIGHT, STRETCH = 64, 64, 8191, 256  # bytes a payload is a multiple of; blocks across; most blocks down; blocks between restarts

#: Code lengths of the difference categories 0 to 8 in the DC tables: for text, for any bytes, for runs of one byte.
PROFILES = ((5, 3, 2, 2, 2, 4, 6, 7, 8), (8, 7, 6, 5, 4, 3, 2, 2, 2), (1, 5, 4, 3, 4, 4, 6, 7, 8))
_AC = (bytes([1, *[0] * 15]), b"\0")  # end of block: the code 0

#: Bytes by how common they are in text; the others follow in numeric order.
COMMON = b" ethnaiors\xc3dulgbc.,fwympvk\xa9\n!EATNIOSRqzxj0123456789-'\"():;?/"


def _levels() -> np.ndarray:
    """The level of each byte: common bytes in the middle, each next one on the other side."""
    order = [*dict.fromkeys([*COMMON, *range(256)])]
    out = np.zeros(256, np.uint8)
    out[order] = [128 + (k + 1) // 2 * (-1 if k % 2 else 1) for k in range(256)]
    return out


LEVELS = _levels()
BYTES = np.argsort(LEVELS).astype(np.uint8)


def _profile(lengths: tuple[int, ...]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body; per difference + 255: bits of the code, the magnitude and the end of block, and how many."""
    order = sorted(range(len(lengths)), key=lambda s: (lengths[s], s))
    code, before, codes = 0, 0, {}
    for s in order:
        code = code << (lengths[s] - before)
        codes[s], before = code, lengths[s]
        code += 1
    bits, wide = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        bits[diff + 255] = ((codes[s] << s) | (diff if diff > 0 else diff + (1 << s) - 1)) << 1
        wide[diff + 255] = lengths[s] + s + 1
    return bytes(sum(n == k for n in lengths) for k in range(1, 17)) + bytes(order), bits, wide


_TABLES = [_profile(p) for p in PROFILES]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan(diff: np.ndarray, bits: np.ndarray, wide: np.ndarray) -> bytes:
    """Entropy-coded intervals of STRETCH blocks, each padded with ones to a whole byte and stuffed, and markers between."""
    size = wide[diff]
    ends = np.cumsum(size)
    last = np.append(np.arange(STRETCH, len(diff), STRETCH), len(diff)) - 1
    length = np.diff(ends[last], prepend=0)
    gap = -length % 8
    start = ends - size
    if len(last) > 1:
        start += np.repeat(np.cumsum(gap) - gap, np.diff(last, prepend=-1))
    pad = start[last] + size[last]  # the ones after an interval's last block
    word = np.append(bits[diff].astype(np.int64), (1 << gap) - 1)
    start, size = np.append(start, pad), np.append(size, gap)
    word <<= 32 - size - (start & 7)
    at = start >> 3
    total = (int(pad[-1]) + 7) // 8
    out = np.zeros(total + 4, np.uint8)
    for k in range(4):  # bits of different blocks never overlap, so sums are their union
        out[k : k + total] += np.bincount(at, word >> (24 - 8 * k) & 255, total)[:total].astype(np.uint8)
    data, cuts = out[:total].tobytes(), ((pad + gap) >> 3).tolist()
    pieces = [data[a:b].replace(b"\xff", b"\xff\0") for a, b in zip([0, *cuts], cuts, strict=False)]
    return b"".join(x for k, p in enumerate(pieces) for x in ((p, bytes([0xFF, 0xD0 + k % 8])) if k < len(pieces) - 1 else (p,)))


def jpeg(levels: np.ndarray, note: bytes) -> bytes:
    """One grey image of WIDTH blocks across, from a block level (uint8) each."""
    value = levels.astype(np.int64) - 128
    diff = np.diff(value, prepend=0)
    diff[::STRETCH] = value[::STRETCH]  # a restart begins from zero
    diff += 255
    count = np.bincount(diff, minlength=511)
    body, bits, wide = min(_TABLES, key=lambda t: int(count @ t[2]))
    high = len(levels) // WIDTH
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xFE, note), segment(0xDB, b"\0" + b"\x08" * 64),
        segment(0xC0, struct.pack(">BHHB", 8, high * 8, WIDTH * 8, 1) + b"\1\x11\0"),
        segment(0xC4, b"\0" + body), segment(0xC4, b"\x10" + _AC[0] + _AC[1]), segment(0xDD, struct.pack(">H", STRETCH)),
        segment(0xDA, b"\1\1\0\0\x3f\0"), scan(diff, bits, wide), b"\xff\xd9",
    ])


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(data: bytes) -> bytes:
    """The padded payload of data as JPEG files, end to end; the first one's comment has the plain length."""
    levels = LEVELS[np.frombuffer(padded(data), np.uint8)]
    step = WIDTH * HEIGHT
    return b"".join(jpeg(levels[k : k + step], b"bytes %d of %d" % (min(step, max(0, len(data) - k)), len(data))) for k in range(0, len(levels), step))


# -- reading ---------------------------------------------------------------------------------


@dataclass
class Frame:
    """What the markers of one image say; of its scans, the one with the luminance."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # of the DC coefficient
    tables: dict[int, bytes] = field(default_factory=dict)  # counts and values, as in the file
    restart: int = 0
    comment: bytes = b""
    who: list[tuple[int, bytes, bytes]] = field(default_factory=list)  # part, DC table, AC table of the scan's components
    runs: list[bytes] = field(default_factory=list)  # its intervals, without stuffing
    level: int = 1  # the luminance's quantiser

    def blocks(self) -> tuple[int, int, int, list[tuple[int, bytes, bytes]]]:
        """Blocks across and down, units of the scan, and (part, DC table, AC table) of a unit's blocks."""
        most_x, most_y = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        _, px, py, _ = self.parts[0]
        if len(self.who) == 1:
            across, down = -(-self.width * px // (8 * most_x)), -(-self.height * py // (8 * most_y))
            return across, down, across * down, self.who
        ux, uy = -(-self.width // (8 * most_x)), -(-self.height // (8 * most_y))
        return ux, uy, ux * uy, [w for w in self.who for _ in range(self.parts[w[0]][1] * self.parts[w[0]][2])]


def table(counts_values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Canonical Huffman codes over the next 16 bits: length (0: no such code) and symbol."""
    counts, values = counts_values[:16], counts_values[16:]
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - size)
            length[code * span : (code + 1) * span] = size
            symbol[code * span : (code + 1) * span] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


_KNOWN: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def known(counts_values: bytes) -> tuple[np.ndarray, np.ndarray]:
    if counts_values not in _KNOWN:
        if len(_KNOWN) > 64:
            _KNOWN.clear()
        _KNOWN[counts_values] = table(counts_values)
    return _KNOWN[counts_values]


def images(data: bytes):
    """The Frame of each of the images that stand end to end."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        f, at = frame(data, at + 2)
        yield f


def frame(data: bytes, at: int) -> tuple[Frame, int]:
    """One image's markers from at on, and where it ends."""
    f = Frame()
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 2 > len(data):
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            if not f.runs:
                raise ValueError("no scan holds the luminance")
            return f, at
        if at + 2 > len(data):
            raise ValueError("a segment is missing")
        (size,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + size]
        if len(body) != size - 2:
            raise ValueError("a segment ends early")
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            precision, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("not of 8-bit samples")
            f.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                f.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            (f.restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            f.comment = f.comment or body
        elif marker == 0xDA:
            ids = [p[0] for p in f.parts]
            who = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(body[0])]
            runs, at = intervals(data, at)
            if any(part == 0 for part, _, _ in who):
                f.who = [(part, f.tables[dc], f.tables[ac]) for part, dc, ac in who]  # the tables as they stand here
                f.runs, f.level = runs, f.quant[f.parts[0][3]]


def intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """A scan's restart intervals without stuffing, and the place of the marker after it."""
    runs, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan does not end")
        nxt = data[at + 1]
        if nxt == 0:
            at += 2
        elif nxt == 0xFF:  # a fill byte
            at += 1
        else:
            runs.append(data[start:at].rstrip(b"\xff").replace(b"\xff\0", b"\xff") if data[at - 1] == 0xFF else data[start:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= nxt <= 0xD7:
                return runs, at
            at += 2
            start = at


def decoded(runs: list[bytes], units: np.ndarray, order: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """DC values of part 0, a row an interval: all intervals side by side, one symbol of each at a time.

    units: of each interval; order: (part, DC table, AC table) of a unit's blocks. Values past an interval's
    last unit are zero.
    """
    rank = np.argsort(-units, kind="stable")
    units = units[rank]
    sizes = np.array([len(runs[i]) for i in rank], np.int64)
    raw = np.frombuffer(b"".join(runs[i] + bytes(8) for i in rank), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    pos = (np.cumsum(sizes + 8) - sizes - 8) * 8
    end = pos + sizes * 8

    def bits(p: np.ndarray) -> np.ndarray:
        return ahead[p >> 3] << (p & 7).astype(np.uint32)  # 25 of them count

    own = sum(part == 0 for part, _, _ in order)
    n = int(units[0]) if len(units) else 0
    out = np.zeros((n * own, len(runs)), np.int32)
    held = np.zeros((1 + max(part for part, _, _ in order), len(runs)), np.int64)
    row = 0
    for u in range(n):
        live = int(np.searchsorted(-units, -u, side="left"))  # intervals with more than u units
        p = pos[:live]
        for part, dc, ac in order:
            length, symbol = known(dc)
            top = bits(p) >> np.uint32(16)
            step, s = length[top], symbol[top].astype(np.int64)
            if not step.all() or (s > 11).any():
                raise ValueError("no such code")
            p += step
            extra = (bits(p) >> np.uint32(1) >> (31 - s).astype(np.uint32)).astype(np.int64)
            p += s
            low = (s > 0) & (extra >> np.maximum(s - 1, 0) == 0)
            held[part, :live] += np.where(low, extra - (1 << s) + 1, extra)
            if part == 0:
                out[row, :live] = held[0, :live]
                row += 1
            length, symbol = known(ac)
            left, k = np.arange(live), np.ones(live, np.int64)
            while len(left):
                top = bits(p[left]) >> np.uint32(16)
                step, rs = length[top], symbol[top].astype(np.int64)
                if not step.all():
                    raise ValueError("no such code")
                p[left] += step + (rs & 15)
                k = k + (rs >> 4) + 1
                go = (rs != 0) & (k < 64)
                if ((rs != 0) & (k > 64)).any():
                    raise ValueError("a block has too many coefficients")
                if not go.any():
                    break
                left, k = left[go], k[go]
            if (p > end[:live]).any():
                raise ValueError("the scan is too short")
    if (end - pos >= 8).any():
        raise ValueError("a scan has bits left over")
    back = np.empty_like(rank)
    back[rank] = np.arange(len(rank))
    return out.T[back]


def thumbnails(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, height in pixels and thumbnail of each of files; an entry's images stand one below the other."""
    frames = [list(images(data)) for data in files]
    together: dict[tuple, list[tuple[Frame, int, int]]] = {}  # frames by the order of their units' blocks
    for f in (f for fs in frames for f in fs):
        across, down, units, order = f.blocks()
        per = f.restart or units
        if len(f.runs) != max(1, -(-units // per)):
            raise ValueError("an interval is missing")
        together.setdefault(tuple(order), []).append((f, units, per))
    values: dict[int, np.ndarray] = {}
    for order, members in together.items():
        runs = [r for f, _, _ in members for r in f.runs]
        n = np.concatenate([np.minimum(per, units - per * np.arange(len(f.runs))) for f, units, per in members])
        got, at = decoded(runs, n, list(order)), 0
        own = sum(part == 0 for part, _, _ in order)
        for f, units, per in members:
            mine = got[at : at + len(f.runs)]
            at += len(f.runs)
            values[id(f)] = mine[:, : per * own].reshape(-1)[: units * own]
    out = []
    for fs in frames:
        if not fs:
            raise ValueError("no image")
        pixels = [luminance(f, values[id(f)]) for f in fs]
        out.append((fs[0].width, sum(f.height for f in fs), np.concatenate(pixels)))
    return out


def luminance(f: Frame, dc: np.ndarray) -> np.ndarray:
    """The thumbnail: one pixel for each luminance block."""
    across, down, _, order = f.blocks()
    pixels = np.clip(np.floor_divide(dc.astype(np.int64) * f.level + 4, 8) + 128, 0, 255).astype(np.uint8)
    if len(f.who) == 1:
        return pixels.reshape(down, across)
    most_x, most_y = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    _, px, py, _ = f.parts[0]
    tiles = pixels.reshape(down, across, py, px).transpose(0, 2, 1, 3).reshape(down * py, across * px)
    return tiles[: -(-f.height * py // (8 * most_y)), : -(-f.width * px // (8 * most_x))]


def thumbnail(data: bytes) -> tuple[int, int, np.ndarray]:
    return thumbnails([data])[0]


def shrunk(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid; where the image has fewer pixels, the nearest ones."""
    r, c = (np.arange(n + 1) * size // n for n, size in ((rows, pixels.shape[0]), (cols, pixels.shape[1])))
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r0, c0 = np.minimum(r[:-1], pixels.shape[0] - 1), np.minimum(c[:-1], pixels.shape[1] - 1)
    r1, c1 = np.maximum(r[1:], r0 + 1), np.maximum(c[1:], c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)
    return (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area


def hashes(pixels: np.ndarray) -> str:
    """Average hash and difference hash, 64 bits each, as hex."""
    small, steps = shrunk(pixels, 8, 8), shrunk(pixels, 8, 9)
    return f"{np.packbits(small > small.mean()).tobytes().hex()}:{np.packbits(steps[:, 1:] > steps[:, :-1]).tobytes().hex()}"


# -- columns ---------------------------------------------------------------------------------


def with_media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and media: each whole text's UTF-8 bytes as JPEG files."""
    import pyarrow as pa

    ship_package(df.sparkSession)

    def work(batches):
        for batch in batches:
            for a, b in slices(batch.column("__text")):
                part = batch.slice(a, b - a)
                media = [store(t.as_py() or b"") for t in part.column("__text")]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(media, pa.binary())], names=[*keep, "media"])

    return df.select(*map(name_of, keep), F.col(text).cast("binary").alias("__text")).mapInArrow(work, with_fields(df, keep, "media binary"))


def described(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and what the stored media say: dimensions, payload, hashes."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "width": "int", "height": "int", "feature": "string"}
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def facts(media: bytes, wide: int, high: int, pixels: np.ndarray) -> tuple:
        payload = BYTES[pixels].tobytes()
        plain = int(media[: media.index(b"\xff\xdb")].rpartition(b" ")[2])  # the first comment stands before the quantiser
        return plain, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), wide, high, f"{wide}x{high}:{hashes(pixels)}"

    def work(batches):
        for batch in batches:
            for a, b in slices(batch.column("media"), 2_000_000):
                part = batch.slice(a, b - a)
                files = part.column("media").to_pylist()
                rows = [facts(m, *t) for m, t in zip(files, thumbnails(files), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array([r[i] for r in rows], types[t]) for i, t in enumerate(kinds.values()))], names=[*keep, *kinds])

    return df.select(*map(name_of, keep), "media").mapInArrow(work, with_fields(df, keep, ", ".join(f"{k} {v}" for k, v in kinds.items())))


def op2(docs: DataFrame) -> DataFrame:
    """Per document: stored losslessly as media in a table of the shared folder, read back from there, described."""
    return described(written(with_media(docs), "media", compression="zstd"))
