"""Token ids in binary shards, with a minimal perfect hash index over document keys.

Format, in one folder. `shard-PPPPPP-KKKK.ids`: a header (magic, id width in bytes, documents, ids), the number of ids
of each document, then the raw ids of documents, little-endian, one after the other in ascending doc_id order (null
first, equal ids by text hash); shards in order of P, K continue each other. `index-BBBBBB.mph`: for the keys that hash
to bucket B a minimal perfect hash (hash and displace: per small bucket of keys a displacement that puts all its keys on
free slots; single keys name their slot), a 32-bit fingerprint per slot that rejects foreign keys, and the slot's
entries: shard, place of the key's first document in it, how many documents, and the number of ids before the first in
all shards. A key costs one hash, one displacement, one slot: constant time, whatever the corpus. Rows of one key stand
together, so a key has one entry a shard however often it is repeated. A shard that is asked for in good part is read
once; else each entry is one ranged read.

Ids come from the tokenizers library. Where the tokenizer's file says that white space separates tokens, every distinct
word of a batch goes through the library once and a text is its words' ids in order; else whole texts go through it.
Where its split pattern is SPLIT, a text of PLAIN characters (Latin letters, digits, marks, white space: their classes,
lower case and NFC are the same in every version of Unicode) is cut by that pattern here, and its distinct pieces, fewer
than its words, go through the library many at a time, side by side; the end-of-word mark shows where each one's ids end.
Documents are dealt by ranges of (doc_id, text hash), so one repeated id does not fill one shard; files are
written under another name and moved, so a task that is run again leaves the same files.

Defined cases: null text counts as empty and gets the end id only; null doc_id is a key of its own; repeated
rows are documents of their own under one key, in order; whole texts count, however long; extra columns do not
matter; an empty table writes no shard and returns no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import NOT_SPACE, SPACE, checked, slices
from .common import bunches, new_path, ship_package, written
from .minhash import mixed

END = 1
SHARD_BYTES, INDEX_KEYS = 16_000_000, 40_000
CACHE_WORDS, SIDE_BY_SIDE = 1_400_000, 400
#: The split pattern that PIECES follows on lower-cased text of PLAIN characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES, _LETTERS = r"\t-\r ", "a-z\xdf-\xf6\xf8-\u0148\u014a-\u017f"
NOT_PLAIN = re.compile(r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017f\u2010-\u2027]")
PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}0-9]+")
GOOD_PART = 0.2  # of a shard's ids: from that share on the shard is read whole
HEAD, INDEX = "<4sIQQ", "<4sQQQQ"  # struct formats
HEAD_BYTES, INDEX_BYTES = struct.calcsize(HEAD), struct.calcsize(INDEX)


# -- files in the shared folder --------------------------------------------------------------


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under another name, then move it: readers see all of it or nothing."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    task = TaskContext.get()
    temporary = f"{path}/.{name}.{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(temporary) as f:
        for p in parts:
            f.write(p)
    store.move(temporary, f"{path}/{name}")


# -- encoding --------------------------------------------------------------------------------


class Pieces(dict):
    """Pieces by the order in which they are first met; added: those met since it was last emptied."""

    def __init__(self) -> None:
        self.added: list[str] = []

    def __missing__(self, piece: str) -> int:
        value = self[piece] = len(self)
        self.added.append(piece)
        return value


class WordIds:
    """The ids of texts, as bytes, through the tokenizers library."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, self.by_piece = spec["model"].get("end_of_word_suffix"), False
        try:
            self.by_word = bool(checked(spec))
            self.by_piece = bool(suffix) and checked(spec) == SPLIT
        except ValueError:
            self.by_word = False
        vocab = self.tokenizer.get_vocab()
        self.kind = "<u2" if len(vocab) <= 1 << 16 else "<u4"
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)  # does the token end a piece?
        if self.by_piece:
            self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.pieces, self.flat, self.ends = Pieces(), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(got.ids, self.kind).tobytes()
            return
        if len(self.known) + len(self.pieces) > CACHE_WORDS:
            self.forget()
        plain = [self.by_piece and not NOT_PLAIN.search(t) and not any(s in t for s in self.special) for t in texts]
        cut = self.of_pieces([t for t, p in zip(texts, plain, strict=True) if p])
        whole = self.of_words([t for t, p in zip(texts, plain, strict=True) if not p])
        for p in plain:
            yield next(cut if p else whole)

    def of_words(self, texts: list[str]) -> Iterator[bytes]:
        split = [[w for w in SPACE.split(t) if w] if NOT_SPACE.search(t) else t.split() for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        for word, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[word] = np.array(got.ids, self.kind).tobytes()
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words))

    def of_pieces(self, texts: list[str]) -> Iterator[bytes]:
        split = [PIECES.findall(t.lower()) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        self.learn()
        first = self.ends[at]
        n = self.ends[at + 1] - first
        stop = np.cumsum(n)
        raw = self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - stop + n, n)].tobytes()
        edge = (np.append(0, stop)[np.append(0, np.cumsum(size))] * self.flat.itemsize).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            yield raw[a:b]

    def learn(self) -> None:
        """The ids of the pieces that were added, behind those of the others."""
        new, self.pieces.added = self.pieces.added, []
        groups = [new[k : k + SIDE_BY_SIDE] for k in range(0, len(new), SIDE_BY_SIDE)]
        flats, sizes = [self.flat], []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            stop = np.flatnonzero(self.closes[ids]) + 1
            if len(stop) == len(group) and stop[-1] == len(ids):
                n = np.diff(stop, prepend=0)
            else:  # a piece that the library leaves out, or cuts in several
                each = [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                ids, n = np.concatenate(each), np.array([len(x) for x in each])
            flats.append(ids)
            sizes.append(n)
        if groups:
            self.flat = np.concatenate(flats)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


# -- the index -------------------------------------------------------------------------------


def key_hash(keys: list) -> np.ndarray:
    """64-bit hashes of keys: of integers, texts or null."""
    import hashlib

    if all(isinstance(k, int) for k in keys):
        return mixed(np.array(keys, np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([int.from_bytes(hashlib.blake2b(repr(k).encode(), digest_size=8).digest(), "little") if not isinstance(k, int) else int(key_hash([k])[0]) for k in keys], np.uint64)


def place(h: np.ndarray, displacement: np.ndarray, slots: int) -> np.ndarray:
    """Slot of a hash under a displacement."""
    return (mixed(h + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket (negative: -1 - slot of its only key) and the slot of every hash; all differ."""
    n = len(h)
    groups = max(1, n // 3)
    group = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=groups)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    shift, slot, used = np.zeros(groups, np.int32), np.full(n, -1), np.zeros(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    for g in np.argsort(-size, kind="stable"):
        if size[g] < 2:
            break
        mine = order[first[g] : first[g] + size[g]]
        start = 0
        while True:
            d = tries + np.uint64(start)
            at = place(h[mine][None, :], d[:, None], n)
            good = ~used[at].any(axis=1)
            if size[g] > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                shift[g], slot[mine] = start + hit[0], at[hit[0]]
                used[at[hit[0]]] = True
                break
            start += 64
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~used)
    slot[order[first[single]]] = free
    shift[single] = -1 - free
    return shift, slot


def build(keys: list, entries: list[list[tuple[int, int, int, int]]]) -> bytes:
    """An index file: entries[i] are those of keys[i]; keys are distinct."""
    h = key_hash(keys)
    shift, slot = perfect_hash(h)
    by_slot = np.argsort(slot)
    count = np.array([len(entries[i]) for i in by_slot], np.uint32)
    flat = np.array([e for i in by_slot for e in entries[i]], np.int64).reshape(-1, 4)
    start = np.concatenate([[0], np.cumsum(count)]).astype("<u4")
    return struct.pack(INDEX, b"TKMP", len(keys), len(shift), len(flat), 1) + shift.astype("<i4").tobytes() + fingerprint(h)[by_slot].astype("<u4").tobytes() + start.tobytes() + flat.astype("<i8").tobytes()


class Index:
    """A read index file."""

    def __init__(self, data: bytes) -> None:
        magic, n, groups, m, _ = struct.unpack_from(INDEX, data)
        if magic != b"TKMP":
            raise ValueError("not an index")
        at = INDEX_BYTES
        self.shift = np.frombuffer(data, "<i4", groups, at)
        self.marks = np.frombuffer(data, "<u4", n, at + 4 * groups)
        self.start = np.frombuffer(data, "<u4", n + 1, at + 4 * (groups + n))
        self.flat = np.frombuffer(data, "<i8", 4 * m, at + 4 * (groups + n + n + 1)).reshape(-1, 4)

    def find(self, keys: list) -> list[np.ndarray]:
        """Each key's entries (shard, place, documents, ids before); none for a key that is not here."""
        if not len(self.marks):
            return [self.flat[:0]] * len(keys)
        h = key_hash(keys)
        shift = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, place(h, np.maximum(shift, 0), len(self.marks)))
        known = self.marks[slot] == fingerprint(h)
        return [self.flat[self.start[s] : self.start[s + 1]] if k else self.flat[:0] for s, k in zip(slot.tolist(), known.tolist(), strict=True)]


# -- on Spark --------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write shards and index of docs (doc_id, text) into folder; returns the shard table (shard, ids, before)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def shards(batches):
        enc = word_ids(tokenizer)
        last = np.array([end], enc.kind).tobytes()
        width, part = len(last), TaskContext.get().partitionId()
        held, size, number = [], 0, 0

        def flush():
            counts = np.array([len(x) // width for x in held], "<u4").tobytes()
            put(folder, f"shard-{part:06d}-{number:04d}.ids", [struct.pack(HEAD, b"TKID", width, len(held), size // width), counts, *held])

        for batch in batches:
            for a, b in slices(batch.column("text")):
                piece = batch.slice(a, b - a)
                rows = []
                for raw in enc.encode_batch(piece.column("text").to_pylist()):
                    raw += last
                    if held and size + len(raw) > SHARD_BYTES:
                        flush()
                        held, size, number = [], 0, number + 1
                    rows.append((part << 20 | number, len(held), size // width, len(raw) // width))
                    held.append(raw)
                    size += len(raw)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], names=["doc_id", "shard", "place", "offset", "n"])
        if held:
            flush()

    where = written(dealt.select("doc_id", "text").mapInArrow(shards, f"doc_id {kind}, shard long, place long, offset long, n long"), "places")
    # ids before each shard: of the parts before, then of the part's own shards before
    table = where.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs")).withColumn("part", F.shiftright("shard", 20))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("ids").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = written(table.withColumn("own", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(parts, "part").select("shard", "ids", "docs", (F.col("base") + F.col("own")).alias("before")), "shards")
    total = table.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // INDEX_KEYS))

    def index(key, rows):
        rows = rows.sort_by([("shard", "ascending"), ("place", "ascending")])
        entries: dict = {}
        for k, *e in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "shard", "place", "docs", "start")), strict=True):
            entries.setdefault(k, []).append(tuple(e))
        put(folder, f"index-{key[0].as_py():06d}.mph", [build(list(entries), list(entries.values()))])
        return pa.table({"bucket": [key[0].as_py()], "keys": [len(entries)]}, schema=pa.schema([("bucket", pa.int32()), ("keys", pa.int64())]))

    runs = where.groupBy("doc_id", "shard").agg(F.min("place").alias("place"), F.count("*").alias("docs"), F.min("offset").alias("offset"))
    placed = runs.join(table.select("shard", "before"), "shard").select("doc_id", "shard", "place", "docs", (F.col("before") + F.col("offset")).alias("start"), bucket(buckets))
    written(placed.groupBy("bucket").applyInArrow(index, "bucket int, keys long"), "index")
    put(folder, "buckets", [str(buckets).encode()])
    return table


def bucket(n: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(1)), F.lit(n)).cast("int").alias("bucket")


def read(spark: SparkSession, keys: DataFrame, folder: str, digests: bool = True) -> DataFrame:
    """Look up each distinct doc_id of keys through the index and read its documents from the shards.

    doc_id, start, n_tokens and, with digests, ids_crc32 (of the ids as little-endian uint32), else ids.
    """
    import pyarrow as pa

    ship_package(spark)
    store, path = filesystem(folder)
    with store.open_input_stream(f"{path}/buckets") as f:
        buckets = int(f.read())
    kind = keys.schema["doc_id"].dataType.simpleString()
    asked = keys.select("doc_id").distinct().withColumn("bucket", bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket")

    def find(batches):
        now, index = None, None
        for batch in batches:
            at, key = batch.column("bucket").to_numpy(), batch.column("doc_id")
            for b in np.unique(at):
                if b != now:
                    disk, base = filesystem(folder)
                    with disk.open_input_stream(f"{base}/index-{b:06d}.mph") as f:
                        now, index = b, Index(f.read())
                mine = key.filter(pa.array(at == b))
                got = index.find(mine.to_pylist())
                take = np.repeat(np.arange(len(mine)), [len(g) for g in got])
                flat = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(take)), *(pa.array(flat[:, k]) for k in range(4))], names=["doc_id", "shard", "place", "docs", "start"])

    hits = asked.mapInArrow(find, f"doc_id {kind}, shard long, place long, docs long, start long")

    def fetch(batches):
        for rows, start in bunches(batches, ["shard"]):
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
                yield from of_shard(rows.slice(a, b - a))

    def of_shard(rows):
        s = rows.column("shard")[0].as_py()
        place, docs, start = (rows.column(k).to_numpy() for k in ("place", "docs", "start"))
        disk, base = filesystem(folder)
        with disk.open_input_file(f"{base}/shard-{s >> 20:06d}-{s & 0xFFFFF:04d}.ids") as f:
            magic, width, n, ids = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
            counts = np.frombuffer(f.read_at(4 * n, HEAD_BYTES), "<u4").astype(np.int64)
            if magic != b"TKID" or len(counts) != n or counts.sum() != ids:
                raise ValueError("not a whole shard")
            ends, first = np.cumsum(counts), HEAD_BYTES + 4 * n
            edge = np.append(0, ends)
            lo, hi = edge[place], edge[place + docs]
            whole = f.read_at(ids * width, first) if (hi - lo).sum() >= GOOD_PART * ids else None
            out: list = []
            for a, b, p, d, at in zip(lo.tolist(), hi.tolist(), place.tolist(), docs.tolist(), start.tolist(), strict=True):
                raw = whole[a * width : b * width] if whole is not None else f.read_at((b - a) * width, first + a * width)
                if len(raw) != (b - a) * width:
                    raise ValueError("a shard ends early")
                mine = np.frombuffer(raw, f"<u{width}").astype("<u4")
                cuts = (edge[p : p + d + 1] - a).tolist()
                for x, y in zip(cuts, cuts[1:], strict=False):
                    out.append((at + x, y - x, zlib.crc32(mine[x:y]) if digests else mine[x:y].tolist()))
        take = pa.array(np.repeat(np.arange(len(rows)), docs))
        keys = rows.column("doc_id").combine_chunks().take(take)
        for k in range(0, len(out), 5000):
            part = out[k : k + 5000]
            yield pa.RecordBatch.from_arrays([keys.slice(k, len(part)), *(pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64() if digests else pa.list_(pa.int64()))))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return hits.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(fetch, f"doc_id {kind}, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def op1(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of docs, through files and index."""
    folder = new_path(docs.sparkSession, "token-ids")
    write(docs, tokenizer, folder)
    return read(docs.sparkSession, docs, folder)
