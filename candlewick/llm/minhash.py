"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set is its distinct five-word shingles as mixed 64-bit hashes. One permutation: the hash's high
bits name one of the bins, a bin keeps its smallest hash, and each empty bin borrows from the occupied bin
that a fixed random table ranks first for it. Bands of some bins each give bucket keys. Documents with equal
sets form one class first, so copies cost one row. In every bucket each member is paired with the smallest
id only (a star). Candidates pass two exact bounds (sizes; a parity sketch whose Hamming distance never
exceeds the symmetric difference) and are confirmed on full sets made from whole texts; only the texts of such pairs
are shuffled for that.

A star alone could miss links between two members that both differ from the centre. So buckets whose members
still lie in several components are compared within (those of more than TILE members first with up to CENTRES further
centres), all outside the largest component with all, in tiles of TILE x TILE members, and pairs of different
components that the bounds allow are confirmed as well: first the NEAREST closest of two components in a
tile, then more, until none is left out. The only approximation is the bucketing: a pair at the threshold of
its Scheme (0.85 for op6, 0.8 for the pipeline) shares no bucket with probability below 1e-6.

Defined cases: null or wordless texts have an empty set and link with nothing; rows whose doc_id is null link
with nothing and are kept, with a null component; repeated rows share a class; a doc_id that occurs with
several texts belongs to the component of each of them (its smallest is returned); empty tables give none.
"""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import groups, removed, ship_package, written, written_at

WORDS = 5
TILE, NEAREST, CENTRES = 400, 8, 4
CACHE_WORDS = 150_000
CELLS = 1 << 23  # bits that stand for ids


class Scheme(NamedTuple):
    """Pairs link from a similarity of num / den on; bands of rows bins each find them."""

    num: int
    den: int
    bands: int
    rows: int


#: A pair at the threshold is missed with a probability of (1 - threshold ** rows) ** bands: 3e-7 and 6e-7.
AT_85, AT_80 = Scheme(85, 100, 32, 6), Scheme(80, 100, 36, 5)

_MASK = (1 << 64) - 1


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


_STEP = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & _MASK) for k in range(max(WORDS, AT_85.rows, AT_80.rows) + 1)]


@cache
def _tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bin starts, and for each bin the ranks of those to borrow from."""
    return np.array([(k << 64) // bins for k in range(bins)], np.uint64), mixed(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins)


class WordHash(dict):
    """64-bit hash of each word, kept up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_WORDS = WordHash()


def shingles(text: bytes | None) -> np.ndarray:
    """The document's set, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += mixed(h[k : k + n] + _STEP[k])  * _STEP[k]
    return np.unique(mixed(total))


def signature(values: np.ndarray, scheme: Scheme = AT_85) -> np.ndarray:
    """The bins' minima of an ascending, non-empty set, densified."""
    bins = scheme.bands * scheme.rows
    edges, ranks = _tables(bins)
    at = np.searchsorted(values, edges)
    ends = np.append(at[1:], len(values))
    full = np.flatnonzero(at < ends)
    out = np.zeros(bins, np.uint64)
    out[full] = values[at[full]]
    if len(full) < bins:
        empty = np.flatnonzero(at >= ends)
        out[empty] = out[full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def buckets(sig: np.ndarray, scheme: Scheme = AT_85) -> np.ndarray:
    rows = sig.reshape(scheme.bands, scheme.rows)
    total = mixed(np.arange(1, scheme.bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for k in range(scheme.rows):
        total = mixed(total + rows[:, k] * _STEP[k])
    return total.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the set over at least two cells a member, as bytes; a power of two of them, eight or more."""
    cells = max(64, 1 << int(2 * len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(cells - 1)).astype(np.intp), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(s: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set over fewer cells."""
    return np.bitwise_xor.reduce(s.reshape(-1, size), axis=0)


def may_link(na, nb, distance, scheme: Scheme = AT_85):
    """Exact: no pair of sets with this many parities apart links if this is false."""
    return (scheme.den + scheme.num) * distance <= (scheme.den - scheme.num) * (na + nb)


def links(a: np.ndarray, b: np.ndarray, scheme: Scheme = AT_85) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return scheme.den * both >= scheme.num * (len(a) + len(b) - both)


def digests(docs: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """doc_id, n_shingles, key (of the set), bands, sketch for every row; the last three null for empty sets."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = [shingles(t.as_py()) for t in part.column("text")]
                some = [len(s) > 0 for s in sets]
                each = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), buckets(signature(s, scheme), scheme).tolist(), sketch(s).tobytes()) if k else (None, None, None) for s, k in zip(sets, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([e[0] for e in each], pa.binary()), pa.array([e[1] for e in each], pa.list_(pa.int64())), pa.array([e[2] for e in each], pa.binary())], names=["doc_id", "n_shingles", "key", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, f"doc_id {kind}, n_shingles long, key binary, bands array<long>, sketch binary")


def plausible(pairs: DataFrame, classes: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """a, b, key_a, key_b of the pairs that the exact bounds allow."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n_a", "n_b"))
            keep = (scheme.den * np.minimum(na, nb) >= scheme.num * np.maximum(na, nb)).tolist()
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint8) for k in ("sketch_a", "sketch_b"))
                size = min(len(x), len(y))
                keep[i] = bool(may_link(na[i], nb[i], int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), scheme))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b", "key_a", "key_b")], names=["a", "b", "key_a", "key_b"])

    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"), F.col("key").alias(f"key_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(work, f"a {kind}, b {kind}, key_a binary, key_b binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows of docs whose id is in ids (id).

    A bitmap of CELLS bits, marked by the ids' hashes, passes over docs first, so of the other texts only a share (that of
    marked cells) is shuffled; the join that follows is exact. The bitmap never exceeds CELLS / 64 words.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS))
    word, bit = (lambda c: F.shiftright(cell(c), 6)), (lambda c: (cell(c) % 64).cast("int"))
    marks = ids.select(word("id").alias("word"), F.expr("shiftleft(1L, cast(pmod(pmod(xxhash64(id), %d), 64) as int))" % CELLS).alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    some = docs.select("doc_id", "text").withColumn("word", word("doc_id")).join(F.broadcast(marks), "word").where(F.getbit("marks", bit("doc_id")) == 1)
    # no semi join, which the optimizer would move before the bitmap
    return some.join(ids.distinct().hint("merge"), F.col("doc_id") == F.col("id")).select("doc_id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """a, b of the pairs that link on full sets; texts whose set is not the class's are another row's."""
    import pyarrow as pa

    kind = pairs.schema["a"].dataType.simpleString()
    pairs = written(pairs, "candidates")
    docs = written(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "texts")
    side = lambda s: docs.select(F.col("doc_id").alias(s), F.col("text").cast("binary").alias(f"text_{s}")).where(F.col(s).isNotNull())

    def work(batches):
        key, centre = None, None
        for batch in batches:
            good = []
            for kb, ka, tb, ta in zip(*(batch.column(k) for k in ("key_b", "key_a", "text_b", "text_a")), strict=True):
                if kb.as_py() != key:
                    s = shingles(tb.as_py())
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != kb.as_py():
                        good.append(False)
                        continue
                    key, centre = kb.as_py(), s
                s = shingles(ta.as_py())
                good.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() == ka.as_py() and links(s, centre, scheme))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(work, f"a {kind}, b {kind}")


def stars(edges: DataFrame) -> DataFrame:
    """a, b with b the smallest id that a reaches over edges (a, b); roots are left out.

    Large-star and small-star turns, each a minimum per node and a join back, until nothing changes.
    """
    flat = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    (now, path), before = written_at(flat(edges), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, (now, path) = path, written_at(flat(small), "edges")
        removed(now.sparkSession, old)


def tile_pairs(n, comp, rep, own, raw: list[np.ndarray], across: bool, nearest: int, scheme: Scheme = AT_85) -> tuple[list[tuple[int, int]], bool]:
    """Of one tile's members, ascending by n: places of the pairs to confirm, and whether any were left out."""
    length = np.array([len(s) for s in raw])
    fold: dict[int, np.ndarray] = {}
    found: list[tuple[int, int, int]] = []
    for i in range(len(n)):
        last = int(np.searchsorted(n, n[i] * scheme.den // scheme.num, side="right"))
        at = np.arange(i + 1, last)
        at = at[(comp[at] != comp[i]) & ((own[at] != own[i]) if across else True)]
        if not len(at):
            continue
        size = int(length[i])
        if size not in fold:
            fold = {size: np.zeros((len(n), size), np.uint8)}
            for j in np.flatnonzero(length >= size):
                fold[size][j] = folded(raw[j], size)
        apart = np.bitwise_count(fold[size][at] ^ fold[size][i]).sum(axis=1, dtype=np.int64)
        good = may_link(n[i], n[at], apart, scheme)
        found += [(int(d), i, int(j)) for d, j in zip(apart[good], at[good], strict=True)]
    found.sort()
    taken: dict[tuple, int] = {}
    out = []
    for _, i, j in found:
        pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
        taken[pair] = k = taken.get(pair, 0) + 1
        if k <= nearest:
            out.append((i, j) if rep[i] > rep[j] else (j, i))
    return out, any(k > nearest for k in taken.values())


def dealt(members: DataFrame) -> DataFrame:
    """members of opened() with own, lo, hi, once for every tile (lo, hi) of their bucket that they are in."""
    few, many = F.ceil(F.col("others") / TILE).cast("int"), F.ceil((F.col("size") - F.col("others")) / TILE).cast("int")
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(6)), n.cast("long")).cast("int")
    own = F.when(F.col("rest"), part(few)).otherwise(few + part(many))
    return members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), few + many - 1).otherwise(few - 1)))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})


def tiles(members: DataFrame, nearest: int, scheme: Scheme = AT_85) -> DataFrame:
    """Pairs of members of one bucket, in different components, that the bounds allow.

    members: those of opened(), with n, sketch, key. The members of a bucket's largest component meet the others only, not
    one another, so with few others rows grow as the bucket does. Returns a, b, key_a, key_b, more, bucket;
    more: the tile left pairs of these two components out, beyond the nearest ones. Tiles come sorted through
    a partition, so only one of them, of at most 2 x TILE rows, is held at a time.
    """
    import pyarrow as pa

    kind = members.schema["rep"].dataType.simpleString()
    tile = ["bucket", "lo", "hi"]
    columns = [*tile, "rep", "comp", "n", "sketch", "key", "own"]

    def pairs_of(part: pa.Table) -> list[tuple]:
        n, comp, rep, own, lo, hi = (part.column(k).to_numpy() if k not in ("rep", "comp") else np.array(part.column(k).to_pylist(), object) for k in ("n", "comp", "rep", "own", "lo", "hi"))
        raw = [np.frombuffer(v, np.uint8) for v in part.column("sketch").to_pylist()]
        key, bucket = part.column("key").to_pylist(), part.column("bucket")[0].as_py()
        places, more = tile_pairs(n, comp, rep, own, raw, bool(lo[0] != hi[0]), nearest, scheme)
        return [(rep[i], rep[j], key[i], key[j], more, bucket) for i, j in places]

    def work(batches):
        out = []
        for part in groups(batches, tile):
            if len(part) > 1:
                out += pairs_of(part)
            if len(out) >= 1000:
                yield rows_of(out, part.column("rep").type)
                out = []
        if out:
            yield rows_of(out, part.column("rep").type)

    def rows_of(out, type_):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((type_, type_, pa.binary(), pa.binary(), pa.bool_(), pa.int64()))], names=["a", "b", "key_a", "key_b", "more", "bucket"])

    return dealt(members).select(*columns).repartition(*[F.col(k) for k in tile]).sortWithinPartitions(*tile, "n", "rep").mapInArrow(work, f"a {kind}, b {kind}, key_a binary, key_b binary, more boolean, bucket long")


def opened(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, rep, comp, size, rest, others of the members (bucket, rep) of buckets that lie in several components.

    rest: outside the component with most members in the bucket; others: how many such members the bucket has.
    """
    bucket = Window.partitionBy("bucket")
    placed = members.select("bucket", "rep").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("comp"))
    split = placed.withColumns({"low": F.min("comp").over(bucket), "high": F.max("comp").over(bucket), "size": F.count("*").over(bucket)}).where("low <> high").drop("low", "high")
    alike = F.count("*").over(Window.partitionBy("bucket", "comp"))
    main = split.withColumn("alike", alike).withColumn("main", F.max(F.struct("alike", "comp")).over(bucket)).withColumn("rest", F.col("comp") != F.col("main.comp"))
    return written(main.withColumn("others", F.sum(F.col("rest").cast("long")).over(bucket)).select("bucket", "rep", "comp", "size", "rest", "others"), "split")


def components(docs: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = written(digests(docs, scheme), "digests")
    whole = rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(whole.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    member = classes.select("rep", F.explode("bands").alias("bucket"))
    bucket = Window.partitionBy("bucket")
    meeting = written(member.withColumns({"b": F.min("rep").over(bucket), "size": F.count("*").over(bucket)}).where("size > 1"), "meeting")
    linked = lambda pairs: written(confirmed(plausible(pairs.distinct(), classes, scheme), docs, scheme), "links")
    roots = stars(linked(meeting.where("rep <> b").select(F.col("rep").alias("a"), "b")))
    split, turn, nearest = opened(meeting, roots), 0, NEAREST
    while turn < CENTRES and split.where(F.col("size") > TILE).limit(1).count():
        turn += 1  # large buckets: each turn one more centre, as every component that joins another spares its tiles
        centre = split.where(F.col("size") > TILE).groupBy("bucket").agg(F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn))).alias("c"))
        fresh = linked(split.join(centre, "bucket").where(F.col("comp") != F.col("c.comp")).select(F.greatest("rep", "c.rep").alias("a"), F.least("rep", "c.rep").alias("b")))
        if not fresh.limit(1).count():
            break
        roots = stars(roots.unionByName(fresh))
        split = opened(split, roots)
    while True:
        found = written(tiles(split.join(classes.select("rep", "n", "sketch", "key"), "rep"), nearest, scheme), "pairs")
        more = found.where("more").limit(1).count()
        fresh = written(confirmed(found.select("a", "b", "key_a", "key_b").distinct(), docs, scheme), "links")
        if fresh.limit(1).count():
            roots = stars(roots.unionByName(fresh))
        if not more:
            break
        # a bucket that left nothing out has had all its pairs confirmed
        split = opened(split.join(found.where("more").select("bucket").distinct(), "bucket", "left_semi"), roots)
        nearest *= 8
    of = rows.select("doc_id", "key").join(classes.select("key", "rep"), "key").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left")
    of = of.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    return rows.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
