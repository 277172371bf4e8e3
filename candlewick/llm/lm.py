"""Language-model scoring: a gated recurrent network with a class-factored softmax, over exact corpus counts.

Texts are tokenised once: A-Z lower-cased, words between ASCII white space, one end token. Documents travel in
chunks of CHUNK bytes of text; a chunk has its distinct words as 64-bit hashes and every token as an index into
them. Counts over all training documents come from the chunks' distinct words, dealt by hash into parts of a
bounded size; each part answers every chunk with the counts of its words. Beyond SHELF chunks, a part's chunks are
merged by shelf first, so a word that every chunk has does not fill its part.

Model. The LISTED most frequent words have places of their own, grouped by rank into classes of MEMBERS; the
other words fall into classes by their last two bytes, the SUFFIXES heaviest endings apart and the rest
together; the end is a class. P(word) = P(class | state) P(word | class, state), where within an ending's class
P = (c + 1) / (n + v + 1) from corpus counts: c of the word, n tokens and v words of the class, so unseen words
have a share. The state is a gated recurrent unit's. In scoring, a chunk's documents run side by side, ROWS at a time, and every
document's state is carried across windows of WINDOW tokens to its end.

Training, in numpy by truncated backpropagation with Adam: first on runs of 2 * WINDOW tokens of about WARM
documents on the driver, then on every token of every training document: each goes whole to one of TRAINERS or more
workers (one for each SHARE tokens of the corpus), which start from the warm weights and read LANES documents side
by side, window after window, the state carried from a document's start to its end. Their averages, weighted by
tokens and taken MERGED at a time, are the model. So weights, counts, classes and lists all follow the whole corpus.

Defined cases: null text counts as empty (the end token only); rows with null doc_id hash as the empty text;
repeated rows train and score each time; words of equal count are ranked by hash; whole texts count, however long;
extra columns do not matter; without training documents every class is equally likely and base_score uses N = V = 0;
an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, ship_package, written

CHUNK, PART, SHELF = 4_000_000, 1_500_000, 1000  # bytes of text in a chunk; distinct (chunk, word) entries in a counting part; chunks on a shelf
LISTED, MEMBERS, SUFFIXES, HIDDEN = 1536, 48, 48, 24
WINDOW, LANES, WARM, WARM_EPOCHS, TRAINERS, SHARE, RATE = 32, 256, 4096, 4, 12, 10_000_000, 0.01  # at least TRAINERS of at most about SHARE tokens
MERGED = 32  # models averaged in one go
ROWS = 1024  # rows of logits at a time: they stay in a core's cache from one sum to the next
LOG10 = float(np.log(10))


# -- tokens ----------------------------------------------------------------------------------


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; per token an index into the distinct hashes; these, ascending; their endings."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    # Arrow's ASCII functions work on bytes, valid UTF-8 or not, and split where bytes.split() does
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words
    edge = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    n = np.diff(edge[split.offsets.to_numpy()])
    words = words.filter(real).dictionary_encode()
    distinct = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
    ending = np.fromiter([int.from_bytes(w[-2:], "little") for w in distinct[first]], np.uint16, len(first))
    return n, back.astype(np.uint32)[words.indices.to_numpy()], uniq, ending


def squeezed(tokens: np.ndarray) -> bytes:
    """Token indices as zstd-compressed uint32: most of what a chunk weighs, written once and shuffled once."""
    import pyarrow as pa

    return pa.compress(tokens.astype("<u4").tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), "<u4")


def chunked(docs: DataFrame) -> DataFrame:
    """docs: doc_id, train, text (binary). One row a chunk: see the module's first paragraph."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(part: int, number: int, ids, type_, train: list[bool], texts: list[bytes]):
        n, tokens, uniq, ending = hashed(texts)
        owner = np.repeat(np.asarray(train, bool), n)
        count = np.bincount(tokens[owner], minlength=len(uniq)).astype("<u4")
        cells = [pa.array([part << 24 | number], pa.int64()), pa.array([ids], pa.list_(type_)), pa.array([np.asarray(train, np.uint8).tobytes()]), pa.array([n.astype("<u4").tobytes()]), pa.array([squeezed(tokens)]), pa.array([uniq.astype("<u8").tobytes()]), pa.array([count.tobytes()]), pa.array([ending.astype("<u2").tobytes()])]
        return pa.RecordBatch.from_arrays(cells, names=["chunk", "doc_ids", "train", "words", "tokens", "uniq", "count", "ending"])

    def work(batches):
        part, number, held, ids, train, texts, type_ = TaskContext.get().partitionId(), 0, 0, [], [], [], None
        for batch in batches:
            type_ = batch.column("doc_id").type
            for i, t, s in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "train", "text")), strict=True):
                if held and held + len(s) > CHUNK:
                    yield row(part, number, ids, type_, train, texts)
                    number, held, ids, train, texts = number + 1, 0, [], [], []
                ids.append(i)
                train.append(t)
                texts.append(s)
                held += len(s)
        if ids:
            yield row(part, number, ids, type_, train, texts)

    return docs.mapInArrow(work, f"chunk long, doc_ids array<{kind}>, train binary, words binary, tokens binary, uniq binary, count binary, ending binary")


# -- counts ----------------------------------------------------------------------------------


def blobs(rows, k: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in rows[k]]


def counted(chunks: DataFrame, bits: int, shelves: int = 1) -> DataFrame:
    """Merge the chunks' counts in 2 ** bits parts by hash.

    Rows with a chunk: part and counts of that chunk's words in the part, in order. A row without one a part:
    v, n (words with a count, their tokens), top (hash, c, ending of its most frequent words) and endings
    (ending, v, n over all of its words). With several shelves, each part's chunks are merged by shelf first and the
    totals go back the same way, so a word that every chunk has comes once a shelf, not once a chunk.
    """
    import pandas as pd
    import pyarrow as pa

    def cut(batches):
        for batch in batches:
            for chunk, u, c, e in zip(*(batch.column(k) for k in ("chunk", "uniq", "count", "ending")), strict=True):
                u, c, e = np.frombuffer(u.as_py(), "<u8"), np.frombuffer(c.as_py(), "<u4"), np.frombuffer(e.as_py(), "<u2")
                part = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
                at = np.flatnonzero(np.diff(part, prepend=-1))
                ends = [*at[1:].tolist(), len(u)]
                spans = list(zip(at.tolist(), ends, strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([chunk.as_py()] * len(spans), pa.int64()), *(pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (u, c.astype("<u8"), e))], names=["part", "chunk", "u", "c", "e"])

    def sums(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Words, counts and endings of all rows together, the place of every entry in them, and each row's entries."""
        cells = blobs(rows, "u", "<u8")
        uniq, first, back = np.unique(np.concatenate(cells), return_index=True, return_inverse=True)
        return uniq, np.bincount(back, np.concatenate(blobs(rows, "c", "<u8"))).astype(np.int64), np.concatenate(blobs(rows, "e", "<u2"))[first], back, [len(x) for x in cells]

    def merge(key, rows):
        uniq, total, ending, back, size = sums(rows)
        seen = total > 0
        best = np.lexsort((uniq, -total))[:LISTED]
        best = best[total[best] > 0]
        kinds, where = np.unique(ending[seen], return_inverse=True)
        by_kind = list(zip(kinds.tolist(), np.bincount(where, minlength=len(kinds)).tolist(), np.bincount(where, total[seen], len(kinds)).astype(np.int64).tolist(), strict=True))
        out = {"part": int(key[0]), "chunk": [*rows["chunk"], None], "counts": [*(x.astype("<u8").tobytes() for x in np.split(total[back], np.cumsum(size)[:-1])), None]}
        blank = [None] * len(size)
        out |= {"v": [*blank, int(seen.sum())], "n": [*blank, int(total.sum())], "top": [*blank, [{"h": int(uniq[i].astype(np.int64)), "c": int(total[i]), "e": int(ending[i])} for i in best]], "endings": [*blank, [{"e": k, "v": v, "n": n} for k, v, n in by_kind]]}
        frame = pd.DataFrame(out)
        for k in ("chunk", "v", "n"):
            frame[k] = frame[k].astype("Int64")
        return frame

    def shelved(key, rows):
        uniq, total, ending, _, _ = sums(rows)
        return pd.DataFrame({"part": [int(key[0])], "chunk": [int(key[1])], "u": [uniq.tobytes()], "c": [total.astype("<u8").tobytes()], "e": [ending.astype("<u2").tobytes()]})

    def returned(key, rows, answers):
        _, _, _, back, size = sums(rows)
        total = np.frombuffer(answers["counts"][0], "<u8")
        return pd.DataFrame({"part": int(key[0]), "chunk": rows["chunk"], "counts": [x.tobytes() for x in np.split(total[back], np.cumsum(size)[:-1])]})

    cells = "part int, chunk long, u binary, c binary, e binary"
    answers = "part int, chunk long, counts binary, v long, n long, top array<struct<h:long,c:long,e:int>>, endings array<struct<e:int,v:long,n:long>>"
    cuts = chunks.select("chunk", "uniq", "count", "ending").mapInArrow(cut, cells)
    if shelves == 1:
        return cuts.groupBy("part").applyInPandas(merge, answers)
    shelf = F.pmod(F.xxhash64("chunk", F.lit(3)), F.lit(shelves)).alias("shelf")
    total = written(cuts.groupBy("part", shelf).applyInPandas(shelved, cells).groupBy("part").applyInPandas(merge, answers), "shelves")
    own = cuts.groupBy("part", shelf).cogroup(total.where("chunk is not null").groupBy("part", F.col("chunk").alias("shelf"))).applyInPandas(returned, "part int, chunk long, counts binary")
    return own.unionByName(total.where("chunk is null"), allowMissingColumns=True)


@dataclass
class Words:
    """What the corpus says: training tokens and words; the listed words; ending classes."""

    n: int = 0
    v: int = 0
    ends: int = 0
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each hash: rank by count
    group: np.ndarray = field(default_factory=lambda: np.full(1 << 16, SUFFIXES))  # of each ending
    mass: np.ndarray = field(default_factory=lambda: np.zeros((SUFFIXES + 1, 2)))  # words, tokens of each group
    listed: np.ndarray = field(default_factory=lambda: np.zeros(LISTED))  # tokens by rank

    @property
    def lists(self) -> int:
        """Classes of listed words."""
        return LISTED // MEMBERS

    @property
    def classes(self) -> int:
        return 1 + self.lists + SUFFIXES + 1

    @property
    def symbols(self) -> int:
        """Inputs: the end, the listed words, the ending classes."""
        return 1 + LISTED + SUFFIXES + 1

    def symbol_of(self, uniq: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Input number of each word; listed words from 1 on, then ending classes."""
        out = 1 + LISTED + self.group[ending]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, uniq), len(self.hashes) - 1)
            hit = self.hashes[at] == uniq
            out[hit] = 1 + self.places[at[hit]]
        return out

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol == 0, 0, np.where(symbol <= LISTED, 1 + (symbol - 1) // MEMBERS, symbol - LISTED + self.lists))


def words_of(totals: DataFrame, ends: int) -> Words:
    """Sum the parts' summaries; at most LISTED words and 65,536 endings come to the driver."""
    some = totals.where("chunk is null")
    s = some.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    out = Words(n=s.n + ends, v=s.v + (ends > 0), ends=ends)
    top = some.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "h").limit(LISTED).collect()
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    out.listed[: len(top)] = [r.c for r in top]
    order = np.argsort(h)
    out.hashes, out.places = h[order], order
    kinds = some.select(F.explode("endings").alias("x")).groupBy("x.e").agg(F.sum("x.v").alias("v"), F.sum("x.n").alias("n")).collect()
    each = {r.e: np.array([r.v, r.n], float) for r in kinds}
    for r in top:
        each[r.e] -= (1, r.c)
    heavy = sorted(each, key=lambda e: (-each[e][1], e))[:SUFFIXES]
    out.group[heavy] = np.arange(len(heavy))
    for e, m in each.items():
        out.mass[out.group[e]] += m
    return out


# -- the network -----------------------------------------------------------------------------


def start_weights(words: Words, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Small random weights; the softmax biases start from the corpus counts, so the start is the unigram model."""
    rng = np.random.default_rng(4)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    member = words.listed.reshape(words.lists, MEMBERS)
    classes = np.concatenate([[words.ends], member.sum(axis=1), words.mass.sum(axis=1)])
    weights = {"E": small(words.symbols, hidden), "W": small(hidden, 3 * hidden), "U": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32)}
    heads = {"C": small(hidden, words.classes) / 10, "M": small(words.lists, hidden, MEMBERS) / 10}
    return weights | heads | {"cb": np.log(classes + 1).astype(np.float32), "mb": np.log(member + 0.1).astype(np.float32)}


class Scratch(dict):
    """Arrays by name that are made once and used again: fresh ones of this size cost as much as the sums in them."""

    def get(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        n = math.prod(shape)
        held = self.setdefault((name, np.dtype(kind)), np.empty(0, kind))
        if len(held) < n:
            held = self[name, np.dtype(kind)] = np.empty(n, kind)
        return held[:n].reshape(shape)


def step(u_gates: np.ndarray, u_cand: np.ndarray, x: np.ndarray, h: np.ndarray, gates: np.ndarray, rh: np.ndarray, c: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One unit's turn, into gates (update, reset), rh, c (candidate) and out (the state).

    x: input times W plus b, of each gate and the candidate apart. x and the recurrent weights come times -1 for the
    gates, whose logistic of v is 1 / (1 + exp(-v)), and times -2 for the candidate: tanh(v) is 2 / (1 + exp(-2 v)) - 1.
    (numpy's exp takes half the time of its tanh.) An exp that overflows gives 0 and -1, as it should.
    """
    np.matmul(h, u_gates, out=gates)
    gates += x[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], h, out=rh)
    np.matmul(rh, u_cand, out=c)
    c += x[2]
    np.exp(c, out=c)
    c += 1
    np.divide(2, c, out=c)
    c -= 1
    np.subtract(c, h, out=out)
    out *= gates[0]
    out += h
    return out


def apart(x: np.ndarray) -> np.ndarray:
    """The three blocks of x's columns as three arrays: what is done to one of them is done to numbers side by side."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def prepared(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What step() takes: each symbol's input (rows of the gates, then of the candidate), the recurrent weights of the gates, those of the candidate."""
    x, u = apart(p["E"] @ p["W"] + p["b"]), apart(p["U"])
    for a in (x, u):
        a[:2] *= -1
        a[2] *= -2
    return x.reshape(-1, x.shape[2]), u[:2], u[2]


def bounded(p: dict) -> bool:
    """Can no logit overflow exp? States lie between -1 and 1."""
    return max(float((np.abs(p[w]).sum(axis=-2) + np.abs(p[b])).max()) for w, b in (("C", "cb"), ("M", "mb"))) < 80


def logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, safe: bool, out: np.ndarray) -> np.ndarray:
    """h times weights plus bias, by row less its maximum if not safe."""
    x = np.matmul(h, weights, out=out)
    x += bias
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    return x


ONES = {np.dtype(kind): np.ones(max(ROWS, 1 + LISTED // MEMBERS + SUFFIXES + 1, MEMBERS), kind) for kind in (np.float32, np.float64)}


def places(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Where each row's goal is in x, flat."""
    return np.arange(0, x.size, x.shape[1]) + goal


def softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of x, in its place, its sums by row, and the log probability of each row's goal; at: its place in x."""
    own = x.reshape(-1)[at]
    np.exp(x, out=x)
    total = x @ ONES[x.dtype][: x.shape[1]]
    own -= np.log(total)
    return total, own


def error(x: np.ndarray, goal: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """Probabilities, in x's place, less one at goal, times scale; the summed loss."""
    at = places(x, goal)
    total, own = softmax(x, at)
    x *= (x.dtype.type(scale) / total)[:, None]
    x.reshape(-1)[at] -= x.dtype.type(scale)
    return x, -float(own.sum())


def by_class(cls: np.ndarray, lists: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Row places in order of class, and for each class of listed words that occurs its spans there, of ROWS at most."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(1, lists + 2)).tolist()
    return order, [(k, a, b) for k in range(lists) for a, b in spans_of(ends[k], ends[k + 1])]


def spans_of(start: int, end: int) -> list[tuple[int, int]]:
    return [(a, min(a + ROWS, end)) for a in range(start, end, ROWS)]


def predicted(p: dict, h: np.ndarray, cls: np.ndarray, member: np.ndarray, room: Scratch | None = None) -> np.ndarray:
    """Log probability of class and, for listed words, of the word within it, for states h."""
    room, safe = Scratch() if room is None else room, bounded(p)
    order, spans = by_class(cls, len(p["M"]))
    h, cls, member = h[order], cls[order], member[order]
    got = np.empty(len(h), h.dtype)

    def within(a: int, b: int, weights: np.ndarray, bias: np.ndarray, goal: np.ndarray) -> np.ndarray:
        x = logits(h[a:b], weights, bias, safe, room.get("logits", b - a, len(bias), kind=h.dtype))
        return softmax(x, places(x, goal[a:b]))[1]

    for a, b in spans_of(0, len(h)):
        got[a:b] = within(a, b, p["C"], p["cb"], cls)
    for k, a, b in spans:
        got[a:b] += within(a, b, p["M"][k], p["mb"][k], member)
    out = np.empty_like(got)
    out[order] = got
    return out


@np.errstate(over="ignore")
def window_gradient(p: dict, inputs: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray, cls: np.ndarray, g: dict | None = None, room: Scratch | None = None) -> tuple[dict, np.ndarray, float]:
    """Loss gradient of one window (time x lanes), truncated at its start; the state at its end; summed loss.

    The input 0 only comes first in a document, so it starts from a zero state. g: zeros to put the gradient in.
    """
    steps, lanes = inputs.shape
    k, kind = h.shape[1], h.dtype
    g = g or {n: np.zeros_like(v) for n, v in p.items()}
    room = Scratch() if room is None else room
    new = lambda name, *shape: room.get(name, *shape, kind=kind)
    by_input, u_gates, u_cand = prepared(p)
    xw = np.take(by_input, inputs + len(p["E"]) * np.arange(3)[:, None, None], axis=0, out=new("xw", 3, steps, lanes, k), mode="clip")
    states, before, rh, cand = (new(n, steps, lanes, k) for n in ("states", "before", "rh", "cand"))
    gates = new("gates", 2, steps, lanes, k)
    carried = (inputs > 0).astype(kind)[:, :, None]
    for t in range(steps):
        np.multiply(h, carried[t], out=before[t])
        h = step(u_gates, u_cand, xw[:, t], before[t], gates[:, t], rh[t], cand[t], states[t])
    h = h.copy()
    flat = states.reshape(-1, k)
    live = np.flatnonzero(mask.reshape(-1))
    goal = target.reshape(-1)[live]
    order, spans = by_class(cls[goal], len(p["M"]))
    live, goal = live[order], goal[order]
    s, c, member = flat[live], cls[goal], (goal - 1) % MEMBERS
    scale, safe = 1.0 / max(len(live), 1), bounded(p)
    loss, ds, heads_t = 0.0, np.empty_like(s), np.ascontiguousarray(p["C"].T)
    for a, b in spans_of(0, len(s)):
        d, more = error(logits(s[a:b], p["C"], p["cb"], safe, new("logits", b - a, len(p["cb"]))), c[a:b], scale)
        loss += more
        g["C"] += s[a:b].T @ d
        g["cb"] += ONES[d.dtype][: len(d)] @ d
        np.matmul(d, heads_t, out=ds[a:b])
    for j, a, b in spans:
        d, more = error(logits(s[a:b], p["M"][j], p["mb"][j], safe, new("logits", b - a, MEMBERS)), member[a:b], scale)
        loss += more
        g["M"][j] += s[a:b].T @ d
        g["mb"][j] += ONES[d.dtype][: len(d)] @ d
        ds[a:b] += d @ p["M"][j].T
    out = new("out", steps * lanes, k)
    out[:] = 0
    out[live] = ds
    out = out.reshape(steps, lanes, k)
    # what each gate's gradient is multiplied by, for all steps at once
    z, r = gates
    keep, by_c, by_z, by_r = (new(n, steps, lanes, k) for n in ("keep", "by_c", "by_z", "by_r"))
    np.subtract(1, r, out=by_r)
    by_r *= r
    by_r *= before
    np.subtract(1, z, out=keep)
    np.subtract(cand, before, out=by_z)
    by_z *= z
    by_z *= keep
    np.multiply(cand, cand, out=by_c)
    np.subtract(1, by_c, out=by_c)
    by_c *= z
    dh, dx, both = np.zeros((lanes, k), kind), new("dx", 3, steps, lanes, k), new("both", 2, lanes, k)
    u_t = np.ascontiguousarray(apart(p["U"]).transpose(0, 2, 1))
    for t in reversed(range(steps)):
        dh += out[t]
        dc = np.multiply(dh, by_c[t], out=dx[2, t])
        drh = dc @ u_t[2]
        np.multiply(dh, by_z[t], out=dx[0, t])
        np.multiply(drh, by_r[t], out=dx[1, t])
        dh *= keep[t]
        drh *= r[t]
        dh += drh
        np.matmul(dx[:2, t], u_t[:2], out=both)
        dh += both[0]
        dh += both[1]
        dh *= carried[t]
    dx = dx.reshape(3, -1, k)
    for j, side in enumerate((before, before, rh)):
        g["U"][:, j * k : j * k + k] += side.reshape(-1, k).T @ dx[j]
    # inputs share few symbols, so their gradients are summed by symbol before they go through W
    place = ((inputs * k).reshape(-1, 1) + np.arange(k)).reshape(-1)
    by_symbol = np.concatenate([np.bincount(place, x.reshape(-1), p["E"].size).astype(kind).reshape(-1, k) for x in dx], axis=1)
    g["W"] += p["E"].T @ by_symbol
    g["b"] += by_symbol.sum(axis=0)
    g["E"] += by_symbol @ p["W"].T
    return g, h, loss


def views(flat: np.ndarray, like: dict) -> dict:
    """The arrays of like's shapes, in order of name, in one flat array."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Adam:
    """Weights and their moments, each in one flat array."""

    def __init__(self, p: dict) -> None:
        self.flat, self.t = np.concatenate([p[k].ravel() for k in sorted(p)]), 0
        self.p = views(self.flat, p)
        self.m, self.v, self.g = (np.zeros_like(self.flat) for _ in range(3))
        self.grad, self.room = views(self.g, p), Scratch()

    def zero(self) -> dict:
        self.g[:] = 0
        return self.grad

    def turn(self, rate: float) -> None:
        """A step down the gradient in self.grad."""
        self.t += 1
        g = self.g
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        fix = rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.m += 0.1 * (g - self.m)
        g *= g
        self.v += 0.01 * (g - self.v)
        np.sqrt(self.v, out=g)
        g += 1e-7
        np.divide(self.m, g, out=g)
        g *= fix
        self.flat -= g


def train(opt: Adam, runs: np.ndarray, cls: np.ndarray, rate: float) -> int:
    """One turn over runs (rows of 2 * WINDOW + 1 symbols, -1 past the end); returns the tokens learnt."""
    tokens = 0
    for a in range(0, len(runs), LANES):
        lane = runs[a : a + LANES].T
        h = np.zeros((lane.shape[1], opt.p["U"].shape[0]), np.float32)
        for w in (0, WINDOW):
            goal = lane[w + 1 : w + 1 + WINDOW]
            mask = goal >= 0
            if not mask.any():
                break
            _, h, _ = window_gradient(opt.p, np.maximum(lane[w : w + WINDOW], 0), np.maximum(goal, 0), mask, h, cls, opt.zero(), opt.room)
            opt.turn(rate)
            tokens += int(mask.sum())
    return tokens


def lanes_of(docs: list[np.ndarray]) -> list[list[np.ndarray]]:
    """docs dealt to LANES lanes of about equal length, longest first to the shortest lane; each lane in random order."""
    lanes: list[list[np.ndarray]] = [[] for _ in range(min(LANES, max(1, len(docs))))]
    held = [(0, k) for k in range(len(lanes))]
    for doc in sorted(docs, key=len, reverse=True):
        n, k = held[0]
        heapq.heapreplace(held, (n + len(doc) + 1, k))
        lanes[k].append(doc)
    rng = np.random.default_rng(6)
    return [[lane[i] for i in rng.permutation(len(lane))] for lane in lanes]


def windows(docs):
    """Targets (WINDOW + 1 x lanes; row 0: the inputs before) that hold all symbols of docs and an end each; -1: none.

    A lane reads one document to its end, then its next one. The docs of one trainer are held: about SHARE symbols.
    """
    end = np.zeros(1, np.int16)
    lanes = lanes_of(list(docs))
    size = np.array([sum(len(doc) + 1 for doc in lane) for lane in lanes])[:, None]
    flat = np.concatenate([x for lane in lanes for doc in lane for x in (doc.astype(np.int16), end)] or [end])
    start, turn = np.cumsum(size)[:, None] - size, np.arange(WINDOW)
    last = np.zeros(len(lanes), np.int16)
    for a in range(0, int(size.max()), WINDOW):
        now = np.empty((len(lanes), WINDOW + 1), np.int32)
        now[:, 0] = last
        now[:, 1:] = np.where(a + turn < size, flat[np.minimum(start + a + turn, len(flat) - 1)], -1)
        last = np.maximum(now[:, -1], 0)
        yield now.T


def train_whole(opt: Adam, docs, cls: np.ndarray, rate: float) -> tuple[int, float]:
    """One turn over all symbols of docs, each document's state carried to its end; the tokens learnt and their loss.

    A window that is not full of tokens counts by its share of them.
    """
    tokens, total = 0, 0.0
    h = np.zeros((LANES, opt.p["U"].shape[0]), np.float32)
    for lane in windows(docs):  # of LANES documents at a time, or all if there are fewer
        live = np.flatnonzero(lane[1] >= 0)
        goal = lane[1:, live]
        mask = goal >= 0
        _, h[live], loss = window_gradient(opt.p, np.maximum(lane[:-1, live], 0), np.maximum(goal, 0), mask, h[live], cls, opt.zero(), opt.room)
        opt.turn(rate * float(mask.mean()) * len(live) / LANES)
        tokens, total = tokens + int(mask.sum()), total + loss
    return tokens, total


def runs_of(symbols: np.ndarray, words: np.ndarray, train_: np.ndarray, salt: int) -> np.ndarray:
    """A run of each training document's symbols: start mark first, the end last if the run reaches it."""
    out, at = np.full((int(train_.sum()), 2 * WINDOW + 1), -1, np.int32), 0
    first = np.concatenate([[0], np.cumsum(words)])
    for row, i in enumerate(np.flatnonzero(train_)):
        n = int(words[i])
        room = max(0, n + 1 - 2 * WINDOW)
        at = (int(first[i]) * 0x9E3779B1 + salt * 0x85EBCA6B + n) % (room + 1)
        piece = symbols[first[i] + max(at - 1, 0) : first[i] + min(n, at + 2 * WINDOW)]
        whole = [*([0] if at == 0 else []), *piece.tolist()]
        if at + 2 * WINDOW > n:
            whole.append(0)
        whole = whole[: 2 * WINDOW + 1]
        out[row, : len(whole)] = whole
    return out


def packed(p: dict) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], "<f4").tobytes() for k in sorted(p))


def averaged(models: DataFrame, n: int) -> list:
    """tokens and weights of models as at most MERGED rows; rows of (part, tokens, weights) meet MERGED at a time."""
    import pyarrow as pa

    def mean(rows: pa.Table) -> pa.Table:
        tokens, total = sum(rows.column("tokens").to_pylist()), 0.0
        for t, w in zip(rows.column("tokens").to_pylist(), rows.column("weights"), strict=True):
            total = total + np.frombuffer(w.as_py(), "<f4").astype(np.float64) * (t / tokens)
        return pa.table({"part": [rows.column("part")[0].as_py()], "tokens": [tokens], "weights": [total.astype("<f4").tobytes()]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())]))

    while n > MERGED:
        n = -(-n // MERGED)
        models = models.groupBy(F.pmod("part", F.lit(n)).alias("group")).applyInArrow(lambda rows: mean(rows.sort_by("part")), "part int, tokens long, weights binary")
        models = models.withColumn("part", F.pmod("part", F.lit(n)))
    return sorted(models.collect())


def fit(chunks: DataFrame, words: Words, train_docs: int) -> dict[str, np.ndarray]:
    """Weights from all training documents; see the module's text."""
    import pyarrow as pa

    spark = chunks.sparkSession
    cls = words.class_of(np.arange(words.symbols))
    p = start_weights(words)
    if not train_docs:
        return {k: np.zeros_like(v) for k, v in p.items()}
    known = spark.sparkContext.broadcast(words)  # bounded: LISTED words, 65,536 endings
    share = min(1.0, WARM / train_docs)

    def symbols(batch):
        """Chunk, symbols of its words, words of each document, whether it trains."""
        for chunk, tokens, uniq, ending, n, t in zip(*(batch.column(k) for k in ("chunk", "tokens", "uniq", "ending", "words", "train")), strict=True):
            n, t = np.frombuffer(n.as_py(), "<u4").astype(np.int64), np.frombuffer(t.as_py(), np.uint8) > 0
            yield chunk.as_py(), known.value.symbol_of(np.frombuffer(uniq.as_py(), "<u8"), np.frombuffer(ending.as_py(), "<u2"))[unsqueezed(tokens.as_py(), int(n.sum()))], n, t

    def extract(batches):
        for batch in batches:
            for chunk, sym, n, t in symbols(batch):
                runs = runs_of(sym, n, t, 1)
                runs = runs[np.random.default_rng([4, chunk]).random(len(runs)) < share]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([runs.astype("<i2").tobytes()])], names=["chunk", "runs"])

    def whole(batches):
        """All training documents' symbols, two bytes each before compression: what is dealt out of a chunk."""
        for batch in batches:
            for chunk, sym, n, t in symbols(batch):
                own = sym[np.repeat(t, n)].astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([n[t].astype("<u4").tobytes()]), pa.array([pa.compress(own, "zstd", asbytes=True)])], names=["chunk", "words", "symbols"])

    source = chunks.select("chunk", "tokens", "uniq", "ending", "words", "train")
    runs = source.mapInArrow(extract, "chunk long, runs binary").where("length(runs) > 0")
    array = lambda blobs: np.concatenate([np.frombuffer(x, "<i2") for x in blobs] or [np.zeros(0, "<i2")]).astype(np.int32).reshape(-1, 2 * WINDOW + 1)
    warm = array(r.runs for r in sorted(runs.collect()))  # about WARM runs
    opt, rng = Adam(p), np.random.default_rng(5)
    for k in range(WARM_EPOCHS):
        train(opt, warm[rng.permutation(len(warm))], cls, RATE / (1 + k))
    first = spark.sparkContext.broadcast(opt.flat)  # some 80,000 numbers
    like = {k: np.zeros(v.shape, np.float32) for k, v in p.items()}

    def documents(batches):
        for batch in batches:
            for n, data in zip(batch.column("words"), batch.column("symbols"), strict=True):
                n = np.frombuffer(n.as_py(), "<u4").astype(np.int64)
                yield from np.split(np.frombuffer(pa.decompress(data.as_py(), 2 * int(n.sum()), "zstd", asbytes=True), "<i2"), np.cumsum(n)[:-1])

    def local(batches):
        mine = Adam(views(first.value.copy(), like))
        tokens, _ = train_whole(mine, documents(batches), cls, RATE / 5)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens], pa.int64()), pa.array([packed(mine.p)])], names=["part", "tokens", "weights"])

    trainers = max(TRAINERS, -(-words.n // SHARE))
    dealt = source.mapInArrow(whole, "chunk long, words binary, symbols binary").where("length(words) > 0").repartition(trainers, "chunk").sortWithinPartitions("chunk")
    models = written(dealt.mapInArrow(local, "part int, tokens long, weights binary").where("tokens > 0"), "models")
    got = averaged(models, models.count())
    total = sum(r.tokens for r in got)
    if total != words.n:
        raise RuntimeError(f"{total} of {words.n} training tokens were learnt from")
    if not got:
        return opt.p
    mean = sum(np.frombuffer(bytes(r.weights), "<f4").astype(np.float64) * (r.tokens / total) for r in got)
    return views(mean.astype(np.float32), p)


# -- scoring ---------------------------------------------------------------------------------


@np.errstate(over="ignore")
def log_scores(p: dict, words: Words, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's classes and listed words, the end included.

    ROWS documents run side by side, longest first; each keeps its state from window to window until its end.
    """
    cls = words.class_of(np.arange(words.symbols))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    order = np.argsort(-n, kind="stable")
    xw, u_gates, u_cand = prepared(p)
    of_gate = len(p["E"]) * np.arange(3)[:, None]
    sym, out, room, k = np.append(sym, 0), np.empty(len(n)), Scratch(), p["U"].shape[0]
    for own in (order[a:b] for a, b in spans_of(0, len(n))):
        at_first, size = first[own], n[own]
        total, h = np.zeros(len(own)), np.zeros((len(own), k), np.float32)
        steps = int(size[0]) + 1
        live = np.searchsorted(-size, -np.arange(steps), side="right")  # documents with a token (or the end) at each step
        for w in range(0, steps, WINDOW):
            now = live[w : w + WINDOW]
            ends = np.cumsum(now)
            owner = np.arange(ends[-1]) - np.repeat(ends - now, now)
            t = np.repeat(np.arange(w, w + len(now)), now)
            at = at_first[owner] + t
            before = np.where(t == 0, 0, sym[at - 1])
            states, beside = room.get("states", len(owner), k), 0
            for a, b in zip((ends - now).tolist(), ends.tolist(), strict=True):
                if b - a != beside:
                    beside = b - a
                    x, gates, rh, cand = (room.get(name, *shape, beside, k) for name, shape in (("x", (3,)), ("gates", (2,)), ("rh", ()), ("cand", ())))
                np.take(xw, before[a:b] + of_gate, axis=0, out=x, mode="clip")
                h = step(u_gates, u_cand, x, h[:beside], gates, rh, cand, states[a:b])
            h = h.copy()
            goal = np.where(size[owner] == t, 0, sym[at])
            got = predicted(p, states, cls[goal], (goal - 1) % MEMBERS, room)
            total[: now[0]] += np.bincount(owner, got, now[0])
        out[own] = total
    return out


def scored(chunks: DataFrame, totals: DataFrame, words: Words, weights: dict) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score of every document."""
    import pyarrow as pa

    spark = chunks.sparkSession
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    answers = totals.where("chunk is not null").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("counts"))  # a chunk's own words
    known = spark.sparkContext.broadcast((words, weights))

    def work(batches):
        m, p = known.value
        below = np.log10(m.n + m.v + 1)
        for batch in batches:
            # the chunks of a batch (some MB) are scored side by side, as their longest documents decide the steps
            facts, symbols = [], []
            for t, n, tokens, uniq, ending, counts in zip(*(batch.column(k) for k in ("train", "words", "tokens", "uniq", "ending", "counts")), strict=True):
                n = np.frombuffer(n.as_py(), "<u4").astype(np.int64)
                tokens = unsqueezed(tokens.as_py(), int(n.sum()))
                u, e = np.frombuffer(uniq.as_py(), "<u8"), np.frombuffer(ending.as_py(), "<u2")
                c = np.concatenate([np.frombuffer(x["counts"], "<u8") for x in counts.as_py() or []] or [np.zeros(0, "<u8")]).astype(np.float64)
                sym = m.symbol_of(u, e)
                owner = np.repeat(np.arange(len(n)), n)
                base = np.bincount(owner, (np.log10(c + 1) - below)[tokens], len(n)) + np.log10(m.ends + 1) - below
                seen = np.bincount(owner, (c > 0)[tokens], len(n)).astype(np.int64) + (m.ends > 0)
                group = np.maximum(sym - 1 - LISTED, 0)
                inner = np.where(sym > LISTED, np.log(c + 1) - np.log(m.mass[group].sum(axis=1) + 1), 0)
                facts.append((np.frombuffer(t.as_py(), np.uint8) > 0, n, seen, base, np.bincount(owner, inner[tokens], len(n))))
                symbols.append(sym.astype(np.int32)[tokens])
            if facts:
                train, n, seen, base, inner = (np.concatenate(x) for x in zip(*facts, strict=True))
                score = (log_scores(p, m, np.concatenate(symbols), n) + inner) / LOG10
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten(), pa.array(train), pa.array(n + 1), pa.array(seen), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return chunks.drop("count").join(answers, "chunk", "left").mapInArrow(work, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    rows = docs.select("doc_id", (bucket_of("doc_id", 7) != 2).alias("train"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chunks = written(chunked(rows), "chunks")
    size = chunks.agg(F.coalesce(F.sum(F.length("uniq") / 8), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.length(F.regexp_replace(F.hex("train"), "0", ""))), F.lit(0)).alias("docs"), F.count("*").alias("chunks")).first()
    bits = max(0, int(np.ceil(np.log2(max(1.0, size.entries / PART)))))
    totals = written(counted(chunks, max(bits, 4), max(1, -(-size.chunks // SHELF))), "counts")
    words = words_of(totals, int(size.docs))
    weights = fit(chunks, words, int(size.docs))
    out = scored(chunks, totals, words, weights)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"), "base_score", "score")
