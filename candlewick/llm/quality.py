"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers about its form (lengths, character classes, repetition; `|` apart from the other
symbols, as it stands between the entries of menus and tables left over from web pages). Each number is cut
into bins at training quantiles. Boosting goes round the features in turn; every step fits a tree of depth two
on one feature's bins to the gradient of the log loss and adds its leaves, times RATE, to that feature's
lookup table. Then the pairs with the largest remaining gain get tables on coarser bins, boosted likewise by
trees with one cut on either feature. A score is the sigmoid of a sum of table entries.

The fit takes a bounded sample of labelled rows (SAMPLE, a parameter). Defined cases: null texts count as
empty and get a score; very long texts are taken whole; rows are independent, so repeated rows, ties and extra
columns do not matter (a column of keep must not have the name of a new one); repeated label rows count once;
null labels teach nothing; an empty table gives none; without both labels the score is the smoothed label share.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import bucket_of, name_of, ship_package, with_fields

SAMPLE, BINS, COARSE, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 40, 0.15, 20
CUT = 0.3
FEATURES = ("log_bytes", "upper", "digit", "pipe", "symbol", "mark", "space", "line", "stop", "other", "word_len", "again", "distinct", "top_word", "line_again", "long_word")
_CLASS = np.zeros(256, np.intp)  # 0: other ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*@^~<>{}[]\\/=+_", b"!?", b" \t\r\v\f", b"\n", b".", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k


def features(text: bytes) -> list[float]:
    """The numbers of FEATURES for one whole text."""
    by = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=11)
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    letters = max(by[1] + by[2] + by[10], 1)
    tally = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    return [
        np.log1p(len(text)), by[2] / letters, by[3] / size, by[4] / n, by[5] / n, by[6] / n, by[7] / size, by[8] / n, by[9] / n, by[10] / size,
        sum(map(len, words)) / n, again / n, len(tally) / n, max(tally.values(), default=0) / n, 1 - len(set(lines)) / len(lines), max(map(len, words), default=0) / 10,
    ]


@dataclass
class Additive:
    """edges: cuts of each feature; tables: entries by bin; pairs: (i, j, coarse cuts of i, of j, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edge, x[:, f], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins lo..hi (right end excluded)."""
    if hi - lo < 2:
        return 0.0, lo
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
    gain[(hl * 4 < LEAST) | ((hs - hl) * 4 < LEAST)] = 0
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two on one feature."""
    n = len(g)
    gain, mid = best_cut(g, h, 0, n)
    ends = [0, n] if gain <= 0 else [0, mid, n]
    for lo, hi in list(zip(ends, ends[1:], strict=False)) if len(ends) == 3 else []:
        more, at = best_cut(g, h, lo, hi)
        if more > 0:
            ends.append(at)
    out = np.zeros(n)
    for lo, hi in zip(sorted(ends), sorted(ends)[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree with one cut on each of two features."""
    best, table = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            gs = np.array([cg[a - 1, b - 1], cg[a - 1, -1] - cg[a - 1, b - 1], cg[-1, b - 1] - cg[a - 1, b - 1], cg[-1, -1] - cg[a - 1, -1] - cg[-1, b - 1] + cg[a - 1, b - 1]])
            hs = np.array([ch[a - 1, b - 1], ch[a - 1, -1] - ch[a - 1, b - 1], ch[-1, b - 1] - ch[a - 1, b - 1], ch[-1, -1] - ch[a - 1, -1] - ch[-1, b - 1] + ch[a - 1, b - 1]])
            gain = float((gs**2 / (hs + 1)).sum())
            if gain > best:
                best, v = gain, gs / (hs + 1)
                table = np.empty_like(g)
                table[:a, :b], table[:a, b:], table[a:, :b], table[a:, b:] = v
    return best, table


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit to rows x with labels y."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))), [], [], [])
    model.edges = [cuts(x[:, f], BINS) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    raw = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = RATE * tree(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)))
            table += step
            raw += step[at[f]]
    p = 1 / (1 + np.exp(-raw))
    rough = [cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    place = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(rough)]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        wide = len(rough[j]) + 1
        return np.bincount(place[i] * wide + place[j], v, (len(rough[i]) + 1) * wide).reshape(-1, wide)

    gains = [(quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)]
    picked = [(i, j) for _, i, j in sorted(gains, key=lambda g: (-g[0], g[1:]))[:PAIRS]]
    tables = {k: np.zeros((len(rough[k[0]]) + 1, len(rough[k[1]]) + 1)) for k in picked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in tables.items():
            p = 1 / (1 + np.exp(-raw))
            step = RATE * quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1]
            table += step
            raw += step[place[i], place[j]]
    model.pairs = [(i, j, rough[i], rough[j], t) for (i, j), t in tables.items()]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Learn quality from the rows of docs that labels marks; about sample of them, drawn by doc_id."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y")).distinct()
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < min(1.0, sample / max(n, 1)))  # about sample rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("__text")).join(picked, F.col("doc_id") == F.col("__id"))

    def work(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("__text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("__y").cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    got = sorted((r.y, bytes(r.x)) for r in rows.select("__text", "__y").mapInArrow(work, "y int, x binary").collect())
    x = np.array([np.frombuffer(v, float) for _, v in got]).reshape(-1, len(FEATURES))
    return boost(x, np.array([y for y, _ in got], float))


def predict(docs: DataFrame, model: Additive, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, score and predicted, for every row."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    fields = with_fields(docs, keep, "score double, predicted int")

    def work(batches):
        for batch in batches:
            for a, b in slices(batch.column("__text")):
                part = batch.slice(a, b - a)
                score = model.score(np.array([features(t.as_py() or b"") for t in part.column("__text")], float))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(score), pa.array((score >= CUT).astype("int32"))], names=[*keep, "score", "predicted"])

    return docs.select(*map(name_of, keep), F.col("text").cast("binary").alias("__text")).mapInArrow(work, fields)


def held_out() -> Column:
    return bucket_of("doc_id", 5) == 0


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; fitted on labelled rows not held out."""
    model = fit(docs, labels.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
