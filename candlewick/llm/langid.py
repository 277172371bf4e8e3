"""Language identification by the nearest of several centroids per language.

A text's vector counts hashed byte trigrams (A-Z lower-cased, other ASCII than letters as spaces), damped by
log(1 + count), weighted by inverse document frequency and scaled to length 1. Document frequencies cover
all training documents. Each language gets a few centroids by spherical k-means over a bounded sample of its
training documents (SAMPLE each, a parameter). A text takes the language of the centroid with the largest
cosine. Short texts lie far from every centroid, so distance is judged against what is attainable: the cosine
of the best text with as many distinct trigrams. A row whose share of that is below REJECT times the low
quantile of its language's training shares is marked rejected. From ENOUGH distinct trigrams on, so is a row that does
no better than chance: hashed trigrams of any writing meet a centroid's by accident, the more of them the more, so the
cosine that as many random ones would reach is taken off first, and what is left is judged likewise.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; whole texts count,
however long; a tie goes to the earlier language by code point; rows are independent, so repeated rows and
extra columns do not matter (a column of keep must not have the name of a new one); an empty table gives none;
without any labelled training document every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import bucket_of, name_of, ship_package, with_fields

BITS = 12
SAMPLE, CLUSTERS, ROUNDS = 600, 3, 8
REJECT, LOW, ENOUGH = 0.15, 0.01, 64
LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hash of every byte trigram of the folded text, with a space at either end."""
    a = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    code = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - BITS)


def counts(text: bytes) -> np.ndarray:
    return np.bincount(trigrams(text), minlength=1 << BITS)


@dataclass
class LangModel:
    """idf: weight of each dimension; centroids: unit rows; owner: index into langs; floor, beyond: least share of the
    attainable cosine by language, and least share once chance is taken off."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    beyond: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _most: np.ndarray | None = None

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf, dtype=np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine, share of the attainable cosine, and that share beyond chance (1 for few trigrams)."""
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        distinct = np.maximum((vectors > 0).sum(axis=1), 1)
        most = np.maximum(self.attainable()[best, distinct - 1], 1e-12)
        chance = self.centroids.mean(axis=1)[best] * np.sqrt(distinct)
        return self.owner[best], top, top / most, np.where(distinct < ENOUGH, 1.0, (top - chance) / np.maximum(most - chance, 1e-12))

    def attainable(self) -> np.ndarray:
        """For each centroid the largest cosine of a vector with 1, 2, ... dimensions."""
        if self._most is None:
            self._most = np.sqrt(np.cumsum(np.sort(self.centroids**2, axis=1)[:, ::-1], axis=1))
        return self._most


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts: the mean's nearest row, then rows farthest from those chosen."""
    first = x @ x.mean(axis=0)
    picked = [int(first.argmax())]
    for _ in range(min(k, len(x)) - 1):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    centre = x[picked]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        fresh = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
    return centre


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all rows of a binary column `text`: in how many each dimension occurs; summed before the shuffle."""
    import pyarrow as pa

    def work(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += counts(t.as_py() or b"") > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], names=["dim", "n"])

    rows = texts.mapInArrow(work, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # at most 2^BITS + 1 rows
    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        out[r.dim] = r.n
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> LangModel:
    """Learn from all rows given (text, lang); lang null rows teach nothing."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    found = document_frequencies(known.select("text"))
    n, df = found[-1], found[:-1]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    draw = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(1.0 * sample / v)) for k, v in sizes.items()], F.lit(0.0)) if sizes else F.lit(0.0)

    def work(batches):
        for batch in batches:
            got = [counts(t.as_py() or b"") for t in batch.column("text")]
            at = [np.flatnonzero(c) for c in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([x.astype("<u2").tobytes() for x in at]), pa.array([c[x].astype("<u4").tobytes() for c, x in zip(got, at, strict=True)])], names=["doc_id", "lang", "at", "tf"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = known.where(draw < rate).mapInArrow(work, f"doc_id {id_type}, lang string, at binary, tf binary").collect()  # about sample rows a language
    rows.sort(key=lambda r: (r.lang, str(r.doc_id), r.at, r.tf))
    langs = sorted({r.lang for r in rows})
    model = LangModel(langs, idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int))
    parts, own, floor, beyond = [], [], [], []
    for i, lang in enumerate(langs):
        mine = [r for r in rows if r.lang == lang]
        tf = np.zeros((len(mine), 1 << BITS), np.float32)
        for row, r in zip(tf, mine, strict=True):
            row[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.tf, "<u4")
        x = model.vectors(tf)
        centre = kmeans(x, clusters)
        parts.append(centre)
        own += [i] * len(centre)
        alone = LangModel([lang], idf, centre, np.zeros(len(centre), int))
        _, _, share, more = alone.nearest(x)
        floor.append(REJECT * float(np.quantile(share, LOW)))
        beyond.append(REJECT * max(0.0, float(np.quantile(more, LOW))))
    if parts:
        model.centroids, model.owner, model.floor, model.beyond = np.concatenate(parts), np.array(own), np.array(floor), np.array(beyond)
    return model


def predict(docs: DataFrame, model: LangModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred, score (cosine, 0 to 1) and rejected, for every row."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    fields = with_fields(docs, keep, "lang_pred string, score double, rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x CLUSTERS x 2^BITS floats

    def work(batches):
        m: LangModel = shared.value
        for batch in batches:
            for a, b in slices(batch.column("__text")):
                for c in range(a, b, 512):
                    part = batch.slice(c, min(b, c + 512) - c)
                    texts = part.column("__text").to_pylist()
                    named = np.array([t is not None and LETTER.search(t) is not None for t in texts])
                    if len(m.langs):
                        who, cosine, share, more = m.nearest(m.vectors(np.stack([counts((t or "").encode()) for t in texts])))
                    else:
                        who, cosine, share, more, named = np.zeros(len(texts), int), *np.zeros((3, len(texts))), named & False
                    score = np.where(named, np.clip(cosine, 0, 1), 0).astype(float)
                    low = ~named | (share < m.floor[who]) | (more < m.beyond[who]) if len(m.langs) else ~named
                    lang = [m.langs[w] if k else "und" for w, k in zip(who, named, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(low)], names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*map(name_of, keep), F.col("text").alias("__text")).mapInArrow(work, fields)


def held_out() -> Column:
    return bucket_of("doc_id", 5) == 0


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs; fitted on rows that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")
