"""Language identification by the nearest of several centroids per language.

Features: counts of hashed byte pairs and triples over the lower-cased text in which everything but letters is one
blank; damped (1 + ln), weighted by inverse document frequency, scaled to unit length.  Fitting takes at most
`per_language` training documents of each language and `total` in all, those of the lowest hash of doc_id, with their
whole texts (the least, where an id has several); spherical k-means gives `clusters` centroids per language.  A document gets the language of the centroid
of greatest cosine, which is its score; `rejected` tells that no centroid is near: the cosine is below the bound of
that language, `slack` times the lowest share `quantile` of its own training documents.  A text of few n-grams cannot
be near any centroid, so below `FULL` n-grams the bound shrinks with the root of their number.

Edge cases: null text and text without any letter get `und`, score 0 and rejected; with no training document every
text gets `und`; null or repeated doc_id and null lang are fine (held_out is null for a null id); ties between
languages go to the one first in order; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import held_out, small_batches, tidy

DIM, FULL = 4096, 400
_OTHER, _BLANKS = re.compile(r"[\W\d_]+"), re.compile("  +")
#: Numbers that are no decimal digits (fractions, Roman and circled numbers) are word characters to `re`.  Those of the basic plane make a set that is quick to search, without the others.
_NUMBERS = [c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
_NEAR, _ALL, _FAR = re.compile("[%s]" % "".join(c for c in _NUMBERS if c <= "\uffff")), re.compile("[%s]" % "".join(_NUMBERS)), re.compile("[\U00010000-\U0010ffff]")


def letters(text: str) -> str:
    """The lower-cased text with one blank for everything between letters."""
    t = _OTHER.sub(" ", text.lower())
    if not t.isascii():
        odd = _ALL if _FAR.search(t) else _NEAR
        if odd.search(t):
            t = _BLANKS.sub(" ", odd.sub(" ", t))
    return t.strip()


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    t = letters(text or "")
    if not t:
        return None
    b = np.frombuffer(f" {t} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    h = two * np.uint32(2654435761)
    h3 = (two[:-1] * np.uint32(65599) + b[2:]) * np.uint32(2246822519)
    return np.bincount(h >> np.uint32(20), minlength=DIM) + np.bincount(h3 >> np.uint32(20), minlength=DIM)


def _damped(c: np.ndarray) -> np.ndarray:
    return np.log1p(c).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        c = counts(text)
        if c is None or not len(self.centroids):
            return "und", 0.0, True
        v = _damped(c) * self.idf
        n = float(np.sqrt(v @ v))
        s = self.centroids @ (v / n if n else v)
        k = int(np.argmax(s))
        lang = self.owner[k]
        return self.languages[lang], float(min(1.0, max(0.0, s[k]))), bool(s[k] < self.bounds[lang] * min(1.0, (float(c.sum()) / FULL) ** 0.5))


def fit(vectors: np.ndarray, langs: list[str], clusters: int = 3, rounds: int = 12, quantile: float = 0.005, slack: float = 0.6) -> Model:
    """vectors: damped counts, a row each."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    idf = np.log((1 + len(vectors)) / (1 + (vectors > 0).sum(0))).astype(np.float32) + 1
    x = vectors * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    which = np.array([names.index(a) for a in langs])
    cents, owner, bounds = [], [], []
    for g in range(len(names)):
        y = x[which == g]
        k = min(clusters, len(y))
        c = [y.mean(0)]
        while len(c) < k:  # the row farthest from all centroids so far
            c.append(y[int(np.argmin(np.max(y @ np.stack(c).T, axis=1)))])
        c = np.stack(c)
        for _ in range(rounds):
            near = np.argmax(y @ c.T, axis=1)
            c = np.stack([y[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        cents.append(c)
        owner += [g] * len(c)
        bounds.append(slack * float(np.quantile(np.max(y @ c.T, axis=1), quantile)))
    return Model(names, idf, np.concatenate(cents).astype(np.float32), np.array(owner), np.array(bounds))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out, vec = batch.column(0).to_pylist(), [], []
        for lang, t in zip(langs, batch.column(1).to_pylist(), strict=True):
            if (c := counts(t)) is not None:
                out.append(lang)
                vec.append(_damped(c).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(vec, pa.binary())], names=["lang", "v"])


def train(docs: DataFrame, per_language: int = 400, total: int = 4000, **kw) -> Model:
    """Fit on the training part of docs (doc_id, text, lang).  At most `total` vectors of 8 KB reach the driver."""
    small_batches(docs.sparkSession)
    part = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    hashed = F.xxhash64("doc_id")
    # The rank is taken over ids only, and its limit is applied in each task before the shuffle.
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = part.select("doc_id", "lang", hashed.alias("h")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language)
    chosen = ids.orderBy("r", "h", "lang").limit(total).select("doc_id", "lang").distinct()
    sample = part.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    # An id may have several rows: one text of each is taken.
    rows = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text").mapInArrow(tidy(_vectors), "lang string, v binary").toArrow()
    vec = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32) if rows.num_rows else np.zeros((0, DIM), np.float32)
    langs = rows["lang"].to_pylist()
    order = sorted(range(len(langs)), key=lambda k: (langs[k], zlib.crc32(vec[k].tobytes())))
    return fit(vec[order], [langs[k] for k in order], **kw)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs (doc_id, text).  The model is a few hundred KB for each language."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with lang set to the prediction; all columns are kept."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[lang] = pa.array([f[0] for f in found], batch.column(lang).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
