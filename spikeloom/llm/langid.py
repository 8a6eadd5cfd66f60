"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

Features are hashed byte bigrams and trigrams of the whole text, on a log scale
and of unit length. Both levels are linear, so scoring a block of documents is
one matrix product.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.training import balanced, remainder

FEATURES = 4096
#: Labelled rows to learn from, for each language and in all (fewer of each, if there are many languages).
PER_LANGUAGE, IN_ALL = 700, 14_000
#: Bytes whose n-grams are hashed at once.
PIECE = 1 << 20
#: Closely related languages by ISO code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tt",
}


def family(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang in of.split()), lang)


def features(s: X.Slice) -> np.ndarray:
    """One row per document: log counts of hashed n-grams, scaled to length 1."""
    rows = s.hi - s.lo
    count = np.zeros(rows * FEATURES, np.int64)
    for lo in range(0, len(s.buf), PIECE):  # n-grams that begin in one piece of the bytes after another
        b = X.LOWER[s.buf[lo : lo + PIECE + 2]].astype(np.uint32)
        at = np.arange(lo, min(lo + PIECE, len(s.buf)))
        doc = np.searchsorted(s.end, at, "right")
        left = s.end[doc] - at
        two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(2246822519)
        three = two[:-1] + b[2:] * np.uint32(3266489917)
        for gram, size, factor in ((two, 2, 668265263), (three, 3, 374761393)):
            use = np.flatnonzero(left >= size)
            np.add.at(count, doc[use] * FEATURES + (gram[use] * np.uint32(factor) >> np.uint32(20)), 1)
    out = np.log1p(count.astype(np.float32))
    out = out.reshape(rows, FEATURES)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def has_letter(s: X.Slice) -> np.ndarray:
    """Whether each document has a letter of any script."""
    low = X.LOWER[s.buf]
    seen = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = seen[s.end] > seen[s.start]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in s.buf[s.start[k] : s.end[k]].tobytes().decode("utf-8", "replace"))
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 80) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient steps; y is -1 or 1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) / 2).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 + 2 * c * 2))
    xt = np.ascontiguousarray(x.T)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        g = v - np.float32(2 * c) * (xt @ (weight * y * gap))
        new = v - rate * g
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Weights of the family level (one-versus-rest) and of each pair of languages inside a family."""
    langs = np.array(langs)
    names = sorted(set(langs))
    fams = sorted({family(n) for n in names})
    of = np.array([family(n) for n in langs])
    top = np.stack([_svm(x, np.where(of == f, 1.0, -1.0)) if len(fams) > 1 else np.append(np.zeros(x.shape[1]), 1.0) for f in fams], 1)
    pairs = [(a, b) for f in fams for a, b in combinations([n for n in names if family(n) == f], 2)]
    low = [_svm(x[np.isin(langs, p)], np.where(langs[np.isin(langs, p)] == p[0], 1.0, -1.0)) for p in pairs]
    return {"names": names, "fams": fams, "pairs": pairs, "w": np.hstack([top, *[v[:, None] for v in low]]).astype(np.float32)}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row: the family's softmax share times the share of pairwise votes."""
    z = x @ model["w"][:-1] + model["w"][-1]
    fams, names = model["fams"], model["names"]
    top = np.exp(4 * (z[:, : len(fams)] - z[:, : len(fams)].max(1, keepdims=True)))
    top /= top.sum(1, keepdims=True)
    best = top.argmax(1)
    vote = np.zeros((len(x), len(names)))
    for k, (a, b) in enumerate(model["pairs"]):
        p = 1 / (1 + np.exp(-4 * z[:, len(fams) + k]))
        vote[:, names.index(a)] += p
        vote[:, names.index(b)] += 1 - p
    lang_fam = np.array([fams.index(family(n)) for n in names])
    size = np.bincount(lang_fam, minlength=len(fams))[lang_fam]
    vote = np.where(size > 1, vote / np.maximum(size * (size - 1) / 2, 1), 1.0)
    vote[lang_fam[None] != best[:, None]] = -1
    pick = vote.argmax(1)
    rows = np.arange(len(x))
    return np.array(names, object)[pick], np.clip(top[rows, best] * vote[rows, pick], 0, 1)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Learn from about per_language rows of each language whose crc32(doc_id) mod 5 is not 0; None without labels."""

    def rows(batches):
        for b in batches:
            x = [features(s).astype(np.float16) for s in X.slices(b.column("text"), max_rows=512)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), X.blobs([r.tobytes() for m in x for r in m])], ["lang", "x"])

    known = docs.select("doc_id", "text", "lang").where((remainder(5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = known.select("lang").distinct().count()
    got = balanced(known, "lang", min(per_language, -(-IN_ALL // max(1, languages)))).select("lang", "text").mapInArrow(rows, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(got.num_rows, FEATURES).astype(np.float32)
    return fit(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: dict | None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (and its text and struct `rest`, with carry); only the text is looked at.

    Null texts, texts without a letter, and all texts when nothing could be
    learned are `und` with score 0. A null doc_id counts as held out nowhere.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    more = ("text", "rest") if carry else ()

    def tell(batches):
        m = held.value
        for b in batches:
            langs, scores = [], []
            for s in X.slices(b.column("text"), max_rows=512):
                ok = has_letter(s)
                name, score = predict(m, features(s)) if m else (np.full(s.hi - s.lo, "und", object), np.zeros(s.hi - s.lo))
                langs += list(np.where(ok, name, "und"))
                scores.append(np.where(ok, score, 0.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), *(b.column(c) for c in more)], ["doc_id", "held_out", "lang_pred", "score", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), *more[1:])
    return rows.mapInArrow(tell, "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in more))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from docs and identify all of docs (see train and identify)."""
    return identify(docs, train(docs))
