"""Toxic spans by a linear-chain conditional random field, with document scores from its marginals.

Sentences are the chains. Token labels are derived from document labels: in a
toxic document the words, and words with a beginning, that are far more frequent
in toxic than in clean documents are the labelled toxic tokens. A token's
features are the word, its beginning (so that unseen forms of a toxic stem are
found) and the words before and after it in its sentence. Forward-backward runs
over all sentences of a slice at once, step by step along the chain; the chain
of a text without stops is cut into blocks that are joined by their transfer
matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.training import balanced, remainder, within

#: Labelled rows to learn from for each label, with their whole texts, and bytes of these at most.
PER_LABEL, BYTES = 2000, 8 << 20
#: A word or beginning is toxic from this many toxic documents, log odds ratio and likelihood ratio (G squared, p about 1e-5) on.
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 3, 2.5, 20.0
#: Features with a weight of their own occur in this many documents of the sample; bytes of a beginning.
#: These bounds were chosen by cross-validation inside the rows that may be learned from.
VOCABULARY_DOCS, STEM = 4, 4
SPAN_AT = 0.5
#: Tokens of a block of a chain.
LONG = 1024
_U = np.uint64


def tokens(s: X.Slice) -> tuple[X.Words, np.ndarray, np.ndarray]:
    """Words, hashes of each and of its beginning (2 rows, 0 if it is shorter), and whether each begins a sentence (after . ! ? or a line end, or a document's start)."""
    buf = X.LOWER[s.buf]
    w = X.words(s, X.word_table("alnum"), buf)
    before = X.prefix_hash(buf)
    stem = X.span_hash(before, w.start, np.minimum(w.start + STEM, w.end)) ^ _U(0x9E3779B97F4A7C15)
    h = np.stack([X.span_hash(before, w.start, w.end), np.where(w.end - w.start >= STEM, stem, _U(0))])
    stops = np.concatenate([[0], np.cumsum((buf == 10) | (buf == 33) | (buf == 46) | (buf == 63))])
    begin = np.ones(h.shape[1], bool)
    begin[1:] = stops[w.start[1:]] > stops[w.end[:-1]]
    begin[w.first[w.first < w.last]] = True
    return w, h, begin


def lookup(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place of each hash among sorted keys, or -1; a bitmap of 2^22 places rules out most first."""
    out = np.full(len(found), -1, np.int64)
    if len(keys):
        places = np.zeros(1 << 22, bool)
        places[keys >> _U(42)] = True
        maybe = np.flatnonzero(places[found >> _U(42)])
        at = np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)
        out[maybe] = np.where(keys[at] == found[maybe], at, -1)
    return out


def emissions(h: np.ndarray, begin: np.ndarray, model: dict) -> np.ndarray:
    """Weight of the toxic state at each token; words outside the vocabulary share one weight, as neighbours and beginnings they have none."""
    at, stem = lookup(model["keys"], h[0]), lookup(model["stems"], h[1])
    known = at >= 0
    out = np.full(len(at), model["other"])
    out[known] = model["weights"][at[known]]
    out[stem >= 0] += model["stem_weights"][stem[stem >= 0]]
    before, after = np.zeros(len(at)), np.zeros(len(at))
    before[known], after[known] = model["before"][at[known]], model["after"][at[known]]
    out[1:] += np.where(begin[1:], 0, before[:-1])
    out[:-1] += np.where(begin[1:], 0, after[1:])
    return out


def _blocks(t: np.ndarray, g: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of chains into blocks of at most LONG tokens, with the state before each block and after it.

    Returns whether a block begins at each token, the share of the toxic state
    just before each block, and the backward share at its last token; blocks at
    the ends of chains get -1 and 0.5. Along a chain only 2 x 2 matrices of
    whole blocks are multiplied.
    """
    at = np.flatnonzero(begin)
    place = np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))
    cut = place % LONG == 0
    first = np.flatnonzero(cut)
    before, after = np.full(len(first), -1.0), np.full(len(first), 0.5)
    if len(first) == len(at):
        return cut, before, after
    size = np.diff(np.append(first, len(g)))
    inner = ~begin[first]  # blocks that go on from the one before
    long = np.flatnonzero(inner | np.append(inner[1:], False))
    m = np.broadcast_to(np.eye(2), (len(first), 2, 2)).copy()  # transfer of each block: from the state before it to its last token
    for k in range(int(size.max())):
        use = long[(size[long] > k) & (inner[long] | (k > 0))]
        step = t[:2][None] * np.stack([np.ones(len(use)), g[first[use] + k]], 1)[:, None, :]
        m[use] = m[use] @ step
        m[use] /= m[use].sum((1, 2), keepdims=True)
    state = None
    for b in long:
        if inner[b]:
            before[b] = state[1]
            v = state @ m[b]
        else:
            v = np.array([t[2, 0], t[2, 1] * g[first[b]]]) @ m[b]
        state = v / v.sum()
    back = None
    for b in long[::-1]:
        if b + 1 == len(first) or not inner[b + 1]:
            back = np.array([0.5, 0.5])
        else:
            v = m[b + 1] @ back
            back = v / v.sum()
        after[b] = back[1]
    return cut, before, after


def marginals(e: np.ndarray, begin: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) at each token, and with `pairs` the expected transitions (2 x 2, the first state apart).

    trans: rows 0 and 1 from clean and toxic, row 2 from the start; in logs.
    """
    n = len(e)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    t = np.exp(trans)
    g = np.exp(np.clip(e, -30, 30))
    cut, before, after = _blocks(t, g, begin)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size, before, after = first[order], size[order], before[order], after[order]
    # how many blocks are longer than each step
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")
    alpha, beta = np.empty(n), np.empty(n)  # shares of the toxic state
    p = first
    a1 = np.where(before < 0, t[2, 1], (1 - before) * t[0, 1] + before * t[1, 1]) * g[p]
    a1 = a1 / (a1 + np.where(before < 0, t[2, 0], (1 - before) * t[0, 0] + before * t[1, 0]))
    alpha[p] = a1
    for k in range(1, size[0]):
        m = alive[k]
        p = first[:m] + k
        a1 = a1[:m]
        a0 = 1 - a1
        x1 = (a0 * t[0, 1] + a1 * t[1, 1]) * g[p]
        x0 = a0 * t[0, 0] + a1 * t[1, 0]
        a1 = x1 / (x1 + x0)
        alpha[p] = a1
    last = first + size - 1
    b1 = after
    beta[last] = b1
    for k in range(1, size[0]):
        m = alive[k]
        p = last[:m] - k
        b1 = b1[:m]
        y1 = b1 * g[p + 1]
        y0 = 1 - b1
        x1 = t[1, 0] * y0 + t[1, 1] * y1
        x0 = t[0, 0] * y0 + t[0, 1] * y1
        b1 = x1 / (x1 + x0)
        beta[p] = b1
    up = alpha * beta
    out = up / (up + (1 - alpha) * (1 - beta))
    if not pairs:
        return out
    inside, expected = np.flatnonzero(~begin), np.zeros((2, 2))
    for k in range(0, len(inside), 1 << 17):  # piece by piece, for the sake of memory
        q = inside[k : k + (1 << 17)]
        a = np.stack([1 - alpha[q - 1], alpha[q - 1]], 1)
        b = np.stack([1 - beta[q], beta[q] * g[q]], 1)
        xi = a[:, :, None] * t[:2][None] * b[:, None, :]
        expected += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
    start = out[begin]
    return out, expected, np.array([len(start) - start.sum(), start.sum()])


def _summary(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Per document: highest marginal, log of expected toxic tokens + 1, their share."""
    out = np.zeros((len(first), 3))
    some = np.flatnonzero(last > first)
    if len(some):
        at = first[some]
        total = np.add.reduceat(p, at)
        out[some] = np.stack([np.maximum.reduceat(p, at), np.log1p(total), total / (last - first)[some]], 1)
    return out


def _lexicon(at: np.ndarray, size: int, doc: np.ndarray, y: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a numbered vocabulary: which entries occur in VOCABULARY_DOCS documents, and which are far more frequent in toxic ones."""
    seen = np.unique(at.astype(np.int64) * len(y) + doc)
    word, toxic = seen // len(y), y[seen % len(y)] > 0
    df1, df0 = np.bincount(word[toxic], minlength=size), np.bincount(word[~toxic], minlength=size)
    n1, n0 = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    odds = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
    total = (df1 + df0) / (n1 + n0)
    ratio = 2 * (df1 * np.log(np.maximum(df1, 1e-9) / (total * n1)) + df0 * np.log(np.maximum(df0, 1e-9) / (total * n0)))
    use = (df1 + df0 >= VOCABULARY_DOCS) & usable
    return use, (df1 >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO) & use


def _fit(texts: list[bytes], y: np.ndarray, steps: int = 40) -> dict:
    parts, n = [], 0
    for s in X.slices(pa.array(texts, pa.binary())):  # slice by slice: hashing needs many times a text's bytes
        w, h, begin = tokens(s)
        parts.append((h[0], h[1], begin, w.first + n, w.last + n))
        n += h.shape[1]
    begin, first, last = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), last - first)
    n1, n0 = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    gold, keys, lexicon, columns = np.zeros(n), [], [], []
    for kind in (0, 1):  # words, beginnings
        vocab, at = np.unique(np.concatenate([p[kind] for p in parts]), return_inverse=True)
        at = at.astype(np.int32)
        use, bad = _lexicon(at, len(vocab), doc, y, vocab != 0)
        gold[bad[at] & (y[doc] > 0)] = 1
        column = np.full(len(vocab), -1, np.int32)
        column[use] = np.arange(use.sum())
        keys.append(vocab[use]), lexicon.append(vocab[bad]), columns.append(column[at])
        del at, column
    del parts, doc
    # places of weights: words, an unknown word, beginnings, words before, words after, and one that stays 0
    k, none = len(keys[0]), 3 * len(keys[0]) + len(keys[1]) + 1
    word = columns[0]
    before, after = np.full(n, none, np.int32), np.full(n, none, np.int32)
    inside = np.flatnonzero(~begin)
    known = inside[word[inside - 1] >= 0]
    before[known] = k + 1 + len(keys[1]) + word[known - 1]
    known = inside[word[inside] >= 0] - 1
    after[known] = 2 * k + 1 + len(keys[1]) + word[known + 1]
    columns = [np.where(word < 0, k, word).astype(np.int32), np.where(columns[1] < 0, none, columns[1] + k + 1).astype(np.int32), before, after]
    del word, known
    weight, trans = np.zeros(none + 1), np.zeros((3, 2))
    base = np.clip(gold.mean(), 1e-6, 1 - 1e-6)
    weight[: k + 1] = np.log(base / (1 - base))
    total_of = lambda v=None: sum(np.bincount(c, v, len(weight)) for c in columns)
    of = lambda: weight[columns[0]] + weight[columns[1]] + weight[columns[2]] + weight[columns[3]]
    q = inside
    want = np.stack([np.bincount(gold[q].astype(int)[gold[q - 1] == j], minlength=2)[:2] for j in (0, 1)]).astype(float)
    open_ = np.bincount(gold[begin].astype(int), minlength=2)[:2].astype(float)
    count, aim = total_of(), total_of(gold)
    speed_w, speed_t = np.full(len(weight), 1e-3), np.full((3, 2), 1e-3)
    for _ in range(steps):
        p, xi, st = marginals(of(), begin, trans, True)
        gw = (aim - total_of(p)) / np.sqrt(count + 1) - 1e-3 * weight
        gw[-1] = 0
        gt = (np.vstack([want, open_]) - np.vstack([xi, st])) / np.sqrt(np.vstack([want, open_]).sum(1, keepdims=True) + 1) - 1e-3 * trans
        gt[:, 0] = 0
        speed_w += gw**2
        speed_t += gt**2
        weight += 0.5 * gw / np.sqrt(speed_w)
        trans += 0.5 * gt / np.sqrt(speed_t)
    model = {"keys": keys[0], "weights": weight[:k], "other": float(weight[k]), "stems": keys[1], "stem_weights": weight[k + 1 : k + 1 + len(keys[1])], "before": weight[-2 * k - 1 : -k - 1], "after": weight[-k - 1 : -1], "trans": trans, "lexicon": np.concatenate(lexicon)}
    x = np.hstack([_summary(marginals(of(), begin, trans), first, last), np.ones((len(texts), 1))])
    c, share = np.zeros(4), np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (share * (y - p)) - 1e-4 * c
        c += np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(4), grad)
    return model | {"combine": c}


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = BYTES) -> dict | None:
    """Learn `toxic` from about per_label rows of each label, of at most `most` bytes of text, whose crc32(doc_id) mod 5 is not 0; None unless both labels occur."""
    known = labels.where((remainder(5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    chosen = within(docs, balanced(known, "y", per_label), "y", most)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("y", F.col("text").cast("binary").alias("data")).toArrow()
    y, data = np.array(got.column("y").to_pylist(), float), got.column("data").to_pylist()
    if not len(y) or y.min() == y.max():
        return None
    order = sorted(range(len(data)), key=lambda k: (y[k], data[k]))  # the same model whatever the order of rows
    return _fit([data[k] for k in order], y[order])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte offsets of toxic runs) of every row; only the text is looked at.

    Null and empty texts have no tokens: no spans, and the score of a document
    without toxic tokens. Without a model every score is 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches):
        m = held.value
        for b in batches:
            scores, spans = [np.zeros(0)], []
            for s in X.slices(b.column("text")):
                if m is None:
                    scores.append(np.zeros(s.hi - s.lo))
                    spans += [[] for _ in range(s.hi - s.lo)]
                    continue
                w, h, begin = tokens(s)
                p = marginals(emissions(h, begin, m), begin, m["trans"])
                x = np.hstack([_summary(p, w.first, w.last), np.ones((s.hi - s.lo, 1))])
                scores.append(1 / (1 + np.exp(-np.clip(x @ m["combine"], -30, 30))))
                at = np.flatnonzero(p >= SPAN_AT)
                found: dict[int, list] = {}
                for i, d in zip(at, np.searchsorted(w.last, at, "right"), strict=True):
                    runs = found.setdefault(int(d), [])
                    a, e = int(w.start[i] - s.start[d]), int(w.end[i] - s.start[d])
                    if runs and i and p[i - 1] >= SPAN_AT and not begin[i]:
                        runs[-1]["end"] = e
                    else:
                        runs.append({"start": a, "end": e})
                spans += [found.get(k, []) for k in range(s.hi - s.lo)]
            z = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(z), pa.array((z >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tell, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from docs and labels, and score all of docs."""
    return score(docs, train(docs, labels))
