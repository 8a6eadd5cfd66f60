"""Quality classifier: a small byte-level convolutional network in numpy.

Learned byte embeddings and filters slide over the bytes; responses are
max-pooled over hops, two neighbouring hops make an overlapping chunk, and the
chunks of the whole document are combined (mean and maximum of their pooled
responses) into one probability. The first layer is evaluated as table lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.training import balanced, remainder, within

WIDTH, STRIDE, FILTERS, EMBED = 6, 2, 16, 8
#: Filter positions in one hop; a chunk is two hops (256 bytes, overlapping by half).
HOP = 64
#: Labelled rows to learn from for each label, with their whole texts, and bytes of these at most.
PER_LABEL, BYTES = 1500, 16 << 20
#: Texts and bytes of one learning step (a longer text is a step of its own), filter positions looked at at once.
STEP_TEXTS, STEP_BYTES, AT_ONCE = 48, 1 << 18, 1 << 16


def layout(s: X.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, the first position of every hop and the one after it, and the first hop of every document (and the end)."""
    n = s.end - s.start
    positions = np.maximum(1, -(-n // STRIDE))
    room = positions * STRIDE + WIDTH
    room += room % STRIDE
    at = np.cumsum(room) - room
    buf = np.zeros(int(room.sum()), np.uint8)
    buf[X.gather(n, at)] = s.buf
    hops = -(-positions // HOP)
    first = np.concatenate([[0], np.cumsum(hops)])
    start = np.repeat(at // STRIDE, hops) + HOP * (np.arange(first[-1]) - np.repeat(first[:-1], hops))
    stop = np.minimum(start + HOP, np.repeat(at // STRIDE + positions, hops))
    return buf, start, stop, first


def responses(buf: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Filter responses at every STRIDE-th byte: sums of one table row per byte of the window."""
    n = (len(buf) - WIDTH) // STRIDE + 1
    out = tables[0][buf[: n * STRIDE : STRIDE]]
    for j in range(1, WIDTH):
        out += tables[j][buf[j : j + (n - 1) * STRIDE + 1 : STRIDE]]
    return out


def maxima(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, tables: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Highest response of every hop and filter, and (with places) the first position that has it.

    Padding between documents is in no hop. Memory goes with AT_ONCE positions, not with the text.
    """
    top = np.empty((len(start), tables.shape[2]), tables.dtype)
    arg = np.empty(top.shape, np.int64) if places else None
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + AT_ONCE, "right")))
        a, b = int(start[lo]), int(stop[hi - 1])
        r = responses(buf[a * STRIDE : (b - 1) * STRIDE + WIDTH], tables)
        bounds = np.stack([start[lo:hi], stop[lo:hi]], 1).ravel()[:-1] - a  # hops, and what lies between them
        top[lo:hi] = np.maximum.reduceat(r, bounds, axis=0)[::2]
        if places:
            same = r == np.repeat(top[lo:hi], np.diff(np.append(start[lo:hi], b)), axis=0)
            arg[lo:hi] = a + np.minimum.reduceat(np.where(same, np.arange(len(r), dtype=np.int32)[:, None], len(r)), bounds, axis=0)[::2]
        lo = hi
    return top, arg


def chunks(act: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectified responses of chunks (each hop and the next one of its document), and that next hop."""
    nxt = np.minimum(np.arange(len(act)) + 1, np.repeat(first[1:] - 1, np.diff(first)))
    return np.maximum(act, act[nxt]), nxt


def combined(chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: mean and maximum over its chunks."""
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunk, first[:-1], axis=0)])


def pooled(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Per document: mean and maximum over chunks of the rectified, max-pooled responses."""
    act = np.maximum(maxima(buf, start, stop, tables)[0] + bias, 0)
    return combined(chunks(act, first)[0], first)


def gradients(p: dict, texts: list[bytes], y: np.ndarray, share: np.ndarray) -> tuple[float, dict]:
    """Weighted log loss of some texts, and its derivatives by all parameters, through the pooling."""
    s = next(X.slices(pa.array(texts, pa.binary()), max_bytes=1 << 40))
    buf, start, stop, first = layout(s)
    tables = np.einsum("be,jef->jbf", p["e"], p["k"]).astype(np.float32)
    top, arg = maxima(buf, start, stop, tables, True)
    act = np.maximum(top + p["c"], 0)
    chunk, nxt = chunks(act, first)
    left = act >= act[nxt]
    x = combined(chunk, first)
    q = 1 / (1 + np.exp(-np.clip(x @ p["w"] + p["b"], -30, 30)))
    loss = -float((share * np.log(np.where(y > 0, q, 1 - q))).sum()) / len(texts)
    d = (q - y) * share / len(texts)
    doc, n, f = np.repeat(np.arange(len(texts)), np.diff(first)), np.diff(first)[:, None], len(p["c"])
    g = {"w": x.T @ d, "b": np.array([d.sum()])}
    high = chunk == x[doc, f:]
    gc = (d[:, None] * p["w"][:f] / n)[doc] + (d[:, None] * p["w"][f:])[doc] * high / np.maximum(1, np.add.reduceat(high.astype(float), first[:-1], axis=0))[doc]
    ga = np.where(left, gc, 0)
    np.add.at(ga, nxt, np.where(left, 0, gc))
    ga *= act > 0
    g["c"] = ga.sum(0)
    gt = np.zeros((WIDTH, 256, f))
    of = np.broadcast_to(np.arange(f), arg.shape)
    for j in range(WIDTH):
        np.add.at(gt[j], (buf[arg * STRIDE + j], of), ga)
    g["k"] = np.einsum("be,jbf->jef", p["e"], gt)
    g["e"] = np.einsum("jbf,jef->be", gt, p["k"])
    return loss, g


def steps(order: np.ndarray, sizes: np.ndarray):
    """Cut an order of texts into learning steps."""
    lo = 0
    while lo < len(order):
        room = np.cumsum(sizes[order[lo : lo + STEP_TEXTS]])
        hi = lo + max(1, int(np.searchsorted(room, STEP_BYTES, "right")))
        yield order[lo:hi]
        lo = hi


def _learn(texts: list[bytes], y: np.ndarray, epochs: int = 6, seed: int = 5) -> dict:
    """Stochastic gradient (Adam) through the pooling; classes weighed equally."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "k": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), "c": np.zeros(FILTERS), "w": rng.normal(0, 0.1, 2 * FILTERS), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    share = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    sizes, decay = np.array([len(t) for t in texts]), {"w": 1e-4, "k": 1e-5, "e": 1e-5}
    for epoch in range(epochs):
        for rows in steps(rng.permutation(len(texts)), sizes):
            _, g = gradients(p, [texts[r] for r in rows], y[rows], share[rows])
            weight = len(rows) / STEP_TEXTS  # a step of few, long texts moves less
            step += 1
            for k in p:
                grad = weight * (g[k] + decay.get(k, 0) * p[k])
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] -= 0.01 * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"tables": np.einsum("be,jef->jbf", p["e"], p["k"]).astype(np.float32), "bias": p["c"].astype(np.float32), "w": p["w"].astype(np.float32), "b": float(p["b"][0])}


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = BYTES) -> dict | None:
    """Learn `quality` from about per_label rows of each label, of at most `most` bytes of text, whose crc32(doc_id) mod 3 is not 1; None unless both labels occur."""
    known = labels.where((remainder(3) != 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = within(docs, balanced(known, "y", per_label), "y", most)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", F.coalesce("text", F.lit("")).cast("binary").alias("data")).toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    data = got.column("data").to_pylist()
    order = sorted(range(len(data)), key=lambda k: (y[k], data[k]))  # the same model whatever the order of rows
    model = _learn([data[k] for k in order], y[order])
    # learned on equal shares: go half of the way (in log odds) to the shares among all labelled rows
    model["b"] += 0.5 * float(np.log(counts[1] / counts[0]))
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is looked at.

    Null counts as an empty text, which has a score too. Without a model (no
    labels, or one kind only) every score is 0.5. Memory goes with a slice of
    text, never with a whole partition.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches):
        m = held.value
        for b in batches:
            out = [np.zeros(0)]
            for s in X.slices(b.column("text"), 1 << 19, 4096):
                x = pooled(*layout(s), m["tables"], m["bias"]) if m else None
                out.append(1 / (1 + np.exp(-np.clip(x @ m["w"] + m["b"], -30, 30).astype(np.float64))) if m else np.full(s.hi - s.lo, 0.5))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tell, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from docs and labels, and score all of docs."""
    return score(docs, train(docs, labels))
