"""Filters of series that are longer than a task: a recursive filter by a scan over blocks, and Fourier transforms by columns and rows.

A block of a series is a row; what one block needs of all others is carried by
small tables of states, so a single channel is as many tasks as it has blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.operators.units import stored

CHANNEL = ("recording_id", "grid", "channel")
#: Samples of a block, states that one task walks through in turn, and complex cells of a part of a transform.
BLOCK, FAN, CELLS = 1 << 18, 1024, 1 << 20

Sections = list[tuple[np.ndarray, np.ndarray]]


# --- recursive filters


def advance(u: np.ndarray, b: np.ndarray, a: np.ndarray, z: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A second-order section from state z on: output and state afterwards; within strips by matrices, from strip to strip by the state alone."""
    step, drive = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    kernel = np.array([b[0], *(powers[k][0] @ drive for k in range(size - 1))])
    lag = np.arange(size)[:, None] - np.arange(size)[None]
    inside = np.where(lag >= 0, kernel[np.abs(lag)], 0.0)  # what earlier inputs of a strip add to each output
    seen = np.array([p[0] for p in powers[:size]])  # what the state before a strip adds
    carry = np.array([powers[size - 1 - k] @ drive for k in range(size)])
    rows = np.zeros((-(-len(u) // size), size))
    rows.ravel()[: len(u)] = u
    push, states, rest = rows @ carry, np.empty((len(rows), 2)), len(u) % size
    for k in range(len(rows)):
        states[k] = z
        z = powers[size] @ z + push[k] if k + 1 < len(rows) or not rest else powers[rest] @ z + rows[k, :rest] @ carry[size - rest :]
    return (rows @ inside.T + states @ seen.T).ravel()[: len(u)], z


def cascade(x: np.ndarray, sections: Sections, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections one after the other; z holds two numbers of each."""
    z = z.reshape(-1, 2).copy()
    for k, (b, a) in enumerate(sections):
        x, z[k] = advance(x, b, a, z[k])
    return x, z.ravel()


def transition(sections: Sections) -> np.ndarray:
    """What one sample without input makes of the state of a cascade."""
    n = 2 * len(sections)
    return np.column_stack([cascade(np.zeros(1), sections, np.eye(n)[k])[1] for k in range(n)])


def steady(sections: Sections, first: float) -> list[float]:
    """State of a band-pass cascade that has always seen one value: it answers 0, so only its first section has a state."""
    b = sections[0][0]
    return [-b[0] * first, b[2] * first, *[0.0] * (2 * len(sections) - 2)]


def entering(maps: DataFrame, step: np.ndarray, fan: int = FAN) -> DataFrame:
    """(keys, k, z): the state before each block, where block k turns a state z into step^n z + c; zero before the first.

    Blocks are put together `fan` at a time, these groups again, and so on; then
    states go down the same tree. maps: (keys, k, n, c), few bytes a block.
    """
    size = len(step)
    span = maps.agg(F.max("k") - F.min("k")).first()[0] or 0

    def walk(pdf: pd.DataFrame, z: np.ndarray):
        for r in pdf.sort_values("k").itertuples():
            yield r.k, z
            z = np.linalg.matrix_power(step, int(r.n)) @ z + np.asarray(r.c)
        yield None, z

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.asarray(pdf["z"].iloc[0], float) if "z" in pdf else np.zeros(size)
        found = list(walk(pdf, z))[:-1]
        return pdf[list(CHANNEL)].iloc[[0] * len(found)].assign(k=[k for k, _ in found], z=[v.tolist() for _, v in found])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = list(walk(pdf, np.zeros(size)))[-1][1]
        return pdf[list(CHANNEL)].iloc[:1].assign(k=int(pdf["k"].iloc[0] // fan), n=int(pdf["n"].sum()), c=[whole.tolist()])

    schema = "recording_id string, grid int, channel int, k long, "
    if span < fan:
        return maps.groupBy(*CHANNEL).applyInPandas(down, schema + "z array<double>")
    group = F.floor(F.col("k") / fan)
    above = entering(maps.groupBy(*CHANNEL, group.alias("_g")).applyInPandas(up, schema + "n long, c array<double>"), step, fan)
    own = maps.withColumn("_g", group).join(above.withColumnRenamed("k", "_g"), [*CHANNEL, "_g"])
    return own.groupBy(*CHANNEL, "_g").applyInPandas(down, schema + "z array<double>")


def filtered(samples: DataFrame, sections: Sections, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Forward and backward pass of a band-pass cascade over each channel, with odd padding at both ends.

    Each block tells how it changes a state; a scan gives the states in which
    blocks are entered; then they are filtered, and tell what they do to the
    state of the way back. Padding is a block of its own at each end.
    """
    keys, pad, step = list(CHANNEL), 3 * (2 * len(sections) + 1), transition(sections)
    at = F.array_sort(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value"))))
    cut = samples.groupBy(*keys, F.floor(F.col("sample") / block).alias("k")).agg(at.alias("s")).select(*keys, "k", F.col("s.sample").alias("at"), F.col("s.value").alias("x"))

    def told(batches):
        for pdf in batches:
            yield pdf.assign(c=[cascade(np.asarray(x), sections, np.zeros(2 * len(sections)))[1].tolist() for x in pdf["x"]])

    schema = "recording_id string, grid int, channel int, k long, at array<long>, x array<double>"
    blocks = stored(cut.mapInPandas(told, schema + ", c array<double>"))
    # both ends of each channel; blocks but the first and last may be short only where samples are missing
    w = W.partitionBy(*keys)
    size = blocks.select(*keys, "k", F.size("x").alias("n"), F.slice("x", 1, pad + 1).alias("head"), F.slice("x", F.greatest(F.lit(1), F.size("x") - pad), pad + 1).alias("tail"))
    size = size.withColumn("before", F.sum("n").over(w.orderBy("k")) - F.col("n")).withColumn("after", F.sum("n").over(w.orderBy(F.col("k").desc())) - F.col("n"))
    join = lambda c, cond: F.flatten(F.array_sort(F.collect_list(F.when(cond, F.struct("k", c))))[c])
    ends = size.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), join("head", F.col("before") <= pad).alias("head"), join("tail", F.col("after") <= pad).alias("tail"))

    def padded(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                p, head, tail = min(pad, r.n - 1), np.asarray(r.head), np.asarray(r.tail)
                base = {"recording_id": r.recording_id, "grid": r.grid, "channel": r.channel, "at": []}
                start, end = 2 * head[0] - head[p:0:-1], 2 * tail[-1] - tail[-2 : -p - 2 : -1]
                out.append(base | {"k": r.lo - 2, "n": 0, "c": steady(sections, start[0] if p else head[0]), "x": []})
                for k, x in ((r.lo - 1, start), (r.hi + 1, end)) if p else ():
                    out.append(base | {"k": k, "n": p, "c": cascade(x, sections, np.zeros(2 * len(sections)))[1].tolist(), "x": x.tolist()})
            yield pd.DataFrame(out)

    more = stored(ends.mapInPandas(padded, schema + ", n long, c array<double>"))
    maps = blocks.select(*keys, "k", F.size("x").cast("long").alias("n"), "c").union(more.select(*keys, "k", "n", "c"))
    all_ = blocks.drop("c").union(more.where("n > 0").select(*blocks.columns[:-1]))

    def forward(batches):
        for pdf in batches:
            y = [cascade(np.asarray(x), sections, np.asarray(z))[0] for x, z in zip(pdf["x"], pdf["z"], strict=True)]
            back = [cascade(v[::-1], sections, np.zeros(2 * len(sections)))[1].tolist() for v in y]
            yield pdf.drop(columns="z").assign(x=[v.tolist() for v in y], c=back, last=[v[-1] for v in y])

    there = stored(all_.join(entering(maps, step, fan), [*keys, "k"]).mapInPandas(forward, schema + ", c array<double>, last double"))
    turned = there.select(*keys, (-F.col("k")).alias("k"), F.size("x").cast("long").alias("n"), "c")
    first = there.groupBy(*keys).agg(F.max("k").alias("k"), F.max_by("last", "k").alias("v"))
    state = F.array(*(F.col("v") * v for v in steady(sections, 1.0)))
    maps = turned.union(first.select(*keys, (-F.col("k") - 1).alias("k"), F.lit(0).cast("long"), state))

    def backward(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if len(r.at):
                    y = cascade(np.asarray(r.x)[::-1], sections, np.asarray(r.z))[0][::-1]
                    yield pd.DataFrame({"recording_id": r.recording_id, "grid": r.grid, "channel": r.channel, "sample": r.at, "value": y})

    back = entering(maps, step, fan).withColumn("k", -F.col("k"))
    return there.select(*keys, "k", "at", "x").join(back, [*keys, "k"]).mapInPandas(backward, "recording_id string, grid int, channel int, sample long, value double")


# --- Fourier transforms


def _shape(n: int, cells: int) -> tuple[int, int, int, int]:
    """Rows and columns of the matrix of at least 2n - 1 cells, and how many columns and rows a part has."""
    m = max(1, (2 * n - 2).bit_length())
    n2 = 1 << m // 2
    n1 = (1 << m) // n2
    return n1, n2, min(n2, max(1, cells // n1)), min(n1, max(1, cells // n2))


def chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi j^2 / n), with the square reduced exactly."""
    j = np.asarray(j, np.int64)
    return np.exp(-1j * np.pi * (j * j % (2 * n)) / n)


def dft(rows: DataFrame, finish, schema: str, cells: int = CELLS) -> DataFrame:
    """Discrete Fourier transforms of any length n of series (keys, n, pos, re, im); what isn't there is 0.

    The transform of length n is a product of chirps with a convolution
    (Bluestein), which is made of transforms of a power of two. That is laid out
    as a matrix of numbers row by row: columns are transformed, turned, sent by
    rows (the first exchange), transformed, multiplied, transformed back, and sent
    by columns again (the second), so each exchange moves every cell once, in
    equal parts of at most `cells`. finish(keys, n, places, values) gets the
    transform in parts and gives rows of schema.
    """
    keys = [*CHANNEL, "n"]
    # the shape of each matrix, as _shape gives it
    bits = F.length(F.bin(F.greatest(2 * F.col("n") - 2, F.lit(1))))
    n2, n1 = (F.pow(F.lit(2.0), b).cast("long") for b in (F.floor(bits / 2), bits - F.floor(bits / 2)))
    width = F.least(n2, F.greatest(F.lit(1), F.floor(F.lit(cells) / n1)))
    parts = rows.withColumn("part", F.floor(F.pmod(F.col("pos"), n2) / width))
    # every part of a series takes part, also where all its cells are 0
    empty = rows.select(*keys).distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n2 - 1) / width))))
    zero = empty.select(*keys, "part", F.lit(-1).cast("long").alias("pos"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    head = "recording_id string, grid int, channel int, n long, "

    def wrapped(f):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            key = {k: pdf[k].iloc[0] for k in keys}
            out = f(int(key["n"]), int(pdf["part"].iloc[0]), pdf)
            return pd.DataFrame([key] * len(out)).assign(**{c: out[c].to_numpy() for c in out}) if len(out) else pd.DataFrame(columns=[*keys, *out.columns])

        return run

    def by_columns(n: int, part: int, pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, c, r = _shape(n, cells)
        a, pdf = np.zeros((n1, c), complex), pdf[pdf["pos"] >= 0]
        at = pdf["pos"].to_numpy()
        a[at // n2, at % n2 - part * c] = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()) * chirp(at, n)
        col = part * c + np.arange(c)
        j = np.arange(n1)[:, None] * n2 + col[None]
        far = np.minimum(j, n1 * n2 - j)
        b = np.where(far < n, np.conj(chirp(np.minimum(far, n), n)), 0)
        turn = np.exp(-2j * np.pi * (np.arange(n1)[:, None] * col[None]) / (n1 * n2))
        a, b = np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn
        cuts = range(0, n1, r)
        return pd.DataFrame({"part": [k // r for k in cuts], "other": part, "a": [a[k : k + r].tobytes() for k in cuts], "b": [b[k : k + r].tobytes() for k in cuts]})

    def gathered(pdf: pd.DataFrame, name: str, rows: int) -> np.ndarray:
        pdf = pdf.sort_values("other")
        return [np.frombuffer(x, complex).reshape(rows, -1) for x in pdf[name]]

    def by_rows(n: int, part: int, pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, c, r = _shape(n, cells)
        a, b = (np.fft.fft(np.hstack(gathered(pdf, x, r)), axis=1) for x in ("a", "b"))
        a = np.fft.ifft(a * b, axis=1)
        row = part * r + np.arange(r)
        a = a * np.exp(2j * np.pi * (row[:, None] * np.arange(n2)[None]) / (n1 * n2))
        return pd.DataFrame({"part": range(n2 // c), "other": part, "a": [np.ascontiguousarray(a[:, k : k + c]).tobytes() for k in range(0, n2, c)]})

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {k: pdf[k].iloc[0] for k in keys}
        n, part = int(key["n"]), int(pdf["part"].iloc[0])
        n1, n2, c, r = _shape(n, cells)
        a = np.fft.ifft(np.vstack(gathered(pdf, "a", r)), axis=0)
        k = (np.arange(n1)[:, None] * n2 + part * c + np.arange(c)[None]).ravel()
        use = k < n
        return finish(key, n, k[use], a.ravel()[use] * chirp(k[use], n))

    out = parts.select(*keys, "part", "pos", "re", "im").union(zero).groupBy(*keys, "part").applyInPandas(wrapped(by_columns), head + "part long, other long, a binary, b binary")
    out = out.groupBy(*keys, "part").applyInPandas(wrapped(by_rows), head + "part long, other long, a binary")
    return out.groupBy(*keys, "part").applyInPandas(back, schema)


def notched(samples: DataFrame, lengths: DataFrame, fs: float, cells: int = CELLS) -> DataFrame:
    """spectral_notch of channels that are longer than a task. lengths: (keys, n, lo), number of samples and first one, which follow without gaps."""
    keys, step = list(CHANNEL), int(fs)
    wide = step * max(1, cells // step)  # bins of a part of whole slices
    x = samples.join(lengths, keys).select(*keys, "n", (F.col("sample") - F.col("lo")).alias("pos"), F.col("value").cast("double").alias("re"))
    head = "recording_id string, grid int, channel int, n long, "

    def parts(key, n, k, v):
        q = np.maximum(k - 1, 0) // wide
        order = np.argsort(q, kind="stable")
        k, v, q = k[order], v[order], q[order]
        at = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
        end = np.append(at[1:], len(q))
        return pd.DataFrame([key] * len(at)).assign(q=q[at], k=[k[a:b].tobytes() for a, b in zip(at, end, strict=True)], v=[v[a:b].tobytes() for a, b in zip(at, end, strict=True)]) if len(at) else pd.DataFrame(columns=[*key, "q", "k", "v"])

    spectrum = stored(dft(x.withColumn("im", F.lit(0.0)), parts, head + "q long, k binary, v binary", cells))

    def whole(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        k, v = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("k", np.int64), ("v", complex)))
        order = np.argsort(k)
        return k[order], v[order]

    def flagged(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf[[*keys, "n"]].iloc[:1], int(pdf["n"].iloc[0])
        k, v = whole(pdf)
        mag = np.abs(v[k > 0])
        k = k[k > 0]
        full = [lo for lo in range(0, len(k), step) if k[lo] + step <= n]
        hit = [k[lo : lo + step][(m := mag[lo : lo + step]) > np.median(m) + 5 * m.std()] for lo in full]
        hit = np.concatenate(hit) if hit else np.zeros(0, np.int64)
        reach = int(np.floor(round(4 * n / fs) / 2))
        a, b = np.maximum(hit - reach, 1), np.minimum(hit + reach, min(n // 2 + 1, n - 1))
        a, b = a[a <= b], b[a <= b]
        new = np.append(True, a[1:] > b[:-1] + 1) if len(a) else np.zeros(0, bool)  # neighbours are one range
        a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)] if len(b) else b
        return key.iloc[[0] * len(a)].assign(a=a, b=b)

    ranges = spectrum.groupBy(*keys, "n", "q").applyInPandas(flagged, head + "a long, b long")
    ranges = ranges.withColumn("q", F.explode(F.sequence(F.floor((F.col("a") - 1) / wide), F.floor((F.col("b") - 1) / wide)))).groupBy(*keys, "n", "q").agg(F.collect_list(F.struct("a", "b")).alias("r"))

    def kept(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                k, v, n = np.frombuffer(row["k"], np.int64), np.frombuffer(row["v"], complex), int(row["n"])
                use = np.zeros(len(k), bool)
                for r in row["r"]:
                    use |= (k >= r["a"]) & (k <= r["b"])
                k, v = k[use], v[use]
                pos, g = np.concatenate([k, (n - k) % n]), np.concatenate([np.conj(v), v])
                if len(pos):
                    yield pd.DataFrame({**{c: row[c] for c in keys}, "n": n, "pos": pos, "re": g.real, "im": g.imag})

    lines = spectrum.join(ranges, [*keys, "n", "q"]).mapInPandas(kept, head + "pos long, re double, im double")
    wave = dft(lines, lambda key, n, k, v: pd.DataFrame({**{c: key[c] for c in keys}, "pos": k, "wave": v.real / n}), "recording_id string, grid int, channel int, pos long, wave double", cells)
    out = samples.join(lengths.drop("n"), keys).withColumn("pos", F.col("sample") - F.col("lo")).join(wave, [*keys, "pos"], "left")
    return out.select(*keys, "sample", (F.col("value").cast("double") - F.coalesce("wave", F.lit(0.0))).alias("value"))
