"""Adaptive decomposition: whitening, separation and spike levels that follow the signal batch by batch.

frames: (recording_id, grid, sample, x), delay-embedded. models, one row per
(recording_id, grid): start long (first sample), whitening array<double>
(row-major), vectors array<array<double>>, low and high array<double> (the
two spike levels of every unit); optional: cov array<double> (covariance of the
whitened signal so far, row-major), kl_mean and kl_std double, contrast_mean and
contrast_std array<double> (calibration of losses), total long (samples of the
recording, by which a stream knows its last batch), and win int where a grid has
models of several windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spikeloom.operators.units import UNIT, local_maxima, peaks_1d, stored, thin_peaks, two_means_split

KEYS = ("recording_id", "grid")
WINDOW = (*KEYS, "win")
OUT = "recording_id string, grid int, win int, unit int, sample long, source double, value double, spike boolean"


@dataclass
class Config:
    """batch: samples of a batch; skip: samples of the first batch without a full history; distance: least samples between spikes."""

    batch: int
    skip: int = 0
    distance: int = 10
    whitening_rate: float = 7e-3
    vector_rate: float = 3e-3
    alpha: float = 0.1
    weight: float = 5.0
    height: float = 3.0
    contrast: str = "logcosh"
    epochs: int = 1
    tol: float = 1e-4


# --- single steps as DataFrame operators


def calibration_centroids(peaks: DataFrame, units: DataFrame) -> DataFrame:
    """(low, high) of each unit: means of both clusters of its peak heights; one peak is the high one; none gives 0 and 1."""
    of = lambda up: F.avg(F.when(F.col("high") == up, F.col("value")))
    c = two_means_split(peaks).groupBy(*UNIT).agg(of(False).alias("low"), of(True).alias("_hi"))
    return units.join(c, list(UNIT), "left").select(*UNIT, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("_hi", F.lit(1.0)).alias("high"))


def bounded_spike_detect(pulses: DataFrame, centres: DataFrame, distance: int, height: float = 3.0) -> DataFrame:
    """Peaks from low / height to height * high of their unit, `distance` apart; spike if above the middle of both levels."""
    c = centres.select(*UNIT, "low", "high")
    band = local_maxima(pulses).join(c, list(UNIT)).where((F.col("value") >= F.col("low") / height) & (F.col("value") <= F.col("high") * height))
    kept = thin_peaks(band.select(*UNIT, "sample", "value"), distance)
    return kept.join(c, list(UNIT)).select(*UNIT, "sample", "value", (F.col("value") > (F.col("low") + F.col("high")) / 2).alias("spike"))


def centroid_update(centres: DataFrame, peaks: DataFrame, weight: float = 5.0) -> DataFrame:
    """Levels drawn to the mean of a batch's spikes and other peaks; the old level weighs as much as `weight` peaks."""
    n = peaks.groupBy(*UNIT).agg(*(f(F.when(F.col("spike") == up, F.col("value"))).alias(f"_{k}{up}") for up in (True, False) for k, f in (("n", F.count), ("s", F.sum))))
    j = centres.join(n, list(UNIT), "left")
    new = lambda old, up: ((weight * F.col(old) + F.coalesce(f"_s{up}", F.lit(0.0))) / (weight + F.coalesce(f"_n{up}", F.lit(0)))).alias(old)
    return j.select(*UNIT, new("low", False), new("high", True)).withColumn("middle", (F.col("low") + F.col("high")) / 2)


def contrast_loss(sources: DataFrame, calibration: DataFrame, batch: int, contrast: str = "logcosh") -> DataFrame:
    """Squared z-score, per unit and batch, of the contrast of the mean source value at spikes; null without spikes.

    calibration: (recording_id, unit_uid, mean, std).
    """
    m = F.avg(F.when(F.col("spike"), F.col("source")))
    g = sources.groupBy(*UNIT, F.floor(F.col("sample") / batch).alias("batch")).agg(m.alias("_m"))
    value = F.log(F.cosh("_m")) if contrast == "logcosh" else F.col("_m") ** 3 / 6
    j = g.join(calibration, list(UNIT))
    return j.select(*UNIT, "batch", F.pow((value - F.col("mean")) / (F.col("std") + 1e-12), F.lit(2.0)).alias("loss"))


# --- the state of one grid


class GridState:
    """Model of one grid, advanced by `feed` with one batch of vectors after another."""

    def __init__(self, row: pd.Series):
        n = len(row["vectors"][0])
        self.whitening = np.array(row["whitening"], float).reshape(n, -1)
        self.vectors = np.array([np.asarray(v, float) for v in row["vectors"]])
        self.levels = np.array([row["low"], row["high"]], float)
        cov = row.get("cov")
        self.cov = np.eye(n) if cov is None or np.size(cov) < n * n else np.array(cov, float).reshape(n, n)
        self.calibration = {k: row.get(k) for k in ("kl_mean", "kl_std", "contrast_mean", "contrast_std")}
        self.losses: tuple[float, np.ndarray] | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.whitening.T @ self.vectors.T

    def follow(self, white: np.ndarray, cfg: Config) -> None:
        """The covariance drawn to that of a batch of whitened vectors."""
        if len(white) > 1:
            self.cov = self.cov + cfg.alpha * (np.cov(white, rowvar=False).reshape(self.cov.shape) - self.cov)

    def whiten(self, x: np.ndarray, cfg: Config) -> np.ndarray:
        """A batch whitened by the matrix as it is, which then takes a step that makes the covariance more like the identity."""
        white = x @ self.whitening.T
        if len(x) > 1:
            self.follow(white, cfg)
            self.whitening = self.whitening - cfg.whitening_rate * (self.cov - np.eye(len(self.cov))) @ self.whitening
        return white

    def feed(self, x: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
        """Sources and spike flags of a batch; whitening, levels and vectors then follow it."""
        white = self.whiten(x, cfg)
        source = white @ self.vectors.T
        power, spikes = source * np.abs(source), np.zeros(source.shape, bool)
        for u, (low, high) in enumerate(self.levels.T):
            at = peaks_1d(power[:, u], cfg.distance, low / cfg.height, high * cfg.height)
            up = power[at, u] > (low + high) / 2
            spikes[at[up], u] = True
            for level, part in ((0, at[~up]), (1, at[up])):
                self.levels[level, u] = (cfg.weight * self.levels[level, u] + power[part, u].sum()) / (cfg.weight + len(part))
        self._score(source, spikes, cfg)
        self._turn(white, source, spikes, cfg)
        return source, spikes

    def _score(self, source: np.ndarray, spikes: np.ndarray, cfg: Config) -> None:
        """Losses of the last batch against calibration."""
        c, z = self.calibration, lambda v, mean, std: ((v - mean) / (std + 1e-12)) ** 2
        count = spikes.sum(0)
        mean = np.where(count > 0, (source * spikes).sum(0) / np.maximum(count, 1), np.nan)
        value = np.log(np.cosh(mean)) if cfg.contrast == "logcosh" else mean**3 / 6
        known = c["kl_mean"] is not None and not pd.isna(c["kl_mean"])
        kl = z(kl_to_identity(self.cov), c["kl_mean"], c["kl_std"]) if known else np.nan
        some = c["contrast_mean"] is not None and np.size(c["contrast_mean"]) == len(value)
        self.losses = kl, z(value, np.asarray(c["contrast_mean"], float), np.asarray(c["contrast_std"], float)) if some else np.full(len(value), np.nan)

    def _turn(self, white: np.ndarray, source: np.ndarray, spikes: np.ndarray, cfg: Config) -> None:
        """One step up the contrast at the spikes, then each vector made orthogonal to those before it; units without spikes stay."""
        slope = (np.tanh(source) if cfg.contrast == "logcosh" else source**2 / 2) * spikes
        count = spikes.sum(0)
        if cfg.epochs > 1:
            return self._turn_often(slope.T @ white / np.maximum(count, 1)[:, None], count, cfg)
        step = self.vectors + cfg.vector_rate * (slope.T @ white) / np.maximum(count, 1)[:, None]
        new = np.where((count > 0)[:, None], step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-8), self.vectors)
        for u in np.flatnonzero(count > 0):
            rest = new[u] - new[:u].T @ (new[:u] @ new[u])
            new[u] = rest / max(np.linalg.norm(rest), 1e-8)
        self.vectors = new


    def _turn_often(self, slope: np.ndarray, count: np.ndarray, cfg: Config) -> None:
        """Unit by unit several steps, until one hardly moves the vector; then it is made orthogonal to those before it."""
        for u in np.flatnonzero(count > 0):
            w = self.vectors[u]
            for _ in range(cfg.epochs):
                new = w + cfg.vector_rate * slope[u]
                new = new / max(np.linalg.norm(new), 1e-8)
                moved, w = 1 - abs(new @ w), new
                if moved < cfg.tol:
                    break
            rest = w - self.vectors[:u].T @ (self.vectors[:u] @ w)
            self.vectors[u] = rest / max(np.linalg.norm(rest), 1e-8)


def kl_to_identity(cov: np.ndarray) -> float:
    """Divergence of a normal distribution of that covariance from the standard one; NaN if it isn't positive."""
    sign, logdet = np.linalg.slogdet(cov)
    return float((np.trace(cov) - logdet - len(cov)) / 2) if sign > 0 else np.nan


def _per_grid(frames: DataFrame, models: DataFrame, step, extra: str) -> DataFrame:
    """models with what step(state, x in sample order, row) gives for the frames of their grid, a bounded window."""
    names = [c.split()[0] for c in extra.split(", ")]
    kept = [f for f in models.schema if f.name not in names]

    def run(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame()
        row = rows.to_dict("records")[0]
        x = np.stack(pdf.sort_values("sample")["x"].to_numpy()) if len(pdf) else np.zeros((0, len(row["vectors"][0])))
        return pd.DataFrame([{f.name: row[f.name] for f in kept} | step(GridState(row), x, row)])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [extra])
    return frames.groupBy(*KEYS).cogroup(models.groupBy(*KEYS)).applyInPandas(run, schema)


def init_whitening_state(frames: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """models with cov, kl_mean and kl_std from calibration frames: their covariance, then drawn to that of each full batch in order.

    The divergences after each batch give mean and deviation (1 if it is 0).
    """

    def step(state: GridState, x: np.ndarray, row: dict) -> dict:
        white = x @ state.whitening.T
        if len(white) > 1:
            state.cov = np.cov(white, rowvar=False).reshape(state.cov.shape)
        kl = []
        for lo in range(0, len(white) - cfg.batch + 1, cfg.batch):
            state.follow(white[lo : lo + cfg.batch], cfg)
            kl.append(kl_to_identity(state.cov))
        kl = np.array([v for v in kl if not np.isnan(v)])
        return {"cov": state.cov.ravel(), "kl_mean": float(kl.mean()) if len(kl) else 0.0, "kl_std": (float(kl.std()) or 1.0) if len(kl) else 1.0}

    return _per_grid(frames, models, step, "cov array<double>, kl_mean double, kl_std double")


def whitening_update(batch: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """models after one batch of frames: covariance and whitening matrix."""

    def step(state: GridState, x: np.ndarray, row: dict) -> dict:
        state.whiten(x, cfg)
        return {"cov": state.cov.ravel(), "whitening": state.whitening.ravel()}

    return _per_grid(batch, models, step, "cov array<double>, whitening array<double>")


def separation_update(batch: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """models after one batch of frames with `spikes` (array<boolean>, a flag for each unit): separation vectors."""
    packed = batch.select(*KEYS, "sample", F.concat("x", F.transform("spikes", lambda s: s.cast("double"))).alias("x"))

    def step(state: GridState, x: np.ndarray, row: dict) -> dict:
        if not len(x):  # a recording that ends before the batch
            return {"vectors": list(state.vectors)}
        n = len(row["vectors"][0])
        white = x[:, :n] @ state.whitening.T
        state._turn(white, white @ state.vectors.T, x[:, n:] > 0, cfg)
        return {"vectors": list(state.vectors)}

    return _per_grid(packed, models, step, "vectors array<array<double>>")


def whitening_loss(models: DataFrame) -> DataFrame:
    """(recording_id, grid, kl, loss): divergence of the covariance from the identity, and its squared z-score against calibration; null if it isn't positive."""

    def tell(batches):
        for pdf in batches:
            n = pdf["cov"].map(lambda c: int(np.sqrt(len(c))))
            yield pdf[["recording_id", "grid"]].assign(kl=[kl_to_identity(np.reshape(c, (k, k))) for c, k in zip(pdf["cov"], n, strict=True)], kl_mean=pdf["kl_mean"], kl_std=pdf["kl_std"])

    rows = models.select(*KEYS, "cov", "kl_mean", "kl_std").mapInPandas(tell, "recording_id string, grid int, kl double, kl_mean double, kl_std double")
    kl = F.nanvl("kl", F.lit(None).cast("double"))
    return rows.select(*KEYS, kl.alias("kl"), F.pow((kl - F.col("kl_mean")) / (F.col("kl_std") + 1e-12), F.lit(2.0)).alias("loss"))


def _rows(key: tuple, sample: np.ndarray, source: np.ndarray, spikes: np.ndarray) -> pd.DataFrame:
    n, u = source.shape
    s = source.ravel()
    return pd.DataFrame({"recording_id": key[0], "grid": key[1], "win": key[2], "unit": np.tile(np.arange(u, dtype=np.int32), n), "sample": np.repeat(sample, u), "source": s, "value": s * np.abs(s), "spike": spikes.ravel()})


class Feeder:
    """Hands the samples of one model over in whole batches, in order, whatever order they come in.

    A batch is fed when all its samples are there. One that is known to stay
    incomplete (`upto`: no sample before this place is still to come; or the
    recording ends in it) is projected as far as it is there, without spikes and
    without a change of the model. Of a sample that comes twice the last counts;
    samples before the open batch are late and left out.
    """

    def __init__(self, state: GridState, cfg: Config, start: int, total: int | None = None, next_: int = 0):
        self.state, self.cfg, self.start, self.total, self.next = state, cfg, start, total, next_
        self.at, self.x = np.zeros(0, np.int64), None

    @classmethod
    def of(cls, row: dict, cfg: Config) -> Feeder:
        return cls(GridState(row), cfg, int(row["start"]), None if pd.isna(row.get("total")) else int(row["total"]))

    @property
    def low(self) -> int:
        """First sample of the open batch."""
        return self.start + self.next * self.cfg.batch

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        ok = at >= self.low
        at, x = at[ok], x[ok]
        if self.x is not None:
            at, x = np.concatenate([self.at, at]), np.concatenate([self.x, x])
        self.at, last = np.unique(at[::-1], return_index=True)
        self.x = x[len(x) - 1 - last]

    def ready(self, upto: float = -np.inf) -> Iterator[tuple]:
        """(samples, sources, spikes, losses or None) of each batch that can be closed."""
        while self.x is not None:
            lo, hi = self.low, self.low + self.cfg.batch
            n = int(np.searchsorted(self.at, hi))
            ends = self.total is not None and lo < self.total <= hi and n >= self.total - lo
            if n < self.cfg.batch and hi > upto and not ends:
                return
            if not n and not len(self.at):
                return
            at, x, self.at, self.x = self.at[:n], self.x[:n], self.at[n:], self.x[n:]
            first, self.next = self.next == 0, self.next + 1 if n else max(self.next + 1, min(int(self.at[0] - self.start) // self.cfg.batch, int(min(upto, 1 << 62) - self.start) // self.cfg.batch))
            if n == self.cfg.batch:
                skip = self.cfg.skip if first else 0
                yield at[skip:], *self.state.feed(x[skip:], self.cfg), self.state.losses
            elif n:
                source = self.state.project(x)
                yield at, source, np.zeros(source.shape, bool), None


MODEL = ("start", "whitening", "vectors", "low", "high")
EXTRA = {"cov": "array<double>", "total": "long", "kl_mean": "double", "kl_std": "double", "contrast_mean": "array<double>", "contrast_std": "array<double>"}


def _whole(models: DataFrame) -> DataFrame:
    """models with win (0 if there is none) and all optional columns."""
    win = F.col("win") if "win" in models.columns else F.lit(0)
    more = [F.col(c) if c in models.columns else F.lit(None).cast(kind).alias(c) for c, kind in EXTRA.items()]
    return models.select(*KEYS, win.cast("int").alias("win"), *MODEL, *more)


def _fed(frames: DataFrame, models: DataFrame, cfg: Config, tell, schema: str) -> DataFrame:
    """What tell(key, batch result) gives for all batches of every model, whose row comes before its samples; a task holds one open batch and one model at a time."""
    m = _whole(models)
    rows = frames.select(*KEYS, "sample", "x").where("sample >= 0").join(m.select(*KEYS, "win"), list(KEYS))
    rows = rows.unionByName(m.withColumn("sample", F.lit(-1).cast("long")), allowMissingColumns=True)

    def told(key, feeder, upto):
        return (df for r in feeder.ready(upto) if (df := tell(key, feeder, r)) is not None)

    def run(batches):
        key, feeder = None, None
        for pdf in batches:
            for own, g in pdf.groupby(list(WINDOW), sort=False):
                if own != key:
                    if feeder:
                        yield from told(key, feeder, np.inf)
                    key, feeder = own, None
                if g["sample"].iloc[0] < 0:
                    feeder, g = Feeder.of(g.iloc[0].to_dict(), cfg), g.iloc[1:]
                if feeder and len(g):
                    feeder.add(g["sample"].to_numpy(), np.stack(g["x"].to_numpy()))
                    yield from told(key, feeder, float(g["sample"].iloc[-1]))
        if feeder:
            yield from told(key, feeder, np.inf)

    return rows.repartition(*WINDOW).sortWithinPartitions(*WINDOW, "sample").mapInPandas(run, schema)


def adaptive_frames(samples: DataFrame, r: int) -> DataFrame:
    """The input of adaptive runs: channels without their mean over the recording, delay-embedded r times."""
    from spikeloom.operators.decompose import delay_embed
    from spikeloom.operators.decompose import frames as framed
    from spikeloom.operators.signals import demean

    return delay_embed(framed(demean(samples)), r)


def adaptive_corpus(frames: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """Sources, signed squares and spikes that every window's model gives over all of its grid's recording.

    models may have several windows (`win`) of one grid; each follows the signal
    by itself. Grids without a model give no rows, nor do samples before a
    model's start.
    """
    return _fed(frames, models, cfg, lambda key, _, r: _rows(key, *r[:3]), OUT)


LOSS = "recording_id string, grid int, win int, batch long, unit int, whitening_loss double, contrast_loss double, total_loss double"


def adaptive_losses(frames: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """Losses of each whole batch of the same runs, a row per unit.

    whitening_loss is the squared z-score of the divergence (kl_mean and kl_std of
    models), contrast_loss that of the contrast of the mean source value at the
    unit's spikes (contrast_mean and contrast_std), null without spikes or
    calibration; total_loss adds all of a batch, missing ones as 0.
    """

    def tell(key, feeder, r):
        if r[3] is None:
            return None
        kl, contrast = r[3]
        return pd.DataFrame({"recording_id": key[0], "grid": key[1], "win": key[2], "batch": feeder.next - 1, "unit": np.arange(len(contrast), dtype=np.int32), "whitening_loss": kl, "contrast_loss": contrast, "total_loss": np.nansum([kl, *contrast])})

    rows = _fed(frames, models, cfg, tell, LOSS)
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("whitening_loss", "contrast_loss")})


class Adapting(StatefulProcessor):
    """Keyed state of one model: itself with its batch number, and the samples that wait, by chunks as they came."""

    #: Arrays are packed doubles; t0 is the time of sample 0 in seconds.
    STATE = "start long, next long, total long, t0 double, n int, whitening binary, vectors binary, levels binary, cov binary"
    WAITING = "samples binary, x binary"

    def __init__(self, cfg: Config, fs: float):
        self.cfg, self.fs = cfg, fs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", self.STATE)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def close(self) -> None:
        pass

    def _save(self, f: Feeder, t0: float | None) -> None:
        s = f.state
        self.model.update((f.start, f.next, f.total, t0, len(s.cov), s.whitening.tobytes(), s.vectors.tobytes(), s.levels.tobytes(), s.cov.tobytes()))

    def _load(self) -> tuple[Feeder, float | None]:
        start, next_, total, t0, n, *packed = self.model.get()
        whitening, vectors, levels, cov = (np.frombuffer(bytes(p)) for p in packed)
        vectors, levels = vectors.reshape(-1, n), levels.reshape(2, -1)
        row = {"whitening": whitening, "vectors": list(vectors), "low": levels[0], "high": levels[1], "cov": cov}
        return Feeder(GridState(row), self.cfg, start, total, next_), t0

    def _restore(self, f: Feeder) -> None:
        for at, x in self.waiting.get():
            at = np.frombuffer(bytes(at), np.int64)
            f.add(at, np.frombuffer(bytes(x)).reshape(len(at), -1))

    def _keep(self, f: Feeder) -> None:
        """What still waits, as one chunk."""
        if f.x is not None and len(f.at):
            self.waiting.put([(f.at.tobytes(), np.ascontiguousarray(f.x, float).tobytes())])
        else:
            self.waiting.clear()

    def _await(self, f: Feeder, t0: float) -> None:
        """A timer at the end of the open batch; one at a time, and none while nothing waits."""
        self.handle.registerTimer(int(np.ceil((t0 + (f.low + self.cfg.batch) / self.fs) * 1000)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._save(Feeder.of(initialState.iloc[0].to_dict(), self.cfg), None)

    def handleInputRows(self, key, rows, timerValues):
        if not self.model.exists():
            return
        f, t0 = self._load()
        late = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [(pdf["sample"].to_numpy(), np.stack(pdf["x"].to_numpy()).astype(float), pdf["us"]) for pdf in (pdf[pdf["us"] >= late] for pdf in rows) if len(pdf)]
        for at, _, us in chunks:
            t0 = us.iloc[0] / 1e6 - at[0] / self.fs if t0 is None else t0
        low = f.low
        for at, x, _ in chunks:
            f.add(at, x)
        if f.x is None or not len(f.at):
            return
        new_at, new_x = f.at, f.x
        self._restore(f)
        done = list(f.ready())
        if done:
            yield from (_rows(key, *r[:3]) for r in done)
            self._keep(f)
        else:  # only what is new is written
            self.waiting.appendValue((new_at.tobytes(), np.ascontiguousarray(new_x).tobytes()))
        self._save(f, t0)
        if len(f.at) and (low != f.low or len(f.at) == len(new_at)):
            self._await(f, t0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        f, t0 = self._load()
        self._restore(f)
        upto = np.floor((timerValues.getCurrentWatermarkInMs() / 1000 - t0) * self.fs + 1e-6)
        yield from (_rows(key, *r[:3]) for r in list(f.ready(upto)))
        self._keep(f)
        self._save(f, t0)
        if f.x is not None and len(f.at):
            self._await(f, t0)


def adaptive_stream(stream: DataFrame, models: DataFrame, cfg: Config, fs: float, delay: str = "10 seconds") -> DataFrame:
    """The same on a stream of frames with `ts`, the time of each sample (fs samples a second from the recording's start on).

    Models are the initial state of their key (recording_id, grid, win). A batch
    closes when all its samples are there, else when the watermark, `delay`
    behind the newest time, has passed its end: then it is projected as far as it
    is there, without spikes. Rows older than the watermark are late and give
    nothing, nor do grids without a model, which keep no state. What waits is
    bounded by the samples of `delay` and one batch. With `total` in models the
    last batch closes when the recording's last sample is there.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    m = stored(_whole(models))  # read again in every micro-batch, so not computed in each
    rows = stream.withWatermark("ts", delay).select(*KEYS, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "sample", "x").join(m.select(*KEYS, "win"), list(KEYS))
    return rows.groupBy(*WINDOW).transformWithStateInPandas(statefulProcessor=Adapting(cfg, fs), outputStructType=OUT, outputMode="Append", timeMode="EventTime", initialState=m.groupBy(*WINDOW))


def adaptive_bidirectional(frames: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """Forward from one batch before each model's start, and backward over what lies before it, block after block in reversed order.

    Samples keep their order inside a block; the blocks of the earlier part are
    numbered from its end. Both runs begin with the given model; the rows of
    both, in samples of the recording, are one result. Models of several windows
    of a grid run side by side.
    """
    size, m = F.lit(cfg.batch), _whole(models)
    starts = m.select(*WINDOW, F.col("start").alias("_start"))
    forward = adaptive_corpus(frames, m.withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("start") - size)), cfg)
    forward = forward.join(starts, list(WINDOW)).where("sample >= _start").drop("_start")
    # blocks of the earlier part; the last of them may be short and comes first. Models with one start share them
    last = F.floor((F.col("_start") - 1) / size)
    rest = F.col("_start") - last * size
    own = F.floor(F.col("sample") / size)
    place = F.when(own == last, F.col("sample") - last * size).otherwise(rest + (last - 1 - own) * size + F.col("sample") % size)
    part = F.concat_ws("\n", "recording_id", F.col("win").cast("string"))  # each window turns the recording in its own way
    turned = frames.join(starts, list(KEYS)).where("sample < _start").select(part.alias("recording_id"), "grid", place.alias("sample"), "x")
    back = adaptive_corpus(turned, m.where("start > 0").withColumn("recording_id", part).withColumn("start", F.lit(0).cast("long")).withColumn("total", F.lit(None).cast("long")), replace(cfg, skip=0))
    back = back.withColumn("recording_id", F.regexp_extract("recording_id", r"(?s)^(.*)\n[^\n]*$", 1)).join(starts, list(WINDOW))
    after = F.col("sample") - rest
    home = F.when(after < 0, last * size + F.col("sample")).otherwise((last - 1 - F.floor(after / size)) * size + after % size)
    return forward.union(back.withColumn("sample", home.cast("long")).select(forward.columns))
