"""European data format (EDF, 16 bits; BDF, 24 bits): a data source that reads ranges of files, the ingest of a corpus, and its sink.

Files are opened with pyarrow.fs, which knows local and shared folders and the
usual object stores by their URI. A task opens one file, reads its header and
seeks to its own data records, so the size of a file bounds nothing.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SAMPLES = "recording_id string, channel int, label string, fsamp double, grid int, local int, sample long, value double"
NAMES = [x.split()[0] for x in SAMPLES.split(", ")]
#: Widths of the signal fields of the header, in order.
FIELDS = {"label": 16, "transducer": 80, "unit": 8, "low": 8, "high": 8, "digital_low": 8, "digital_high": 8, "filter": 80, "samples": 8, "reserved": 32}
#: Data records decoded at once, and bytes of a file that one input partition reads, about.
RECORDS, SPLIT_BYTES = 64, 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Header:
    """What the header of a file says."""

    fields: dict[str, list[str]]
    start: int
    records: int
    seconds: float
    width: int

    @classmethod
    def read(cls, f, size: int) -> Header:
        head = f.read(256)
        n, fields = int(head[252:256]), {}
        for name, width in FIELDS.items():
            data = f.read(n * width)
            fields[name] = [data[k * width : (k + 1) * width].decode("latin-1").strip() for k in range(n)]
        out = cls(fields, int(head[184:192]), int(head[236:244]), float(head[244:252]), 3 if head[:1] == b"\xff" else 2)
        if out.records < 0:  # not known when the file was begun
            out.records = (size - out.start) // out.record_bytes
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.array([int(x) for x in self.fields["samples"]])

    @property
    def record_bytes(self) -> int:
        return int(self.counts.sum()) * self.width

    def number(self, field: str) -> np.ndarray:
        return np.array([float(x) for x in self.fields[field]])


def channel_rows(text: str) -> list[dict]:
    """Rows of a tab-separated channel sidecar in order: kind, group, grid, local (place in its grid), bad and what else is said.

    EMG rows with a group are grid channels, grids numbered by (length, name) of
    their group; all others are auxiliary (grid -1). `n/a` and blank are null.
    """
    rows = []
    for k, row in enumerate(csv.DictReader(io.StringIO(text), delimiter="\t")):
        own = {c: (v or "").strip() for c, v in row.items() if c}
        own = {c: None if v == "" or v.lower() == "n/a" else v for c, v in own.items()}
        emg = (own.get("type") or "").upper() == "EMG" and own.get("group") is not None
        rows.append(own | {"channel": k, "group": own.get("group") if emg else None, "bad": (own.get("status") or "").lower() == "bad"})
    groups = sorted({r["group"] for r in rows if r["group"] is not None}, key=lambda g: (len(g), g))
    seen: dict[int, int] = {}
    for r in rows:
        r["grid"] = groups.index(r["group"]) if r["group"] is not None else -1
        r["local"] = seen[r["grid"]] = seen.get(r["grid"], -1) + 1
        r["name"] = r.get("name") or f"Ch{r['channel']:02d}"
    return rows


@dataclass
class Part(InputPartition):
    """Share `part` of `parts` of a file's data records."""

    path: str
    size: int
    sidecar: str | None
    part: int
    parts: int

    def __init__(self, path: str, size: int, sidecar: str | None, part: int, parts: int):
        super().__init__((path, part))
        self.path, self.size, self.sidecar, self.part, self.parts = path, size, sidecar, part, parts


def recording_files(listing: list[tuple[str, int]]) -> list[tuple[str, int, str | None]]:
    """(path, size, channel sidecar) of each recording: .bdf before .edf, the sidecar's current name before the older one."""
    there, best = dict(listing), {}
    for path, size in sorted(listing):
        if m := re.fullmatch(r"(.*)\.(bdf|edf)", path, re.IGNORECASE):
            label = m[1].removesuffix("_emg")
            rank = m[2].lower() != "bdf"
            if label not in best or rank < best[label][0]:
                best[label] = (rank, path, size, next((p for p in (f"{label}_channels.tsv", f"{label}_emg_channels.tsv") if p in there), None))
    return [x[1:] for _, x in sorted(best.items())]


def recording_id(path: str) -> str:
    """Entity label of a signal file."""
    return re.sub(r"(_emg)?\.[^.]*$", "", path.rsplit("/", 1)[-1])


class EdfReader(DataSourceReader):
    """Reads samples in physical units; bounds on channel, grid and sample choose what is decoded at all."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.channel = self.grid = None
        self.low, self.high = 0, None

    def bound(self, filters):
        """Note what filters say about channel, grid and sample; all are given back, as Spark tests its rows again."""
        for f in filters:
            name, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if isinstance(f, EqualTo) and name in ("channel", "grid"):
                setattr(self, name, value)
            if name == "sample":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self):
        store, root = opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        if info.is_file:
            found += [x for x in store.get_file_info(fs.FileSelector(root.rsplit("/", 1)[0])) if x.path.endswith(".tsv")]
        files = recording_files([(x.path, x.size) for x in found if x.is_file])
        self.base = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return [Part(self.base + p, size, side and self.base + side, k, n) for p, size, side in files for n in [max(1, -(-size // self.split))] for k in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        roles = {}
        if partition.sidecar:
            store, path = opened(partition.sidecar)
            with store.open_input_stream(path) as f:
                roles = {r["channel"]: r for r in channel_rows(f.read().decode())}
        store, path = opened(partition.path)
        with store.open_input_file(path) as f:
            h = Header.read(f, partition.size)
            counts, width = h.counts, h.width
            edge = np.append(0, np.cumsum(counts))
            gain = (h.number("high") - h.number("low")) / (h.number("digital_high") - h.number("digital_low"))
            base, low = h.number("digital_low"), h.number("low")
            use = [c for c, label in enumerate(h.fields["label"]) if "annotations" not in label.lower() and self.channel in (None, c) and self.grid in (None, roles.get(c, {"grid": -1})["grid"])]
            if not use:
                return
            lo, hi = (h.records * (partition.part + k) // partition.parts for k in (0, 1))
            most, least = int(counts[use].max()), max(1, int(counts[use].min()))
            lo = max(lo, self.low // max(1, most))
            hi = min(hi, h.records if self.high is None else -(-self.high // least))
            for at in range(lo, hi, RECORDS):
                n = min(RECORDS, hi - at)
                f.seek(h.start + at * h.record_bytes)
                raw = np.frombuffer(f.read(n * h.record_bytes), np.uint8).reshape(n, -1)
                for c in use:
                    digits = raw[:, edge[c] * width : edge[c + 1] * width].reshape(-1, width).astype(np.int32)
                    v = sum(digits[:, b] << 8 * b for b in range(width))
                    v = np.where(v >= 1 << 8 * width - 1, v - (1 << 8 * width), v)
                    role, size = roles.get(c, {"grid": -1, "local": c}), len(v)
                    one = lambda x, kind: pa.repeat(pa.scalar(x, kind), size)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([
                        one(recording_id(partition.path), pa.string()), one(c, pa.int32()), one(h.fields["label"][c], pa.string()), one(counts[c] / h.seconds, pa.float64()),
                        one(role["grid"], pa.int32()), one(role["local"], pa.int32()), pa.array(at * counts[c] + np.arange(size)), pa.array((v - base[c]) * gain[c] + low[c]),
                    ], NAMES)


class BoundedReader(EdfReader):
    """Takes filters from Spark, which must be allowed to push them (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters):
        return self.bound(filters)


class HeaderReader(EdfReader):
    """One row per file: rate and length of its first signal."""

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.part:
            return
        store, path = opened(partition.path)
        with store.open_input_file(path) as f:
            h = Header.read(f, partition.size)
        yield recording_id(partition.path), partition.path, float(h.counts[0] / h.seconds), int(h.records * h.counts[0])


class EdfSource(DataSource):
    """`spark.read.format("edf").option("splitBytes", n).load(folder or file)`."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> EdfReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (BoundedReader if options.get("pushdown") == "true" else EdfReader)(options)


class EdfHeaders(EdfSource):
    """The same files, header by header."""

    @classmethod
    def name(cls) -> str:
        return "edf_headers"

    def schema(self) -> str:
        return "recording_id string, path string, fsamp double, total_samples long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader({"path": self.options["path"], "splitbytes": 1 << 62})


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, fsamp, total_samples) of each recording, from the headers alone."""
    spark.dataSource.register(EdfHeaders)
    return spark.read.format("edf_headers").load(path)


def read_edf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All samples below a folder (or of a file) in physical units, annotation signals left out, in about size / split_bytes partitions a file.

    Where spark.sql.python.filterPushdown.enabled is set, equality on channel or
    grid and bounds on sample are used while reading.
    """
    spark.dataSource.register(EdfSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("edf").option("splitBytes", split_bytes).option("pushdown", push).load(path)


CHANNELS = "recording_id string, channel int, name string, type string, group string, grid int, local int, grid_name string, target_muscle string, sampling_frequency string, status string, bad boolean"
#: Keys of the recording's JSON sidecar that `recordings` keeps, in order.
SIDECAR = "SamplingFrequency double, RecordingDevice string, HardwareFilters string, ElectrodeManufacturersModelName string, SoftwareVersions string, RecordingType string, SoftwareFilters string, Manufacturer string, ManufacturersModelName string, Gain string, PowerLineFrequency string, EMGPlacementScheme string, EMGPlacementSchemeDescription string, SkinPreparation string, EMGGround string, InstitutionName string, InstitutionAddress string, InstitutionalDepartmentName string, TaskDescription string, Instructions string"


def _label(column: str) -> F.Column:
    return F.regexp_replace(F.substring_index(column, "/", -1), r"(_emg)?(_channels)?\.[^.]*$", "")


def ingest_edf_corpus(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, channels, samples) of a tree of EDF and BDF files with channel listings and JSON sidecars.

    channels has a row per line of a listing, with its grid (-1: auxiliary). The
    model of a grid is the `grid_name` of its first row, else the sidecar's
    ElectrodeManufacturersModelName. recordings has the rate (the sidecar's,
    else the file's), length, grids (number, group, model, muscle, channels) and
    the sidecar's other keys as `meta`. A recording without a listing, without a
    grid or with a grid of unknown model is an error when it is read; if not
    strict, `problem` says so instead.
    """
    look = lambda kind: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", kind)
    names = [x.split()[0] for x in CHANNELS.split(", ")]

    def listed(batches):
        for b in batches:
            rows = [{"recording_id": r} | x for r, text in zip(b.column("recording_id").to_pylist(), b.column("value").to_pylist(), strict=True) for x in channel_rows(text)]
            kinds = {"channel": pa.int32(), "grid": pa.int32(), "local": pa.int32(), "bad": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], kinds.get(c, pa.string())) for c in names], names)

    older = F.col("path").endswith("_emg_channels.tsv")
    texts = look("*_channels.tsv").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").withColumn("recording_id", _label("path"))
    first = texts.groupBy("recording_id").agg(F.min_by("value", older).alias("value"))
    channels = first.select("recording_id", "value").mapInArrow(listed, CHANNELS)
    samples = read_edf(spark, root, split_bytes)
    heads = file_headers(spark, root)
    side = look("*_emg.json").schema(SIDECAR).option("multiLine", True).json(root).select("*", _label("_metadata.file_path").alias("recording_id"))
    grids = channels.where("grid >= 0").groupBy("recording_id", "grid").agg(F.min_by(F.struct("group", "grid_name", "target_muscle"), "local").alias("g"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("local")))).alias("bad"))
    grids = grids.join(side.select("recording_id", F.col("ElectrodeManufacturersModelName").alias("_model")), "recording_id", "left")
    grids = grids.select("recording_id", F.struct("grid", "g.group", F.coalesce("g.grid_name", "_model").alias("grid_name"), F.coalesce("g.target_muscle", F.lit("")).alias("muscle"), "n", "bad").alias("g"))
    grids = grids.groupBy("recording_id").agg(F.array_sort(F.collect_list("g")).alias("grids"))
    has = channels.select("recording_id").distinct().withColumn("_listed", F.lit(True))
    r = heads.join(side, "recording_id", "left").join(grids, "recording_id", "left").join(has, "recording_id", "left")
    r = r.withColumn("problem", F.when(F.col("_listed").isNull(), "no channel listing").when(F.col("grids").isNull(), "no grid channels").when(F.exists("grids", lambda g: g["grid_name"].isNull()), "unknown grid model"))
    if strict:
        r = r.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "recording_id", "problem"))).cast("string"))
    rest = [x.split()[0] for x in SIDECAR.split(", ")][1:]
    meta = F.map_filter(F.create_map(*(y for c in rest for y in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    rate = F.coalesce(F.when(F.col("SamplingFrequency") > 0, F.col("SamplingFrequency")), F.col("fsamp"))
    return r.select("recording_id", rate.alias("fsamp"), "total_samples", "grids", meta.alias("meta"), "problem"), channels, samples


def write_edf(samples: DataFrame, ranges: DataFrame, root: str, fsamp: float, record: int, bits: int = 16) -> DataFrame:
    """Write each recording's channels as `<root>/<recording_id>_emg.edf` (.bdf with 24 bits); returns (recording_id, path, records).

    samples: (recording_id, channel, label, sample, value); ranges: (recording_id,
    channel, low, high), physical limits of at most eight characters. A data
    record holds `record` samples of each channel; missing ones are 0. Records
    are packed by many tasks; one task per recording streams them in order into
    a file that gets its name when it is complete, so a repeated task does no harm.
    """
    from spikeloom.operators.signals import quantize

    spark, width = samples.sparkSession, bits // 8
    keys = ["recording_id", "channel"]
    top, low = 2 ** (bits - 1) - 1, -(2 ** (bits - 1))
    zero = F.rint((F.lit(0.0) - F.col("low")) / (F.col("high") - F.col("low")) * (top - low) + low)
    ready = samples.withColumn("grid", F.lit(0))
    digital = quantize(ready, ranges.withColumn("grid", F.lit(0)), bits)
    digital = digital.select(*keys, F.floor(F.col("sample") / record).alias("at"), F.struct((F.col("sample") % record).cast("int").alias("k"), F.greatest(F.lit(low), F.least(F.lit(top), "digital")).alias("d")).alias("s"))
    packed = digital.groupBy(*keys, "at").agg(F.collect_list("s").alias("s"))
    limits = ranges.select(*keys, F.struct("channel", "low", "high", F.greatest(F.lit(low), F.least(F.lit(top), zero)).alias("zero")).alias("c"))
    limits = limits.join(samples.select(*keys, "label").distinct(), keys).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("c.*", "label"))).alias("channels"))
    length = samples.groupBy("recording_id").agg((F.floor(F.max("sample") / record) + 1).alias("records"))
    rows = packed.groupBy("recording_id", "at").agg(F.collect_list(F.struct("channel", "s")).alias("cells"))
    head = limits.join(length, "recording_id").select("recording_id", F.lit(-1).cast("long").alias("at"), "channels", "records")
    rows = rows.select("recording_id", "at", "cells").unionByName(head, allowMissingColumns=True)
    suffix = "bdf" if bits == 24 else "edf"

    def write(batches):
        f = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] < 0:
                    if f:
                        yield f.done()
                    f = _Writer(root, f"{r['recording_id']}_emg.{suffix}", r, fsamp, record, width)
                else:
                    f.put(r["at"], {c["channel"]: c["s"] for c in r["cells"]})
        if f:
            yield f.done()

    dealt = rows.repartition("recording_id").sortWithinPartitions("recording_id", "at")
    return dealt.mapInArrow(write, "recording_id string, path string, records long")


class _Writer:
    """One file, record after record."""

    def __init__(self, root: str, name: str, head: dict, fsamp: float, record: int, width: int):
        self.store, base = opened(root)
        self.store.create_dir(base)
        self.recording, self.path, self.temp = head["recording_id"], f"{base}/{name}", f"{base}/.{name}-{np.random.default_rng().integers(1 << 60):x}"
        self.channels, self.records, self.next, self.record, self.width = head["channels"], head["records"], 0, record, width
        self.f = self.store.open_output_stream(self.temp)
        top, n = 2 ** (8 * width - 1), len(self.channels)
        pad = lambda x, k: str(x)[:k].ljust(k).encode("latin-1")
        text = lambda v: next(t for k in range(6, -1, -1) if len(t := f"{v:.{k}f}") <= 8 or not k)
        self.f.write((b"\xffBIOSEMI" if width == 3 else pad(0, 8)) + pad("", 160) + pad("01.01.2400.00.00", 16) + pad(256 * (n + 1), 8) + pad("24BIT" if width == 3 else "", 44) + pad(self.records, 8) + pad(f"{record / fsamp:g}", 8) + pad(n, 4))
        fixed = {"unit": "mV", "digital_low": -top, "digital_high": top - 1, "samples": record}
        for field, k in FIELDS.items():
            for c in self.channels:
                self.f.write(pad(c["label"] if field == "label" else text(c[field]) if field in ("low", "high") else fixed.get(field, ""), k))

    def put(self, at: int | None, cells: dict[int, list[dict]]) -> None:
        while self.next < (self.records if at is None else at):
            self.put(self.next, {})
        if at is None:
            return
        for c in self.channels:
            d = np.full(self.record, int(c["zero"]), np.int32)
            for s in cells.get(c["channel"], ()):
                d[s["k"]] = s["d"]
            self.f.write(d.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : self.width].tobytes())
        self.next += 1

    def done(self) -> pa.RecordBatch:
        self.put(None, {})
        self.f.close()
        self.store.move(self.temp, self.path)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (self.recording, self.path, self.records)], ["recording_id", "path", "records"])


def write_texts(files: DataFrame, root: str) -> DataFrame:
    """Write small files (name, text), such as listings and sidecars, below a folder; returns their paths. Each appears when it is complete."""

    def write(batches):
        for batch in batches:
            store, base = opened(root)
            store.create_dir(base)
            done = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                temp = f"{base}/.{name}-{np.random.default_rng().integers(1 << 60):x}"
                with store.open_output_stream(temp) as f:
                    f.write(text.encode())
                store.move(temp, f"{base}/{name}")
                done.append(f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return files.select("name", "text").mapInArrow(write, "path string")
