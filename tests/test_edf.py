"""The EDF source, its ingest and its sink on files made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import signals as S
from spikeloom.sources import edf


def made_edf(path, width, labels, data, rates, scale, records=None):
    """A recording with the digital values as given (a list for each channel, rates samples a record); physical values are these over the scale."""
    top = 2 ** (8 * width - 1)
    n, count = len(labels), len(data[0]) // rates[0]
    pad = lambda x, k: str(x).ljust(k).encode()
    head = (b"\xffBIOSEMI" if width == 3 else pad(0, 8)) + pad("", 160) + pad("01.01.2401.00.00", 16) + pad(256 * (n + 1), 8) + pad("", 44) + pad(count if records is None else records, 8) + pad(1, 8) + pad(n, 4)
    one = {"label": labels, "transducer": [""] * n, "unit": ["mV"] * n, "low": [f"{-top / scale:.1f}" if scale > 1 else -top] * n, "high": [f"{(top - 1) / scale:.1f}" if scale > 1 else top - 1] * n, "digital_low": [-top] * n, "digital_high": [top - 1] * n, "filter": [""] * n, "samples": rates, "reserved": [""] * n}
    body = b"".join(int(v).to_bytes(width, "little", signed=True) for k in range(count) for c in range(n) for v in data[c][k * rates[c] : (k + 1) * rates[c]])
    path.write_bytes(head + b"".join(pad(x, edf.FIELDS[f])[: edf.FIELDS[f]] for f in edf.FIELDS for x in one[f]) + body)


LISTING = "name\ttype\tgroup\ttarget_muscle\tgrid_name\tstatus\nEMG1\temg\tGrid10\tbiceps\tA10\tgood\nEMG2\tEMG\tGrid2\tn/a\tn/a\tBad\n\tMISC\tn/a\tn/a\tn/a\tn/a\n"


@pytest.fixture
def corpus(tmp_path):
    rng = np.random.default_rng(4)
    made = {}
    for width, name, scale, known in ((2, "sub-1_emg.edf", 10, None), (3, "ses/sub-2_emg.bdf", 1, -1)):
        data = [rng.integers(-(2 ** (8 * width - 1)), 2 ** (8 * width - 1), n) for n in (50, 50, 25)]
        (tmp_path / "ses").mkdir(exist_ok=True)
        made_edf(tmp_path / name, width, ["EMG1", "EMG2", "AUX"], data, [10, 10, 5], scale, known)
        made[name.split("/")[-1].split("_")[0]] = [d / scale for d in data]
    (tmp_path / "ses/sub-2_emg.edf").write_bytes(b"the other format comes second")
    (tmp_path / "sub-1_channels.tsv").write_text(LISTING)
    (tmp_path / "sub-1_emg_channels.tsv").write_text("name\ttype\nold\tEMG\n")
    (tmp_path / "ses/sub-2_emg_channels.tsv").write_text(LISTING)
    for label, own in (("sub-1", {"SamplingFrequency": 20, "Manufacturer": "M", "ElectrodeManufacturersModelName": "B2"}), ("ses/sub-2", {"ElectrodeManufacturersModelName": "C"})):
        (tmp_path / f"{label}_emg.json").write_text(json.dumps(own, indent=1))
    return tmp_path, made


def test_values_come_back_by_ranges(spark, corpus):
    root, made = corpus
    s = edf.read_edf(spark, str(root), split_bytes=256)
    assert s.rdd.getNumPartitions() >= 8
    got = {(r.recording_id, r.channel, r.sample): r.value for r in s.collect()}
    assert len(got) == 250
    assert all(abs(got[r, c, k] - v) < 1e-3 for r, data in made.items() for c in range(3) for k, v in enumerate(data[c]))
    one = edf.read_edf(spark, str(root / "sub-1_emg.edf"))
    assert one.rdd.getNumPartitions() == 1 and one.select("recording_id", "grid", "local").distinct().count() == 3


def test_bounds_are_used_while_reading(spark, corpus):
    root, made = corpus
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = edf.read_edf(spark, f"file://{root}", 256).where("grid = 0 and sample >= 12 and sample < 31")
        got = {(r.recording_id, r.sample): r.value for r in part.collect()}
        assert set(got) == {(r, k) for r in made for k in range(12, 31)}
        assert all(abs(v - made[r][1][k]) < 1e-3 for (r, k), v in got.items())
        assert edf.read_edf(spark, str(root), 256).where("channel = 2 and sample > 20 and sample <= 22").count() == 4
        reader = edf.BoundedReader({"path": str(root / "sub-1_emg.edf")})
        list(reader.pushFilters([edf.EqualTo(("channel",), 0), edf.GreaterThanOrEqual(("sample",), 20), edf.LessThan(("sample",), 30)]))
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_corpus_tables(spark, corpus):
    root, _ = corpus
    recordings, channels, samples = edf.ingest_edf_corpus(spark, str(root), 256)
    r = {x.recording_id: x for x in recordings.collect()}
    assert {k: (x.fsamp, x.total_samples, [(g.grid, g.group, g.grid_name, g.muscle, g.n, g.bad) for g in x.grids]) for k, x in r.items()} == {
        "sub-1": (20.0, 50, [(0, "Grid2", "B2", "", 1, [0]), (1, "Grid10", "A10", "biceps", 1, [])]),
        "sub-2": (10.0, 50, [(0, "Grid2", "C", "", 1, [0]), (1, "Grid10", "A10", "biceps", 1, [])]),
    }
    assert r["sub-1"].meta == {"Manufacturer": "M", "ElectrodeManufacturersModelName": "B2"}
    assert {(x.channel, x.name, x.grid, x.local, x.bad) for x in channels.collect()} == {(0, "EMG1", 1, 0, False), (1, "EMG2", 0, 0, True), (2, "Ch02", -1, 0, False)}
    assert {tuple(x) for x in samples.select("channel", "grid", "local").distinct().collect()} == {(0, 1, 0), (1, 0, 0), (2, -1, 0)}


def test_what_is_missing_is_an_error(spark, corpus):
    root, _ = corpus
    (root / "ses/sub-2_emg.json").write_text("{}")
    (root / "sub-1_channels.tsv").write_text("name\ttype\tgroup\nx\tEMG\tn/a\n")
    said = {r.recording_id: r.problem for r in edf.ingest_edf_corpus(spark, str(root), strict=False)[0].collect()}
    assert said == {"sub-1": "no grid channels", "sub-2": "unknown grid model"}
    (root / "sub-1_channels.tsv").unlink(), (root / "sub-1_emg_channels.tsv").unlink()
    said = {r.recording_id: r.problem for r in edf.ingest_edf_corpus(spark, str(root), strict=False)[0].collect()}
    assert said["sub-1"] == "no channel listing"
    with pytest.raises(Exception, match="unknown grid model|no channel listing"):
        edf.ingest_edf_corpus(spark, str(root))[0].collect()


@pytest.mark.parametrize("bits", [16, 24])
def test_round_trip_through_the_sink(spark, tmp_path, bits):
    rows = [(f"sub-{r}", c, f"E{c}", k, float(np.sin(k * (c + 1) + r) * 10**c)) for r in range(3) for c in range(3) for k in range(95 - 30 * r) if (k < 20 or k > 45)]
    s = spark.createDataFrame(rows, "recording_id string, channel int, label string, sample long, value double")
    ranges = S.physical_range(s.withColumn("grid", F.lit(0))).drop("grid")
    out = edf.write_edf(s, ranges, str(tmp_path / "x"), 10.0, 10, bits).collect()
    assert {r.recording_id: r.records for r in out} == {"sub-0": 10, "sub-1": 7, "sub-2": 2} or len(out) == 3
    span = {(r.recording_id, r.channel): (r.low, r.high) for r in ranges.collect()}
    want = {(r, c, k): v for r, c, _, k, v in rows}
    got = edf.read_edf(spark, str(tmp_path / "x"), 200).collect()
    assert len(got) == sum(r.records for r in out) * 30 and {r.fsamp for r in got} == {10.0}
    for r in got:
        lo, hi = span[r.recording_id, r.channel]
        v = min(max(want.get((r.recording_id, r.channel, r.sample), 0.0), lo), hi)
        assert abs(r.value - v) <= (hi - lo) / (2**bits - 1) * 0.51 + 1e-9
    assert not [p for p in (tmp_path / "x").iterdir() if p.name.startswith(".sub")]
