"""One query per operator over the given tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.functions import labels as L
from spikeloom.operators import channels as C
from spikeloom.operators import decompose as D
from spikeloom.operators import edits as E
from spikeloom.operators import signals as S
from spikeloom.operators import units as U
from spikeloom.operators import windows as V
from spikeloom.plans.views import CH, MIN, PARTS, SIG, SPK, channels, minutes, parts, sig, spk, table
from spikeloom.streaming import adaptive as A

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Register a query; `views` names the view expressions that its SQL starts from."""

    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            parts = {"sig": SIG, "parts": f"{SIG}, {PARTS}", "spk": SPK, "min": f"{SPK}, {MIN}", "ch": CH}
            head = ", ".join(parts[v] for v in views.split())
            body = sql.strip()
            _sql[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{head}{', ' if body.startswith('+') else ' '}{body.lstrip('+')}" if head else body
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.select_units(U.isi_cov(spk(spark, sf_dir)), cov=1.05).withColumn("cov", F.round("cov", 6))


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _settled(df: DataFrame, *cols: str) -> DataFrame:
    """Six places that don't hang on the order of sums: what is within 5e-13 of a tie is one, as it is for the exact sum of values with two places."""
    return _round(df.withColumns({c: F.round(c, 12) for c in cols}), *cols)


_ISI = "i AS (SELECT *, sample - lag(sample) OVER (PARTITION BY recording_id, unit_uid ORDER BY sample) AS isi FROM spk)"


# --- sources, sinks and dataset tables


@query("SELECT channel, sample, round(value, 6) AS value FROM sig WHERE sample >= 100 AND sample < 200", "sig")
def read_grid_window(spark, sf_dir):
    return _round(S.read_grid_window(sig(spark, sf_dir), "r", 0, 100, 100).select("channel", "sample", "value"), "value")


@query("SELECT channel, sample, round(value * 5.0 / pow(2.0, 16) * 1000 / (CASE WHEN channel % 3 = 0 THEN 1.0 ELSE channel % 3 END), 6) AS value FROM sig", "sig")
def scale_adc_counts(spark, sf_dir):
    tracks = spark.range(64).select(F.col("id").cast("int").alias("channel"), F.lit(5.0).alias("range"), F.lit(16.0).alias("bits"), (F.col("id") % 3).cast("string").alias("gain"))
    return _round(S.scale_adc_counts(sig(spark, sf_dir), tracks).select("channel", "sample", "value"), "value")


@query("SELECT channel, sample, CASE WHEN channel = 0 THEN 0.0 WHEN channel = 1 OR value = 'inf'::DOUBLE THEN 1.7976931348623157e308 WHEN isnan(value) THEN 0.0 WHEN value = '-inf'::DOUBLE THEN -1.7976931348623157e308 ELSE round(value, 6) + 0.0 END AS value FROM sig", "sig")
def sanitize_values(spark, sf_dir):
    s = sig(spark, sf_dir)
    bad = s.withColumn("value", F.when(F.col("channel") == 0, float("nan")).when(F.col("channel") == 1, float("inf")).otherwise(F.round("value", 6)))
    return S.sanitize_values(bad).select("channel", "sample", "value")


@query("+n AS (SELECT count(DISTINCT sample) + 5 AS n FROM sig), p AS (SELECT channel, unnest(range(n)) AS sample FROM (SELECT DISTINCT channel FROM sig), n) SELECT channel, sample, round(coalesce(value, 0.0), 6) AS value FROM p LEFT JOIN sig USING (channel, sample)", "sig")
def align_lengths(spark, sf_dir):
    s = sig(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").agg((F.count_distinct("vec_id") + 5).alias("length")).withColumn("recording_id", F.lit("r"))
    return _round(S.align_lengths(s, n).select("channel", "sample", "value"), "value")


def _totals(spikes):
    return spikes.groupBy("recording_id").agg((F.max("sample") + 1).alias("total_samples"))


@query("+l AS (SELECT recording_id, min(sample) AS low, max(sample) // 2 AS n FROM spk GROUP BY 1), b AS (SELECT unit_uid, sample - CASE WHEN low > 0 THEN 1 ELSE 0 END AS sample, n FROM spk JOIN l USING (recording_id)) SELECT unit_uid, sample FROM b WHERE sample >= 0 AND sample < n", "spk")
def shift_index_base(spark, sf_dir):
    s = spk(spark, sf_dir)
    half = s.groupBy("recording_id").agg(F.floor(F.max("sample") / 2).alias("total_samples"))
    return U.shift_index_base(s.select("recording_id", "unit_uid", "sample"), half).select("unit_uid", "sample")


@query("SELECT recording_id, CASE recording_id WHEN 'r0' THEN 7 WHEN 'r1' THEN coalesce(max(sample) FILTER (WHERE unit_uid % 8 = 1), max(sample)) + 1 ELSE max(sample) + 1 END AS total_samples FROM spk GROUP BY recording_id UNION ALL SELECT 'empty', 0", "spk")
def infer_total_samples(spark, sf_dir):
    s = spk(spark, sf_dir)
    r = s.select("recording_id").distinct().union(spark.sql("select 'empty'")).withColumn("total_samples", F.when(F.col("recording_id") == "r0", 7).cast("long"))
    return U.infer_total_samples(r, s.where("recording_id = 'r1' and unit_uid % 8 = 1"), s)


_FIT8 = "coalesce(" + ", ".join(f"CASE WHEN length(printf('%.{k}f', {{0}})) <= 8 THEN CAST(printf('%.{k}f', {{0}}) AS DOUBLE) END" for k in range(6, -1, -1)) + ")"


@query("+r AS (SELECT channel, CASE WHEN min(value) = max(value) THEN min(value) - 1 ELSE min(value) END * pow(10.0, channel % 7) AS low, CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END * pow(10.0, channel % 7) AS high FROM sig GROUP BY channel) SELECT channel, " + _FIT8.format("low") + " AS low, " + _FIT8.format("high") + " AS high FROM r", "sig")
def physical_range(spark, sf_dir):
    s = sig(spark, sf_dir)
    return S.physical_range(s.withColumn("value", F.col("value") * F.pow(F.lit(10.0), F.col("channel") % 7))).select("channel", "low", "high")


@query("SELECT printf('%.6f', sample / 1.0) AS onset, 0.0 AS duration, sample, unit_uid FROM spk", "spk")
def spike_events_table(spark, sf_dir):
    from spikeloom.sources.tables import spike_events_table as events

    return events(spk(spark, sf_dir), 1.0).select("onset", "duration", "sample", "unit_uid")


@query("SELECT p.c_custkey AS participant_id, CASE WHEN p.c_custkey % 3 = 0 THEN 'updated' ELSE coalesce(nullif(p.c_mktsegment, ''), 'n/a') END AS handedness FROM customer p")
def upsert_participants(spark, sf_dir):
    from spikeloom.sources.tables import upsert_participants as upsert

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("handedness"))
    return upsert(c.where("participant_id % 2 = 0"), c.where("participant_id % 2 = 1 or participant_id % 3 = 0").withColumn("handedness", F.when(F.col("participant_id") % 3 == 0, "updated").otherwise(F.col("handedness"))))


@query("SELECT o_orderpriority AS grp, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS prio FROM orders GROUP BY 1")
def uniform_or_null(spark, sf_dir):
    from spikeloom.sources.tables import uniform_or_null as uniform

    return uniform(table(spark, sf_dir, "orders").withColumn("grp", F.col("o_orderpriority")), ["grp"], {"o_orderstatus": "status", "o_orderpriority": "prio"})


@query("SELECT url FROM pages EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0")
def write_missing_only(spark, sf_dir):
    from spikeloom.sources.tables import missing_only

    p = table(spark, sf_dir, "pages")
    return missing_only(p.select("url"), p.where("page_id % 3 = 0").select("url"), "url").distinct()


@query("SELECT c_custkey, c_nationkey, 'sub-' || c_custkey AS participant, CASE WHEN c_custkey % 2 = 0 THEN n.n_name END AS age FROM customer JOIN nation n ON n_nationkey = c_nationkey")
def lookup_participants(spark, sf_dir):
    from spikeloom.sources.tables import lookup_participants as look

    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    p = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("sub-"), F.col("c_custkey").cast("string")).alias("participant_id"), F.col("n_name").alias("age"), F.lit(0).alias("row"))
    r = c.select("c_custkey", "c_nationkey", F.col("c_custkey").cast("string").alias("subject"))
    return look(r, p).select("c_custkey", "c_nationkey", F.concat(F.lit("sub-"), "subject").alias("participant"), "age")


_EDF = (
    "+s AS (SELECT 'sub-' || (sample // 150) AS recording_id, channel, sample % 150 AS sample, value FROM sig), r AS (SELECT recording_id, channel, min(value) AS a, max(value) AS b, (max(sample) // 100 + 1) * 100 AS n FROM s GROUP BY 1, 2), "
    "f AS (SELECT recording_id, channel, n, " + _FIT8.format("a") + " AS lo, " + _FIT8.format("b") + " AS hi FROM r), p AS (SELECT *, unnest(range(n)) AS sample FROM f), "
    "d AS (SELECT recording_id, channel, p.sample, lo, hi, round_even((coalesce(value, 0.0) - lo) / (hi - lo) * 65535 - 32768, 0) AS d FROM p LEFT JOIN s USING (recording_id, channel, sample)) "
    "SELECT recording_id, CASE WHEN channel < 32 THEN 0 WHEN channel < 48 THEN 1 ELSE -1 END AS grid, CASE WHEN channel < 32 THEN channel WHEN channel < 48 THEN channel - 32 ELSE channel - 48 END AS local, sample, channel % 7 = 0 AS bad, "
    "CASE WHEN channel < 48 THEN CASE WHEN CAST(substr(recording_id, 5) AS INTEGER) % 2 = 0 THEN 'G' || (channel // 32) ELSE 'model' END END AS grid_name, 100.0 AS fsamp, n AS total_samples, "
    "round((greatest(-32768, least(32767, d)) + 32768) * ((hi - lo) / 65535) + lo, 6) AS value FROM d JOIN r USING (recording_id, channel)"
)


@query(_EDF, "sig")
def ingest_edf_corpus(spark, sf_dir):
    from spikeloom.sources import edf

    root = f"{U.ready_checkpoints(spark)}/edf-{uuid.uuid4().hex}"
    c, k = F.col("channel"), F.floor(F.col("sample") / 150)
    s = sig(spark, sf_dir).select(F.concat(F.lit("sub-"), k.cast("string")).alias("recording_id"), "channel", F.concat(F.lit("E"), c.cast("string")).alias("label"), (F.col("sample") % 150).alias("sample"), "value")
    ranges = S.physical_range(s.withColumn("grid", F.lit(0))).drop("grid")
    edf.write_edf(s, ranges, root, 100.0, 100).write.format("noop").mode("overwrite").save()
    odd = F.substring_index("recording_id", "-", -1).cast("int") % 2 == 1
    group = F.when(c < 32, "Grid2").when(c < 48, "Grid10").otherwise("n/a")
    line = F.concat_ws("\t", "label", F.when(c < 48, "EMG").otherwise("MISC"), group, F.when(odd, "n/a").otherwise(F.concat(F.lit("G"), F.floor(c / 32).cast("string"))), F.when(c % 7 == 0, "bad").otherwise("good"))
    rows = s.select("recording_id", "channel", "label").distinct().withColumn("line", line).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("channel", "line")))["line"].alias("lines"))
    listing = rows.select(F.concat("recording_id", F.lit("_channels.tsv")).alias("name"), F.concat_ws("\n", F.lit("name\ttype\tgroup\tgrid_name\tstatus"), "lines").alias("text"))
    side = rows.select(F.concat("recording_id", F.lit("_emg.json")).alias("name"), F.to_json(F.struct(F.lit(100.0).alias("SamplingFrequency"), F.when(odd, "model").alias("ElectrodeManufacturersModelName"))).alias("text"))
    edf.write_texts(listing.union(side), root).write.format("noop").mode("overwrite").save()
    recordings, listed, samples = edf.ingest_edf_corpus(spark, root, split_bytes=6400)
    grids = recordings.select("recording_id", "fsamp", "total_samples", F.explode("grids").alias("g")).select("recording_id", "g.grid", "g.grid_name")
    out = samples.join(listed.select("recording_id", "channel", "bad"), ["recording_id", "channel"]).join(recordings.select("recording_id", F.col("fsamp").alias("rate"), "total_samples"), "recording_id").join(grids, ["recording_id", "grid"], "left")
    return _round(out.select("recording_id", "grid", "local", "sample", "bad", "grid_name", F.col("rate").alias("fsamp"), "total_samples", "value"), "value")


# --- labels


@query("SELECT c_custkey, concat_ws('_', 'sub-' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'ses-' || c_nationkey END, 'task-' || lower(c_mktsegment), CASE WHEN c_nationkey % 3 = 0 THEN 'run-' || c_nationkey END) AS label FROM customer")
def build_entity_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey").cast("string")
    return c.select("c_custkey", L.build_entity_label(sub=F.col("c_custkey").cast("string"), ses=F.when(F.col("c_nationkey") % 2 == 0, n), task=F.lower("c_mktsegment"), acq=F.lit(""), run=F.when(F.col("c_nationkey") % 3 == 0, n)).alias("label"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS sub, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS ses, CASE WHEN c_custkey % 3 = 0 THEN 'a-b-' || c_custkey ELSE lower(c_mktsegment) END AS task FROM customer")
def parse_entity_label(spark, sf_dir):
    b = build_entity_label(spark, sf_dir)
    more = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("_task-a-b-"), F.col("c_custkey").cast("string"))).otherwise("")
    label = F.concat("label", more, F.when(F.col("c_custkey") % 4 == 0, "_sub-_run-").otherwise(""))
    return b.select("c_custkey", L.parse_entity_label(label).alias("p")).select("c_custkey", "p.sub", "p.ses", "p.task")


@query("SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS other, CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_custkey % 12 END AS number, CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE 'Grid' || (c_custkey % 12) END AS label FROM customer")
def grid_sort_key(spark, sf_dir):
    c = channels(spark, sf_dir)
    return c.select(F.col("row_no").alias("c_custkey"), L.grid_sort_key(F.col("group")).alias("k")).select("c_custkey", "k.other", F.coalesce("k.number", F.lit(-1)).alias("number"), "k.label")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN repeat('Grid 1,', c_custkey % 4) ELSE repeat(c_mktsegment || ',', greatest(1, c_custkey % 4)) END AS padded FROM customer")
def pad_grid_names(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("")))
    padded = L.pad_grid_names(names, (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("", F.transform(padded, lambda x: F.concat(x, F.lit(",")))).alias("padded"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'true' ELSE 'true,false' END AS flags, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '4' ELSE '4,0' END AS grids, c_mktsegment AS muscles FROM customer")
def normalize_unit_lists(spark, sf_dir):
    n = (F.col("c_custkey") % 3).cast("int")
    lists = L.normalize_unit_lists(F.array(F.lit(True)), F.array(F.lit(4)), F.array(F.lit(" "), F.concat("c_mktsegment", F.lit(" "))), n)
    return table(spark, sf_dir, "customer").select("c_custkey", lists.alias("l")).select("c_custkey", _text("l.flags").alias("flags"), _text("l.grids").alias("grids"), F.array_join("l.muscles", ",").alias("muscles"))


@query(r"SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '(_decomp|_edited)+$', '') AS label FROM part")
def strip_artifact_suffix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_partkey") % 2 == 0, "_decomp_edited").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "_grid-1").otherwise(""), F.lit(".npz"))
    return p.select("p_partkey", L.strip_artifact_suffix(name).alias("label"))


@query(r"SELECT p_partkey, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = '' THEN 'x' ELSE regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') END AS token FROM part")
def safe_token(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.safe_token(F.col("p_name"), "x").alias("token"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '/data/set' || (p_partkey % 7) WHEN p_partkey % 2 = 0 THEN '/data/set' || (p_partkey % 7) || '/bids_out' END AS root FROM part")
def infer_dataset_root(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("/data/set"), (F.col("p_partkey") % 7).cast("string"), F.when(k == 0, "/derivatives/decomp/sub-01/x.npz").when(k == 1, "/sub-01/emg/x.edf").when(F.col("p_partkey") % 2 == 0, "/bids_out/x.edf").otherwise("/x.edf"))
    return p.select("p_partkey", L.infer_dataset_root(path).alias("root"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN 2048.0 / p_size WHEN 2 THEN CAST(p_size AS DOUBLE) END AS hz FROM part")
def parse_cutoff(spark, sf_dir):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(n, F.lit(" Hz"))).when(k == 1, F.concat(F.lit("Fsamp/"), n)).when(k == 2, n).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", L.parse_cutoff(text, F.lit(2048.0)).alias("hz"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(printf('%.4f', CAST(p_retailprice AS DOUBLE)), '0+$', ''), '\.$', '') AS hz FROM part")
def format_hz(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.format_hz(F.col("p_retailprice").cast("double")).alias("hz"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN trim(role) END AS value FROM conversations")
def na_to_null(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", L.na_to_null(F.when(F.col("turn") % 3 == 0, F.when(F.col("turn") % 2 == 0, " N/A ").otherwise("  ")).otherwise(F.col("role"))).alias("value"))


@query("SELECT p_partkey, CASE WHEN upper(p_name) LIKE '%TRIG%' OR upper(p_name) LIKE '%SYNC%' THEN 'TRIG' ELSE 'MISC' END AS type FROM part")
def aux_channel_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.aux_channel_type(F.col("p_name")).alias("type"))


@query("+k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, CASE WHEN k = 1 THEN c_mktsegment ELSE c_mktsegment || '_' || k END AS unique_label FROM k", "sig")
def unique_labels(spark, sf_dir):
    return L.unique_labels(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], "c_mktsegment").select("c_custkey", "unique_label")


@query("SELECT recording_id, unit_uid AS unit, 'g' || grid || '_mu' || (row_number() OVER (PARTITION BY recording_id, grid ORDER BY unit_uid) - 1) AS unit_uid FROM (SELECT DISTINCT recording_id, grid, unit_uid FROM spk)", "spk")
def assign_unit_uids(spark, sf_dir):
    u = spk(spark, sf_dir).select("recording_id", "grid", F.col("unit_uid").alias("unit")).distinct()
    return L.assign_unit_uids(u, ["recording_id"], ["unit"]).select("recording_id", "unit", "unit_uid")


@query("SELECT recording_id, grid, 'g' || grid || '_mu' || count(DISTINCT unit_uid) AS next_uid FROM spk GROUP BY 1, 2", "spk")
def next_unit_uid(spark, sf_dir):
    u = spk(spark, sf_dir).select("recording_id", "grid", F.col("unit_uid").alias("unit")).distinct()
    return L.next_unit_uid(L.assign_unit_uids(u, ["recording_id"], ["unit"]), ["recording_id"])


# --- signals

_MA = "+s AS (SELECT *, sum(value) OVER (PARTITION BY channel ORDER BY sample RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM sig) "


@query("SELECT channel, sample, round(value - avg(value) OVER (PARTITION BY channel), 6) AS value FROM sig", "sig")
def demean(spark, sf_dir):
    return _round(S.demean(sig(spark, sf_dir)).select("channel", "sample", "value"), "value")


@query("SELECT sample, round(avg(abs(value)), 6) AS activity FROM sig GROUP BY sample", "sig")
def rectified_mean(spark, sf_dir):
    return _round(S.rectified_mean(sig(spark, sf_dir)).select("sample", "activity"), "activity")


@query("SELECT channel, round(avg(abs(value)), 6) AS mean_abs FROM sig GROUP BY channel", "sig")
def channel_mean_abs(spark, sf_dir):
    return _round(S.channel_mean_abs(sig(spark, sf_dir)).select("channel", "mean_abs"), "mean_abs")


@query(_MA + "SELECT channel, sample, round(smooth, 6) AS smooth FROM s", "sig")
def moving_average(spark, sf_dir):
    return _round(S.moving_average(sig(spark, sf_dir), list(S.CHANNEL), 5).select("channel", "sample", "smooth"), "smooth")


@query("SELECT channel, sample, round(value, 6) AS value FROM sig WHERE sample % 4 = 0", "sig")
def decimate(spark, sf_dir):
    return _round(S.decimate(sig(spark, sf_dir), 100.0, 25.0).select("channel", "sample", "value"), "value")


@query("+n AS (SELECT max(sample) + 1 AS n FROM sig) SELECT channel, sample // ((n + 95) // 96) AS bin, round(min(value), 6) AS low, round(max(value), 6) AS high FROM sig, n GROUP BY 1, 2", "sig")
def minmax_envelope(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return _round(S.minmax_envelope(sig(spark, sf_dir), 0, n, 96).select("channel", "bin", "low", "high"), "low", "high")


@query("SELECT channel, sample, round(value, 6) AS value FROM sig WHERE channel = 3 AND sample >= 50 AND (sample - 50) % 2 = 0", "sig")
def qc_window(spark, sf_dir):
    return _round(S.qc_window(sig(spark, sf_dir), 0, 50, 0, 1 << 40, "raw", 2000.0, 3).select("channel", "sample", "value"), "value")


@query("SELECT channel, sample, round(value, 6) AS value FROM sig WHERE channel % 5 <> 0", "sig")
def keep_channels(spark, sf_dir):
    masks = spark.range(0, 64, 5).select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), F.col("id").cast("int").alias("channel"))
    return _round(S.keep_channels(sig(spark, sf_dir), masks).select("channel", "sample", "value"), "value")


@query("SELECT channel, sample, CAST(sample // 250 AS INTEGER) AS win FROM sig WHERE sample % 250 BETWEEN 20 AND 229", "sig")
def assign_windows(spark, sf_dir):
    win = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 250).alias("win")).distinct()
    w = win.select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), F.col("win").cast("int").alias("win"), (F.col("win") * 250).alias("start"), (F.col("win") * 250 + 250).alias("end"))
    return S.assign_windows(sig(spark, sf_dir), w, 20).select("channel", "sample", "win")


@query("+r AS (SELECT channel, min(value) AS a, max(value) AS b FROM sig GROUP BY channel), f AS (SELECT channel, " + _FIT8.format("a") + " AS lo, " + _FIT8.format("b") + " AS hi FROM r) SELECT channel, sample, CAST(round_even((value - lo) / (hi - lo) * 65535 - 32768, 0) AS BIGINT) AS digital FROM sig JOIN f USING (channel)", "sig")
def quantize(spark, sf_dir):
    s = sig(spark, sf_dir)
    return S.quantize(s, S.physical_range(s), 16).select("channel", "sample", "digital")


def _bandpass_sql(low: float, high: float, order: int, fs: float) -> str:
    """The filter as its difference equations, sample by sample, there and back."""
    sections = S.butterworth_bandpass(order, low, high, fs)
    pad, states, names = 3 * (2 * order + 1), "", []
    u = "u"
    for k, (b, a) in enumerate(sections):
        v = f"({b[0]!r} * {u} + z{k}1)".replace("np.float64", "")
        states += f", {b[1]!r} * {u} - {a[1]!r} * {v} + z{k}2 AS z{k}1, {b[2]!r} * {u} - {a[2]!r} * {v} AS z{k}2".replace("np.float64", "")
        names += [f"z{k}1", f"z{k}2"]
        u = v
    b = sections[0][0]
    begin = ", ".join([f"{-b[0]!r} * u AS z01, {b[2]!r} * u AS z02".replace("np.float64", ""), *(f"0.0::DOUBLE AS {z}" for z in names[2:])])
    run = lambda src: f"SELECT channel, -1::BIGINT AS k, {begin}, NULL::DOUBLE AS y FROM {src} WHERE k = 0 UNION ALL SELECT i.channel, i.k{states}, {u} AS y FROM {src}_run r JOIN {src} i ON i.channel = r.channel AND i.k = r.k + 1"
    return f"""WITH RECURSIVE {SIG}, n AS (SELECT max(sample) + 1 AS n FROM sig), e AS (SELECT channel, max(value) FILTER (WHERE sample = 0) AS a, max(value) FILTER (WHERE sample = n - 1) AS z FROM sig, n GROUP BY channel),
there AS MATERIALIZED (SELECT channel, sample + {pad} AS k, value AS u FROM sig UNION ALL SELECT channel, {pad} - sample, 2 * a - value FROM sig JOIN e USING (channel) WHERE sample BETWEEN 1 AND {pad}
  UNION ALL SELECT channel, {pad} + n + (n - 2 - sample), 2 * z - value FROM n, sig JOIN e USING (channel) WHERE sample BETWEEN n - 1 - {pad} AND n - 2),
there_run(channel, k, {", ".join(names)}, y) AS ({run("there")}),
turned AS MATERIALIZED (SELECT channel, n + {2 * pad} - 1 - k AS k, y AS u FROM there_run, n WHERE k >= 0),
turned_run(channel, k, {", ".join(names)}, y) AS ({run("turned")})
SELECT channel, n + {pad} - 1 - k AS sample, round(y, 6) AS value FROM turned_run, n WHERE k BETWEEN {pad} AND n + {pad} - 1"""


@query(_bandpass_sql(10.0, 30.0, 2, 100.0))
def bandpass(spark, sf_dir):
    return _round(S.bandpass(sig(spark, sf_dir), 100.0, band=(10.0, 30.0, 2), block=128).select("channel", "sample", "value"), "value")


_LINE = "value + 3 * sin(sample * pi() / 5)"
_NOTCH = f"""+x AS (SELECT channel, sample, {_LINE} AS v FROM sig), n AS (SELECT max(sample) + 1 AS n FROM sig), k AS (SELECT unnest(range(n)) AS k FROM n),
f AS MATERIALIZED (SELECT channel, k, sum(v * cos(2 * pi() * ((k * sample) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((k * sample) % n) / n)) AS im FROM x, n, k GROUP BY 1, 2),
s AS (SELECT channel, (k - 1) // 100 AS s, median(sqrt(re * re + im * im)) + 5 * stddev_pop(sqrt(re * re + im * im)) AS top FROM f, n WHERE k > 0 AND (k - 1) // 100 * 100 + 101 <= n GROUP BY 1, 2),
h AS (SELECT f.channel, k FROM f JOIN s ON s.channel = f.channel AND s.s = (k - 1) // 100 WHERE k > 0 AND sqrt(re * re + im * im) > top),
w AS (SELECT DISTINCT channel, k + d AS k FROM h, n, (SELECT unnest(range(-(round_even(4 * n / 100.0, 0)::BIGINT // 2), round_even(4 * n / 100.0, 0)::BIGINT // 2 + 1)) AS d FROM n) WHERE k + d > 0 AND k + d <= least(n // 2 + 1, n - 1)),
g AS (SELECT channel, k, re, im FROM w JOIN f USING (channel, k) UNION SELECT w.channel, (n - w.k) % n, re, -im FROM n, w JOIN f USING (channel, k)),
o AS (SELECT channel, k, any_value(re) AS re, any_value(im) AS im FROM g GROUP BY 1, 2),
y AS (SELECT o.channel, x.sample, sum(re * cos(2 * pi() * ((k * sample) % n) / n) - im * sin(2 * pi() * ((k * sample) % n) / n)) / any_value(n) AS y FROM o JOIN x USING (channel), n GROUP BY 1, 2)
SELECT channel, sample, round(v - coalesce(y, 0.0), 6) AS value FROM x LEFT JOIN y USING (channel, sample)"""


@query(_NOTCH, "sig")
def spectral_notch(spark, sf_dir):
    s = sig(spark, sf_dir).withColumn("value", F.col("value") + 3 * F.sin(F.col("sample") * F.lit(3.141592653589793) / 5))
    return _round(S.spectral_notch(s, 100.0, block=256, cells=1 << 14).select("channel", "sample", "value"), "value")


_SMOOTH = "SELECT '{0}' AS kind, 0 AS unit, sample, round(smooth, 6) AS value FROM (SELECT sample, sum(activity) OVER (ORDER BY sample RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM (SELECT sample, avg(abs(value)) AS activity FROM sig WHERE {1} GROUP BY sample)) WHERE sample % 2 = 0"


@query(
    _SMOOTH.format("overall", "true") + " UNION ALL " + _SMOOTH.format("by_grid", "channel % 5 <> 0")
    + " UNION ALL SELECT 'channels', channel, 0, round(avg(abs(value)), 6) FROM sig GROUP BY channel"
    + " UNION ALL SELECT CASE WHEN channel < 3 THEN 'preview' ELSE 'pulses' END, channel, sample, round(value * abs(value), 6) FROM sig WHERE channel < 7 AND sample % 2 = 0"
    + " UNION ALL SELECT 'spikes', channel, sample, 1.0 FROM sig WHERE channel < 7 AND value > 1"
    + " UNION ALL SELECT 'auxiliary', channel, sample, round(value, 6) FROM sig WHERE channel > 61 AND sample % 2 = 0"
    + " UNION ALL SELECT 'coordinates', c + 1, c // 8, CAST(c % 8 AS DOUBLE) FROM (SELECT unnest(range(64)) AS c)",
    "sig",
)
def preview_bundle(spark, sf_dir):
    s = sig(spark, sf_dir)
    masks = spark.range(0, 64, 5).select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), F.col("id").cast("int").alias("channel"))
    pulses = s.where("channel < 7").select("recording_id", F.col("channel").alias("unit_uid"), "sample", (F.col("value") * F.abs("value")).alias("value"))
    spikes = s.where("channel < 7 and value > 1").select("recording_id", F.col("channel").alias("unit_uid"), "sample")
    grids = s.select("recording_id", "grid").distinct().withColumn("grid_name", F.lit("an 8x8 grid"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda c: r * 8 + c))
    catalog = spark.range(1).select(F.lit(0).alias("ord"), F.lit("8x8").alias("key"), F.lit(64).alias("n"), cells.alias("channel_map"))
    b = S.preview_bundle(s, 2000.0, 5, masks, pulses, spikes, s.where("channel > 61"), grids, catalog)
    row = lambda df, kind, unit, sample, value: df.select(*(x.alias(n) for x, n in zip((kind, unit.cast("int"), sample.cast("long"), F.round(value.cast("double"), 6)), ("kind", "unit", "sample", "value"), strict=True)))
    c, zero = F.col, F.lit(0)
    out = row(b["overall"], F.lit("overall"), zero, c("sample"), c("smooth")).union(row(b["by_grid"], F.lit("by_grid"), zero, c("sample"), c("smooth"))).union(row(b["channels"], F.lit("channels"), c("channel"), zero, c("mean_abs")))
    out = out.union(row(b["pulses"], F.when(c("preview"), "preview").otherwise("pulses"), c("unit_uid"), c("sample"), c("value")))
    out = out.union(row(b["spikes"].select("unit_uid", F.explode("samples").alias("sample")), F.lit("spikes"), c("unit_uid"), c("sample"), F.lit(1.0)))
    return out.union(row(b["auxiliary"], F.lit("auxiliary"), c("channel"), c("sample"), c("value"))).union(row(b["coordinates"], F.lit("coordinates"), c("channel"), c("row"), c("col")))


# --- decomposition


@query("+f AS (SELECT sample, channel, value FROM sig), g AS (SELECT DISTINCT a.sample, m, a.channel FROM f a CROSS JOIN (SELECT unnest(range(3)) AS m)) SELECT g.sample, CAST(g.m * 64 + g.channel AS INTEGER) AS dim, round(coalesce(f.value, 0.0), 6) AS value FROM g LEFT JOIN f ON f.sample = g.sample - g.m AND f.channel = g.channel", "sig")
def delay_embed(spark, sf_dir):
    f = D.frames(sig(spark, sf_dir))
    return _round(D.delay_embed(f, 3).select("sample", F.posexplode("x").alias("dim", "value")), "value")


@query("SELECT a.channel AS i, b.channel AS j, round(covar_pop(a.value, b.value), 6) AS cov FROM sig a JOIN sig b ON a.sample = b.sample AND a.channel <= b.channel GROUP BY 1, 2", "sig")
def covariance_matrix(spark, sf_dir):
    return _round(D.covariance_matrix(sig(spark, sf_dir)).select("i", "j", "cov"), "cov")


@query()
def whiten(spark, sf_dir):
    s = sig(spark, sf_dir)
    return _round(D.whiten(D.frames(s), D.whitening_basis(D.covariance_matrix(s))).select("sample", F.posexplode("x").alias("dim", "value")), "value")


def _filters(spark):
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k % (F.col("id") + 2) == 0, 1.0).otherwise(-0.5))
    return spark.range(3).select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), F.col("id").alias("unit_uid"), w.alias("filter"))


_DOT = "+p AS (SELECT u AS unit_uid, sample, sum(value * (CASE WHEN channel % (u + 2) = 0 THEN 1.0 ELSE -0.5 END)) AS s FROM sig CROSS JOIN (SELECT unnest(range(3)) AS u) GROUP BY 1, 2) "


@query(_DOT + "SELECT unit_uid, sample, round(s * abs(s), 6) AS value FROM p", "sig")
def pulse_train(spark, sf_dir):
    return _round(D.pulse_train(D.frames(sig(spark, sf_dir)), _filters(spark)).select("unit_uid", "sample", "value"), "value")


@query(_DOT + "SELECT channel AS dim, round(avg(value * s * s) - 2 * avg(s) * max(CASE WHEN channel % 2 = 0 THEN 1.0 ELSE -0.5 END), 6) AS w FROM sig JOIN p USING (sample) WHERE unit_uid = 0 GROUP BY channel", "sig")
def contrast_step(spark, sf_dir):
    v = _filters(spark).where("unit_uid = 0").select("recording_id", "grid", F.col("filter").alias("w"))
    return _round(D.contrast_step(D.frames(sig(spark, sf_dir)), v).select("dim", "w"), "w")


def _at(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), (F.col("vec_id") % 17).alias("unit_uid"), F.col("vec_id").alias("sample"))
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("total_samples")).withColumn("recording_id", F.lit("r"))
    return s, n


_AT = "at_ AS (SELECT vec_id % 17 AS unit_uid, vec_id AS spike FROM embeddings), fit AS (SELECT * FROM at_ WHERE spike >= 3 AND spike + 3 <= (SELECT max(vec_id) FROM embeddings)), seg AS (SELECT unit_uid, spike, channel, sample - spike AS off, value FROM fit JOIN sig ON sample BETWEEN spike - 3 AND spike + 3)"


@query("+" + _AT + " SELECT unit_uid, channel AS dim, round(sum(value), 6) AS weight FROM at_ JOIN sig ON sample = spike GROUP BY 1, 2", "sig")
def spike_triggered_sum(spark, sf_dir):
    s, _ = _at(spark, sf_dir)
    return _round(D.spike_triggered_sum(D.frames(sig(spark, sf_dir)), s).select("unit_uid", "dim", "weight"), "weight")


@query("+" + _AT + " SELECT unit_uid, spike, channel, CAST(off AS INTEGER) AS off, round(value, 6) AS value FROM seg", "sig")
def muap_segments(spark, sf_dir):
    s, n = _at(spark, sf_dir)
    return _round(D.muap_segments(sig(spark, sf_dir), s.drop("grid"), 3, n).select("unit_uid", "spike", "channel", F.col("offset").alias("off"), "value"), "value")


@query("+" + _AT + " SELECT unit_uid, channel, CAST(off AS INTEGER) AS off, round(avg(value), 6) AS mean FROM seg GROUP BY ALL", "sig")
def spike_triggered_average(spark, sf_dir):
    s, n = _at(spark, sf_dir)
    return _round(D.spike_triggered_average(sig(spark, sf_dir), s.drop("grid"), 3, n).select("unit_uid", "channel", F.col("offset").alias("off"), "mean"), "mean")


@query("+" + _AT + ", mean AS (SELECT unit_uid, channel, off, avg(value) AS m FROM seg GROUP BY ALL), put AS (SELECT channel, spike + off AS sample, sum(m) AS s FROM fit JOIN mean USING (unit_uid) GROUP BY ALL) SELECT sig.channel, sig.sample, round(value - coalesce(s, 0), 6) AS value FROM sig LEFT JOIN put USING (channel, sample)", "sig")
def peel_off(spark, sf_dir):
    s, n = _at(spark, sf_dir)
    return _round(D.peel_off(sig(spark, sf_dir), s.drop("grid"), 3, n).select("channel", "sample", "value"), "value")


@query("+p AS (SELECT sample, round(pow(sum(value), 2), 9) AS p FROM sig GROUP BY sample) SELECT sample FROM p ORDER BY p DESC, sample LIMIT 1", "sig")
def activity_seed(spark, sf_dir):
    return D.activity_seed(D.frames(sig(spark, sf_dir))).select("sample")


@query()
def whitening_basis(spark, sf_dir):
    b = D.whitening_basis(D.covariance_matrix(sig(spark, sf_dir)))
    return b.select("recording_id", "grid", "rank", F.posexplode("matrix").alias("place", "value"))


_TWO = "+b AS (SELECT CAST(0 AS INTEGER) AS dim, 0.6 AS q UNION ALL SELECT 1, 0.8), f AS (SELECT sample, channel AS dim, value FROM sig), d AS (SELECT sample, sum(value * q) AS s FROM f JOIN b USING (dim) GROUP BY 1), r AS (SELECT sample, dim, value - coalesce(q, 0) * s AS v FROM f LEFT JOIN b USING (dim) JOIN d USING (sample)) "


@query(_TWO + "SELECT sample, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY sample)), 6) AS w FROM r", "sig")
def deflate(spark, sf_dir):
    v = D.frames(sig(spark, sf_dir)).withColumnRenamed("x", "w")
    q = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == 0, 0.6).when(k == 1, 0.8).otherwise(0.0))
    basis = spark.sql("select 'r' recording_id, 0 grid").withColumn("w", q)
    return _round(D.deflate(v, basis).select("sample", F.posexplode("w").alias("dim", "w")), "w")


@query()
def fit_units(spark, sf_dir):
    s = sig(spark, sf_dir)
    w = D.whiten(D.frames(s), D.whitening_basis(D.covariance_matrix(s)))
    rows = w.withColumn("win", F.floor(F.col("sample") / 2000).cast("int"))
    return V.fit_units(rows, V.Fit(100.0, sil=0.0, apart=0.02, peel=0.02)).select("recording_id", "grid", "win", "unit", F.round("sil", 6).alias("sil"), F.round("cov", 6).alias("cov"), F.size("spikes").alias("n_spikes"))


@query()
def fit_units_distributed(spark, sf_dir):
    """The mode for windows beyond a worker, on all recordings in step, eight grids of eight channels each, with the extractions and updates of the other mode."""
    s = parts(spark, sf_dir).withColumn("grid", F.floor(F.col("channel") / 8).cast("int")).withColumn("channel", F.col("channel") % 8)
    f = U.stored(D.packed(D.frames(s)))
    w = D.whiten(f, D.whitening_basis(D.covariance_matrix(f)))
    return V.fit_units_distributed(w, V.Fit(100.0, sil=0.0)).select("recording_id", "grid", "win", "unit", F.round("sil", 6).alias("sil"), F.round("cov", 6).alias("cov"), F.size("spikes").alias("n_spikes"))


@query()
def update_filter_window(spark, sf_dir):
    s, n = _at(spark, sf_dir)
    views = s.select("recording_id", "grid", "unit_uid", (F.floor(F.col("sample") / 2000) * 2000).alias("start")).distinct().withColumn("end", F.col("start") + 2000)
    out = V.update_filter_window(sig(spark, sf_dir), s, views, 100.0, peel_others=True, band=(10.0, 30.0, 2))
    return out.select("unit_uid", "start", "changed", F.size("spikes").alias("n_spikes"), F.round(F.aggregate("pulse", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# --- units


#: Maxima of {}: runs of equal values that are higher than both sides, at the middle (rounded down) of their first and last sample.
_MAXIMA = (
    "e AS (SELECT recording_id, unit_uid, sample, value, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS e FROM {} WINDOW w AS (PARTITION BY recording_id, unit_uid ORDER BY sample)), "
    "f AS (SELECT *, sum(e) OVER (PARTITION BY recording_id, unit_uid ORDER BY sample) AS f FROM e), tops AS (SELECT recording_id, unit_uid, f, (min(sample) + max(sample)) // 2 AS sample, any_value(value) AS value FROM f GROUP BY 1, 2, 3), "
    "p AS MATERIALIZED (SELECT recording_id, unit_uid, sample, value FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM tops WINDOW w AS (PARTITION BY recording_id, unit_uid ORDER BY f)) WHERE value > b AND value > a), "
)


@query("+" + _MAXIMA.format("spk").rstrip(", ") + " SELECT unit_uid, sample, value FROM p", "spk")
def local_maxima(spark, sf_dir):
    return U.local_maxima(spk(spark, sf_dir)).select("unit_uid", "sample", "value")


def _greedy(peaks: str, distance: int) -> str:
    """CTEs: places of `peaks` chosen from the highest down, unit by unit, as `chosen`."""
    return f"""k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_uid ORDER BY value DESC, sample DESC) AS k FROM {peaks}),
g(recording_id, unit_uid, k, kept) AS (SELECT DISTINCT recording_id, unit_uid, 0::BIGINT, []::BIGINT[] FROM k UNION ALL
  SELECT g.recording_id, g.unit_uid, g.k + 1, CASE WHEN len(list_filter(kept, lambda s: abs(s - sample) < {distance})) = 0 THEN list_append(kept, sample) ELSE kept END FROM g JOIN k ON k.recording_id = g.recording_id AND k.unit_uid = g.unit_uid AND k.k = g.k + 1),
chosen AS (SELECT recording_id, unit_uid, unnest(arg_max(kept, k)) AS sample FROM g GROUP BY 1, 2)"""


@query("+" + _MAXIMA.format("spk") + _greedy("p", 40_000) + " SELECT unit_uid, sample, value FROM chosen JOIN p USING (recording_id, unit_uid, sample)", "spk", True)
def find_peaks(spark, sf_dir):
    return U.find_peaks(spk(spark, sf_dir), 40_000).select("unit_uid", "sample", "value")


_SPLIT = """+k AS (SELECT *, row_number() OVER w AS k, sum(value) OVER w AS c, sum(value * value) OVER w AS q, count(*) OVER t AS n, sum(value) OVER t AS sc, sum(value * value) OVER t AS sq
  FROM spk WINDOW w AS (PARTITION BY recording_id, unit_uid ORDER BY value, sample ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY recording_id, unit_uid)),
  cost AS (SELECT *, CASE WHEN k < n THEN round(q - c * c / k + sq - q - (sc - c) * (sc - c) / (n - k), 9) END AS cost FROM k),
  best AS (SELECT recording_id, unit_uid, arg_min(k, struct_pack(c := cost, k := k)) AS cut FROM cost WHERE cost IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT cost.*, k > cut AS high FROM cost JOIN best USING (recording_id, unit_uid)) """


@query(_SPLIT + "SELECT unit_uid, sample, high FROM s", "spk")
def two_means_split(spark, sf_dir):
    return U.two_means_split(spk(spark, sf_dir)).select("unit_uid", "sample", "high")


@query(_SPLIT + ", c AS (SELECT *, avg(CASE WHEN high THEN value END) OVER (PARTITION BY unit_uid) AS hi, avg(CASE WHEN NOT high THEN value END) OVER (PARTITION BY unit_uid) AS lo FROM s) SELECT unit_uid, round((sum(pow(value - lo, 2)) - sum(pow(value - hi, 2))) / greatest(sum(pow(value - lo, 2)), sum(pow(value - hi, 2))), 6) AS sil FROM c WHERE high GROUP BY unit_uid", "spk")
def silhouette(spark, sf_dir):
    return _round(U.silhouette(spk(spark, sf_dir)).select("unit_uid", "sil"), "sil")


@query("SELECT unit_uid, sample FROM (SELECT *, avg(value) OVER (PARTITION BY unit_uid) + 3 * stddev_pop(value) OVER (PARTITION BY unit_uid) AS top FROM spk) WHERE value <= top", "spk")
def reject_high_peaks(spark, sf_dir):
    return U.reject_high_peaks(spk(spark, sf_dir)).select("unit_uid", "sample")


@query("+" + _ISI + " SELECT unit_uid, sample, isi FROM i WHERE isi IS NOT NULL", "spk")
def inter_spike_intervals(spark, sf_dir):
    return U.inter_spike_intervals(spk(spark, sf_dir)).select("unit_uid", "sample", "isi")


@query("+" + _ISI + " SELECT unit_uid, count(*) AS n_spikes, round(stddev_pop(isi) / avg(isi), 6) AS cov FROM i GROUP BY unit_uid", "spk")
def isi_cov(spark, sf_dir):
    return _round(U.isi_cov(spk(spark, sf_dir)).select("unit_uid", "n_spikes", "cov"), "cov")


@query("+" + _ISI + ", c AS (SELECT unit_uid, round(stddev_pop(isi) / avg(isi), 6) AS cov FROM i GROUP BY unit_uid) SELECT * FROM c WHERE cov <= 1.0", "spk")
def select_units(spark, sf_dir):
    return U.select_units(_round(U.isi_cov(spk(spark, sf_dir)).select("unit_uid", "cov"), "cov"), cov=1.0)


def _by_minutes(spark, sf_dir):
    """The spikes of spk by minutes, as they come: several in a minute are several rows."""
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1704067200
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("recording_id"), F.col("user_id").alias("unit_uid"), sec.alias("sec"))
    return e.select("recording_id", "unit_uid", F.floor(F.col("sec") / 60).alias("sample"))


def _trains(spark, sf_dir):
    """The spike trains by minutes, a unit's in one place, so that what goes on unit by unit shuffles nothing more."""
    return _by_minutes(spark, sf_dir).repartition("unit_uid").distinct()


@query("+t AS (SELECT recording_id, max(sample) + 1 AS n FROM m GROUP BY 1), u AS (SELECT DISTINCT recording_id, unit_uid FROM m), p AS (SELECT recording_id, unit_uid, unnest(range(n)) AS sample FROM u JOIN t USING (recording_id)) SELECT p.unit_uid, p.sample, CASE WHEN m.sample IS NULL THEN 0.0 ELSE 1.0 END AS value FROM p LEFT JOIN m ON m.recording_id = p.recording_id AND m.unit_uid = p.unit_uid AND m.sample = p.sample", "min")
def pulse_from_spikes(spark, sf_dir):
    m = _by_minutes(spark, sf_dir)
    return U.pulse_from_spikes(m, U.stored(_totals(m))).select("unit_uid", "sample", "value")


@query("SELECT unit_uid, sample, CASE WHEN sample % 3 = 0 THEN 0.0 ELSE value END AS value FROM spk", "spk")
def spike_heights(spark, sf_dir):
    s = spk(spark, sf_dir)
    return U.spike_heights(s, s.where("sample % 3 <> 0").select("recording_id", "unit_uid", "sample", "value")).select("unit_uid", "sample", "value")


@query("SELECT DISTINCT unit_uid FROM spk WHERE grid = 2", "spk")
def units_for_grid(spark, sf_dir):
    return U.units_for_grid(spk(spark, sf_dir).select("recording_id", "grid", "unit_uid").distinct(), 2).select("unit_uid")


@query("SELECT DISTINCT unit_uid, unnest(range(greatest(sample - 1, 0), sample + 2)) AS sample FROM m", "min")
def expand_jitter(spark, sf_dir):
    return U.expand_jitter(minutes(spk(spark, sf_dir)), 1).select("unit_uid", "sample")


_LAG = "+o AS (SELECT a.recording_id, a.unit_uid AS u, b.unit_uid AS v, b.sample - a.sample AS lag, count(*) AS n FROM m a JOIN m b ON a.recording_id = b.recording_id AND a.unit_uid < b.unit_uid AND b.sample - a.sample BETWEEN -4 AND 4 GROUP BY ALL) "


def _gridded(trains):
    """With the grid of each unit, as spk has it."""
    return trains.withColumn("grid", (F.floor(F.col("unit_uid") / 4) % 4).cast("int"))


@query(_LAG + "SELECT u, v, lag, n FROM o", "min")
def lag_overlap(spark, sf_dir):
    return U.lag_overlap(_trains(spark, sf_dir), 2, copies=True).select("u", "v", "lag", "n")


_BEST = _LAG + ", c AS (SELECT unit_uid, count(*) AS k FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, lag) AS rk FROM o), best AS (SELECT u, v, lag, n, cu.k AS n_u, cv.k AS n_v FROM r JOIN c cu ON cu.unit_uid = u JOIN c cv ON cv.unit_uid = v WHERE rk = 1) "


@query(_BEST + "SELECT u, v, lag, round(n / sqrt(CAST(n_u AS DOUBLE) * n_v), 6) AS share FROM best", "min")
def best_lags(spark, sf_dir):
    return _round(U.best_lags(U.lag_overlap(_trains(spark, sf_dir), 2, best=True, copies=True)).select("u", "v", "lag", "share"), "share")


@query(_BEST + ", h AS (SELECT best.*, a.sample, a.sample - lag(a.sample) OVER (PARTITION BY u, v ORDER BY a.sample) AS gap FROM best JOIN m a ON a.unit_uid = u JOIN m b ON b.unit_uid = v AND b.sample = a.sample + best.lag) SELECT u, v, round(sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) / CAST(greatest(max(n_u), max(n_v)) AS DOUBLE), 6) AS score FROM h GROUP BY u, v", "min")
def duplicate_score(spark, sf_dir):
    return _round(U.duplicate_score(U.best_lags(U.lag_overlap(_trains(spark, sf_dir), 2, best=True, copies=True))).select("u", "v", "score"), "score")


_DEDUP = """, h AS (SELECT best.*, a.recording_id, a.sample, a.sample - lag(a.sample) OVER (PARTITION BY u, v ORDER BY a.sample) AS gap FROM best JOIN m a ON a.unit_uid = u JOIN m b ON b.unit_uid = v AND b.sample = a.sample + best.lag),
near AS (SELECT recording_id, u, v FROM h GROUP BY ALL HAVING sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) / CAST(greatest(max(n_u), max(n_v)) AS DOUBLE) >= 0.02),
i AS (SELECT *, sample - lag(sample) OVER (PARTITION BY recording_id, unit_uid ORDER BY sample) AS isi FROM m),
units AS MATERIALIZED (SELECT recording_id, unit_uid, coalesce(CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END, 100.0) AS cov, row_number() OVER (PARTITION BY recording_id ORDER BY unit_uid) AS k FROM i GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT a.recording_id, a.k, list(struct_pack(cov := b.cov, k := b.k)) AS l FROM near JOIN units a ON a.unit_uid = u JOIN units b ON b.unit_uid = v GROUP BY 1, 2),
steps(recording_id, k, taken, kept) AS (SELECT DISTINCT recording_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM units UNION ALL
  SELECT recording_id, k, CASE WHEN list_contains(taken, k) THEN taken ELSE list_concat(taken, list_transform(own, lambda x: x.k)) END, CASE WHEN list_contains(taken, k) THEN kept ELSE list_append(kept, (list_sort(own)[1]).k) END
  FROM (SELECT steps.recording_id, units.k, taken, kept, list_append(list_filter(coalesce(l, []), lambda x: NOT list_contains(taken, x.k)), struct_pack(cov := cov, k := units.k)) AS own
    FROM steps JOIN units ON units.recording_id = steps.recording_id AND units.k = steps.k + 1 LEFT JOIN nb ON nb.recording_id = steps.recording_id AND nb.k = units.k)),
last AS (SELECT recording_id, unnest(arg_max(kept, k)) AS k FROM steps GROUP BY 1)
SELECT recording_id, unit_uid, round(cov, 6) AS cov FROM last JOIN units USING (recording_id, k)"""


@query(_BEST + _DEDUP, "min", True)
def dedup_units(spark, sf_dir):
    m = _trains(spark, sf_dir)
    c = U.stored(U.train_classes(m))
    first = c.where("unit_uid = rep").select("recording_id", "unit_uid")
    best = U.lag_overlap(m.join(first, ["recording_id", "unit_uid"], "left_semi"), 2, own=True, best=True)
    units = U.isi_cov(m, 100.0).withColumn("ord", F.col("unit_uid"))
    return U.dedup_units(units, U.class_scores(best, c, 0.02), 0.02, classes=c).select("recording_id", "unit_uid", F.round("cov", 6).alias("cov"))


@query("+l AS (SELECT *, lead(sample) OVER (PARTITION BY unit_uid ORDER BY sample) - sample AS isi FROM spk) SELECT unit_uid, CAST(round_even(sample + isi / 2, 0) AS BIGINT) AS \"at\", round(1.0 / isi, 6) AS rate FROM l WHERE isi > 0", "spk")
def discharge_rate(spark, sf_dir):
    return _round(U.discharge_rate(spk(spark, sf_dir), 1.0).select("unit_uid", "at", "rate"), "rate")


@query("+" + _ISI + ", c AS (SELECT recording_id, unit_uid, round(stddev_pop(isi) / avg(isi), 6) AS sil FROM i GROUP BY 1, 2) SELECT recording_id, count(*) AS n_units, round(avg(sil), 6) AS mean_sil FROM c GROUP BY 1", "spk")
def unit_summary(spark, sf_dir):
    u = _round(U.isi_cov(spk(spark, sf_dir)), "cov").withColumnRenamed("cov", "sil")
    return _round(U.unit_summary(u).select("recording_id", "n_units", "mean_sil"), "mean_sil")


# --- edits


def _rois(spikes):
    return spikes.select("recording_id", "unit_uid").distinct().select("recording_id", "unit_uid", F.lit(500_000).cast("long").alias("x_start"), F.lit(1_500_000).cast("long").alias("x_end"), F.lit(20.0).alias("y_min"), F.lit(60.0).alias("y_max"))


@query("SELECT unit_uid, sample FROM spk WHERE NOT (sample BETWEEN 500000 AND 1500000 AND value BETWEEN 20 AND 61)", "spk")
def delete_spikes_in_roi(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.delete_spikes_in_roi(s, s.select("recording_id", "unit_uid", "sample", "value"), _rois(s)).select("unit_uid", "sample")


@query("+z AS (SELECT recording_id, unit_uid, sample, CASE WHEN sample BETWEEN 500000 AND 1500000 THEN value ELSE 0 END AS value FROM spk), " + _MAXIMA.format("z") + _greedy("(SELECT * FROM p WHERE value >= 20)", 5000) + " SELECT unit_uid, sample FROM chosen UNION SELECT unit_uid, sample FROM spk WHERE sample % 2 = 0", "spk", True)
def add_spikes_in_roi(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.add_spikes_in_roi(s.select("recording_id", "unit_uid", "sample", "value"), s.where("sample % 2 = 0"), _rois(s), 5000).select("unit_uid", "sample")


_PAIR = "+p AS (SELECT unit_uid, sample, value, lead(sample) OVER w AS r, lead(value) OVER w AS rv FROM spk WINDOW w AS (PARTITION BY unit_uid ORDER BY sample)), q AS (SELECT *, r - sample AS isi, CASE WHEN value < rv THEN sample ELSE r END AS low FROM p WHERE r IS NOT NULL) "


@query(_PAIR + "SELECT unit_uid, sample FROM spk EXCEPT SELECT unit_uid, low FROM q WHERE r - isi // 2 BETWEEN 500000 AND 1500000 AND 100000.0 / isi > 20", "spk")
def delete_high_rate_in_roi(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.delete_high_rate_in_roi(s, s.select("recording_id", "unit_uid", "sample", "value"), _rois(s), 100_000.0).select("unit_uid", "sample")


@query(_PAIR + ", t AS (SELECT *, avg(1.0 / isi) OVER (PARTITION BY unit_uid) + 3 * stddev_pop(1.0 / isi) OVER (PARTITION BY unit_uid) AS top, count(*) OVER (PARTITION BY unit_uid) AS n FROM q) SELECT unit_uid, sample FROM spk EXCEPT SELECT unit_uid, low FROM t WHERE 1.0 / isi > top AND n >= 2", "spk")
def remove_rate_outliers(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.remove_rate_outliers(s, s.select("recording_id", "unit_uid", "sample", "value"), 1.0).select("unit_uid", "sample")


@query("+a AS (SELECT unit_uid, sample FROM m WHERE sample % 2 = 0), b AS (SELECT unit_uid, sample AS peak FROM m WHERE sample % 2 = 1), r AS (SELECT a.unit_uid, sample, peak, row_number() OVER (PARTITION BY a.unit_uid, sample ORDER BY abs(peak - sample), peak) AS k FROM a LEFT JOIN b ON a.unit_uid = b.unit_uid AND abs(peak - sample) <= 200) SELECT DISTINCT unit_uid, coalesce(peak, sample) AS sample FROM r WHERE k = 1", "min")
def lock_spikes(spark, sf_dir):
    m = minutes(spk(spark, sf_dir))
    return E.lock_spikes(m.where("sample % 2 = 0"), m.where("sample % 2 = 1"), 200).select("unit_uid", "sample")


@query("SELECT channel AS unit_uid, sample, round(CASE WHEN sample >= 110 AND sample < 390 THEN -value ELSE value END, 6) AS value FROM sig", "sig")
def splice_pulse(spark, sf_dir):
    p = sig(spark, sf_dir).select("recording_id", F.col("channel").alias("unit_uid"), "sample", "value")
    return _round(E.splice_pulse(p, p.withColumn("value", -F.col("value")), 100, 400, 10).select("unit_uid", "sample", "value"), "value")


@query("SELECT unit_uid, sample FROM spk UNION ALL SELECT 1000000, sample FROM spk WHERE unit_uid = 5", "spk")
def duplicate_unit(spark, sf_dir):
    s = spk(spark, sf_dir).select("unit_uid", "sample")
    return E.duplicate_unit(s, 5, 1_000_000)


@query("SELECT unit_uid, sample, CASE WHEN sample % 3 = 0 THEN 'removed' ELSE 'added' END AS change FROM spk WHERE (sample % 3 = 0) <> (sample % 5 = 0)", "spk")
def spike_diff(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.spike_diff(s.where("sample % 3 = 0"), s.where("sample % 5 = 0")).select("unit_uid", "sample", "change")


@query("SELECT unit_uid, 'add_spikes' AS type, string_agg(CASE WHEN sample % 5 = 0 THEN CAST(sample AS VARCHAR) END, ',' ORDER BY sample) AS added, string_agg(CASE WHEN sample % 3 = 0 THEN CAST(sample AS VARCHAR) END, ',' ORDER BY sample) AS removed FROM spk WHERE (sample % 3 = 0) <> (sample % 5 = 0) GROUP BY 1", "spk")
def edit_history_entries(spark, sf_dir):
    s = spk(spark, sf_dir)
    d = E.spike_diff(s.where("sample % 3 = 0"), s.where("sample % 5 = 0"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return E.edit_history_entries(d, "add_spikes").select("unit_uid", "type", join("added"), join("removed"))


@query("SELECT DISTINCT unit_uid FROM spk WHERE sample % 50 = 0", "spk")
def dirty_units(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.dirty_units(s.where("sample % 50 <> 0"), s).select("unit_uid")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.lit("r").alias("recording_id"), F.col("conv_id").alias("unit_uid"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "flag_mu").otherwise("add_spikes").alias("type"), (F.col("turn") % 2 == 0).alias("flagged"))


@query("SELECT conv_id AS unit_uid, max(turn) AS seq, CASE WHEN arg_max(role, turn) = 'user' THEN 'flag_mu' ELSE 'add_spikes' END AS type FROM conversations GROUP BY 1")
def last_edit_per_unit(spark, sf_dir):
    return E.last_edit_per_unit(_log(spark, sf_dir)).select("unit_uid", "seq", "type")


@query("SELECT conv_id AS unit_uid, turn AS seq FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations) WHERE turn < top")
def undo_last(spark, sf_dir):
    return E.undo_last(_log(spark, sf_dir)).select("unit_uid", "seq")


@query("SELECT conv_id AS unit_uid, turn AS seq FROM conversations WHERE conv_id % 4 <> 0")
def reset_units(spark, sf_dir):
    log = _log(spark, sf_dir)
    return E.reset_units(log, log.where("unit_uid % 4 = 0").select("recording_id", "unit_uid").distinct()).select("unit_uid", "seq")


@query("SELECT conv_id AS unit_uid, arg_max(CASE WHEN role = 'user' THEN turn % 2 = 0 ELSE false END, turn) AS flagged FROM conversations GROUP BY 1")
def flag_units(spark, sf_dir):
    log = _log(spark, sf_dir)
    return E.flag_units(log.select("recording_id", "unit_uid").distinct(), log).select("unit_uid", "flagged")


@query("SELECT conv_id AS unit_uid, turn AS seq FROM conversations UNION ALL SELECT conv_id, max(turn) + 1 FROM conversations GROUP BY 1")
def append_edit_log(spark, sf_dir):
    log = _log(spark, sf_dir)
    new = log.groupBy("recording_id", "unit_uid").agg((F.max("seq") + 1).alias("seq"))
    return E.append_edit_log(log, new).select("unit_uid", "seq")


# --- streaming


@query("SELECT user_id AS unit_uid, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, min(value) AS low, max(value) AS high, round(avg(abs(value)), 6) AS activity FROM events GROUP BY 1, 2")
def stream_qc_envelope(spark, sf_dir):
    from spikeloom.streaming.envelope import stream_qc_envelope as envelope

    e = table(spark, sf_dir, "events").select(F.lit("r").alias("recording_id"), F.col("user_id").alias("unit_uid"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return _round(envelope(e, "1 day").select("unit_uid", F.unix_seconds("start").alias("start"), "low", "high", "activity"), "activity")


# --- channels, grids and saved units


@query("+e AS (SELECT recording_id, \"group\" AS g, coalesce(arg_min(trim(target_muscle), row_no), '') AS m FROM ch WHERE type = 'EMG' AND \"group\" <> 'n/a' GROUP BY 1, 2), f AS (SELECT recording_id, arg_min(TRY_CAST(sampling_frequency AS DOUBLE), row_no) FILTER (WHERE TRY_CAST(sampling_frequency AS DOUBLE) IS NOT NULL) AS fsamp FROM ch WHERE type = 'EMG' AND \"group\" <> 'n/a' GROUP BY 1) SELECT recording_id, string_agg(g, ',' ORDER BY length(g), g) AS grids, regexp_replace(string_agg(m, ',' ORDER BY length(g), g), ',+$', '') AS muscles, any_value(fsamp) AS fsamp FROM e JOIN f USING (recording_id) GROUP BY 1", "ch")
def grid_summary(spark, sf_dir):
    return C.grid_summary(channels(spark, sf_dir)).select("recording_id", F.array_join("grids", ",").alias("grids"), F.array_join("muscles", ",").alias("muscles"), "fsamp")


@query("+u AS (SELECT recording_id, trim(target_muscle) AS m, min(row_no) AS k FROM ch WHERE trim(target_muscle) <> '' GROUP BY 1, 2), n AS (SELECT recording_id, string_agg(m, ',' ORDER BY k) AS muscles FROM u GROUP BY 1) SELECT recording_id, arg_min(low_cutoff, row_no) FILTER (WHERE low_cutoff IS NOT NULL) AS low_cutoff, arg_min(gain, row_no) AS gain, coalesce(any_value(muscles), '') AS muscles FROM ch LEFT JOIN n USING (recording_id) GROUP BY 1", "ch")
def recording_auto_info(spark, sf_dir):
    return C.recording_auto_info(channels(spark, sf_dir)).select("recording_id", "low_cutoff", "gain", F.array_join("muscles", ",").alias("muscles"))


@query("+a AS (SELECT recording_id, count(*) FILTER (WHERE type = 'EMG') AS emg, count(*) FILTER (WHERE type = 'MISC') AS misc, CASE WHEN min(gain) = max(gain) THEN min(gain) END AS gain, arg_min(row_no, row_no) FILTER (WHERE low_cutoff IS NOT NULL) AS low, sum(row_no) AS n FROM ch GROUP BY 1) SELECT recording_id, CAST(emg AS VARCHAR) AS emg, CAST(misc AS VARCHAR) AS misc, gain, CASE WHEN emg % 2 = 0 THEN 'own' ELSE CAST(low AS VARCHAR) END AS low, CAST(n / 1024.0 AS DOUBLE) AS duration FROM a", "ch")
def recording_sidecar(spark, sf_dir):
    ch = channels(spark, sf_dir)
    even = F.count_if(F.col("type") == "EMG") % 2 == 0
    r = ch.groupBy("recording_id").agg(F.lit(1024.0).alias("fsamp"), F.sum("row_no").alias("total_samples"), F.when(even, F.create_map(F.lit("HighpassCutoff"), F.lit("own"), F.lit("EMGChannelCount"), F.lit("-1"))).alias("extra"))
    m = F.col("sidecar")
    return C.recording_sidecar(r, ch).select("recording_id", m["EMGChannelCount"].alias("emg"), m["MISCChannelCount"].alias("misc"), m["EMGGain"].alias("gain"), m["HighpassCutoff"].alias("low"), m["RecordingDuration"].cast("double").alias("duration"))


@query("SELECT p_partkey, CAST(a AS INTEGER) AS adapter, CASE WHEN a IN (3, 4) THEN 'grid' WHEN a = 5 THEN 'aux' ELSE 'other' END AS kind FROM (SELECT p_partkey, CASE WHEN contains(d, '16') THEN 2 WHEN contains(d, '32') THEN 3 WHEN contains(d, '64') THEN 4 WHEN contains(d, 'General') THEN 1 ELSE 5 END AS a FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'General' ELSE p_name || (p_size * 2) END AS d FROM part))")
def classify_channels(spark, sf_dir):
    d = F.when(F.col("p_partkey") % 10 == 0, "General").otherwise(F.concat("p_name", (F.col("p_size") * 2).cast("string")))
    return C.classify_channels(table(spark, sf_dir, "part").select("p_partkey", d.alias("description"))).select("p_partkey", "adapter", "kind")


@query("SELECT channel, sample, round(value * CASE channel % 8 WHEN 0 THEN 0.1526 WHEN 1 THEN 1.0 WHEN 2 THEN 0.00024928 WHEN 3 THEN 0.00025177 WHEN 4 THEN 0.00014648 WHEN 5 THEN 4.8 / 16777216 * 1000 / 2.0 WHEN 6 THEN 0.00037217 ELSE 4.8 / 16777216 * 1000 END, 9) AS value FROM sig", "sig")
def scale_by_device(spark, sf_dir):
    k = F.col("id") % 8
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k + 1).cast("int"))
    meta = spark.range(64).select(F.col("id").cast("int").alias("channel"), pick("QUATTRO", "QUATTROCENTO", "DUE+", "DUE", "SESSANTAQUATTRO", "SESSANTAQUATTRO+", "SYNCSTATION", "x").alias("device"), pick("Direct connection", "AdapterControl", "a", "a", C.AUX_INPUT, "a", "AdapterLoadCell", "a").alias("adapter"), pick(16, 16, 16, 16, 16, 24, 16, 24).alias("bits"), pick(1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, 0.0).alias("gain"))
    return C.scale_by_device(sig(spark, sf_dir), meta).select("channel", "sample", F.round("value", 9).alias("value"))


@query("+c AS (SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS a, CAST(p_partkey % 3 AS INTEGER) AS b, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END AS n FROM part) SELECT p_partkey, CASE WHEN n = 2 AND a < 2 AND b < 2 THEN a || ',' || b WHEN a BETWEEN 1 AND n AND b BETWEEN 1 AND n THEN array_to_string([CASE WHEN k IN (a, b) THEN 1 ELSE 0 END FOR k IN range(1, n + 1)], ',') WHEN a < n AND b < n THEN array_to_string([CASE WHEN k IN (a, b) THEN 1 ELSE 0 END FOR k IN range(n)], ',') WHEN n = 2 THEN CAST(a <> 0 AS INTEGER) || ',' || CAST(b <> 0 AS INTEGER) ELSE '0,0,0,0' END AS mask FROM c", "sig")
def normalize_bad_masks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cells = F.array((F.col("p_size") % 4).cast("int"), (F.col("p_partkey") % 3).cast("int"))
    mask = C.normalize_bad_mask(cells, F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(4))
    return p.select("p_partkey", F.array_join(F.transform(mask, lambda x: x.cast("string")), ",").alias("mask"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("+r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit FROM conversations) SELECT conv_id, CAST(unit AS INTEGER) AS unit, array_to_string(list_sort(list_distinct(list_filter([turn, 2 * turn - 5, turn], lambda x: x >= 0))), ',') AS spikes FROM r", "sig")
def normalize_spike_lists(spark, sf_dir):
    t = F.col("turn").cast("long")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", F.array(t, 2 * t - 5, t).alias("v"))))["v"]).alias("payload"))
    return C.normalize_spike_lists(g, "payload").select("conv_id", "unit", _text("spikes").alias("spikes"))


@query("+d AS (SELECT c_custkey AS k, 1 + c_custkey % 3 AS n0, c_custkey % 2 AS n1 FROM customer), u AS (SELECT *, unnest(range(n0 + n1)) AS unit FROM d) SELECT k AS recording_id, CAST(unit AS INTEGER) AS unit, CAST(CASE k % 4 WHEN 0 THEN CASE WHEN unit < n0 THEN 0 ELSE 1 END WHEN 1 THEN CASE WHEN n0 + n1 = 3 THEN 5 + unit ELSE 0 END ELSE 0 END AS INTEGER) AS grid, CASE WHEN unit >= n0 THEN CAST(k + 2 AS VARCHAR) WHEN unit < 2 THEN CAST(k + unit AS VARCHAR) ELSE '' END AS spikes FROM u", "sig")
def unpack_gridwise_units(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    num = lambda c: c.cast("int")
    d = table(spark, sf_dir, "customer").select(k.alias("recording_id"), F.array(F.array(F.array(k), F.array(k + 1)), F.array(F.array(k + 2))).alias("spikes"), F.array(num(1 + k % 3), num(k % 2)).alias("pulse_rows"), F.when(k % 4 == 1, F.array(F.lit(5), F.lit(6), F.lit(7))).when(k % 4 > 1, F.array(F.lit(9), F.lit(9), F.lit(9), F.lit(9), F.lit(9))).alias("mapping"))
    return C.unpack_gridwise_units(d).select("recording_id", "unit", "grid", _text("spikes").alias("spikes"))


@query("SELECT DISTINCT 'E' || (channel + 1) AS name, round((channel // 8) * 4.0, 4) AS x, round((channel % 8) * 4.0, 4) AS y, 'HD08MM' AS coordinate_system FROM sig", "sig")
def electrodes_table(spark, sf_dir):
    c = F.col("channel")
    e = sig(spark, sf_dir).select("recording_id", "grid", "channel").distinct().select("*", F.lit("HD-08 MM").alias("grid_name"), F.floor(c / 8).alias("row"), (c % 8).alias("col"), F.lit(4.0).alias("ied"), F.lit(None).cast("string").alias("material"))
    return C.electrodes_table(e).select("name", "x", "y", "coordinate_system")


@query("+g AS (SELECT p_partkey % 10 AS recording_id, p_partkey AS grid, CASE WHEN p_partkey % 7 = 0 THEN 'Grid' || (p_partkey + 1) ELSE regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') END AS space, CASE WHEN p_size % 2 = 0 THEN 'mm' ELSE 'a.u.' END AS units FROM part) SELECT recording_id, space, arg_min(units, grid) AS units FROM g GROUP BY 1, 2", "sig")
def coordinate_spaces(spark, sf_dir):
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select((k % 10).alias("recording_id"), k.alias("grid"), F.when(k % 7 == 0, "-").otherwise(F.col("p_name")).alias("grid_name"), F.when(F.col("p_size") % 2 == 0, 4.0).alias("ied"))
    return C.coordinate_spaces(g)


# --- filters over windows and adaptive decomposition


@query(_DOT + ", n AS (SELECT max(sample) + 11 AS n FROM sig), q AS (SELECT unnest(range(n)) AS sample FROM n) SELECT unit_uid, q.sample, round(coalesce(s * abs(s) * CASE WHEN q.sample >= 200 THEN 4 ELSE 1 END, 0.0), 5) AS value FROM (SELECT unnest(range(3)) AS unit_uid) CROSS JOIN q LEFT JOIN p USING (unit_uid, sample)", "sig")
def apply_filters(spark, sf_dir):
    f = D.frames(sig(spark, sf_dir))
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 11).alias("total_samples")).withColumn("recording_id", F.lit("r"))
    late = f.where("sample >= 200").select("recording_id", "grid", "sample", F.transform("x", lambda v: 2 * v).alias("x"), F.lit(1).alias("win"))
    out = D.apply_filters(f.where("sample < 300").withColumn("win", F.lit(0)).union(late), _filters(spark), n)
    return out.select("unit_uid", "sample", F.round("value", 5).alias("value"))


@query()
def refine_by_isi(spark, sf_dir):
    return D.refine_by_isi(D.frames(sig(spark, sf_dir)), _filters(spark), 4).select("unit_uid", F.posexplode("filter").alias("dim", "w"), "cov")


_CENTRES = "c AS (SELECT recording_id, unit_uid, avg(value) * 0.5 AS low, avg(value) AS high FROM spk GROUP BY 1, 2)"


def _centres(spikes):
    return spikes.groupBy("recording_id", "unit_uid").agg((F.avg("value") * 0.5).alias("low"), F.avg("value").alias("high"))


@query(_SPLIT + "SELECT unit_uid, round(coalesce(avg(value) FILTER (WHERE NOT high), 0), 6) AS low, round(avg(value) FILTER (WHERE high), 6) AS high FROM s GROUP BY 1", "spk")
def calibration_centroids(spark, sf_dir):
    s = spk(spark, sf_dir)
    return _round(A.calibration_centroids(s, s.select("recording_id", "unit_uid").distinct()).select("unit_uid", "low", "high"), "low", "high")


_DETECT = "+" + _CENTRES + ", " + _MAXIMA.format("spk") + "d AS (SELECT p.unit_uid, sample, value, low, high, value > (low + high) / 2 AS spike FROM p JOIN c USING (recording_id, unit_uid) WHERE value >= low / 3 AND value <= high * 3) "


@query(_DETECT + "SELECT unit_uid, sample, spike FROM d", "spk")
def bounded_spike_detect(spark, sf_dir):
    s = spk(spark, sf_dir)
    return A.bounded_spike_detect(s, _centres(s), 1).select("unit_uid", "sample", "spike")


@query(_DETECT + "SELECT c.unit_uid, round((5 * c.low + coalesce(sum(value) FILTER (WHERE NOT spike), 0)) / (5 + count(*) FILTER (WHERE NOT spike)), 6) AS low, round((5 * c.high + coalesce(sum(value) FILTER (WHERE spike), 0)) / (5 + count(*) FILTER (WHERE spike)), 6) AS high FROM c LEFT JOIN d USING (unit_uid) GROUP BY c.unit_uid, c.low, c.high", "spk")
def centroid_update(spark, sf_dir):
    s = spk(spark, sf_dir)
    c = _centres(s)
    return _settled(A.centroid_update(c, A.bounded_spike_detect(s, c, 1)).select("unit_uid", "low", "high"), "low", "high")


@query("SELECT unit_uid, sample // 86400 AS batch, round(pow((ln(cosh(avg(value / 50) FILTER (WHERE sample % 2 = 0))) - 0.4) / (0.2 + 1e-12), 2), 6) AS loss FROM spk GROUP BY 1, 2", "spk")
def contrast_loss(spark, sf_dir):
    s = spk(spark, sf_dir).select("recording_id", "unit_uid", "sample", (F.col("value") / 50).alias("source"), (F.col("sample") % 2 == 0).alias("spike"))
    cal = s.select("recording_id", "unit_uid").distinct().withColumns({"mean": F.lit(0.4), "std": F.lit(0.2)})
    return _round(A.contrast_loss(s, cal, 86_400).select("unit_uid", "batch", "loss"), "loss")


# --- listings, catalogues, masks and ranges


@query("SELECT DISTINCT '/d/s' || (p_partkey % 50) AS folder, 'sub-' || (p_partkey // 50) AS label, '/d/s' || (p_partkey % 50) || '/sub-' || (p_partkey // 50) || CASE WHEN p_partkey % 3 = 0 THEN '_emg.bdf' WHEN p_partkey % 3 = 1 THEN '_emg.edf' ELSE '_emg.csv' END AS path, CASE WHEN p_partkey % 5 < 4 THEN '/d/s' || (p_partkey % 50) || '/sub-' || (p_partkey // 50) || CASE WHEN p_partkey % 5 < 2 THEN '_channels.tsv' ELSE '_emg_channels.tsv' END END AS channels FROM part")
def resolve_recording_paths(spark, sf_dir):
    from spikeloom.sources.tables import resolve_recording_paths as resolve

    k = F.col("p_partkey")
    stem = F.concat(F.lit("/d/s"), (k % 50).cast("string"), F.lit("/sub-"), F.floor(k / 50).cast("string"))
    some = lambda cond, *names: F.when(cond, F.array(*(F.lit(n) for n in names))).otherwise(F.array().cast("array<string>"))
    names = F.concat(some(k % 3 == 0, "_emg.bdf"), some(k % 3 < 2, "_emg.edf"), some(F.lit(True), "_emg.csv", "_emg.json"), some(k % 5 < 2, "_channels.tsv"), some(k % 5 < 4, "_emg_channels.tsv"))
    return resolve(table(spark, sf_dir, "part").select(stem.alias("stem"), F.explode(names).alias("name")).select(F.concat("stem", "name").alias("path")))


@query("SELECT recording_id, row_no, type, CASE WHEN \"group\" <> 'n/a' THEN \"group\" END AS \"group\", row_no % 7 = 0 AS bad FROM ch", "ch")
def read_channels_table(spark, sf_dir):
    from spikeloom.sources.tables import read_channels_table as read

    root = f"{U.ready_checkpoints(spark)}/{uuid.uuid4().hex}"
    c = channels(spark, sf_dir).withColumn("status", F.when(F.col("row_no") % 7 == 0, "BAD").otherwise("good"))
    c.write.option("header", True).option("sep", "\t").csv(root)
    return read(spark, root).select("recording_id", F.col("row_no").cast("long").alias("row_no"), "type", "group", "bad")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS rate, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS maker FROM customer")
def read_recording_sidecars(spark, sf_dir):
    from spikeloom.sources.tables import read_recording_sidecars as read

    root = f"{U.ready_checkpoints(spark)}/{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    j = F.to_json(F.struct(k.alias("id"), F.when(k % 2 == 0, k.cast("double")).alias("rate"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("maker")))
    table(spark, sf_dir, "customer").select(j.alias("value")).write.text(root)
    return read(spark, root, "id long, rate double, maker string", lines=True).select("id", "rate", "maker")


@query(
    "+v AS (SELECT * FROM (VALUES (0, 'r0'), (0, 'r1'), (1, 'r0'), (1, 'r1'), (1, 'r2'), (1, 'r3')) x(version, recording_id)), o AS (SELECT version, spk.* FROM spk JOIN v USING (recording_id) WHERE recording_id <> 'r1' OR version = 1 OR unit_uid % 8 = 1) "
    "SELECT version, recording_id, unit_uid, sample, value, coalesce(CASE WHEN version = 0 OR recording_id <> 'r0' THEN grid END, grid) AS grid, max(sample) OVER (PARTITION BY version, recording_id) + 1 AS total_samples FROM o WHERE sample >= 0",
    "spk",
)
def save_decomposition(spark, sf_dir):
    from spikeloom.sources import versions
    from spikeloom.sources.tables import save_decomposition as save

    root = f"{U.ready_checkpoints(spark)}/{uuid.uuid4().hex}"
    all_ = spk(spark, sf_dir)

    def put(s):
        rows = s.select("recording_id", "unit_uid", "sample")
        save(s.select("recording_id", "unit_uid", "grid").distinct(), s.select("recording_id", "unit_uid", "sample", "value"), rows.union(rows), s.select("recording_id").distinct().withColumn("total_samples", F.lit(None).cast("long")), root)

    put(all_.where("recording_id = 'r0' or recording_id = 'r1' and unit_uid % 8 = 1"))
    put(all_.where("recording_id <> 'r0'"))  # r0 stays as it is, r1 is saved anew
    keys, out = ["recording_id", "unit_uid"], []
    for v in (0, 1):
        read = lambda n: versions.read(spark, root, n, v)  # noqa: B023, E731
        out.append(read("spikes").join(read("pulses"), [*keys, "sample"]).join(read("units"), keys).join(read("recordings"), "recording_id").select(F.lit(v).alias("version"), *keys, "sample", "value", "grid", "total_samples"))
    return out[0].union(out[1])


@query("SELECT c_custkey, array_to_string(list_sort(list_filter(['a=' || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'new' ELSE 'old' END, 'b=' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c=' || c_mktsegment END], lambda x: x IS NOT NULL)), ',') AS meta FROM customer")
def patch_metadata(spark, sf_dir):
    from spikeloom.sources.tables import patch_metadata as patch

    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), k.cast("string")).alias("meta"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.create_map(F.lit("a"), F.when(k % 3 > 0, "new").otherwise(""), F.lit("c"), F.col("c_mktsegment")).alias("meta"))
    once = patch(old, new, "c_custkey")
    pairs = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return patch(once, new, "c_custkey").select("c_custkey", F.array_join(pairs, ",").alias("meta"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'a') THEN 'a' WHEN contains(p_name, 'e') THEN 'e' WHEN contains(p_name, 'o') THEN 'o' END AS key FROM part")
def match_grid_spec(spark, sf_dir):
    catalog = spark.createDataFrame([("a", 0), ("e", 1), ("o", 2)], "key string, ord int")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("grid_name"))
    return S.match_grid_spec(p, catalog).select("p_partkey", "spec.key")


_MAP = "+m AS (SELECT DISTINCT o_orderkey AS key, unnest(range(6)) AS cell FROM orders), c AS (SELECT key, cell, CASE WHEN cell = 5 THEN 1 ELSE (cell + key) % 7 END AS channel FROM m), r AS (SELECT key, channel, max(cell) AS cell FROM c WHERE channel BETWEEN 1 AND 5 GROUP BY 1, 2) "


@query(_MAP + "SELECT key, CAST(channel AS INTEGER) AS channel, CAST(cell // 3 AS INTEGER) AS \"row\", CAST(cell % 3 AS INTEGER) AS col FROM r", "sig")
def electrode_coordinates(spark, sf_dir):
    key = F.col("o_orderkey")
    cell = lambda k: (F.lit(1) if k == 5 else (key + k) % 7).cast("int")
    grid = F.array(F.array(*(cell(k) for k in range(3))), F.array(*(cell(k) for k in range(3, 6))))
    return S.electrode_coordinates(table(spark, sf_dir, "orders").select(key.alias("key"), F.lit(5).alias("n"), grid.alias("channel_map")))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS channel, l_orderkey % 2 = 0 AND count(*) OVER (PARTITION BY l_orderkey) = 3 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 2 AS discard FROM lineitem")
def channel_masks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("channel", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1)
    c = rows.select(F.col("l_orderkey").alias("recording_id"), F.lit(0).alias("grid"), "channel")
    over = c.where("recording_id % 2 = 0").select("recording_id", "grid").distinct().withColumn("mask", F.array(F.lit(0), F.lit(1), F.lit(0)))
    return S.channel_masks(c, over).select(F.col("recording_id").alias("l_orderkey"), "channel", "discard")


@query("+r AS (SELECT o_orderkey, o_orderkey % 90 + 1 AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 200 - 50 ELSE 0 END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 70 ELSE 40 END AS b FROM orders), s AS (SELECT *, greatest(0, least(a, n - 1)) AS start FROM r) SELECT o_orderkey, start, greatest(start + 1, least(b, n)) AS \"end\" FROM s", "sig")
def resolve_rois(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    r = o.select(k.alias("recording_id"), (k % 90 + 1).alias("total_samples"), F.lit(20.0).alias("fsamp"))
    given = o.where("o_orderkey % 2 = 0").select(k.alias("recording_id"), (k % 200 - 50).alias("start"), (k % 70).alias("end"))
    return S.resolve_rois(r, given, 2.0).select(F.col("recording_id").alias("o_orderkey"), "start", "end")


_LIST = "+e AS (SELECT *, 'r' || c_nationkey AS recording_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3, c_custkey) AS k FROM customer WHERE c_custkey % 5 > 0), x AS (SELECT *, 'r' || c_nationkey AS recording_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 5 = 0), n AS (SELECT recording_id, count(*) AS n FROM e GROUP BY 1) "


@query(_LIST + "SELECT recording_id, k AS row_no, 'Ch' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS name, 'EMG' AS type, 'E' || k AS electrode, 'Grid' || (c_custkey % 3 + 1) AS grp, c_mktsegment AS muscle, CASE WHEN c_custkey % 7 = 0 THEN 'bad/manually excluded' ELSE 'good/n/a' END AS status, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '5' END AS gain, CASE WHEN c_custkey % 4 = 0 THEN '20.5' ELSE 'n/a' END AS low, 'measured' AS scheme FROM e UNION ALL SELECT recording_id, coalesce(n, 0) + k, CASE WHEN c_custkey % 2 = 0 THEN 'trigger' ELSE c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'TRIG' ELSE 'MISC' END, 'n/a', 'Aux', 'n/a', 'good/n/a', 'n/a', '0.1', 'n/a' FROM x LEFT JOIN n USING (recording_id)", "sig")
def channels_sidecar(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("recording_id", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")))
    null = F.lit(None).cast("double")
    r = c.select("recording_id").distinct().select("recording_id", F.lit(2048.0).alias("fsamp"), F.lit("uV").alias("units"), F.lit("wrist").alias("reference"), F.lit("Measured").alias("placement_scheme"), F.lit("5").alias("gain"), *(null.alias(n) for n in ("low_cutoff", "high_cutoff", "notch")))
    e = c.where("c_custkey % 5 > 0").select("recording_id", (k % 3).cast("int").alias("grid"), k.alias("channel"), F.lit("HD").alias("grid_name"), F.col("c_mktsegment").alias("target_muscle"), F.lit(4.0).alias("ied"), (k % 7 == 0).cast("int").alias("discard"), F.when(k % 2 == 0, k.cast("string")).alias("gain"), F.when(k % 4 == 0, 20.5).alias("low_cutoff"), null.alias("high_cutoff"), null.alias("notch"))
    x = c.where("c_custkey % 5 = 0").select("recording_id", k.alias("ord"), F.when(k % 2 == 0, "trigger").otherwise(F.col("c_mktsegment")).alias("label"), F.lit(None).cast("string").alias("gain"), F.lit(0.1).alias("low_cutoff"), null.alias("high_cutoff"))
    out = C.channels_sidecar(r, e, x)
    return out.select("recording_id", "row_no", "name", "type", F.col("signal_electrode").alias("electrode"), F.col("group").alias("grp"), F.col("target_muscle").alias("muscle"), F.concat_ws("/", "status", "status_description").alias("status"), "gain", F.col("low_cutoff").alias("low"), F.col("placement_scheme").alias("scheme"))


# --- artifacts and saved edits


@query("SELECT unit_uid, sample FROM spk WHERE sample >= 0 AND NOT (sample BETWEEN 500000 AND 1500000 AND value BETWEEN 20 AND 61)", "spk")
def delete_artifacts_in_roi(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.delete_artifacts_in_roi(s.select("recording_id", "unit_uid", "sample"), s.select("recording_id", "unit_uid", "sample", "value"), _rois(s)).select("unit_uid", "sample")


@query("+z AS (SELECT recording_id, unit_uid, sample, CASE WHEN sample BETWEEN 500000 AND 1500000 THEN value ELSE 0 END AS value FROM spk), " + _MAXIMA.format("z") + "t AS (SELECT * FROM p WHERE value >= 20) SELECT unit_uid, sample FROM t UNION SELECT unit_uid, sample FROM spk WHERE sample % 2 = 0", "spk")
def add_artifacts_in_roi(spark, sf_dir):
    s = spk(spark, sf_dir)
    return E.add_artifacts_in_roi(s.select("recording_id", "unit_uid", "sample", "value"), s.where("sample % 2 = 0"), _rois(s), 1).select("unit_uid", "sample")


@query()
def dedup_by_grid(spark, sf_dir):
    m = U.stored(_gridded(_trains(spark, sf_dir)))
    u = U.isi_cov(m, 100.0).join(m.select("recording_id", "unit_uid", "grid").distinct(), ["recording_id", "unit_uid"]).withColumn("ord", F.col("unit_uid"))
    return U.dedup_by_grid(u, m.select("recording_id", "unit_uid", "sample"), 100.0, 0.01, True, _totals(m)).select("recording_id", "unit_uid", "grid")


#: Units that aren't flagged, without duplicates; variabilities come from whole numbers, so that equal trains have equal ones.
_KEPT = (
    "+f AS MATERIALIZED (SELECT recording_id, unit_uid, sample FROM m WHERE unit_uid % 3 > 0), " + _LAG.lstrip("+").replace("FROM m a JOIN m b", "FROM f a JOIN f b")
    + ", c AS (SELECT unit_uid, count(*) AS n_spikes FROM f GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, lag) AS rk FROM o), "
    "best AS (SELECT u, v, CASE WHEN n / sqrt(CAST(cu.n_spikes AS DOUBLE) * cv.n_spikes) > 0.2 THEN lag ELSE 0 END AS lag, cu.n_spikes AS n_u, cv.n_spikes AS n_v FROM r JOIN c cu ON cu.unit_uid = u JOIN c cv ON cv.unit_uid = v WHERE rk = 1) "
    + _DEDUP.replace("JOIN m ", "JOIN f ").replace("FROM m)", "FROM f)").replace("CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END", "CASE WHEN sum(isi) > 0 THEN sqrt(CAST(count(isi) * sum(isi * isi) - sum(isi) * sum(isi) AS DOUBLE)) / CAST(sum(isi) AS DOUBLE) END").rsplit("SELECT", 1)[0].rstrip()
    + ", kept AS (SELECT recording_id, unit_uid FROM last JOIN units USING (recording_id, k)) "
)


@query(
    _KEPT + ", len AS (SELECT *, max(sample) OVER (PARTITION BY recording_id) + 1 AS length FROM m) SELECT recording_id, unit_uid, count(*) AS n_spikes, max(length) AS length, CAST(count(*) AS DOUBLE) AS total, count(*) AS n_events, "
    "printf('%.6f', min(sample) / 100.0) AS onset, CAST(sum(CASE WHEN sample % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_artifacts, CAST(2 AS BIGINT) AS n_log, CAST(CASE WHEN recording_id < 'r2' THEN 31 ELSE 30 END AS VARCHAR) AS age FROM len JOIN kept USING (recording_id, unit_uid) GROUP BY recording_id, unit_uid",
    "min", True,
)
def save_edits(spark, sf_dir):
    from spikeloom.sources import versions
    from spikeloom.sources.tables import save_edited

    root = f"{U.ready_checkpoints(spark)}/{uuid.uuid4().hex}"
    m, keys = U.stored(_gridded(_trains(spark, sf_dir))), ["recording_id", "unit_uid"]
    people = m.select("recording_id").distinct().select(F.concat(F.lit("sub-"), "recording_id").alias("participant_id"), F.lit("30").alias("age"))

    def save(rows, seq, people):
        units = rows.select(*keys, "grid").distinct().withColumn("flagged", F.col("unit_uid") % 3 == 0)
        short = rows.select(*keys, "sample", F.lit(1.0).alias("value"))  # pulses that aren't as long as the recording
        log = units.select(*keys, F.lit(seq).cast("long").alias("seq"), F.lit("add_spikes").alias("type"))
        save_edited(root, units, rows, short, _totals(rows), 100.0, log, rows.where("sample % 7 = 0"), people, tol=0.02)

    save(m, 1, people)
    save(m.where("recording_id < 'r2'"), 1, None)  # entries that the log has already
    save(m, 2, people.where("participant_id < 'sub-r2'").withColumn("age", F.lit("31")))
    count = lambda t, n: versions.read(spark, root, t).groupBy(*keys).agg(F.count("*").alias(n))
    p = versions.read(spark, root, "pulses").groupBy(*keys).agg(F.count("*").alias("length"), F.sum("value").alias("total"))
    e = versions.read(spark, root, "events").groupBy(*keys).agg(F.count("*").alias("n_events"), F.min_by("onset", "sample").alias("onset"))
    out = versions.read(spark, root, "units").join(count("spikes", "n_spikes"), keys).join(p, keys).join(e, keys).join(count("artifacts", "n_artifacts"), keys, "left").join(count("edit_log", "n_log"), keys)
    ages = versions.read(spark, root, "participants").select(F.substring("participant_id", 5, 9).alias("recording_id"), "age")
    return out.join(ages, "recording_id").select(*keys, "n_spikes", "length", "total", "n_events", "onset", F.coalesce("n_artifacts", F.lit(0).cast("long")).alias("n_artifacts"), "n_log", "age")


# --- adaptive state


def _models(spark, sf_dir, starts=(0,)):
    """A model for each recording and window, each window with a start of its own."""
    basis = D.whitening_basis(D.covariance_matrix(parts(spark, sf_dir)))
    unit = F.array(*(F.array(*(F.lit(float(k == u)) for k in range(64))) for u in range(3)))
    level = lambda x: F.array_repeat(F.lit(x), 3)
    win = F.posexplode(F.array(*(F.lit(x).cast("long") for x in starts))).alias("win", "start")
    return basis.select("recording_id", "grid", win, F.col("matrix").alias("whitening"), unit.alias("vectors"), level(0.5).alias("low"), level(4.0).alias("high"))


@query()
def init_whitening_state(spark, sf_dir):
    m = A.init_whitening_state(D.frames(parts(spark, sf_dir)), _models(spark, sf_dir), A.Config(25))
    return m.select("recording_id", "grid", F.round("kl_mean", 6).alias("kl_mean"), F.round("kl_std", 6).alias("kl_std"), F.posexplode(F.transform("cov", lambda v: F.round(v, 6))).alias("place", "cov"))


def _batch(spark, sf_dir):
    """The third batch of 25 samples of every recording."""
    return D.frames(parts(spark, sf_dir).where("sample >= 50 and sample < 75"))


@query()
def whitening_update(spark, sf_dir):
    m = A.whitening_update(_batch(spark, sf_dir), _models(spark, sf_dir), A.Config(25))
    return m.select("recording_id", "grid", F.posexplode(F.transform("whitening", lambda v: F.round(v, 6))).alias("place", "weight"))


@query()
def separation_update(spark, sf_dir):
    f = _batch(spark, sf_dir)
    f = f.withColumn("spikes", F.array(*(F.get("x", F.lit(u)) > 1 for u in range(3))))
    m = A.separation_update(f, _models(spark, sf_dir), A.Config(25, epochs=5))
    return m.select("recording_id", "grid", F.posexplode("vectors").alias("unit", "w")).select("recording_id", "grid", "unit", F.posexplode(F.transform("w", lambda v: F.round(v, 6))).alias("dim", "w"))


@query("+c AS (SELECT p_partkey AS k, 1.0 + p_size % 5 AS a, 0.5 + p_size % 3 AS b FROM part), q AS (SELECT k, 0.5 * (a + b - ln(a * b) - 2) AS kl FROM c) SELECT 'p' || k AS recording_id, round(kl, 6) AS kl, round(pow((kl - 0.25) / (0.5 + 1e-12), 2), 6) AS loss FROM q", "sig")
def whitening_loss(spark, sf_dir):
    size = F.col("p_size")
    cov = F.array((1.0 + size % 5).cast("double"), F.lit(0.0), F.lit(0.0), (0.5 + size % 3).cast("double"))
    m = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("recording_id"), F.lit(0).alias("grid"), cov.alias("cov"), F.lit(0.25).alias("kl_mean"), F.lit(0.5).alias("kl_std"))
    return _round(A.whitening_loss(m).select("recording_id", "kl", "loss"), "kl", "loss")


@query()
def adaptive_bidirectional(spark, sf_dir):
    out = A.adaptive_bidirectional(A.adaptive_frames(parts(spark, sf_dir), 1), _models(spark, sf_dir, (60, 100)), A.Config(25, distance=4))
    return _round(out.select("recording_id", "win", "unit", "sample", "value", "spike"), "value")


_SIMPLE = "+a AS (SELECT recording_id, channel AS unit, sample, value - avg(value) OVER (PARTITION BY recording_id, channel) AS source FROM parts WHERE channel < 3), l AS (SELECT *, max(sample) OVER (PARTITION BY recording_id) + 1 AS n FROM a)"


def _plain_models(spark, sf_dir, starts=(0,)):
    """Models that whiten by the identity, whose first batch SQL can follow."""
    eye = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: F.when(k % 65 == 0, 1.0).otherwise(0.0))
    return _models(spark, sf_dir, starts).withColumn("whitening", eye)


@query(_SIMPLE + ", w AS (SELECT * FROM (VALUES (0, 0), (1, 30)) w(win, start)) SELECT recording_id, win, unit, sample, CASE WHEN sample < start + 25 THEN round(source * abs(source), 6) END AS value FROM l, w WHERE sample >= start", "parts")
def adaptive_corpus(spark, sf_dir):
    out = A.adaptive_corpus(A.adaptive_frames(parts(spark, sf_dir), 1), _plain_models(spark, sf_dir, (0, 30)), A.Config(25, distance=4))
    first = F.col("sample") < F.when(F.col("win") == 0, 25).otherwise(55)
    return _round(out.select("recording_id", "win", "unit", "sample", F.when(first, F.col("value")).alias("value")), "value")


@query()
def adaptive_losses(spark, sf_dir):
    frames = A.adaptive_frames(parts(spark, sf_dir), 1)
    models = A.init_whitening_state(frames, _models(spark, sf_dir).withColumn("contrast_mean", F.array_repeat(F.lit(0.1), 3)).withColumn("contrast_std", F.array_repeat(F.lit(0.2), 3)), A.Config(25))
    return _round(A.adaptive_losses(frames, models, A.Config(25, distance=4)), "whitening_loss", "contrast_loss", "total_loss")


@query(_SIMPLE + " SELECT recording_id, unit, sample, CASE WHEN sample < 25 THEN round(source * abs(source), 6) END AS value FROM l", "parts")
def adaptive_stream(spark, sf_dir):
    """Frames of all recordings as files in mixed order, read as a stream to the end of what is there."""
    root = f"{U.ready_checkpoints(spark)}/{uuid.uuid4().hex}"
    frames = A.adaptive_frames(parts(spark, sf_dir), 1)
    ts = F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("sample") * 10_000).cast("long"))
    frames.withColumn("ts", ts).repartition(6, F.xxhash64("recording_id", "sample")).write.parquet(f"{root}/in")
    totals = spark.read.parquet(f"{root}/in").groupBy("recording_id", "grid").agg((F.max("sample") + 1).alias("total"))
    models = _plain_models(spark, sf_dir).join(totals, ["recording_id", "grid"])
    live = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    out = A.adaptive_stream(live, models, A.Config(25, distance=4), 100.0, "1 minute")
    run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return _round(out.select("recording_id", "unit", "sample", F.when(F.col("sample") < 25, F.col("value")).alias("value")), "value")
