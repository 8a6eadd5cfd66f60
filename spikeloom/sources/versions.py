"""Several tables of many recordings, committed together and kept by version.

A commit first writes its data, `<root>/data/<table>/_commit=<id>/_scope=<recording>/`,
then a manifest (a Parquet table that names the commit of every recording),
and last `<root>/versions/<number>`, a file that must not exist yet. Readers
follow the newest number, so they see all tables of a commit or none, a commit
that broke off is as if it had never begun, recordings that a commit doesn't
touch keep what they had, and earlier versions stay readable. Of two commits at
once the later one finds the number taken and puts its recordings on top of the other.

Tables without a recording, such as participants, have the scope `d-`; they are
replaced as a whole. Nothing but the number and the ids of commits passes the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "scope string, name string, commit string"
#: Files that a task writes at once without sorting its rows by recording; beyond, Spark sorts the rest.
WRITERS, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 16


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions."""
    p, fs = _path(spark, f"{root}/versions")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []


def _manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    p, fs = _path(spark, f"{root}/versions/{version}")
    stream = fs.open(p)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{name}")


def _claim(spark: SparkSession, root: str, version: int, manifest: str) -> bool:
    """Make a version the newest one, unless it is there already."""
    p, fs = _path(spark, f"{root}/versions/{version}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(manifest.encode()))
    out.close()
    return True


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], shared: dict[str, DataFrame] | None = None, tries: int = 20, laid: frozenset[str] = frozenset()) -> int:
    """Write these tables and make them the newest version; returns its number.

    Each of tables has recording_id (rows without one are an error). What is
    stored for the recordings of the first table, in any of the tables given, is
    replaced; a table that has no rows of a recording is then empty for it.
    Tables not given keep their rows. shared are tables of the whole dataset.

    Rows are dealt out by recording, a large one to several tasks. Tables named in
    laid (series that tasks lay out unit by unit) are written where their rows
    are: neither shuffled nor sorted, as a task keeps the files of up to `OPEN_FILES` recordings open.
    """
    own, shared = f"c{uuid.uuid4().hex}", shared or {}
    named = F.when(F.col("recording_id").isNull(), F.raise_error(F.lit("a row without recording_id")).cast("string")).otherwise(F.concat(F.lit("r-"), F.col("recording_id").cast("string")))
    for name, df in tables.items():
        out = df.withColumn("_scope", named)
        path = f"{root}/data/{name}/_commit={own}"
        if name not in laid:
            out.hint("rebalance", "_scope").write.partitionBy("_scope").parquet(path)
            continue
        before = spark.conf.get(WRITERS, None)
        spark.conf.set(WRITERS, OPEN_FILES)
        try:
            out.write.partitionBy("_scope").parquet(path)
        finally:
            spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)
    for name, df in shared.items():
        df.withColumn("_scope", F.lit("d-")).write.partitionBy("_scope").parquet(f"{root}/data/{name}/_commit={own}")
    scopes = spark.read.parquet(f"{root}/data/{next(iter(tables))}/_commit={own}").select(F.col("_scope").alias("scope")).distinct() if tables else None
    new = [scopes.select("scope", F.lit(n).alias("name"), F.lit(own).alias("commit")) for n in tables] + [spark.createDataFrame([("d-", n, own)], MANIFEST) for n in shared]
    rows = new[0]
    for df in new[1:]:
        rows = rows.union(df)
    for _ in range(tries):
        last = max(versions(spark, root), default=-1)
        all_ = rows if last < 0 else rows.union(_manifest(spark, root, last).join(rows, ["scope", "name"], "left_anti"))
        manifest = uuid.uuid4().hex
        all_.write.parquet(f"{root}/manifests/{manifest}")
        if _claim(spark, root, last + 1, manifest):
            return last + 1
    raise RuntimeError(f"{tries} other commits came first")


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version (the newest complete one by default).

    The manifest is joined on the columns that folders are named after, so that
    Spark skips the folders of other commits before it opens any file.
    """
    if version is None:
        version = max(versions(spark, root))
    live = _manifest(spark, root, version).where(F.col("name") == table).select(F.col("scope").alias("_scope"), F.col("commit").alias("_commit"))
    return spark.read.option("mergeSchema", True).parquet(f"{root}/data/{table}").join(live, ["_commit", "_scope"], "left_semi").drop("_commit", "_scope")


def tables(spark: SparkSession, root: str, version: int | None = None) -> set[str]:
    """Names of the tables that a version has."""
    if version is None:
        version = max(versions(spark, root))
    return {r.name for r in _manifest(spark, root, version).select("name").distinct().collect()}


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Forget all but the newest `keep` versions, and delete data of commits that none of them names; returns how many folders went.

    Data of a commit that is under way would go too: no commit may run meanwhile.
    """
    all_ = versions(spark, root)
    for v in all_[: max(0, len(all_) - keep)]:
        p, fs = _path(spark, f"{root}/versions/{v}")
        fs.delete(p, False)
    live = set()
    for v in all_[-keep:]:
        live |= {(r.name, r.commit) for r in _manifest(spark, root, v).select("name", "commit").distinct().collect()}
    gone = 0
    data, fs = _path(spark, f"{root}/data")
    for t in fs.listStatus(data):
        for c in fs.listStatus(t.getPath()):
            if (t.getPath().getName(), c.getPath().getName().removeprefix("_commit=")) not in live:
                fs.delete(c.getPath(), True)
                gone += 1
    return gone
