"""Labels, paths and text formats of a dataset, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The parts of an entity label in order; the first and the task are always written.
ENTITIES = ("sub", "ses", "task", "acq", "run", "recording")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def build_entity_label(**parts: Column) -> Column:
    """`sub-x[_ses-x]_task-x[_acq-x][_run-x][_recording-x]`; empty parts are dropped."""
    return F.concat_ws("_", *(F.concat(F.lit(f"{e}-"), _filled(parts[e])) for e in ENTITIES if e in parts))


def parse_entity_label(label: Column) -> Column:
    """Struct of the six entities; the last of a repeated one that is not empty counts, hyphens in it stay, a missing one is null."""
    return F.struct(*(_entity(label, e).alias(e) for e in ENTITIES))


def _entity(label: Column, name: str) -> Column:
    of = F.filter(F.split(label, "_"), lambda p: p.startswith(f"{name}-") & (F.length(p) > len(name) + 1))
    return F.when(F.size(of) > 0, F.substring(F.element_at(of, -1), len(name) + 2, 1 << 20))


def strip_artifact_suffix(name: Column) -> Column:
    """File name to entity label: no extension, no grid part, no repeated `_decomp` or `_edited` ending."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, "_grid-.*$", ""), "(_decomp|_edited)+$", "")


def safe_token(c: Column, fallback: str) -> Column:
    """Letters and digits only; the fallback if none is left."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")
    return F.when(kept == "", F.lit(fallback)).otherwise(kept)


def infer_dataset_root(path: Column, marker: str = "bids_out") -> Column:
    """Path before `derivatives/<pipeline>`, else before the first `sub-*`, else through the marker folder, else null."""
    pick = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    return F.coalesce(pick(r"^(.*?)/derivatives/[^/]+"), pick(r"^(.*?)/sub-[^/]*(?:/|$)"), pick(rf"^(.*/{marker})(?:/|$)"))


def parse_cutoff(c: Column, fsamp: Column) -> Column:
    """`<x> Hz`, `Fsamp/<x>` (a share of the rate) or a bare number; else null."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    share = F.regexp_extract(c, rf"(?i)^\s*fsamp\s*/\s*{number}\s*$", 1)
    plain = F.regexp_extract(c, rf"(?i)^\s*{number}\s*(?:hz)?\s*$", 1)
    return F.when(share != "", F.try_divide(fsamp, share.cast("double"))).when(plain != "", plain.cast("double"))


def format_hz(c: Column) -> Column:
    """A number with at most four decimals and no trailing zeros; null is `n/a`."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), F.lit("n/a")).otherwise(text)


def na_to_null(c: Column) -> Column:
    """Trimmed text; blank or `n/a` in any case becomes null."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "n/a"), t)


def grid_sort_key(c: Column) -> Column:
    """`GridN` by its number, other labels after them, lexically."""
    n = F.regexp_extract(c, r"^Grid(\d+)$", 1)
    return F.struct((n == "").cast("int").alias("other"), F.when(n != "", n.cast("long")).alias("number"), c.alias("label"))


def aux_channel_type(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.contains("TRIG") | u.contains("SYNC"), "TRIG").otherwise("MISC")


def unique_labels(df: DataFrame, part: list[str], order: list[str], label: str, out: str = "unique_label") -> DataFrame:
    """The second and later of equal labels get `_2`, `_3`, ... in order; blank ones become `Aux<n>` by place."""
    place = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    named = df.withColumn("_label", F.coalesce(_filled(F.col(label)), F.concat(F.lit("Aux"), place.cast("string"))))
    k = F.row_number().over(W.partitionBy(*part, "_label").orderBy(*order))
    return named.withColumn(out, F.when(k == 1, F.col("_label")).otherwise(F.concat_ws("_", "_label", k.cast("string")))).drop("_label")


def assign_unit_uids(units: DataFrame, recording: list[str], order: list[str]) -> DataFrame:
    """Stable ids `g<grid>_mu<k>`, k from 0 in unit order within each grid."""
    k = F.row_number().over(W.partitionBy(*recording, "grid").orderBy(*order)) - 1
    return units.withColumn("unit_uid", F.concat(F.lit("g"), F.col("grid").cast("string"), F.lit("_mu"), k.cast("string")))


def next_unit_uid(units: DataFrame, recording: list[str]) -> DataFrame:
    """The id that a copied unit of each grid gets: the greatest k so far plus one."""
    k = F.max(F.regexp_extract("unit_uid", r"_mu(\d+)$", 1).cast("long")) + 1
    return units.groupBy(*recording, "grid").agg(F.concat(F.lit("g"), F.first("grid").cast("string"), F.lit("_mu"), k.cast("string")).alias("next_uid"))


def pad_grid_names(names: Column, n: Column, numbered: bool = False) -> Column:
    """Blanks dropped, padded to n with the last name (or `Grid <k>`)."""
    kept = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    more = F.greatest(n - F.size(kept), F.lit(0))
    if numbered:
        extra = F.when(more > 0, F.transform(F.sequence(F.size(kept) + 1, n), lambda k: F.concat(F.lit("Grid "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    else:
        extra = F.array_repeat(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("Grid 1")), more)
    return F.concat(kept, extra)


def normalize_unit_lists(flags: Column, grids: Column, muscles: Column, n: Column) -> Column:
    """Struct of per-unit lists: flags and grid numbers cut or padded (false, 0) to n units, muscle names without blanks."""
    names = F.filter(F.transform(F.coalesce(muscles, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    flags, grids = F.coalesce(flags, F.array().cast("array<boolean>")), F.coalesce(grids, F.array().cast("array<int>"))
    return F.struct(pad_list(flags, n, F.lit(False)).alias("flags"), pad_list(grids, n, F.lit(0)).alias("grids"), names.alias("muscles"))


def pad_list(values: Column, n: Column, fill: Column) -> Column:
    """A list cut or padded to n entries."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), F.lit(1), n)
