"""The trie of all conversation prefixes, by van Emde Boas recursion.

A trie of height 2s is cut at depth s: the upper trie holds the first s turns of
all sequences, and below each distinct prefix of s turns, which gets a name,
hangs a trie of what follows it (the lower forest). Both are cut again in the
same way, all at once, until one turn is left. So a prefix is named after the
cut prefixes that make it up, and equal prefixes get equal names without
meeting; one grouping by name then gives the nodes. On the way back the totals
of each lower trie are grafted onto its cut prefix and added to the nodes of the
upper trie above it, level by level: the number of rounds is the logarithm of
the depth, and a round touches every path at most once.

Names are 128-bit MD5 values, also of turns. A conversation is held in blocks of
BLOCK turns: cuts inside a block need no shuffle, cuts between blocks of longer
conversations are rounds of joins, so a conversation of any length is many rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.llm.graph import written

#: Turns of a conversation that one row holds (a power of two), and conv_ids that one piece of an end list holds.
BLOCK, PIECE = 4096, 50_000
#: Parents of more than this share of all nodes, and more than so many, are broadcast: fewer than 1 / share.
HOT_SHARE, HOT_CHILDREN = 1 / 1000, 256
#: Turns that a rebuilt conversation takes from another one, at most, and how many conversations take from one.
HEAD, FAMILY = 3, 20

NODE = "a long, b long, pa long, pb long, depth long, words long, conv_id long"


def name_of(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts), usedforsecurity=False).digest()


ROOT = name_of(b"")


def _halves(name: bytes) -> tuple[int, int]:
    return int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)


def cut_names(start: bytes, names: bytes) -> list[bytes]:
    """Names of the prefixes of 0, 1, ... n turns after one named start; names holds 16 bytes for each turn."""
    n = len(names) // 16
    out = [start] + [b""] * n

    def cut(lo: int, size: int) -> None:
        if size == 1:
            return
        mid = lo + size // 2
        if mid <= n:
            out[mid] = name_of(out[lo], name_of(names[16 * lo : 16 * mid]))
        cut(lo, size // 2)
        if mid <= n:
            cut(mid, size // 2)

    cut(0, 1 << n.bit_length())
    return out


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order as (conv_id, part, k, name, words), and (conv_id, part, before, length): what precedes each part.

    Turns are sorted over all tasks together, so one conversation can lie in many of
    them; k counts inside a part. Ties in turn are ordered by the MD5 of role and text.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).where("conv_id is not null")
    rows = written(rows)  # the sort looks at its keys twice, but texts are read once
    keys = ["conv_id", "turn", "name", "salt"]  # equal rows are told apart too, so that any number of them can be split
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            at = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            k = np.arange(len(conv)) - np.repeat(at, np.diff(np.append(at, len(conv))))
            if last == conv[0]:
                k[: at[1] if len(at) > 1 else len(conv)] += seen
            last, seen = int(conv[-1]), int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), part)), pa.array(k), b.column("name"), b.column("words")], ["conv_id", "part", "k", "name", "words"])

    rows = written(rows.select("conv_id", "name", "words").mapInArrow(number, "conv_id long, part long, k long, name binary, words long"))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = W.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    return rows, parts.select("conv_id", "part", before.alias("before"), F.sum("n").over(whole).alias("length"))


def rebuilt(rows: DataFrame, parts: DataFrame, mixed: bool) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, name, words, length) of all rebuilt turns, and (conv_id, length) of all conversations."""
    if not mixed:
        placed = rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("k") + F.col("before")).alias("at"), "name", "words", "length")
        return placed, parts.where("before = 0").select("conv_id", "length")
    base = F.col("conv_id") % FAMILY == 0
    first = rows.where(base & (F.col("k") < HEAD)).join(parts.where(base & (F.col("before") < HEAD)), ["conv_id", "part"])
    heads = first.withColumn("at", F.col("k") + F.col("before")).where(F.col("at") < HEAD).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "name", "words"))).alias("head"))
    convs = parts.where("before = 0").select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1)).alias("h"))
    taken = F.coalesce(F.least(F.col("h"), F.size("head").cast("long")), F.lit(0).cast("long"))  # size of a null array isn't 0
    convs = convs.join(heads, "base", "left").withColumn("taken", F.when(F.col("head").isNull(), F.lit(0).cast("long")).otherwise(taken))
    convs = written(convs.select("conv_id", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"), F.when(F.col("taken") > 0, F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("head")))
    own = rows.join(parts.drop("length").join(convs.drop("head"), "conv_id"), ["conv_id", "part"]).withColumn("at", F.col("k") + F.col("before")).where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "name", "words", "length")
    other = convs.where("taken > 0").select("conv_id", F.explode("head").alias("t"), "length").select("conv_id", "t.at", "t.name", "t.words", "length")
    return own.union(other), convs.select("conv_id", "length")


def _named(*cols) -> F.Column:
    return F.unhex(F.md5(F.concat(*cols)))


def block_starts(blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(conv_id, j, start): the name of the prefix before block j of conversations that fill blocks, by the same recursion over blocks.

    Digests of 1, 2, 4, ... blocks are made from below; then, from the top, the
    upper half of a range keeps its name and the lower half is named after the
    name and the digest of the upper one.
    """
    full = convs.select("conv_id", F.floor(F.col("length") / block).alias("full")).where("full > 0")
    digest = written(blocks.where(F.size("names") == block).select("conv_id", "j", _named(F.unhex(F.array_join(F.transform("names", F.hex), ""))).alias("digest")))
    levels, most = [digest], full.agg(F.max("full")).first()[0]
    while 2 << (len(levels) - 1) <= most:
        side = F.col("j") % 2
        up = levels[-1].groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(F.max(F.when(side == 0, F.col("digest"))).alias("x"), F.max(F.when(side == 1, F.col("digest"))).alias("y"))
        levels.append(written(up.where("x is not null and y is not null").select("conv_id", "j", _named("x", "y").alias("digest"))))
    at = full.select("conv_id", F.lit(0).cast("long").alias("j"), F.lit(bytearray(ROOT)).alias("start"), "full")
    for k, digest in reversed(list(enumerate(levels))):
        upper = at.withColumn("j", F.col("j") * 2)
        lower = upper.where((F.col("j") + 1) * (1 << k) <= F.col("full")).join(digest, ["conv_id", "j"])
        at = written(upper.union(lower.select("conv_id", F.col("j") + 1, _named("start", "digest"), "full")))
    return at.select("conv_id", "j", "start")


def paths(blocks: DataFrame) -> DataFrame:
    """(conv_id, j, length, a, b, words): names of the prefixes that end with each turn of a block, the one before them first."""

    def work(batches):
        for b in batches:
            a, c = [], []
            for k in range(b.num_rows):
                start, end = b.column("start")[k].as_py() or ROOT, b.column("end")[k].as_py()
                found = cut_names(start, b"".join(b.column("names")[k].as_py()))
                found[-1] = end or found[-1]
                x = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
                a.append(x[::2]), c.append(x[1::2])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("j"), b.column("length"), pa.array(a, longs), pa.array(c, longs), b.column("words")], ["conv_id", "j", "length", "a", "b", "words"])

    return blocks.select("conv_id", "j", "length", "start", "end", "names", "words").mapInArrow(work, "conv_id long, j long, length long, a array<long>, b array<long>, words array<long>")


def end_lists(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the ascending conv_ids of each node, which pass in order, a piece at a time."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        for batch in batches:
            a, b, conv = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
            at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            at = np.unique(np.concatenate([at, np.arange(0, len(a), PIECE)]))
            text = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(at, np.append(at[1:], len(a)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array(text, pa.string())], ["a", "b", "first", "text"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if key == (a, b):
                    sha.update(f",{text}".encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], ["a", "b", "ends_sha256"])

    out = ends.repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(pieces, "a long, b long, first long, text string")
    return out.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def graft(nodes: DataFrame, way: DataFrame, block: int) -> DataFrame:
    """Subtree totals (leaves, saved) of all nodes, by joining halves from the smallest up.

    Totals start with the node itself. For heights 1, 2, 4, ...: the totals of the
    roots of lower tries are summed for each cut prefix, and added to all nodes
    on the way from it to the top of its upper trie; the way is that of
    the smallest conversation that goes through the cut prefix.
    """
    deepest, half = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while half < deepest:
        place = F.col("depth") - 1
        lower = nodes.where(F.pmod(place, F.lit(2 * half)) == half)
        total = lower.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        cut = total.join(nodes.select("a", "b", "conv_id", "depth"), ["a", "b"]).select("conv_id", (F.col("depth") - half).alias("lo"), F.col("depth").alias("hi"), "more_leaves", "more_saved")
        cut = cut.withColumn("j", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
        at, upto = (F.least(F.greatest(F.col(c) - F.col("j") * block, F.lit(0)), F.lit(block)).cast("int") for c in ("lo", "hi"))
        above = cut.join(way, ["conv_id", "j"]).select(F.explode(F.slice(F.arrays_zip("a", "b"), at + 2, upto - at)).alias("node"), "more_leaves", "more_saved")
        more = above.groupBy("node.a", "node.b").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        nodes = nodes.join(more, ["a", "b"], "left")
        for c in ("leaves", "saved"):
            nodes = nodes.withColumn(c, F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).drop(f"more_{c}")
        nodes, half = written(nodes), 2 * half
    return nodes


def prefix_trie(turns: DataFrame, mixed: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role and text), from the
    textless root; conv_id is the smallest conversation that starts with it and,
    with depth, its key. saved_tokens counts the words that need no second
    reading in the subtree. Null role or text is empty, a null turn comes first,
    rows without conv_id are no conversation, repeated rows are turns of their
    own; other columns are left aside, and an empty table has no node. With
    mixed, conversations are rebuilt first: up to three first turns come from the
    conversation at the start of each twenty.
    """
    spark = turns.sparkSession
    all_, convs = rebuilt(*numbered(turns), mixed)
    blocks = all_.groupBy("conv_id", F.floor(F.col("at") / block).alias("j")).agg(F.array_sort(F.collect_list(F.struct("at", "name", "words"))).alias("t"), F.max("length").alias("length"))
    blocks = blocks.select("conv_id", "j", "length", F.col("t.name").alias("names"), F.col("t.words").alias("words"))
    count = convs.agg(F.count("*"), F.min("conv_id"), F.max("length")).first()
    if (count[2] or 0) >= block:
        blocks = written(blocks)
        start = block_starts(blocks, convs, block)
        after = start.select("conv_id", (F.col("j") - 1).alias("j"), F.col("start").alias("end"))
        blocks = blocks.join(start, ["conv_id", "j"], "left").join(after, ["conv_id", "j"], "left")
    else:
        blocks = blocks.withColumn("start", F.lit(None).cast("binary")).withColumn("end", F.lit(None).cast("binary"))
    way = written(paths(blocks))

    def nodes_of(batches):
        for b in batches:
            conv, j, size = b.column("conv_id").to_numpy(), b.column("j").to_numpy(), np.diff(b.column("words").offsets.to_numpy())
            first = b.column("a").offsets.to_numpy()[:-1] - b.column("a").offsets[0].as_py()
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            up = np.repeat(first, size) + k
            a, c = (b.column(x).flatten().to_numpy() for x in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a[up + 1], c[up + 1], a[up], c[up], np.repeat(j, size) * block + k + 1)), b.column("words").flatten(), pa.array(np.repeat(conv, size))], [x.split()[0] for x in NODE.split(", ")])

    same = [F.min(c).alias(c) for c in ("pa", "pb", "depth", "words", "conv_id")]
    nodes = written(way.mapInArrow(nodes_of, NODE).groupBy("a", "b").agg(F.count("*").alias("n_convs"), *same))
    kids = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = graft(written(nodes), way, block)
    root, top = _halves(ROOT), nodes.where("depth = 1").agg(F.count("*"), F.sum("leaves"), F.sum("saved")).first()
    own = spark.createDataFrame([(*root, count[1], 0, None, count[0], top[0], top[1] or 1, top[2] or 0)] if count[0] else [], "a long, b long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, leaves long, saved long")
    limit = max(HOT_CHILDREN, int(nodes.count() * HOT_SHARE))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > limit).drop("n_children"))
    below = nodes.where("depth > 1")
    found = below.join(hot, ["pa", "pb"]).unionByName(below.join(hot, ["pa", "pb"], "left_anti").join(parents.where(F.col("n_children") <= limit).drop("n_children"), ["pa", "pb"]))
    found = found.unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(count[1]).cast("long"))).select(own.columns).union(own)
    j = F.floor((F.col("length") - 1) / block)
    last = (F.col("length") - F.col("j") * block + 1).cast("int")
    ends = way.where(F.col("j") == j).select(F.element_at("a", last).alias("a"), F.element_at("b", last).alias("b"), "conv_id")
    ends = ends.union(convs.where("length = 0").select(F.lit(root[0]).alias("a"), F.lit(root[1]).alias("b"), "conv_id"))
    out = found.join(end_lists(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
