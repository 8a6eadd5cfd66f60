"""Every query against plain Python, DuckDB or held-out labels, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from spikeloom.llm import pii
from spikeloom.llm import queries as Q

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def run(spark, name, sf=SF):
    return Q.queries()[name](spark, sf).collect()


def least(pairs, nodes):
    """Smallest node reachable from each."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [] if n in out else [n]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = n
                todo += near[x]
    return out


def shingle_components(docs, size, percent):
    sets = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER), re.ASCII)
        sets[r.doc_id] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    held, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            shared.update((e, d) for e in held[x])
            held[x].append(d)
    links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return least(links, sets), sets, Counter(d for p in links for d in p)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for p in Path(SF).iterdir():
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_jaccard(spark):
    comp, sets, links = shingle_components(table(spark, "documents"), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in run(spark, "op1_ngram_jaccard_join")} == {d: (len(sets[d]), comp[d], links[d]) for d in sets}


def test_bpe_is_the_library_and_comes_back(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op3_byte_bpe")}
    for r in table(spark, "documents"):
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_shards_are_near_equal(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, "documents", LARGER)}
    rows = run(spark, "op4_sharding", LARGER)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total, slots, home, groups = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "bytes")
        total[r.shard] += r["size"]
        groups[docs[r.doc_id]] += r["size"]
        slots[r.shard].append(r.slot)
        home[docs[r.doc_id]].add(r.shard)
    assert set(total) == set(range(16)) and all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= max(groups.values())


def test_surrogates_are_distinct_and_corefer(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents", LARGER)}
    given, taken, real = {}, {}, set()
    rows = pii.replace_pii(spark.read.parquet(f"{LARGER}/documents.parquet")).collect()
    assert len(rows) == len(docs) and sum(r.n_entities for r in rows) > 100
    for r in rows:
        out, at = [], 0
        assert [(e.start, e.end, e.kind) for e in r.entities] == list(pii.detect(docs[r.doc_id] or ""))
        for e in r.entities:
            entity = (e.kind, docs[r.doc_id][e.start : e.end])
            real.add(entity[1])
            assert given.setdefault(entity, e.surrogate) == e.surrogate
            assert taken.setdefault(e.surrogate, entity) == entity
            out += [docs[r.doc_id][at : e.start], e.surrogate]
            at = e.end
        assert r.new_text == ("".join(out) + docs[r.doc_id][at:] if r.entities else docs[r.doc_id])
    assert not real & set(taken)


def test_embeddings(spark):
    rows = table(spark, "embeddings")
    pairs = []
    for label in {r.label for r in rows} - {None}:
        use = [r for r in rows if r.label == label and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
        x = np.array([r.embedding for r in use], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        pairs += [(use[i].vec_id, use[j].vec_id) for i, j in zip(a, b, strict=True)]
    links, comp = Counter(k for p in pairs for k in p), least(pairs, [r.vec_id for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op6_embedding_near_dedup")}
    want = {k: (links[k], comp[k], comp[k] == k) for k in comp}
    assert got == want


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents", LARGER)}
    rows = [r for r in run(spark, "op2_language_id", LARGER) if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.97


@pytest.mark.parametrize(("name", "column", "parts", "rest", "enough"), [("op7_quality", "quality", 3, 1, 0.85), ("op10_toxicity", "toxic", 5, 0, 0.93)])
def test_scores_on_held_out_rows(spark, name, column, parts, rest, enough):
    truth = {r.doc_id: r[column] for r in table(spark, "labels", LARGER) if r[column] is not None}
    rows = run(spark, name, LARGER)
    assert len(rows) == len(table(spark, "documents", LARGER))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= enough


def test_pipeline(spark):
    docs = table(spark, "documents")
    docs = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    comp, _, _ = shingle_components(docs, 5, 80)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 10]) for r in table(spark, "benchmark") if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    want = {}
    for r in docs:
        w = words(r.text)
        if comp[r.doc_id] == r.doc_id and not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            want[r.doc_id] = r.text
    got = {r.doc_id: r for r in run(spark, "pipeline")}
    assert set(got) == set(want)
    for d, text in want.items():
        if not pii.detect(text):
            assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        else:
            assert got[d].decoded_sha256 != hashlib.sha256(text.encode()).hexdigest()
