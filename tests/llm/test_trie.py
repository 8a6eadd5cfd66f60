"""Prefix tries of conversations against plain Python, cut inside blocks and between them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spikeloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows, mixed):
    """Every node with its whole member list, from the definition."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            t = (role or "", text or "")
            key = f"{len(t[0].encode())}:{t[0]}{t[1]}".encode()
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(key).hexdigest(), t))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:] if mixed else own[c]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, below = Counter(n[:-1] for n in members if n), defaultdict(list)
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1], re.ASCII)) if n else 0 for n in members}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], sum(not kids[x] for x in below[n]), sum((len(members[x]) - 1) * words[x] for x in below[n]), hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items()
    )


def made(spark, rows, **how):
    return sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=lambda r: (r[0], r[1]))


def test_mixed_conversations(spark):
    rows = []
    for c in (*range(0, 70), 100, 119, 121, 199, 201):
        for t in range((c * 7) % 6 + (c == 40) * 9):
            rows.append((c, None if c == 3 and t == 1 else t, None if c == 5 else "user" if t % 2 == 0 else "bot", None if c == 20 and t == 1 else f"hi {' '.join('x' * (t % 3))} {c % 3 if t > 1 else ''}", 9, "z"))
    rows += [(40, 2, "user", "tie"), (40, 2, "user", "tie"), (40, 2, "bot", "tie\x0btwo"), (None, 0, "user", "nobody"), (13, 0, "", "alone")]
    rows = [(*r, 1, "q")[:6] for r in rows]
    want = brute(rows, True)
    assert any(r[1] == 0 and r[7] != EMPTY for r in want)  # some are turnless
    assert made(spark, rows, mixed=True) == want == made(spark, rows, mixed=True, block=2)
    assert made(spark, rows) == brute(rows, False)


def test_long_conversations_are_cut_between_blocks(spark):
    rows = [(c, t, "user", f"w{t if t < stop else -c} w", 0, "") for c, stop, n in ((1, 99, 37), (2, 20, 37), (3, 16, 16), (4, 99, 36), (5, 99, 37), (6, 0, 3), (7, 33, 64)) for t in range(n)]
    assert made(spark, rows, block=4) == brute(rows, False)


def test_many_children_and_long_end_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "HOT_CHILDREN", 5)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, t, "user", "same" if t == 0 or c % 3 == 0 else f"own {c % 20}", 0, "") for c in range(60) for t in range(2)]
    assert made(spark, rows) == brute(rows, False)


@pytest.mark.parametrize("mixed", [False, True])
def test_empty_and_rootless(spark, mixed):
    assert made(spark, [], mixed=mixed) == []
    assert made(spark, [(None, 1, "a", "b", 0, "")], mixed=mixed) == []


def test_cuts_name_equal_prefixes_alike():
    names = [bytes([k]) * 16 for k in (1, 2, 3, 4, 5, 6, 7)]
    whole = trie.cut_names(trie.ROOT, b"".join(names))
    assert len(set(whole)) == 8
    for n in range(7):
        assert trie.cut_names(trie.ROOT, b"".join(names[:n])) == whole[: n + 1]
