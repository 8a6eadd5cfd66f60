"""Personal data replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity's own format (which characters
are digits, which letters of which script and case stand where), so equal
entities get equal surrogates everywhere and different ones stay different
without any shared state. Names are found by what stands around them (module
names: titles and phrases that introduce a person, and a model of contexts that
such mentions teach); given names and surnames are entities of their own and of
one type, so that a full name, a title with a surname and a later bare name
agree in all documents. A surrogate of a name ends as names of its gender do,
which is the same in the whole corpus.

A check over all distinct entities of the corpus finds surrogates that equal a
real entity or each other; those get another key turn, in a longer format if
theirs can grow. Where a format is so full that no turn is free, its entities
are shifted within it, which keeps them distinct from each other and themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import names
from spikeloom.llm.graph import saved

#: Entities with another turn that are broadcast at most; more of them are joined to the documents that hold them.
EXCEPTIONS = 50_000
#: Turns of the key before entities of a full format are shifted; the last is the mark of those.
TURNS, SHIFTED = 8, 1000
#: Endings of surrogates by gender, in Latin and Cyrillic letters, and endings of names of women.
ENDINGS = {"f": {"latin": "ae", "cyrillic": "ая"}, "m": {"latin": "nrsktd", "cyrillic": "нрктвм"}}
FEMALE = "aeiаяе"

_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_PLUS = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)")
_LOCAL = re.compile(r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)")
_DIGITS = re.compile(r"[0-9](?:\d{0,2}(?:\.\d{1,3}){3}|\d{2}-\d{2}-\d{4}|\d{2}[-.]\d{3}[-.]\d{4}|\d{3}([ -])\d{4}\1\d{4}\1\d{4}|\d{12,18})")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}(?![\w:])")
_VALUE = re.compile(r"[=:] ?[\"']?([^\s\"'=:]{8,})")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?$", re.IGNORECASE)


def _apart(text: str, a: int, b: int) -> bool:
    """No letter, digit, or a point or hyphen that leads on to a digit, next to text[a:b]."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if before.isalnum() or after.isalnum() or before in ("_", ".", "-") and a > 1 and text[a - 2].isdigit():
        return False
    return not (after in (".", "-") and text[b + 1 : b + 2].isdigit())


def detect(text: str, model: names.Model | None = None) -> list[tuple[int, int, str]]:
    """Entities (start, end, type) in order, none overlapping; earlier types of the list below win."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        # the local part is looked for backwards from each @, so a text without one costs nothing
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    for m in _VALUE.finditer(text):
        if _NAMED.search(text, max(0, m.start() - 16), m.start()):
            found.append((m.start(1), m.end(1), "secret"))
    found += [(m.start(), m.end(), "key") for m in _KEY.finditer(text)]
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if _mod97(m.group()) == 1]
    if "::" in text or text.count(":") > 6:
        found += [(m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text)]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PLUS.finditer(text)]
    if "(" in text:
        found += [(m.start(), m.end(), "phone") for m in _LOCAL.finditer(text)]
    for m in _DIGITS.finditer(text):
        s = m.group()
        if _apart(text, m.start(), m.end()):
            if s.count(".") == 3:
                if all(int(x) < 256 for x in s.split(".")):
                    found.append((m.start(), m.end(), "ip"))
            else:
                found.append((m.start(), m.end(), "ssn" if len(s) == 11 and s[3] == "-" == s[6] else "phone" if len(s) == 12 else "card"))
    found += names.names(text, model)
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


@lru_cache(4096)
def _letters(c: str) -> str:
    """Letters that may stand for c: same script block and case; ASCII vowels and consonants apart."""
    if c.isascii():
        of = "aeiou" if c.lower() in "aeiou" else "bcdfghjklmnpqrstvwxyz"
        return of.upper() if c.isupper() else of
    lo = ord(c) // 32 * 32
    return "".join(x for x in map(chr, range(lo, lo + 32)) if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower())


def _permute(key: bytes, kind: str, parts: list[str | tuple[str, ...]], values: list[str]) -> list[str]:
    """Keyed permutation of sequences over the given alphabets: eight rounds of adding to one half what the other says."""
    digits = [p.index(v) for p, v in zip(parts, values, strict=True)]
    form = repr([len(p) for p in parts]).encode() + kind.encode()
    for r in range(8):
        mine, other = range(r % 2, len(digits), 2), bytes(repr(digits[1 - r % 2 :: 2]), "ascii")
        stream, n = b"", 0
        for k in mine:
            if n + 8 > len(stream):
                stream += hashlib.blake2b(form + other, key=key, salt=(r * 4096 + len(stream) // 64).to_bytes(8, "little")).digest()
            digits[k] = (digits[k] + int.from_bytes(stream[n : n + 8], "little")) % len(parts[k])
            n += 8
    return [p[d] for p, d in zip(parts, digits, strict=True)]


_OCTETS = {n: tuple(str(k) for k in range(lo, hi)) for n, lo, hi in ((1, 0, 10), (2, 10, 100), (3, 100, 256))}


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _mod97(iban: str) -> int:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _shifted(key: bytes, kind: str, parts: list[str], values: list[str]) -> list[str]:
    """Keyed shift of a sequence, read as a number over its alphabets: another one for each, and never itself."""
    size = number = 0
    for p, v in zip(parts, values, strict=True):
        size, number = (size or 1) * len(p), number * len(p) + p.index(v)
    if size > 1:
        form = repr([len(p) for p in parts]).encode() + kind.encode()
        number = (number + 1 + int.from_bytes(hashlib.blake2b(form, key=key, digest_size=32).digest(), "little") % (size - 1)) % size
    out = []
    for p in reversed(parts):
        number, k = divmod(number, len(p))
        out.append(p[k])
    return out[::-1]


def _longer(kind: str, entity: str, by: int) -> str:
    """The entity in a format with `by` more places, if its type allows for it."""
    if kind == "ip":
        for _ in range(by):
            short = min(entity.split("."), key=len)
            entity = ".".join({1: "1" + v, 2: "1" + v, 3: v}[len(v)] if v == short else v for v in entity.split("."))
        return entity
    if kind == "email":
        at = entity.index("@")
        return entity[:at] + "a" * by + entity[at:]
    if kind.startswith("name"):
        more = entity[-1] if entity[-1].isalpha() else "a"
        return entity[:-1] + more * by + entity[-1]
    return entity


def surrogate(key: bytes, kind: str, entity: str, turn: int = 0) -> str:
    """The replacement of one entity under a key; another turn gives another one, in a longer format from the third on."""
    shift = turn == SHIFTED
    if turn > 1 and not shift:
        entity = _longer(kind, entity, turn - 1)
    _permute_ = _shifted if shift else _permute
    key = hashlib.blake2b(key + turn.to_bytes(2, "little"), digest_size=32).digest()
    if kind == "ip":
        values = entity.split(".")
        if all(str(int(v)) == v for v in values):
            return ".".join(_permute_(key, kind, [_OCTETS[len(v)] for v in values], values))
    fixed, check = set(), False
    if kind == "email":
        fixed = set(range(entity.rindex("."), len(entity)))
    elif kind == "key":
        fixed = set(range(4))
    elif kind == "phone" and entity[0] == "+":
        fixed = set(range(re.match(r"\+\d+", entity).end())) if not entity[1:].isdigit() else {0, 1}
    elif kind == "card":
        plain = re.sub(r"\D", "", entity)
        check = _luhn(plain) == 0
        fixed = {len(entity) - 1} if check else set()
    elif kind == "iban":
        fixed = {0, 1, 2, 3}
    ending = _ending(kind, entity) if not shift else ""
    if ending:
        fixed = {len(entity) - 1}
    hexa = kind == "ipv6" and entity == entity.lower() or kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity)
    at, parts = [], []
    for k, c in enumerate(entity):
        if k in fixed:
            continue
        if hexa:
            if c in "0123456789abcdef":
                at.append(k), parts.append("0123456789abcdef")
        elif c in "0123456789":
            lead = c != "0" and not entity[k - 1 : k].isdigit() and kind in ("card", "phone", "ssn")
            at.append(k), parts.append("123456789" if lead else "0123456789")
        elif c.isalpha() and c in _letters(c):
            at.append(k), parts.append(_letters(c))
    out = list(entity)
    for k, v in zip(at, _permute_(key, kind, parts, [entity[k] for k in at]), strict=True):
        out[k] = v
    if check:
        plain = re.sub(r"\D", "", "".join(out[:-1]))
        out[-1] = str((10 - _luhn(plain + "0")) % 10)
    if kind == "iban":
        out[2:4] = f"{98 - _mod97(entity[:2] + '00' + ''.join(out[4:])):02d}"
    if ending:
        out[-1] = ending[int.from_bytes(hashlib.blake2b("".join(out).encode(), key=key, digest_size=8).digest(), "little") % len(ending)]
    return "".join(out)


def _script(entity: str) -> str:
    return "latin" if "a" <= entity[-1] <= "ɏ" else "cyrillic" if "а" <= entity[-1] <= "я" else ""


def _ending(kind: str, entity: str) -> str:
    """Last letters of a surrogate: by the gender that titles give a name, else by how the name itself ends; none in other scripts."""
    if not kind.startswith("name") or not _script(entity):
        return ""
    gender = kind[-1] if kind[-2] == "_" else "f" if entity[-1] in FEMALE else "m"
    return ENDINGS[gender][_script(entity)]


def _type(kind: str) -> str:
    """Given names and surnames are one type, so that one name has one surrogate wherever it stands."""
    return "name" if kind == "surname" or kind.startswith("given_") else kind


def entities(docs: DataFrame, model: names.Model | None = None) -> DataFrame:
    """Distinct (kind, entity) of all texts.

    A name has one kind in the whole corpus: name_m or name_f where titles
    before it as a given name mostly say so against its ending, else name.
    """

    def find(batches):
        for b in batches:
            got = Counter((kind, t[x:y]) for t in map(lambda v: v.as_py() or "", b.column(0)) for x, y, kind in detect(t, model))
            rows = [(_type(kind), e, n if kind == "given_m" else -n if kind == "given_f" else 0) for (kind, e), n in got.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["kind", "entity", "male"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(find, "kind string, entity string, male long").groupBy("kind", "entity").agg(F.sum("male").alias("male"))
    last = F.substring("entity", -1, 1)
    scripted, female = last.between("a", "ɏ") | last.between("а", "я"), last.isin(*FEMALE)
    kind = F.when((F.col("kind") != "name") | ~scripted, F.col("kind")).when((F.col("male") > 0) & female, "name_m").when((F.col("male") < 0) & ~female, "name_f").otherwise("name")
    return found.select(kind.alias("kind"), "entity")


def _turned(found: DataFrame, key: bytes) -> DataFrame:
    def turn(batches):
        for b in batches:
            s = [surrogate(key, k, e, t) for k, e, t in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), b.column("turn").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), b.column("turn"), pa.array(s, pa.string())], ["kind", "entity", "turn", "surrogate"])

    return found.select("kind", "entity", "turn").mapInArrow(turn, "kind string, entity string, turn int, surrogate string")


def _taken(current: DataFrame, found: DataFrame) -> DataFrame:
    """Entities whose surrogate equals any entity of the corpus, or that of an entity before them in (kind, entity) order."""
    real = found.select(F.col("entity").alias("surrogate"), F.lit("").alias("k"), F.lit("").alias("e"))
    made = current.select("surrogate", F.concat(F.lit("1"), "kind").alias("k"), F.col("entity").alias("e"))
    owner = real.union(made).groupBy("surrogate").agg(F.min(F.struct("k", "e")).alias("o"), F.count("*").alias("n")).where("n > 1")
    return current.join(owner, "surrogate").where((F.col("o.k") != F.concat(F.lit("1"), "kind")) | (F.col("o.e") != F.col("entity"))).select("kind", "entity").distinct()


def turns(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, turn) of the entities whose turn is not 0.

    Taken surrogates get the next turn, until none is taken. What is still
    taken after TURNS, as in formats of which most values occur, is shifted
    within its format, and so is what the shifted ones displace.
    """
    keys = ["kind", "entity"]
    current = saved(_turned(found.withColumn("turn", F.lit(0)), key))
    for turn in range(1, TURNS + 1):
        taken = saved(_taken(current, found))
        if taken.isEmpty():
            return current.where("turn <> 0").select(*keys, "turn")
        current = saved(current.join(taken, keys, "left_anti").select(*keys, "turn", "surrogate").union(_turned(taken.withColumn("turn", F.lit(turn)), key)))
    moved = saved(_taken(current, found))
    shifted = saved(_turned(moved.withColumn("turn", F.lit(SHIFTED)), key))
    while not moved.isEmpty():
        current = saved(current.join(moved, keys, "left_anti").select(*keys, "turn", "surrogate"))
        moved = saved(current.join(shifted.select("surrogate").distinct(), "surrogate", "left_semi").select(*keys))
        shifted = saved(shifted.union(_turned(moved.withColumn("turn", F.lit(SHIFTED)), key)))
    return current.where("turn <> 0").select(*keys, "turn").union(shifted.select(*keys, "turn"))


def replace_pii(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """doc_id, rest, new_text, n_entities, entities (kind, start, end in the old text, surrogate) of every input row.

    rest is a struct of the other columns, whatever their names (it has one
    more, null). Texts without entities stay as they are; a null text stays
    null with no entities. Equal entities of one kind get equal surrogates in
    all documents and different ones different surrogates; a surrogate equals no
    entity of the corpus unless its format is full.
    """
    spare = "_none"
    while spare in docs.columns:
        spare += "_"
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(None).cast("int").alias(spare))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("rest"), F.col("text").cast("string").alias("text"))
    model = names.learned(docs)
    found = saved(entities(docs, model))
    turned = saved(turns(found, key))
    gendered = found.where(F.col("kind").isin("name_m", "name_f")).join(turned, ["kind", "entity"], "left_anti")
    late = turned.union(gendered.withColumn("turn", F.lit(0))).withColumnRenamed("kind", "as")
    late = saved(late.withColumn("kind", F.regexp_replace("as", "^name_[mf]$", "name")).select("kind", "entity", "as", F.col("turn").cast("int").alias("turn")))
    few = late.count() <= EXCEPTIONS
    held = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): (r["as"], r.turn) for r in late.collect()} if few else {})
    own = "array<struct<kind: string, entity: string, as: string, turn: int>>"
    if few:
        rows = docs.withColumn("own", F.lit(None).cast(own))
    else:
        rows = docs.withColumn("hash", F.xxhash64("text"))

        def mentions(batches):
            for b in batches:
                got = [(h, _type(kind), t[x:y]) for h, t in zip(b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True) if t for x, y, kind in detect(t, model)]
                got = list(dict.fromkeys(got))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2))], ["hash", "kind", "entity"])

        named = rows.select("hash", "text").mapInArrow(mentions, "hash long, kind string, entity string").join(late, ["kind", "entity"])
        per = named.groupBy("hash").agg(F.collect_set(F.struct("kind", "entity", "as", "turn")).cast(own).alias("own"))
        rows = rows.join(per, "hash", "left").drop("hash")

    def put(batches):
        known: dict = {}
        for b in batches:
            texts, spans = [], []
            for v, mine in zip(b.column("text"), b.column("own").to_pylist(), strict=True):
                text = v.as_py()
                out, at, found = [], 0, []
                turn = held.value if mine is None else {(x["kind"], x["entity"]): (x["as"], x["turn"]) for x in mine}
                for x, y, kind in detect(text or "", model):
                    kind = _type(kind)
                    as_, turned = turn.get((kind, text[x:y]), (kind, 0))
                    e = (as_, text[x:y], turned)
                    if e not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[e] = surrogate(key, *e)
                    out += [text[at:x], known[e]]
                    found.append({"kind": kind, "start": x, "end": y, "surrogate": known[e]})
                    at = y
                texts.append("".join(out) + text[at:] if found else text)
                spans.append(found)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rest"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "rest", "new_text", "n_entities", "entities"])

    return rows.mapInArrow(put, f"doc_id long, rest {docs.schema['rest'].dataType.simpleString()}, new_text string, n_entities long, entities array<struct<kind: string, start: int, end: int, surrogate: string>>")
