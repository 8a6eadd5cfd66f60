"""Names of persons in texts: by what introduces them, and by a model of contexts that those mentions teach.

Titles, phrases that introduce a person and words after a Han name are cues.
What they mark are labels: a logistic model over the word, its ending and its
neighbours learns from the marked mentions, their cue hidden, against other
capitalised words. It finds mentions without a cue and rejects words that a cue
marks by chance ("Don Not Touch"). Its two bounds come from examples it didn't
learn from: it accepts at most one in a hundred other words, and rejects at
most one in a hundred marked mentions.

The model knows cased scripts only. Han names are a surname out of a list, and
what stands between it and the word after the name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.graph import saved

#: Mentions and other words that the model learns from at most (those of least hash), and the least number it needs of each.
EXAMPLES, ENOUGH = 4_000, 50
#: Places of the hashed features, and steps of the fit.
PLACES, STEPS = 1 << 16, 200
#: Where the word itself stands among the features.
WORD = 1
#: Titles and introducing phrases, by the gender of who follows (x: either).
TITLES = {
    "m": "Mr Mister Herr Herrn Señor Sr Don Monsieur Signor Signore Senhor Pan господин г-н сэр κύριος κ السيد श्री",
    "f": "Mrs Ms Miss Frau Fräulein Señora Señorita Sra Srta Doña Madame Mme Mademoiselle Mlle Signora Signorina Senhora Pani госпожа г-жа κυρία السيدة श्रीमती",
    "x": "Dr Prof Professor Doctor Doktor Docteur Profesor доктор профессор",
}
INTRODUCED = "my name is|I am called|signed by|name:|Name:|mein Name ist|ich heiße|je m'appelle|mon nom est|me llamo|mi nombre es|mi chiamo|меня зовут|Имя:"
AFTER = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f"}
#: Words inside surnames that are not capitalised.
PARTICLES = "van von de der den del della di da dos du la le bin ibn al"
#: Frequent Han surnames of one and of two signs, and signs that stand before the words in AFTER without being names.
SURNAMES = "王李张張刘劉陈陳杨楊黄黃赵趙周吴吳徐孙孫朱马馬胡郭林何高罗羅郑鄭梁谢謝宋唐许許邓鄧冯馮韩韓曹曾彭萧蕭蔡潘田董袁于余叶葉蒋蔣杜苏蘇魏程吕呂丁沈任姚卢盧傅钟鐘姜崔谭譚廖范汪陆陸金石戴贾賈韦韋夏邱方侯邹鄒熊孟秦白江阎閻薛尹段雷黎史龙龍陶贺賀顾顧毛郝龚龔邵万萬钱錢严嚴武莫孔汤湯"
COMPOUND = "欧阳 歐陽 司马 司馬 诸葛 諸葛 上官 夏侯 东方 皇甫 尉迟 公孙 慕容 令狐"
NOT_NAMES = "位老个名些等的们大小各诸女男"

_TITLE_OF = {t: g for g, of in TITLES.items() for t in of.split()}
_ANY_TITLE = "|".join(sorted(_TITLE_OF, key=len, reverse=True))
_PARTICLE = "|".join(PARTICLES.split())
_CASED = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}[\p{Ll}\p{M}]+)*"
_ONE = _CASED + r"|[\p{Arabic}\p{Devanagari}]{2,}"
_NAME = regex.compile(rf"(?<!\w)(?:({_ANY_TITLE})\.? |({INTRODUCED}) )(?:(?:{_ANY_TITLE})\.? )*(?P<surname>(?:(?:{_PARTICLE}) )*(?:{_ONE}))(?P<more> (?:(?:{_PARTICLE}) )*(?:{_ONE}))?(?!\w)")
_CUES = sorted({*_TITLE_OF, *INTRODUCED.split("|")}, key=len, reverse=True)
_CUE = re.compile(rf"(?<!\w)(?=[{''.join(sorted({c[0] for c in _CUES}))}])(?:{'|'.join(_CUES)})\.? ")
_CAPITAL = regex.compile(rf"(?<![\w'’-]){_CASED}(?![\w'’-])")
_BEFORE = regex.compile(r"(?:([\w'’-]+)([^\w]+))?([\w'’-]+)([^\w]*)$")
_NEXT = re.compile(r"([^\w]*)([\w'’-]+)")
_HAN = re.compile(r"([一-鿿]{1,4})(" + "|".join(AFTER) + ")")
_ENDS = re.compile(r"[.!?:;\n|]")


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features; scores from `accept` on are names without a cue, below `reject` no names with one."""

    weights: list[float]
    accept: float
    reject: float

    def score(self, features: list[int]) -> float:
        w = self.weights
        return sum([w[k] for k in features])


def features(text: str, a: int, b: int, seen_to: int | None = None) -> list[int]:
    """Hashed features of the word text[a:b]; what lies between seen_to and a (its cue) is hidden."""
    word, seen_to = text[a:b], a if seen_to is None else seen_to
    before = _BEFORE.search(text[max(0, seen_to - 60) : seen_to])
    after = _NEXT.match(text[b : b + 60])
    p1, p2 = (before[3], before[1] or "") if before else ("", "")
    gap = before[4] if before else ""
    start = not before or bool(_ENDS.search(gap))
    n1, joined = (after[2], after[1] == " ") if after else ("", False)
    if start:
        p1 = p2 = "^"
    elif before[2] and _ENDS.search(before[2]):
        p2 = "^"
    mark = text[b : b + 1]
    of = (
        "bias",
        "w" + word,
        "s" + word[-3:].lower(),
        "e" + word[-2:].lower(),
        "b" + p1.lower(),
        "c" + p2.lower() + " " + p1.lower(),
        "n" + (n1.lower() if joined else mark),
        f"k{start}{p1[:1].isupper()}{joined and n1[:1].isupper()}",
        f"m{mark}{start}",
    )
    return [zlib.crc32(f.encode()) % PLACES for f in of]


def _han(text: str) -> list[tuple[int, int, str]]:
    """Surnames and given names before a word such as 先生, and the same full names elsewhere in the text."""
    found, full = [], {}
    for m in _HAN.finditer(text):
        run, end = m[1], m.end(1)
        for size in range(len(run), 0, -1):
            name = run[-size:]
            surname = 2 if name[:2] in COMPOUND.split() else 1 if size < 4 and name[0] in SURNAMES else 0
            if surname:
                break
        else:
            size, surname = 1, int(run[-1] not in NOT_NAMES)
        if not surname:
            continue
        found.append((end - size, end - size + surname, "surname"))
        if size > surname:
            found.append((end - size + surname, end, f"given_{AFTER[m[2]]}"))
            full[run[-size:]] = (surname, AFTER[m[2]])
    done = {x for x, _, _ in found}
    for m in re.finditer("|".join(map(re.escape, sorted(full, key=len, reverse=True))), text) if full else ():
        if m.start() not in done:
            surname, gender = full[m.group()]
            found += [(m.start(), m.start() + surname, "surname"), (m.start() + surname, m.end(), f"given_{gender}")]
    return found


def _marked(text: str, model: Model | None) -> tuple[list[tuple[int, int, str, int]], set[int]]:
    """Mentions after a cue (start, end, kind and where the cue starts) and the starts of those that the model rejects."""
    found, rejected = [], set()
    if not _CUE.search(text):
        return found, rejected
    for m in _NAME.finditer(text):
        gender = _TITLE_OF.get(m[1] or "", "x")
        parts = [(m.start("surname"), m.end("surname"))] + ([(m.start("more") + 1, m.end("more"))] if m["more"] else [])
        # words such as "van der" stay and the name after them is the entity
        parts = [(y - len(text[x:y].rpartition(" ")[2]), y) for x, y in parts]
        if model and text[parts[0][0]].isupper() and model.score(features(text, *parts[0], m.start())) < model.reject:
            rejected.update(x for x, _ in parts)
            continue
        kinds = [f"given_{gender}", "surname"] if m["more"] else ["surname" if m[1] else f"given_{gender}"]
        found += [(x, y, k, m.start() if n == 0 else x) for n, ((x, y), k) in enumerate(zip(parts, kinds, strict=True))]
    return found, rejected


def _unmarked(text: str, model: Model, done: set[int], rejected: set[int]) -> list[tuple[int, int, str]]:
    """Capitalised words that the model accepts, and words next to those, or equal to them, that it finds likelier than not."""
    words = [(m.start(), m.end()) for m in _CAPITAL.finditer(text) if m.start() not in rejected]
    scores = [model.score(features(text, a, b)) if a not in done else model.accept for a, b in words]
    sure = [s >= model.accept for s in scores]
    known = {text[a:b] for (a, b), s in zip(words, sure, strict=True) if s and a not in done}

    def by(k: int, n: int) -> bool:
        return 0 <= n < len(words) and sure[n] and text[min(words[k][1], words[n][1]) : max(words[k][0], words[n][0])] == " "

    return [(a, b, "given_x") for k, (a, b) in enumerate(words) if a not in done and (sure[k] or scores[k] >= 0 and (text[a:b] in known or by(k, k - 1) or by(k, k + 1)))]


def names(text: str, model: Model | None = None) -> list[tuple[int, int, str]]:
    """Given names and surnames (start, end, kind): after a cue, where the same document repeats them, and what the model finds."""
    given, family = {}, set()
    marked, rejected = _marked(text, model)
    found = [m[:3] for m in marked]
    if "先" in text or "女" in text or "小" in text or "太" in text:
        han = _han(text)
    else:
        han = []
    for x, y, kind in found:
        if kind == "surname":
            family.add(text[x:y])
        elif given.get(text[x:y], "given_x") == "given_x":
            given[text[x:y]] = kind
    # one kind for one name in a document: a name known as given stays so after a title, and has one gender
    found = [(x, y, given.get(text[x:y], "surname") if kind != "surname" or text[x:y] in given else kind) for x, y, kind in found]
    done = {x for x, _, _ in found}
    cased = sorted((n for n in {*given, *family} if n[0].isupper()), key=len, reverse=True)
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, cased)) + r")(?!\w)", text) if cased else ():
        if m.start() not in done:
            found.append((m.start(), m.end(), given.get(m.group(), "surname")))
    if model:
        found += _unmarked(text, model, {x for x, _, _ in found}, rejected)
    return found + han


def examples(text: str) -> list[tuple[int, int, list[int]]]:
    """(place, label, features) of the mentions that cues mark and their repetitions (1), and of one other word (0)."""
    marked = [m for m in _marked(text, None)[0] if text[m[0]].isupper()]
    known, out = {text[m[0] : m[1]] for m in marked}, []
    started = {m[0]: m[3] for m in marked}
    if known:
        for m in _CAPITAL.finditer(text):
            if m.group() in known:
                out.append((1, m.start(), m.end(), started.get(m.start())))
    if text:
        m = _CAPITAL.search(text, zlib.crc32(text.encode("utf-8", "replace")) % len(text))
        if m and m.group() not in known:
            out.append((0, m.start(), m.end(), None))
    return [(xxhash.xxh64_intdigest(text[max(0, a - 60) : b + 60].encode("utf-8", "replace"), label) >> 1, label, features(text, a, b, seen_to)) for label, a, b, seen_to in out]


def fitted(rows: list[tuple[int, int, list[int]]]) -> Model | None:
    """The model of (place, label, features); none from too few examples of either label, or of too few places it didn't learn from.

    Marked words that are more often other words are left out: a cue stood before them by chance.
    """
    often: Counter = Counter()
    for _, label, of in rows:
        often[of[WORD]] += 1 if label else -1
    rows = [r for r in rows if not r[1] or often[r[2][WORD]] >= 0]
    place, y = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)
    learn = place % 5 != 0
    if min((y == 1).sum(), (y == 0).sum()) < ENOUGH or not all((~learn & (y == v)).any() for v in (0, 1)):
        return None
    x = np.array([r[2] for r in rows], dtype=np.int64)
    part = np.where(y == 1, 0.5 / (y[learn] == 1).sum(), 0.5 / (y[learn] == 0).sum())[learn]
    w, size = np.zeros(PLACES), np.full(PLACES, 1e-8)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-w[x[learn]].sum(1)))
        slope = np.bincount(x[learn].ravel(), np.repeat((p - y[learn]) * part, x.shape[1]), PLACES) + 1e-5 * w
        size += slope * slope
        w -= 0.3 * slope / np.sqrt(size)
    score = w[x].sum(1)
    accept = max(np.quantile(score[~learn & (y == 0)], 0.99), 1.0)
    reject = min(np.quantile(score[~learn & (y == 1)], 0.01), -1.0)
    return Model(w.tolist(), float(np.nextafter(accept, np.inf)), float(reject))


def learned(docs: DataFrame) -> Model | None:
    """The model that the marked mentions of all texts teach: those of least hash, EXAMPLES of each label; None if there are too few."""

    def least(batches):
        kept: tuple[dict, dict] = {}, {}

        def cut():
            for k in kept:
                for place in sorted(k)[EXAMPLES:]:
                    del k[place]

        for b in batches:
            for v in b.column(0):
                for place, label, of in examples(v.as_py() or ""):
                    kept[label][place] = of
                if max(map(len, kept)) > 2 * EXAMPLES:
                    cut()
        cut()
        rows = [(place, label, of) for label, k in enumerate(kept) for place, of in k.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["place", "label", "features"])

    found = saved(docs.select(F.col("text").cast("string")).mapInArrow(least, "place long, label int, features array<int>").distinct())
    if found.where("label = 1").limit(ENOUGH).count() < ENOUGH:
        return None
    rows = [tuple(r) for label in (0, 1) for r in found.where(F.col("label") == label).orderBy("place", "features").limit(EXAMPLES).collect()]
    return fitted(rows)
