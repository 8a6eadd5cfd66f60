"""Names: one surrogate whatever the cue, Han surnames, and a model of contexts learned from the marked mentions."""

import random

import pytest

from spikeloom.llm import names, pii

VERBS = "said smiled laughed answered nodded waved slept wrote agreed left".split()
PLACES = "Paris Berlin Madrid Lisbon Vienna Prague Dublin Oslo Bern Riga".split()


def made_names(rng, n):
    out = set()
    while len(out) < n:
        out.add("".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.choice((2, 3)))).capitalize() + rng.choice(("", "n", "r", "s")))
    return sorted(out)


def corpus():
    """Texts with marked names, places and sentence starts that are no names, and marked common words here and there."""
    rng = random.Random(5)
    people = made_names(rng, 300)
    texts = []
    for k, name in enumerate(people):
        first = rng.choice(people)
        of = [f"The train from {rng.choice(PLACES)} was late.", f"Then {rng.choice(('Mr', 'Mrs', 'Dr'))} {first} {name} {rng.choice(VERBS)}.", f"Not many came to {rng.choice(PLACES)} again.", f"Later {name} {rng.choice(VERBS)} and went home."]
        if k % 20 == 0:
            of.append("We saw Mr The Company in the rules.")
        rng.shuffle(of)
        texts.append(" ".join(of))
    return texts + [f"The road to {rng.choice(PLACES)} is long. Not today. The end of {rng.choice(PLACES)} is near." for _ in range(300)]


@pytest.fixture(scope="module")
def model():
    rows = {(p, l): f for t in corpus() for p, l, f in names.examples(t)}
    return names.fitted([(p, l, f) for (p, l), f in rows.items()])


@pytest.mark.parametrize(("text", "want"), [
    ("今天王先生来了", ["王"]),
    ("王先生", ["王"]),
    ("昨天王小明先生来了，王小明走了", ["王", "小明", "王", "小明"]),
    ("看见欧阳修先生", ["欧阳", "修"]),
    ("各位先生，那位小姐", []),
    ("先生", []),
])
def test_han_surnames_end_where_the_name_does(text, want):
    assert [text[a:b] for a, b, _ in pii.detect(text)] == want


def test_one_name_one_surrogate_whatever_its_cue(spark):
    texts = ["Herr Berg kam.", "mein Name ist Berg.", "Mrs Anna Lind", "my name is Anna", "今天王先生来了", "王先生", "Mr Andrea Rossi", "Mr Andrea Bianchi", "name: Andrea", "Dr Andrea"]
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = {r.doc_id: {texts[r.doc_id][e.start : e.end]: e for e in r.entities} for r in rows}
    for name in ("Berg", "Anna", "王", "Andrea"):
        assert len({o[name].surrogate for o in of.values() if name in o}) == 1
    assert {e.kind for o in of.values() for e in o.values()} == {"name"}
    # titles say that this Andrea is a man, although the name ends as names of women do
    assert of[8]["Andrea"].surrogate[-1] in pii.ENDINGS["m"]["latin"] and of[3]["Anna"].surrogate[-1] in "ae"


def test_the_model_finds_names_without_a_cue_and_spares_places(model):
    rng = random.Random(77)
    fresh = [n for n in made_names(rng, 400) if not any(n in t for t in corpus())][:200]
    hit = sum([t[a:b] for a, b, _ in names.names(t, model)] == [n] for n in fresh for t in [f"The train from {rng.choice(PLACES)} was late. Later {n} {rng.choice(VERBS)} and went home."])
    assert hit / len(fresh) >= 0.95
    wrong = sum(bool(names.names(f"Not today. The road to {p} is long. The end of {q} is near.", model)) for p in PLACES for q in PLACES)
    assert wrong <= 2


def test_the_model_rejects_common_words_after_a_title(model):
    text = "We saw Mr The Company in the rules. Then Mr Tester smiled."
    assert [text[a:b] for a, b, _ in names.names(text, None)] == ["The", "Company", "Tester"]
    assert [text[a:b] for a, b, _ in names.names(text, model)] == ["Tester"]  # neither after its title nor as a word without one


def test_no_model_from_few_examples_and_the_same_one_from_any_order(spark):
    assert names.learned(spark.createDataFrame([(t,) for t in corpus()[:20]], "text string")) is None
    assert names.learned(spark.createDataFrame([(None,), ("",)], "text string")) is None
    texts = corpus()
    one = names.learned(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    # copies of one text, a third of all rows, teach nothing more
    other = names.learned(spark.createDataFrame([(t,) for t in texts[::-1] + texts[:1] * 300], "text string").repartition(5))
    assert one == other and one.reject < one.accept


def test_names_without_a_cue_get_their_surrogates_in_all_documents(spark):
    texts = [*corpus(), "Later Tamino smiled and went home.", "Then Mr Tamino slept.", None, ""]
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = {r.doc_id: r for r in rows}
    a, b = of[len(texts) - 4], of[len(texts) - 3]
    assert "Tamino" not in a.new_text + b.new_text and a.entities[0].surrogate == b.entities[0].surrogate
    assert of[len(texts) - 2].new_text is None and of[len(texts) - 1].n_entities == 0
