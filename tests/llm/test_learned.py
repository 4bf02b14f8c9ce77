"""Subjects and reading levels by held-out accuracy, and their edges."""

import random

from millrace.llm.reading import fit_cuts, grade_counts, reading_levels, sentences, syllables, vote
from millrace.llm.subjects import Classifier, document_subjects, units

STOCK = {
    "sport": "goal match team coach striker league".split(), "law": "court judge contract verdict appeal statute".split(), "cooking": "oven recipe sauce flour pan soup".split(),
    "science": "lens molecule orbit enzyme sample reaction".split(), "software": "server compiler branch bug query cache".split(),
}
FILLER = ["It was a fine day.", "He said yes.", "The sun was up.", "There is more to say."]


def document(rng, subjects, sentences=8):
    out = []
    for i in range(sentences):
        s = subjects[i % len(subjects)] if subjects else None
        out.append(f"The {rng.choice(STOCK[s])} near the {rng.choice(STOCK[s])} was better than the old {rng.choice(STOCK[s])}." if s and rng.random() < 0.85 else rng.choice(FILLER))
    return " ".join(out)


def made(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        subjects = rng.sample(sorted(STOCK), rng.choice([0, 1, 1, 1, 2]))
        out.append((i, document(rng, subjects), set(subjects)))
    return out


def test_subjects_on_held_out_documents(spark):
    rows = made(1, 700)
    rng = random.Random(5)
    labels = [(i, s if rng.random() > 0.05 else "law", "a") for i, _, found in rows[:400] for s in found]
    edges = [(9001, None, "prose", "en"), (9002, "", "prose", "en"), (9003, "  \n", None, None), (9004, "He said yes. The sun was up.", "prose", "en"), (9005, "x = 1\ndef f(a):\n    return a", "code", "python")]
    data = [(i, t, "prose", "en") for i, t, _ in rows] + edges
    df = spark.createDataFrame([(*r, "web" if r[0] % 3 else None, "clash") for r in data + data[:10]] + [(None, "goal", "prose", "en", "web", "c")], "doc_id bigint, text string, domain string, lang string, source string, subject string")
    lab = spark.createDataFrame(labels + [(None, "law", "a"), (1, None, "a")], "doc_id bigint, subject string, annotator string")
    names = spark.createDataFrame([(i, s) for i, s in enumerate(sorted(STOCK))], "subject_id int, subject string")
    got = {}
    for r in document_subjects(df, lab, names).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert all(len(v) == len(set(v)) for v in got.values())
    right = sum(set(got.get(i, [])) == found for i, _, found in rows[400:])
    assert right >= 0.9 * len(rows[400:])
    assert not {9001, 9002, 9003, 9004} & set(got) and got[9005] == ["software"]
    assert document_subjects(df.limit(0), lab, names).count() == 0
    assert {r.doc_id for r in document_subjects(df, lab.limit(0), names).collect()} == {9005}


def test_units():
    assert units('A b. "C d!" said E.\nf', False)[0] == ["a", "b"] and units("Let $x$ be.", False)[0][0] == "$"
    assert units("int fooBar_baz = 1;\n\n{", True) == [["int", "foo", "bar", "baz"]]
    assert Classifier.is_code("x", "code", None) and not Classifier.is_code("x", "prose", "python") and Classifier.is_code("x", None, " Python")


EASY = ["The cat sat on the mat.", "He ran to the red bus.", "Look at the big dog."]
MIDDLE = ["The council decided on Monday that the bridge near the station will be closed for repairs.", "Several visitors asked about the delayed opening of the new museum in the city centre."]
HARD = ["The institutionalisation of methodological heterogeneity presupposes an epistemologically ambiguous reconceptualisation, which contemporary investigations have consistently underestimated in the majority of documented treatments."]


def graded(rng, level, n=12):
    stock = (EASY, MIDDLE, HARD)[level - 1]
    return " ".join(rng.choice(stock if rng.random() < 0.8 else MIDDLE) for _ in range(n if level > 1 else 3 * n))


def test_levels_on_held_out_documents(spark):
    rng = random.Random(2)
    rows = [(i, graded(rng, i % 3 + 1), "en") for i in range(300)]
    edges = [(900, None, "en"), (901, "", "en"), (902, "x" * 399, "en"), (903, graded(rng, 1), "fr"), (904, graded(rng, 1), None), (905, "Let $x_1$ be.\n" * 40, " EN-xa "), (906, "q" * 500, "en"), (907, graded(rng, 2, 3000), "en")]
    df = spark.createDataFrame([(*r, 7) for r in rows + edges + rows[:5]], "doc_id bigint, text string, lang string, level int")
    labels = [(i, i % 3 + 1 if rng.random() > 0.06 else 2) for i in range(0, 150)]
    lab = spark.createDataFrame(labels + [(None, 1), (2, None), (3, 9)], "doc_id bigint, level int")
    got = {r.doc_id: r.level for r in reading_levels(df, lab).collect()}
    assert sum(got[i] == i % 3 + 1 for i in range(150, 300)) >= 145
    assert not {900, 901, 902, 903, 904} & set(got) and got[905] == 3 and 906 in got and got[907] == 2
    assert len({r.level for r in reading_levels(df, lab.limit(0)).collect()}) == 3
    assert reading_levels(df.limit(0), lab).count() == 0


def test_rules():
    assert [syllables(w) for w in ("cat", "table", "idea", "nation", "walked", "wanted", "institution", "the")] == [1, 2, 3, 2, 1, 2, 4, 1]
    said = "so much was said of it that nobody could tell any more who had begun with the whole story"
    assert sentences(f'> quoted line\nReal text here. "{said}" Next one! <b class="{"x" * 300}">Bold.</b>') == ["Real text here.", "Next one!", "Bold.\n"]
    assert sentences('"Yes," he said.') == ['"Yes," he said.']
    counts = grade_counts(["", "The cat sat. The dog ran.", "word " * 500])
    assert counts.sum(axis=1).tolist()[:2] == [0, 2] and vote(counts, 12, 40)[0] == 2
    assert fit_cuts(counts, counts.sum(axis=1) * 0 + 1) == (10, 38)
