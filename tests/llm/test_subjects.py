import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import subjects

TERMS = {
    "sport": ["the rowing lake", "youth football", "ticket touts", "the ski jump", "match fixing", "the medal table"],
    "law": ["jury service", "the parole board", "court fees", "small claims", "legal aid", "the civil code"],
    "farming": ["dairy herds", "the wheat harvest", "crop insurance", "sheep subsidies", "abattoirs", "the milk price"],
}
FRAMES = ["Let me turn to {}, which matters.", "My constituents write about {} every week.", "The report devotes pages to {}.", "We have spent millions on {}.", "Nobody disputes {} here."]
FILL = ["That is not rocket science.", "It is a matter of trust.", "I yield the floor.", "Time will tell."]
CONDUCT = ["The sitting is suspended for 5 minutes.", "Question put, and agreed to.", "The Clerk will read the Orders of the Day.", "Clauses 4 to 9 stand part."]


def sentence(rng, subject, terms):
    return rng.choice(FRAMES).format(rng.choice(terms))


def data(seed=1, docs=700):
    rng = random.Random(seed)
    samples, corpus, truth = [], [], {}
    for subject, terms in TERMS.items():
        for _ in range(25):
            samples.append((len(samples), " ".join(sentence(rng, subject, terms[:3]) for _ in range(3)) + " " + rng.choice(FILL), "en", subject))
    for _ in range(25):
        samples.append((len(samples), " ".join(rng.sample(CONDUCT, 3)), "en", "procedure"))
    for d in range(docs):
        if d % 10 == 0:
            parts, truth[d] = rng.choices(CONDUCT, k=4), {"procedure"}
        else:
            chosen = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
            parts = [sentence(rng, s, TERMS[s]) for s in chosen for _ in range(rng.randint(3, 6))]
            parts += rng.choices(FILL, k=3) + [sentence(rng, "x", TERMS[rng.choice(sorted(set(TERMS) - set(chosen)))])]
            rng.shuffle(parts)
            parts[0] = parts[0].replace(" ", " (Interruption: jury service. jury service.) ", 1)
            truth[d] = set(chosen)
        corpus.append((d, " ".join(parts), rng.choice(["en", "EN", None]), "x", "y"))
    return samples, corpus, truth


def run(spark, samples, corpus, names=(*TERMS, "procedure")):
    c = spark.createDataFrame(corpus, "doc_id long, text string, lang string, doc string, subject string")
    s = spark.createDataFrame(samples, "sample_id long, text string, lang string, subject string")
    a = spark.createDataFrame([(n, "") for n in names], "subject string, description string")
    return [tuple(r) for r in subjects.document_subjects(c, "doc_id", "text", "lang", s, a).collect()]


def test_held_out_accuracy(spark):
    samples, corpus, truth = data()
    extra = [(9001, None, "en", "", ""), (9002, "", None, "", ""), (9003, "x. " * 100_000 + corpus[1][1], "en", "", "")]
    got = run(spark, samples, corpus + extra)
    want = {(d, s) for d, all_of in truth.items() for s in all_of}
    found = {p for p in got if p[0] < 9000}
    assert len(found & want) / len(found) > 0.95 and len(found & want) / len(want) > 0.95
    assert len(got) == len(set(got)) and not {d for d, _ in got} & {9001, 9002}
    of = {}
    for d, s in got:
        of.setdefault(d, set()).add(s)
    assert all(len(v) == 1 for v in of.values() if "procedure" in v)
    assert of[9003] >= truth[1]


def test_empty_tables(spark):
    samples, corpus, _ = data(docs=20)
    assert run(spark, samples, []) == []
    assert run(spark, [], corpus) == []


def test_sentence_features():
    of_doc, of_sentence, index = subjects.hashed_sentences(["One two three. 12 34. Four!", "", "five"])
    assert of_doc.tolist() == [0, 2, 2, 3] and of_sentence.tolist() == [0, 5, 6, 7] and len(index) == 7
    again = subjects.hashed_sentences(["one two three."])[2]
    assert again.tolist() == index[:5].tolist() and (index >= 0).all() and (index < subjects.FEATURES).all()
    assert subjects.hashed_sentences([])[2].tolist() == []


@pytest.mark.parametrize("steps", [60])
def test_logistic_separates(steps):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    index = np.stack([y * 10 + rng.integers(0, 3, 400), 50 + rng.integers(0, 9, 400)], axis=1).ravel()
    w, b = subjects.logistic(np.arange(0, 802, 2), index, y.astype(float), steps=steps)
    scores = subjects._sums(w[index], np.arange(0, 802, 2)) + b
    assert ((scores > 0) == (y == 1)).all()
    assert subjects.best_threshold(np.array([3.0, -0.125, -2.0]), np.array([1, 1, 0])) == -0.125
    assert subjects.best_threshold(np.array([3.0, -0.9, -2.0]), np.array([1, 1, 0])) == subjects.LOWEST


def test_sections_label_what_they_are_pure_in(spark):
    """Documents whose own wording the samples lack are labelled by their section; a mixed section says nothing."""
    names = ["a", "b", "procedure"]
    counted = [(i, 10, [3, 0, 0]) for i in range(8)] + [(i, 10, [0, 3, 0]) for i in range(8, 16)] + [(i, 10, [0, 0, 0]) for i in range(16, 20)]
    of = {**{i: ["s=A"] for i in (*range(8), 16)}, **{i: ["s=B", "p=x"] for i in (*range(8, 16), 17)}, 18: ["s=A", "s=B"], 19: ["s=C"]}
    c = spark.createDataFrame(counted, "doc long, n_sentences long, counts array<long>")
    keys = spark.createDataFrame([(d, k) for d, ks in of.items() for k in ks] + [(d, "s=mixed") for d in range(20)], "doc long, section string")
    got = {r.doc: r.section_label for r in subjects.section_labels(c, keys, names, subjects.Rules()).collect()}
    assert got == {**dict.fromkeys((*range(8), 16), "a"), **dict.fromkeys((*range(8, 16), 17), "b")}
    strict = subjects.section_labels(c, keys, names, subjects.Rules(section_sentences=25)).collect()
    assert strict == []


def test_section_keys(spark):
    df = spark.createDataFrame([("x", "https://a.b/news/sport/1.html?q=1#t"), (None, None), ("y", "/one"), ("z", "")], "s string, p string")
    got = [sorted(r[0]) for r in df.select(subjects.section_keys(["s"], ["p"])).collect()]
    assert got[0] == ["p=a.b", "p=a.b/news", "p=a.b/news/sport", "s=x"] and got[1] == [] and got[2] == ["p=one", "s=y"]


def test_sections_bring_in_wording(spark):
    samples, corpus, truth = data(docs=300)
    spoken = ["the velodrome", "fencing bouts", "the regatta course", "handball refs"]
    rng = random.Random(5)
    new = [(5000 + i, " ".join(FRAMES[k % 5].format(x) for k, x in enumerate(rng.sample(spoken, 4))), "en") for i in range(60)]
    mixed = [(6000 + i, " ".join([sentence(rng, "sport", TERMS["sport"]) for _ in range(3)] + [FRAMES[0].format(rng.choice(spoken))]), "en") for i in range(60)]
    rows = [(d, t, lang, f"A{d % 7}") for d, t, lang, *_ in corpus] + [(*r, "sports page") for r in new + mixed]
    c = spark.createDataFrame(rows, "doc_id long, text string, lang string, section string")
    s = spark.createDataFrame(samples, "sample_id long, text string, lang string, subject string")
    a = spark.createDataFrame([(n, "") for n in (*TERMS, "procedure")], "subject string, description string")
    got = {tuple(r) for r in subjects.document_subjects(c, "doc_id", "text", "lang", s, a, sections=["section"]).collect()}
    assert sum((d, "sport") in got for d, *_ in new) >= 54


def test_every_language_is_fitted_on(spark):
    rows = [(i, "t", f"l{i % 9}" if i % 10 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "d long, t string, lang string")
    got = subjects.fit_sample(df, "d", "t", "lang", subjects.section_keys([], []), 900).join(df, F.col("doc") == F.col("d")).groupBy("lang").count().collect()
    assert len(got) == 10 and all(50 < r["count"] < 140 for r in got)


def test_a_sentence_may_deal_with_several_subjects(spark):
    one = subjects.hashed_sentences(["jury ski."])[2]
    model = {}
    for s, word in (("law", "jury"), ("sport", "ski"), ("farming", "cow")):
        w = np.zeros(subjects.FEATURES, np.float32)
        w[subjects.hashed_sentences([word])[2][0]] = 5
        model[s] = (w, -1.0, 0.0)
    df = spark.createDataFrame([(1, "Jury ski. Cow. The rest."), (2, None)], "d long, t string")
    got = {r.doc: (r.n_sentences, r.counts) for r in subjects.count_sentences(df, "d", "t", model, ["farming", "law", "sport"]).collect()}
    assert len(one) == 3 and got == {1: (3, [1, 1, 1]), 2: (0, [0, 0, 0])}
