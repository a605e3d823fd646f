import random
from collections import Counter

from skein.llm import subjects

TERMS = {
    "law": ["court", "appeal", "contract clause", "evidence", "tribunal", "notary"],
    "sport": ["pitch", "rowing crew", "goalkeeper", "league", "penalty", "referee"],
    "food": ["yeast", "glaze", "stock pot", "lentil", "chef", "butter"],
}
FORMS = ["Before the {} is settled, check the {}.", "We compared the {} with the {}.", "The {} came first, then the {}."]
PLAIN = ["Thanks to everyone who stayed.", "Room 4 is booked.", "More on this next week."]


def doc(rng, subject, n=12, other=None, k=0):
    out = [rng.choice(FORMS).format(*rng.sample(TERMS[subject], 2)) for _ in range(n)] if subject else []
    out += [rng.choice(FORMS).format(*rng.sample(TERMS[other], 2)) for _ in range(k)]
    out += [rng.choice(PLAIN) for _ in range(4)]
    rng.shuffle(out)
    return "# Title\n\n" + " ".join(out)


def corpus(rng):
    docs, labels = [], []
    for i in range(120):
        s = rng.choice(list(TERMS))
        docs.append((i, doc(rng, s), "x"))
        labels.append((i, s if i % 30 else "food"))  # a few wrong
    for i in range(120, 130):
        docs.append((i, doc(rng, None), "x"))
        labels.append((i, "general"))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")  # noqa: E741
    out = {}
    for r in subjects.subjects_of(d, l).collect():
        out.setdefault(r["doc_id"], set()).add(r["subject"])
    return out


def test_held_out_documents(spark):
    rng = random.Random(8)
    docs, labels = corpus(rng)
    want = {}
    for i in range(200, 260):
        s = rng.choice(list(TERMS))
        docs.append((i, doc(rng, s), "x"))
        want[i] = {s}
    docs.append((300, doc(rng, "law", 10, "sport", 4), "x"))  # two subjects
    docs.append((301, doc(rng, "law", 30, "food", 1), "x"))  # a stray sentence
    docs.append((302, doc(rng, None), "x"))
    docs.append((303, doc(rng, "food", 3000), "x"))  # very long
    docs += [(304, "", "x"), (305, None, "x"), (306, " ?! ", "x"), (None, "court", "x")]
    want |= {300: {"law", "sport"}, 301: {"law"}, 302: {"general"}, 303: {"food"}}
    got = run(spark, docs, labels + labels[:5] + [(99999, "law"), (None, "law"), (1, None)])
    assert got == want


def test_without_labels_and_empty(spark):
    assert run(spark, [(1, "court appeal", "x")], []) == {1: {"general"}}
    assert run(spark, [], []) == {}


def test_sentences_skip_structure():
    text = "﻿---\nspace:\n  a: b\n---\n\n# Head\n\nOne two.\r\n```py\ncode here\n```\n三 望遠鏡。四。"
    assert subjects.sentences(text)[0] == ["one", "two"] and ["code", "here"] not in subjects.sentences(text)


def test_choice():
    assert subjects.chosen(20, Counter(a=18, b=1), 0.08) == ["a"]
    assert subjects.chosen(20, Counter(a=10, b=2), 0.08) == ["a", "b"]
    assert subjects.chosen(20, Counter(), 0.08) == ["general"]


def test_only_permitted_subjects(spark):
    rng = random.Random(8)
    docs, labels = corpus(rng)
    docs += [(i, doc(rng, "sport"), "x") for i in range(200, 210)] + [(i, doc(rng, "law"), "x") for i in range(210, 220)]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")  # noqa: E741
    areas = spark.createDataFrame([("law", "x"), ("food", "x"), ("general", "x")], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects_of(d, l, areas).where("doc_id >= 210").collect()}
    assert got == {(i, "law") for i in range(210, 220)}
    assert {r["subject"] for r in subjects.subjects_of(d, l, areas).collect()} <= {"law", "food", "general"}


def test_mining_a_very_long_repeated_sentence(spark):
    rng = random.Random(2)
    docs, labels = corpus(rng)
    long = " ".join(f"court{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    docs += [(i, long + ".", "x") for i in range(400, 410)]
    labels += [(i, "law") for i in range(400, 410)]
    docs += [(500, long, "x")]
    assert run(spark, docs, labels)[500] == {"law"}
