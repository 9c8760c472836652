import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm.subject_queries import subjects_of_documents
from kmerloom.llm.subjects import SubjectGraph
from kmerloom.session import table

SF = "/root/testdata/sf0.01"
WORDS = {
    "farming": "tractor harvest orchard slurry barley flock".split(),
    "sport": "goalkeeper stadium referee league velodrome relay".split(),
    "health": "hospital midwife vaccine surgeon clinic ambulance".split(),
    "law": "tribunal statute magistrate appeal injunction precedent".split(),
}
PLAIN = ["We ask the minister about {0} and {1} today.", "The report on {0} says nothing about {1}.", "Who will pay for {0} and for {1}?"]


def made(n=240):
    rng = np.random.default_rng(8)
    docs, labels, truth = [], [], {}
    for i in range(n):
        of = [s for s in WORDS if rng.random() < 0.35]
        lines = [PLAIN[int(rng.integers(3))].format(*rng.choice(WORDS[s], 2)) for s in of for _ in range(3)] + ["The sitting is resumed.", "I beg to move."]
        if not of:
            lines.append("The " + str(rng.choice(WORDS["sport"])) + " was mentioned once.")
        docs.append((i, " ".join(rng.permutation(lines)), "en", None, "clash"))
        truth[i] = set(of)
        if i < 80:
            labels += [(i, s.title() if rng.random() < 0.3 else s, "a") for s in of or ["none"]]
    docs += [(1000, None, None, None, ""), (1001, "  ", "en", "x", ""), (1002, "", "en", "", ""), (None, "tractor", "en", None, ""), (1003, ("The tractor and the harvest matter. " * 3000), None, None, "")]
    return docs, labels, truth


def tables(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, agenda_item string, doc string"),
        spark.createDataFrame([("farming", ""), ("sport", ""), ("health", ""), ("law", ""), (None, "")], "subject string, covers string"),
        spark.createDataFrame(labels + labels[:5] + [(None, "sport", "a"), (3, None, "b"), (2, "unknown", None)], "doc_id bigint, subject string, annotator string"),
    )


def test_made_documents(spark):
    docs, labels, truth = made()
    got = {}
    for r in subjects_of_documents(spark, *tables(spark, docs, labels)).collect():
        got.setdefault(r.doc, set()).add(r.subject)
    assert got.pop(1003) == {"farming"} and not {1000, 1001, 1002, None} & set(got)
    assert np.mean([got.get(i, set()) == t for i, t in truth.items()]) > 0.9


def test_empty_tables(spark):
    docs, labels, _ = made(20)
    d, s, lab = tables(spark, docs, labels)
    assert subjects_of_documents(spark, d.limit(0), s, lab).count() == 0
    assert subjects_of_documents(spark, d, s, lab.limit(0)).count() == 0
    assert subjects_of_documents(spark, d, s.limit(0), lab).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("sf,recall,precision", [(SF, 0.4, 0.5), ("/root/testdata/sf0.1", 0.9, 0.9)])  # some 90 labels don't suffice at the small size, see the README
def test_held_out_labels(spark, sf, recall, precision):
    labels = table(spark, sf, "subject_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    want = {}
    for r in labels.filter(held).select("doc_id", F.lower("subject").alias("s")).distinct().collect():
        want.setdefault(r.doc_id, set()).update({r.s} - {"none"})
    got = {}
    for r in subjects_of_documents(spark, table(spark, sf, "documents"), table(spark, sf, "subjects"), labels.filter(~held)).collect():
        got.setdefault(r.doc, set()).add(r.subject)
    hit = sum(len(got.get(d, set()) & s) for d, s in want.items())
    found = hit / sum(map(len, want.values())), hit / sum(len(got.get(d, set())) for d in want)
    print(sf, "recall, precision", found)
    assert found[0] >= recall and found[1] >= precision


def test_edges_are_all_verified_overlaps(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 40, i // 40, sorted(set(rng.integers(0, 12, int(rng.integers(1, 7))).tolist()))) for i in range(200)]
    full = spark.createDataFrame(rows, "doc bigint, s int, terms array<bigint>")
    content = spark.createDataFrame([(t,) for t in range(9)], "term bigint")
    passages, nodes, edges = SubjectGraph(["a", "b"]).similarity(full, content)
    sets = {r.node: frozenset(r.members) for r in nodes.collect()}
    assert len(set(sets.values())) == len(sets)
    assert {(r.doc, r.s): sets[r.node] for r in passages.collect()} == {(d, s): frozenset(t) & set(range(9)) for d, s, t in rows if set(t) & set(range(9))}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and 2 * len(x & y) >= len(x | y)}
    got = {(r.src, r.dst): r.overlap for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and got
