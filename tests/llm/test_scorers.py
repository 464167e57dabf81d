"""Classifiers on planted data, held-out accuracy, and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from corelode.llm import quality, toxicity
from corelode.llm.labelled import held_out, training_rows

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def planted(spark, make_docs):
    """Clean prose, junk between signs, and insults by word or by stem."""
    rows, labels, draw = [], [], random.Random(5)
    for i in range(400):
        words = prose(i, draw.randrange(20, 120)).split(" ")
        low, toxic = i % 5 == 1, i % 4 == 2
        if low:
            words = [w + draw.choice(["$$$", "%%%", "&&&"]) for w in words]
        if toxic:
            for _ in range(draw.randrange(1, 6)):
                words[draw.randrange(len(words))] = draw.choice(["Blockhead,", "nitwit", f"zogg{draw.randrange(1000)}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not low), int(toxic)))
    labels += [(None, 1, 1), (7, None, None), (10**6, 1, 0)]
    return make_docs(rows), spark.createDataFrame(labels, LABELS)


def _accuracy(scored, labels, label):
    both = scored.join(labels.dropna(), "doc_id").filter("held_out")
    return both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_on_held_out_rows(planted):
    docs, labels = planted
    scored = quality.quality_scores(docs, quality.train(docs, labels))
    assert _accuracy(scored, labels, "quality") > 0.95
    r = scored.filter("doc_id = 17").first()
    assert r["held_out"] == (zlib.crc32(b"17") % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_on_held_out_rows(planted):
    docs, labels = planted
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.grade_documents(docs, model)
    assert _accuracy(scored, labels, "toxic") > 0.95
    left = toxicity.reject_toxic(docs, model)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in scored.filter("kept").collect())


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_odd_rows_and_labels(spark, make_docs, kind):
    docs = make_docs([(1, None), (2, ""), (None, "x"), (3, "word " * 50_000), (3, "word " * 50_000)])
    for labels in ([], [(1, 1, 1)], [(1, 0, 0)]):
        model = kind.train(docs, spark.createDataFrame(labels, LABELS))
        scored = (quality.quality_scores if kind is quality else toxicity.grade_documents)(docs, model)
        got = scored.collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert scored.limit(0).count() == 0
    assert (quality.quality_scores if kind is quality else toxicity.grade_documents)(docs.limit(0), model).count() == 0


def test_one_model_whatever_the_partitioning(planted):
    """Near copies count once by the same row of theirs, so weights and thresholds are equal to the last bit."""
    docs, labels = planted
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" !"))))
    more = labels.unionByName(labels.dropna().withColumn("doc_id", F.col("doc_id") + 1000))
    one, other = toxicity.train(copies.repartition(1), more), toxicity.train(copies.repartition(9, "text"), more.repartition(4))
    assert one.slots.tolist() == other.slots.tolist() and len(one.slots)
    assert one.weights.tolist() == other.weights.tolist() and one.thresholds.tolist() == other.thresholds.tolist()


def _plain_features(text):
    """Words of letters (bytes of 128 and more count) and their beginnings, as (size or None, bytes)."""
    words = re.findall(rb"[a-z\x80-\xFF]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))
    return {(size, w[:size] if size else w) for w in words for size in (None, *toxicity.PREFIXES) if size is None or len(w) >= size}


def test_features_are_those_of_a_plain_loop():
    texts = [b"Scum, scum! scumbag", b"", b"12 -- 3", "\u00c9t\u00e9 \u00e9t\u00e9s".encode(), b"a " * 5 + b"sevenseven"]
    row, slot = toxicity.features(texts)
    slot_of = {}
    for i, text in enumerate(texts):
        mine = slot[row == i].tolist()
        assert len(mine) == len(set(mine)) == len(_plain_features(text))  # no two share a slot here
        alone = toxicity.features([text])[1].tolist()
        assert alone == mine
        slot_of[i] = set(mine)
    assert slot_of[0] & slot_of[4] == set() and len(slot_of[0]) == len(_plain_features(texts[0]))


def test_long_texts_have_the_features_of_their_stretches():
    text = (prose(3, 250_000, 3000)).encode()
    whole = toxicity._feature_keys([text])
    assert len(text) > 1 << 20 and toxicity.features([text])[1].tolist() == (whole & ((1 << toxicity.SLOT_BITS) - 1)).tolist()


def test_labels_of_held_out_rows_are_not_learned_from(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], LABELS)
    rows = training_rows(docs, labels, "quality", 1000, 1000)
    assert {r.doc_id for r in rows.collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert training_rows(docs, labels, "quality", 10, 1000).count() == 10
    assert docs.filter(held_out(F.col("doc_id"))).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))


def test_convolution_covers_the_whole_text():
    """A sign at any place of a long text moves the step that holds it; passes and steps meet without a gap."""
    net = quality.ByteNetwork.fresh()
    text = np.full(3 * quality.PASS + 77, ord("a"), dtype=np.uint8)
    base, _ = net.step_maxima(text)
    for at in (0, 1, quality.STEP - 1, quality.STEP, quality.PASS - 1, quality.PASS, 2 * quality.PASS + 5, len(text) - 1):
        changed = text.copy()
        changed[at] = ord("%")
        assert (net.step_maxima(changed)[0] != base).any(axis=1)[at // quality.STEP]


def test_gradient_of_the_ordinal_fit():
    """Separable grades end with weights in their order and thresholds between them."""
    rows, columns, grades = [], [], []
    for i in range(300):
        g = i % 3
        grades.append(g)
        for c in range(g):
            rows.append(i)
            columns.append(c)
    weights, thresholds = toxicity.fit_grades(np.array(rows), np.array(columns), np.array(grades), 2)
    score = np.bincount(rows, weights=weights[columns], minlength=300)
    assert (np.searchsorted(thresholds, score) == np.array(grades)).all()
