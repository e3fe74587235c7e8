import random

import numpy as np
import pytest

from foliant.llm import quality as q
from foliant.llm.features import Selection

R = random.Random(3)
V = ["".join(R.choices("abcdefghij", k=R.randint(1, 7))) for _ in range(300)]


def corpus(n, start=0):
    rows, labels = [], []
    for d in range(start, start + n):
        words = [R.choice(V) for _ in range(R.randint(20, 80))]
        kind = d % 5
        if kind == 0:
            for w in R.sample(["vile", "rotten", "nasty"], 2):
                words[R.randrange(len(words))] = w
        if kind == 1:
            words = [w + " |" for w in words]
        rows.append((d, " ".join(words), "en", f"s{d % 3}"))
        labels.append((d, int(kind != 1), int(kind == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(700)
    docs, lab = frames(spark, rows, labels[:450])
    got = {r.doc_id: r for r in q.classify(docs, lab).collect()}
    assert len(got) == 700
    held = labels[450:]
    bad = [d for d, good, toxic in held if not good or toxic]
    fine = [d for d, good, toxic in held if good and not toxic]
    assert np.mean([not got[d].kept for d in bad]) > 0.95
    assert np.mean([got[d].kept for d in fine]) > 0.95


def test_scores_are_those_of_the_definition(spark):
    rows, labels = corpus(120)
    docs, lab = frames(spark, rows, labels)
    m = q.train(docs, lab)
    rng = np.random.default_rng(0)
    n, size = 6, len(m.w)
    cols = [np.sort(rng.choice(size, k, replace=False)) for k in (0, 1, 2, 5, 9, 30)]
    got = m.logit(np.repeat(np.arange(n), [len(c) for c in cols]), np.concatenate(cols), n)
    for c, z in zip(cols, got, strict=True):
        want = m.w0 + sum(m.w[i] for i in c) + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(c) for j in c[a + 1 :])
        assert z == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_odd_rows(spark):
    rows, labels = corpus(60)
    rows += [(500, None, None, None), (501, "", "en", "s1"), (None, "a b", "en", "s1"), (500, "x " * 200_000, "en", "s0")]
    docs, lab = frames(spark, rows, [*labels, (None, 1, 1), (3, None, 1), (4, 0, None), (5, 1, 1), (999, 1, 0)])
    docs = docs.selectExpr("*", "1 as quality", "2 as toxic", "'z' as words", "0.5 as stats", "3 as d")
    out = q.classify(docs, lab).collect()
    assert len(out) == 64 and all(0 <= r.score <= 1 for r in out)
    none = q.classify(docs, lab.limit(0)).collect()
    assert len(none) == 64 and all(r.kept for r in none)
    assert q.classify(docs.limit(0), lab).collect() == []


def test_every_metadata_value_of_the_sample_is_a_feature(spark):
    """5,000 sources, of which the last in the alphabet are the bad ones: nothing else tells them apart."""
    rows = [(d, "the same words in every text", "en", f"s{d % 5000:05d}") for d in range(10_000)]
    docs, lab = frames(spark, rows, [(d, int(d % 5000 < 4500), 0) for d in range(10_000)])
    machine = q.train(docs, lab)
    assert len([v for v in machine.features.meta if v.startswith("source=")]) == 5000
    kept = {r.doc_id: r.kept for r in q.classify(docs, lab).collect()}
    assert np.mean([kept[d] == (d % 5000 < 4500) for d in kept]) > 0.95


def test_fewer_features_and_fewer_rows_can_be_asked_for(spark):
    rows, labels = corpus(200)
    docs, lab = frames(spark, rows, labels)
    few = q.train(docs, lab, selection=Selection(most=2))
    assert len(few.features.words) == 2 and len(q.train(docs, lab, selection=Selection(least_chi2=0, least_rows=1)).features.words) > 200
    assert q.train(docs, lab, train_rows=30).w.shape


def test_a_filter_judges_as_the_classifier_does(spark):
    """Metadata of any type, and columns named as the filter's own."""
    rows, labels = corpus(300)
    docs, lab = frames(spark, rows, labels)
    docs = docs.selectExpr("doc_id", "text", "array(lang, source) as lang", "cast(doc_id % 3 as double) / 7 as source", "1 as lang_text", "2 as source_text")
    kept = {r.doc_id for r in q.classify(docs, lab).collect() if r.kept}
    got = q.passing(docs, lab)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept and 0 < len(kept) < 300


def test_ties_and_repeated_labels(spark):
    """Equal rows score equally, and a score of just the threshold is rejected; of two texts of a labelled id one is fitted to."""
    rows, labels = corpus(80)
    rows += [(7, rows[7][1] + " more", "en", "s1"), rows[8], rows[8]]
    docs, lab = frames(spark, rows, labels)
    out = q.classify(docs, lab).collect()
    same = [r for r in out if r.doc_id == 8]
    assert len(out) == 83 and len({r.score for r in same}) == 1 and len(same) == 3
    again = q.classify(docs, lab, threshold=same[0].score).collect()
    assert not any(r.kept for r in again if r.doc_id == 8)
