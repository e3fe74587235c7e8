import random

import pytest

from foliant.llm import decontam
from foliant.llm.textkit import words_of

R = random.Random(9)
V = ["".join(R.choices("abcdefghij", k=R.randint(1, 6))) for _ in range(60)]


def prose(k):
    return [R.choice(V) for _ in range(k)]


def brute(docs, items, threshold):
    out = {}
    k = decontam.SHINGLE
    for i, t in items:
        w = words_of(t)
        s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for d, text in docs:
            v = words_of(text)
            sh = [tuple(v[j : j + k]) for j in range(max(1, len(v) - k + 1))] if v else []
            span = max(1, len(w) - k + 1)
            best = max(((len(s & set(sh[j : j + span])), -j) for j in range(len(sh)) if sh[j] in s), default=(0, 0))
            if s and best[0] / len(s) >= threshold - 1e-9 and best[0]:
                out[d, i] = (round(best[0] / len(s), 9), -best[1])
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks_match_brute_force(spark, limit):
    items = [(i, " ".join(prose(R.randint(2, 40)))) for i in range(25)]
    docs = []
    for d in range(150):
        w = prose(R.randint(0, 120))
        if d % 3 == 0:
            x = items[d % 25][1].split()
            x = [R.choice(V) if R.random() < R.choice([0, 0.05, 0.15]) else y for y in x]
            w[len(w) // 2 : len(w) // 2] = x
        docs.append((d, ", ".join(w)))
    docs += [(900, items[3][1].upper()), (901, None), (902, ""), (903, "zz " * 20000 + items[4][1])]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_lookup=limit).collect()
    want = brute(docs, items, 0.6)
    assert {(r.doc_id, r.item_id): (round(r.containment, 9), r.start) for r in got} == want and len(got) == len(want) > 40


def test_odd_rows(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, item, 5), (1, item, 6), (1, "x", 7), (None, item, 8), (2, None, 9), (3, "short one", 1)], "doc_id long, text string, items int")
    items = spark.createDataFrame([(0, item, "a"), (0, item, "b"), (1, None, "c"), (None, item, "d"), (2, "", "e"), (3, "Short, one", "f")], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id, r.containment, r.start) for r in decontam.leaks(docs, items).collect()}
    assert got == {(1, 0, 1.0, 0), (3, 3, 1.0, 0)}
    assert decontam.leaks(docs.limit(0), items).collect() == []
    assert decontam.leaks(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [10**6, 0])
def test_the_filter_leaves_out_what_leaks(spark, limit):
    item = "one two three four five six seven"
    rows = [(1, "x " + item), (1, "clean text"), (2, "clean text"), (None, item), (3, None), (3, ""), (4, item), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, body string").selectExpr("*", "1 as text", "2 as leaking", "3 as d")
    bench = spark.createDataFrame([(0, item)], "item_id long, question string")
    out = decontam.without_leaks(docs, bench, max_lookup=limit, text_col="body", item_text_col="question")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.body or "") for r in out.collect()) == [(0, item), (2, "clean text"), (3, ""), (3, ""), (5, "other")]
    assert decontam.without_leaks(docs.limit(0), bench, max_lookup=limit, text_col="body", item_text_col="question").collect() == []
