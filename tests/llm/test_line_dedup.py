import random

import pytest

from foliant.llm import line_dedup

R = random.Random(4)


def brute(docs, window):
    """(doc_id, text, n_lines, n_removed) of each row, from all windows of all documents in order."""
    order = sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = set(), {}
    for d, text in order:
        raw = (text or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip(" \t\r")]
        lines = [raw[i].strip(" \t\r") for i in at]
        out = set()
        for p in range(max(1, len(lines) - window + 1) if lines else 0):
            w = tuple(lines[p : p + window])
            if w in seen:
                out |= set(range(p, p + len(w)))
            seen.add(w)
        drop = {at[i] for i in out}
        gone[d, text] = ("\n".join(x for i, x in enumerate(raw) if i not in drop) if drop else text, len(lines), len(drop))
    return [(d, *gone[d, text]) for d, text in docs]


def order(rows):
    return sorted(rows, key=repr)


def found(spark, docs, window):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return [tuple(r) for r in line_dedup.remove_repeated_lines(df, window=window).collect()]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_rows_match_brute_force(spark, window):
    lines = [f" line {k}\t" if k % 5 == 0 else f"line {k}" for k in range(14)]
    docs = [(d, "\n".join(R.choice([*lines, "", f"own {d}"]) for _ in range(R.randint(0, 12)))) for d in range(80)]
    docs += [(200, "\n".join(["x", "y"] * 3000)), (201, "a\n" * 5), (202, "tail one\ntail two"), (203, "tail one\ntail two")]
    got = found(spark, docs, window)
    assert order(got) == order(brute(docs, window))
    assert sum(r[3] for r in got) > 50


def test_long_runs_are_extended_both_ways(spark):
    run = "\n".join(f"shared {k}" for k in range(40))
    docs = [(1, f"first\n{run}\nend"), (2, f"other\nlead\n{run}\ntail")]
    assert order(found(spark, docs, 4)) == order([(1, docs[0][1], 42, 0), (2, "other\nlead\ntail", 43, 40)])


def test_odd_rows(spark):
    rows = [
        (None, "a\nb", 1), (1, "a\nb", 2), (1, "a\nb", 3), (2, None, 4), (3, "", 5), (4, " \n\t\r\n", 6),
        (5, "alone", 7), (6, "alone", 8), (7, "\n".join(["long " * 50_000, "c"]), 9), (8, "\n".join(["long " * 50_000, "c"]), 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, drop int")
    df = df.withColumns(dict.fromkeys(["d", "t", "p", "h", "s", "dd", "n_lines"], df["drop"]))
    got = [tuple(r) for r in line_dedup.remove_repeated_lines(df).collect()]
    # The null id comes first; the two equal rows are one document, and give a row each.
    assert order(got) == order(brute([r[:2] for r in rows], 2))
    assert [r[3] for r in got if r[0] == 1] == [2, 2] and [r[1:] for r in got if r[0] == 2] == [(None, 0, 0)]
    assert line_dedup.remove_repeated_lines(df.limit(0)).collect() == []


def test_a_row_is_written_for_each_selected_position_only(spark):
    """About 2 of window + 1 windows have a position of their own, and all windows travel with one."""
    texts = [(d, "\n".join(f"{d} {R.random()}" for _ in range(200))) for d in range(20)]
    d = spark.createDataFrame(texts, "d long, text string").selectExpr("*", "xxhash64(text) as t")
    for window, share in ((1, 1.0), (2, 2 / 3), (4, 2 / 5), (8, 2 / 9)):
        rows, windows = line_dedup.fingerprints(d, window).selectExpr("count(*)", "sum(size(runs))").first()
        assert windows == 20 * (200 - window + 1) and rows <= windows and abs(rows / windows - share) < 0.05


def test_texts_without_deletions_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "c")], "doc_id long, text string")
    plan = line_dedup.remove_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and plan.count("SortMergeJoin") <= 1
