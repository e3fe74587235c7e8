"""The counts of a known run: thirteen pairs of one DOI, and forty records whose DOI is the text null.

Pairs are (DOI, score of the first, score of the second, place of the best); scores count filled fields.
"""

from foliant.operators import dedup
from foliant.schema import as_records

PAIRS = [
    ("10.1007/s10639-023-12405-0", 5, 6, 1), ("10.1007/s10639-024-12835-4", 5, 5, 0), ("10.1007/s10639-025-13420-z", 5, 5, 0), ("10.1007/s12525-023-00680-1", 5, 6, 1),
    ("10.1016/j.caeai.2024.100328", 5, 5, 0), ("10.1038/s41746-024-01076-x", 5, 6, 1), ("10.1080/00207543.2025.2485318", 5, 5, 0), ("10.1080/08874417.2023.2261010", 5, 6, 1),
    ("10.1080/17538947.2024.2353122", 5, 6, 1), ("10.1109/mc.2023.3253292", 5, 6, 1), ("10.3390/systems12030103", 4, 6, 1), ("10.3390/systems12100385", 5, 6, 1), ("10.48550/arxiv.2402.09880", 5, 6, 1),
]


def record(k, doi, score, source):
    filled = ["url", "authors", "abstract_text", "journal", "keywords"][: score - 2]  # besides title and DOI
    return {"ord": k, "id": f"r{k}", "title": f"Title {k}", "doi": doi, "source": source} | {c: ["x"] if c in ("authors", "keywords") else "x" for c in filled}


def test_known_run(spark):
    rows = []
    for doi, a, b, _ in PAIRS:
        rows += [record(len(rows), doi.upper(), a, "DBLP"), record(len(rows) + 1, f" {doi}", b, "OPENALEX")]
    rows += [record(26 + k, "null", 6 if k == 0 else 4 + k % 3, "OPENALEX") for k in range(40)]
    kinds = "ord long, id string, title string, doi string, source string, url string, authors array<string>, abstract_text string, journal string, keywords array<string>"
    names = [x.split()[0] for x in kinds.split(", ")]
    u = dedup.unify(as_records(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)))
    s = u.stats.first()
    assert (s.total_records, s.dblp_records, s.openalex_records, s.unique_records, s.duplicates_found, s.duplicate_percentage) == (66, 13, 53, 14, 66, 100.0)
    groups = dedup.doi_groups(u.keyed).collect()
    assert len(groups) == 14 and {g.key: g.n for g in groups}["null"] == 40 and dedup.title_groups(u.keyed).count() == 0
    assert sorted((r.key, r.ord) for r in dedup.best(u.members).collect()) == sorted([*((doi, 2 * k + at) for k, (doi, _, _, at) in enumerate(PAIRS)), ("null", 26)])
    assert [r.score for r in u.keyed.orderBy("ord").collect()][:26] == [x for _, a, b, _ in PAIRS for x in (a, b)]
