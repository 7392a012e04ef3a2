"""Near duplicates of 10,000 documents against an exact join, where the generated tables are at hand."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from sparkloom.llm import components, minhash

DOCS = Path("/root/testdata/sf0.1/documents.parquet")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_links(sets: dict, percent: int):
    """All pairs that reach the similarity. Elements from rare to frequent: similar sets share one among the first n - ceil(n * percent / 100) + 1."""
    often = Counter(x for s in sets.values() for x in s)
    rank = {x: k for k, (x, _) in enumerate(sorted(often.items(), key=lambda p: (p[1], p[0])))}
    lists = {i: sorted(rank[x] for x in s) for i, s in sets.items()}
    full, seen = {i: set(v) for i, v in lists.items()}, defaultdict(list)
    for i in sorted(lists, key=lambda i: len(lists[i])):
        n, met = len(lists[i]), set()
        for x in lists[i][: n - -(-n * percent // 100) + 1]:
            met.update(seen[x])
            seen[x].append(i)
        for j in met:
            shared = len(full[i] & full[j])
            if 100 * shared >= percent * (n + len(lists[j]) - shared):
                yield i, j


@pytest.mark.skipif(not DOCS.exists(), reason="no generated tables")
def test_recall(spark, k=2):
    docs = spark.read.parquet(str(DOCS))
    sets = {}
    for i, text in docs.select("doc_id", "text").toLocalIterator():
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        if s := {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set()):
            sets[i] = s
    one = {}  # equal sets are compared once
    for i in sorted(sets):
        one.setdefault(frozenset(sets[i]), i)
    group = components.UnionFind()
    links = list(exact_links({i: s for s, i in one.items()}, 80))
    for i, s in sets.items():
        group.union(i, one[frozenset(s)])
    for i, j in links:
        group.union(i, j)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=k).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    print(f"k {k}: {len(links)} links between different sets of {len(sets)} documents, {found} within one group")
    assert len(sets) > 9000 and links and found == len(links)
    assert all(got[i] == group.find(i) for i in sets)
