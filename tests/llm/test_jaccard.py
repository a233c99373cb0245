import random
import re

import numpy as np
import pytest
from wordloom.llm import graph, jaccard


def sets_of(text, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)], key=str)


def check(spark, rows, k=4, percent=85):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, TILE string").repartition(3)
    got = sorted([tuple(r) for r in jaccard.jaccard_components(df, k, percent).collect()], key=str)
    assert got == brute(rows, k, percent)


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") + str(rng.randrange(50)) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "GROUP_TILE", 7)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 20_000)
    rng = random.Random(k)
    texts = []
    for _ in range(12):  # families with edits around the threshold
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03]))))
    hot = [f"h{rng.randrange(300)}" for _ in range(80)]  # a large group of near copies
    texts += [" ".join(edited(rng, hot, 0.02)) for _ in range(40)] + [" ".join(hot)] * 20
    passage = " ".join(f"p{i}" for i in range(30))  # a passage that unlike texts share
    texts += [passage + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(40)) for _ in range(15)]
    texts += ["A b C", "a B c", "a b", "", None, " \t\n\x0b\x0c\r", "x", "x", "X", "ä ö ü ß É", "ä ö ü ß é", "a\x1cb c\xa0d e"]
    texts += ["again " * 300, "again " * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, hot[0]), (None, " ".join(hot)), (3, texts[3])]
    check(spark, rows, k, percent)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])


def test_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(150_000))
    check(spark, [(1, long), (2, long + " end"), (3, "end")])


def test_overlaps_sum_over_fragments():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(0, 200))) for _ in range(20)]
    got = sum(jaccard.partial_overlaps([jaccard._fragment(s, f) for s in sets]) for f in range(jaccard.FRAGMENTS))
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_chained_passages_stay_linear(spark):
    """Documents of two passages, each shared with one neighbour: no pair links,
    and the pairs of product tiles grow as the documents do."""
    seen = []
    for n in (600, 1200):
        rng = random.Random(n)
        passages = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(25)) for _ in range(n + 1)]
        df = spark.createDataFrame([(i, passages[i] + " " + passages[i + 1]) for i in range(n)], "doc_id long, text string")
        made = []
        whole = jaccard.tile_pairs

        def counted(rows, places):
            out = whole(rows, places)
            made.append(out.count())
            return out

        jaccard.tile_pairs = counted
        try:
            got = jaccard.jaccard_components(df).collect()
        finally:
            jaccard.tile_pairs = whole
        assert all(r.doc_id == r.component_id for r in got)
        seen.append(made[0])
    assert seen[1] <= 2.6 * seen[0]


@pytest.mark.parametrize("task_edges", [1_000_000, 20])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    rng = random.Random(4)
    for n, m in ((60, 40), (300, 200), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += [(n + i, n + i + 1) for i in range(40)]  # a long chain
        got = {r.node: r.component for r in graph.components(
            spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(7)).collect()}
        label = {x: x for e in edges for x in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert got == {x: c for x, c in label.items() if x != c}
