import collections
import math
import random
import re

from wordloom.llm import lexical

TERM = re.compile(lexical.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """{item place: [(doc_id, score)]}"""
    held = [(d, collections.Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = {}
    for k, (_, text, *_) in enumerate(items):
        scores = []
        for d, c, n in held:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[k] = [(None if null else d, -s) for s, null, d in sorted(scores)[:top]]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "of", "AND"] + [f"w{i}" for i in range(60)] + [f"rare{i}Ü" for i in range(300)] + ["日本", "a-b", "x_y", "ÄÖ"]
    weight = [40, 30, 20] + [5] * 60 + [0.4] * 300 + [1] * 4
    text = lambda k: " ".join(rng.choices(words, weight, k=k))
    docs = [(i, text(rng.choice([1, 5, 40, 200])), "s") for i in range(n)]
    docs += [(n + i, docs[3][1], "s") for i in range(25)] + [(n + 50, None, "s"), (n + 51, "", "s"), (n + 52, "-- !", "s"), (None, docs[5][1], "s")]
    items = [(i, text(rng.choice([3, 20, 60])), 0) for i in range(20)] + [(50, docs[3][1], 0), (51, None, 0), (52, "", 0), (53, "unheardof", 0), (54, "THE the", 0)]
    rng.shuffle(docs)
    return docs, items


def rows(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def frames(spark, docs, items, parts=3):
    return (spark.createDataFrame(docs, "doc_id long, text string, term string").repartition(parts).cache(),
            spark.createDataFrame(items, "item_id long, text string, slice int"))


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    want = {items[k][0]: v for k, v in brute(docs, items).items() if v}
    d, q = frames(spark, docs, items)
    assert rows(lexical.search(d, q)) == want
    # slices and bundles of a few rows, all terms indexed, other owners
    monkeypatch.setattr(lexical, "SLICE_DOCS", 32)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 7)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lexical, "OWNERS", (100, 20, 10, 3))
    assert rows(lexical.search(d, q)) == want
    assert rows(lexical.search(d, q, top=1)) == {k: v[:1] for k, v in want.items()}


def test_nothing_kept_is_lost_on_the_way():
    """Scores that go through ``carried`` end with the same best as without."""
    import numpy as np
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, rest = 50, np.zeros((lexical.BUNDLE_ITEMS, 3), "<i8")
        rest[:5] = rng.integers(1, 3000, (5, 3))
        sizes = rng.integers(1, 400, n).astype("<u4").tobytes()
        whole = lexical.Bundle(sizes, rest.tobytes(), 3, n, 10_000)
        carried, dropped = None, 0
        for owner in range(3):
            part = lexical.Bundle(sizes, rest.tobytes(), 3, n, 10_000)
            if carried:
                part.load(*carried)
            for item in range(5):
                at = np.sort(rng.choice(n, 30, replace=False)).astype("<u2").tobytes()
                tfs = rng.integers(1, 9, 30).astype("<u4").tobytes()
                for b in (whole, part):
                    b.add(int(rest[item, owner]), [item], at, tfs)
            carried = part.carried(owner, 5)
            dropped += int((part.score > 0).sum()) - len(carried[0]) // 2
        end = lexical.Bundle(sizes, rest.tobytes(), 3, n, 10_000)
        end.load(*carried)
        a, b = whole.best(5), end.best(5)
        assert [x.tolist() for x in a] == [x.tolist() for x in b]
        assert (whole.score[a] == end.score[b]).all()
    assert dropped


def test_equal_items_and_empty_tables(spark):
    docs, items = corpus(2, 60)
    d, q = frames(spark, docs, [items[0], (items[0][0], items[0][1], 1), (None, items[1][1], 2)])
    got = lexical.search(d, q).collect()
    want = brute(docs, items[:2])
    assert sorted(r.score for r in got if r.item_id is not None) == sorted(2 * [s for _, s in want[0]])
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.item_id is None] == want[1]
    assert lexical.search(d.where("false"), q).count() == 0 and lexical.search(d, q.where("false")).count() == 0


def test_very_long_and_repeated_texts(spark):
    docs = [(1, "needle " * 30_000 + "hay", ""), (1, "needle", ""), (2, "hay " * 5, ""), (2, "needle", "")]
    items = [(0, "Needle", 0), (1, "hay needle", 0)]
    d, q = frames(spark, docs, items, 1)
    assert rows(lexical.search(d, q)) == {k: v for k, v in brute(docs, items).items() if v}
