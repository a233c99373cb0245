import random

import numpy as np
import pytest
from wordloom.llm import alignment as al


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (al.MATCH if a[i] == b[j] else al.MISMATCH),
                                  h[i, j + 1] + al.GAP, h[i + 1, j] + al.GAP)
    return h.max()


def test_alignment_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 14)), rng.integers(0, 6, rng.integers(1, 20))
        score, start, end, equal = al.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == brute_align(a, b)
        assert 0 <= start <= end <= len(b) and equal <= min(len(a), len(b))


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(15, 50))] for _ in range(30)]
    items.append(["one", "two"])
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, want = [], set()
    for d in range(120):
        w = prose(rng.randrange(20, 300))
        kind = d % 4
        i = rng.randrange(30)
        copy = list(items[i])
        if kind == 1:
            want.add((d, i))
        elif kind == 2:  # edited: words changed, dropped and added
            for p in range(3, len(copy), 9):
                copy[p] = "changed"
            copy.insert(len(copy) // 2, "added")
            del copy[len(copy) // 3]
            want.add((d, i))
        elif kind == 3:
            copy = copy[:len(copy) // 4]  # a small part is no leak
        if kind:
            at = rng.randrange(len(w))
            w = w[:at] + [c.upper() + "," for c in copy] + w[at:]
        docs.append((d, " ".join(w)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], want


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, SCORE string").repartition(4),
            spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string"))


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_finds_exact_and_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(al, "ITEM_BLOCK_BYTES", block)
    docs, items, want = corpus()
    got = al.find_leaks(*frames(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1.0 for r in got if r.doc_id % 4 == 1)
    assert all(0.5 <= r.score < 1.0 for r in got if r.doc_id % 4 == 2)
    r = next(r for r in got if r.doc_id % 4 == 1)
    words = docs[r.doc_id][1].replace(",", "").lower().split()
    assert " ".join(words[r.start_word:r.end_word]) == items[r.item_id][1]


def test_hot_item_nulls_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(i, f"start {item} end {i}") for i in range(50)] + [(None, item), (None, None), (60, ""), (61, "x " * 50_000 + item)]
    d, b = frames(spark, docs, [(5, item), (6, item), (7, None), (None, "zz yy"), (8, "")])
    got = al.find_leaks(d, b).collect()
    assert len(got) == 52 * 2 and {r.item_id for r in got} == {5, 6}
    kept = al.without_leaks(d, b).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 60]
    assert al.find_leaks(d, b.limit(0)).count() == 0 and al.find_leaks(d.limit(0), b).count() == 0


def all_pairs(docs, items, threshold=0.5):
    """Smith-Waterman of every item with every text."""
    out = {}
    for d, t in docs:
        for i, x in items:
            w, v = x.split(), t.split()
            number = {}
            a, b = (np.array([number.setdefault(y, len(number)) for y in z], np.uint64) for z in (w, v))
            if not len(a):
                continue
            score, _, _, equal = al.align(a, b)
            if score / (al.MATCH * len(a)) >= threshold and equal >= min(al.LEAST_WORDS, len(a)):
                out[d, i] = score / (al.MATCH * len(a))
    return out


def hard_cases(seed, n=160):
    """Copies with edits of every kind and rate, up to the threshold and beyond."""
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    vocab = common * 30 + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 6, 7, 12, 30, 31, 45])))) for i in range(25)]
    docs = []
    for d in range(n):
        item = rng.choice(items)[1].split()
        kind, w = rng.randrange(6), []
        for p, x in enumerate(item):
            if kind == 0 and p % 3 == 2:
                w.append("other")                       # every third word replaced
            elif kind == 1:
                w += [x, "between"]                     # a word after each
            elif kind == 2 and rng.random() < 0.3:
                w += rng.choice([[], ["new"], [x, "new"], ["new", "new", x]])
            elif kind == 3 and p % 4 == 3:
                w += []                                 # every fourth word lost
            elif kind == 4:
                w += [x] + ["far"] * rng.choice([0, 0, 1, 3])
            else:
                w.append(x)
        around = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        at = rng.randrange(len(around) + 1)
        docs.append((d, " ".join(around[:at] + w + around[at:])))
    docs.append((n, " ".join((items[7][1] + " ") * 300)))     # an item without end
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_no_alignment_above_the_threshold_is_missed(seed):
    docs, items = hard_cases(seed)
    for threshold in (0.5, 0.7):
        some = al.Items(items, threshold)
        texts = {d: np.frombuffer(t.encode(), np.uint8) for d, t in docs}
        words = {d: al.text_words(x, np.array([0, len(x)])) [0] for d, x in texts.items()}
        counts = {}
        for w in words.values():
            for s in np.unique(some.seed[np.unique(al._hits(w, some)[1])]).view(np.int64).tolist():
                counts[s] = counts.get(s, 0) + 1
        some.keep_rare(counts)
        got = {(d, some.ids[i]): score for d, w in words.items() for i, score, *_ in al.leaks_of(w, some)}
        want = all_pairs(docs, items, threshold)
        assert want and got == want


def test_spark_finds_what_all_pairs_find(spark):
    docs, items = hard_cases(9, 80)
    got = {(r.doc_id, r.item_id): r.score for r in al.find_leaks(*frames(spark, docs, items)).collect()}
    assert got == all_pairs(docs, items)


def test_pieces_hold_every_path():
    rng = random.Random(2)
    for _ in range(200):
        n, reach = rng.randrange(1, 400), rng.randrange(2, 12)
        at = np.array(sorted(rng.choices(range(n), k=rng.randrange(1, 60))))
        pieces = list(al._pieces(at, reach, n))
        assert all(0 <= a < b <= n and b - a <= 16 * reach for a, b in pieces)
        for p in at:      # any range of ``reach`` words through p lies in one piece
            for start in range(max(0, p - reach + 1), p + 1):
                end = min(start + reach, n)
                assert any(a <= start and end <= b for a, b in pieces)
