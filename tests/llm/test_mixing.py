import collections

import pytest
from wordloom.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
    return target


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, Target string")


@pytest.mark.parametrize("shape", [
    {"a": 500, "b": 20, "c": 5, "d": 90, None: 40}, {"a": 3}, {"b": 50, "B": 50, "é": 1, "z": 1}, {None: 30, "": 70}])
def test_targets_and_words_taken(spark, shape):
    rows, i = [], 0
    for s, n in shape.items():
        for k in range(n):
            rows.append((i if i % 11 else None, None if k % 13 == 5 else "w\tv\x0b " * (k % 6 + (k % 17 == 3)), s, "x"))
            i += 1
    rows += [rows[0]] * 4
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    got = mixing.mix_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r._size and r.taken == r.copies * r._size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert t - 16 <= taken[s] <= t + 1e-6, (s, taken[s], t)
    again = mixing.mix_documents(docs(spark, rows[::-1])).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    got = mixing.mix_documents(docs(spark, [(1, "", "a", ""), (2, None, None, "")])).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]
