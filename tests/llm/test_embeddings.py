import math

import numpy as np
import pytest
from wordloom.llm import embeddings as emb


def brute(rows, threshold=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64) / max(abs(x) for x in v)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]):
                c = ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b])
                if c >= threshold:
                    links[a].add(b)
    return links


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, VECTOR string")


def check(spark, rows):
    links = brute(rows)
    got = emb.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        want.append((i, len(links[k]), low, i == low))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(emb, "TILE", 16)
    monkeypatch.setattr(emb, "STRIP", 7)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        base = rng.normal(size=12)
        for j in range(rng.integers(1, 4)):
            rows.append((len(rows), (base + rng.normal(size=12) * rng.choice([0.0, 0.3, 0.5])).tolist()))
    hot = rng.normal(size=12).tolist()
    rows += [(len(rows) + k, hot) for k in range(30)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [math.nan] + [1.0] * 11), (n + 4, [None] + [1.0] * 11),
             (n + 5, [math.inf] * 12), (n + 6, [1.0] * 5), (n + 7, [2.0] * 5), (None, [0.0]), (n + 8, [3e38] * 12),
             (n + 9, [1e-38] * 12)]
    check(spark, rows)


def test_empty_and_all_invalid(spark):
    check(spark, [])
    check(spark, [(1, None), (2, [0.0])])


@pytest.mark.parametrize("block", [1, 3])
def test_partners_over_blocks(spark, monkeypatch, block):
    """Pairs of tiles that meet in several blocks are those of one block, each once."""
    monkeypatch.setattr(emb, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(6)[i % 6] + rng.normal(size=6) * 0.15).tolist()) for i in range(120)]
    monkeypatch.setattr(emb, "PARTNER_TILES", block)
    check(spark, rows)


def test_products_of_many_dimensions_are_exact():
    """Beyond the dimensions that float32 adds exactly, sums of parts stay whole numbers."""
    rng = np.random.default_rng(1)
    base = rng.choice([-1.0, 1.0], 4096)
    x = emb.unit(np.stack([base * (1 + 1e-3 * k * rng.choice([0, 1], 4096)) for k in range(40)]))
    side = (x, *emb.quantise(x))
    exact = x @ x.T
    for threshold in np.sort(exact[np.triu_indices(40, 1)])[::97]:
        got = {(int(i), int(j)) for p, r in emb.linked_pairs(side, side, threshold, True) for i, j in zip(p, r)}
        assert {p for p in zip(*np.nonzero(np.triu(exact >= threshold + 1e-12, 1)))} <= got
        assert all(exact[i, j] >= threshold - 1e-12 for i, j in got)


def test_double_precision_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81) - 1e-9]), (3, [0.9, math.sqrt(1 - 0.81) + 1e-9]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in emb.near_duplicates(df).collect()}
    want = {rows[k][0]: len(v) for k, v in brute(rows).items()}
    assert got == want


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_error_bound_holds(dims):
    rng = np.random.default_rng(dims)
    x = emb.unit(rng.normal(size=(60, dims)) * rng.lognormal(0, 2, size=(60, dims)))
    q, s, length, err = emb.quantise(x)
    assert q.dtype == np.int8
    approx = (q.astype(np.int64) @ q.astype(np.int64).T) * s[:, None] * s[None, :]
    bound = length[:, None] * err[None, :] + err[:, None]
    assert (np.abs(x @ x.T - approx) <= bound + 1e-12).all()
    side = (x, q, s, length, err)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.5}
    got = {(int(i), int(j)) for p, r in emb.linked_pairs(side, side, 0.5, True) for i, j in zip(p, r)}
    assert got == want
