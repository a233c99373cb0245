import collections

import numpy as np
from wordloom.llm import sharding


def docs(spark, n):
    rows = [(i % 7 if i % 3 else None, "x" * (i % 5), i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, SHARD int").repartition(5)


def test_sizes_slots_and_rows(spark):
    for n in (0, 1, 15, 500):
        got = sharding.shuffle_into_shards(docs(spark, n)).collect()
        assert len(got) == n
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_matrix_margins_and_law():
    counts, sizes = [40, 0, 17, 103], [40, 40, 40, 40]
    seen = []
    for seed in range(400):
        m = np.array(sharding.communication_matrix(counts, sizes, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and m.min() >= 0
        seen.append(m[0, 0])
    # 40 rows into 40 of 160 places: mean 10, variance 40*.25*.75*120/159
    assert abs(np.mean(seen) - 10) < 0.7 and 3.8 < np.var(seen) < 7.8


def test_large_population_draw():
    rng = np.random.default_rng(3)
    x = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(x) - 750_000) < 150 and 250 < np.std(x) < 620


def test_shuffle_is_uniform(spark):
    import itertools
    hits = collections.Counter()
    df = spark.range(4).toDF("doc_id").coalesce(2)
    for seed in range(48):
        r = sharding.shuffle_into_shards(df, shards=2, seed=seed).orderBy("shard", "slot").collect()
        hits[r[0].doc_id] += 1
    assert set(hits) == set(range(4)) and max(hits.values()) < 28
    assert len(list(itertools.chain(hits.elements()))) == 48


def test_query_against_brute_force(spark, tmp_dir):
    import zlib
    texts = [None, "", "a", "é日", "a", "long " * 5000] * 7
    rows = [(i if i % 5 else None, t, "x", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, law string, AT long").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    got = sharding.op5_sharding(spark, tmp_dir).collect()
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in [(r[0] if r[0] is not None else -1, *r[1:]) for r in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
