import collections
import random

import corpus_pipeline as cp
from wordloom.llm.common import read


def make(spark, folder):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(800)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = prose(25)
    docs, labels, toxic, leak, near = [], [], set(), set(), {}
    for i in range(240):
        w, s = prose(rng.randrange(30, 90)), ["a", "b", "c", None][i % 4]
        if i % 6 == 0:
            w.insert(5, ["idiot", "scum", "moron"][i // 6 % 3])
            toxic.add(i)
        elif i % 24 == 1:
            w[9:9] = item
            leak.add(i)
        elif i % 24 == 7:
            w = docs[i - 3][1].split() + ["tail"]
            near[i] = i - 3
        docs.append((i, " ".join(w), "en", s, 0))
        labels.append((i, 1, int(i in toxic)))
    docs += [(300, None, "en", "a", 0), (301, "", "en", "a", 0), (None, "only words here", "en", None, 0), (2, docs[2][1], "en", "c", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return toxic, leak, near


def test_stages(spark, tmp_dir):
    folder = f"{tmp_dir}/in"
    toxic, leak, near = make(spark, folder)
    docs = read(spark, folder, "documents")
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    columns, everything = docs.columns, ids(docs)
    out = {}
    for name, stage in cp.STAGES:
        path = f"{tmp_dir}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = ids(docs)
        if name != "sharding":
            assert docs.columns == columns
    assert set(everything) - set(out["toxicity"]) == toxic
    dropped = set(out["toxicity"]) - set(out["near_duplicates"])
    assert dropped == {i for i, o in near.items() if o not in toxic}
    assert max(out["near_duplicates"].values()) == 1 and {300, 301, None} <= set(out["near_duplicates"])
    assert set(out["near_duplicates"]) - set(out["decontamination"]) == leak - toxic
    assert set(out["mixing"]) <= set(out["decontamination"]) and max(out["mixing"].values()) <= 3
    assert out["sharding"] == out["mixing"]
    sizes = collections.Counter(r.shard for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_and_empty_documents(spark, tmp_dir):
    folder = f"{tmp_dir}/in"
    make(spark, folder)
    empty = f"{tmp_dir}/empty"
    for t in ("labels", "benchmark"):
        read(spark, folder, t).write.parquet(f"{empty}/{t}.parquet")
    read(spark, folder, "documents").limit(0).write.parquet(f"{empty}/documents.parquet")
    assert cp.run(spark, empty).count() == 0
