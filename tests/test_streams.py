import json
import os
import time

from wordloom.functions import text as tx
from wordloom.streaming import streams as st


def test_stream_equals_batch(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    schema = "id INT, text STRING"
    rows = [{"id": i, "text": t} for i, t in enumerate(["a  b", "   ", "pt 123-45-6789", "x #y", ""])]
    out, ckpt = f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    for step in range(3):                                        # files arrive in three steps
        with open(f"{src}/part{step}.json", "w") as f:
            for r in rows[step * 2:(step + 1) * 2]:
                f.write(json.dumps(r) + "\n")
        s = st.clean_stream(st.file_stream(spark, src, "json", schema), pipeline="general")
        q = st.write_stream(s, out, ckpt)
        q.awaitTermination()
        time.sleep(0.1)
    got = sorted((r.id, r.text) for r in spark.read.parquet(out).collect())
    batch = spark.read.schema(schema).json(src)
    from pyspark.sql import functions as F
    exp = tx.drop_blank(batch).select("id", tx.general_clean(F.col("text")).alias("text"))
    assert got == sorted((r.id, r.text) for r in exp.collect())
    assert len(got) == 3


def test_stream_metrics_complete_mode(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        for ds, t in [("x", "a b"), ("x", "c"), ("y", "d e f")]:
            f.write(json.dumps({"dataset": ds, "text": t}) + "\n")
    s = st.file_stream(spark, src, "json", "dataset STRING, text STRING")
    res = st.run_to_table(spark, st.dataset_metrics_stream(s, "dataset"), "m", complete=True)
    assert {r.dataset: (r.items, r.total_tokens) for r in res.collect()} == {"x": (2, 3), "y": (1, 3)}


def _files(folder, steps):
    os.makedirs(folder, exist_ok=True)
    for name, rows in steps.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)


def test_run_metrics_have_all_figures(spark, tmp_dir):
    _files(f"{tmp_dir}/in", {
        "a": [{"ds": "x", "text": "a b", "ts": "2024-01-01T00:00:00"}, {"ds": "x", "text": None, "ts": "2024-01-01T00:00:02"}],
        "b": [{"ds": "x", "text": " ", "ts": "2024-01-01T00:00:04"}, {"ds": "x", "text": "c", "ts": "2024-01-01T00:00:01"},
              {"ds": None, "text": "d", "ts": "2024-01-01T00:00:09"}]})
    s = st.file_stream(spark, f"{tmp_dir}/in", "json", "ds STRING, text STRING, ts TIMESTAMP")
    rows = {r.ds: r for r in st.run_to_table(spark, st.dataset_metrics_stream(s, "ds", time_col="ts"), "m", complete=True).collect()}
    x = rows["x"]
    assert (x["items"], x.processed_items, x.failed_items, x.total_tokens, x.mean_tokens) == (4, 2, 2, 3, 1.5)
    assert x.items_per_second == 1.0 and rows[None].items_per_second is None and rows[None].processed_items == 1


def test_a_batch_run_again_changes_nothing(spark, tmp_dir):
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt"))
    schema = "ds STRING, text STRING"

    def run():
        st.write_snapshots(st.dataset_metrics_stream(st.file_stream(spark, src, "json", schema), "ds"), out, ckpt).awaitTermination()
        return sorted(map(tuple, st.read_snapshot(spark, out).collect()))

    _files(src, {"a": [{"ds": "x", "text": "a b"}], "b": [{"ds": "y", "text": "c"}]})
    first = run()
    _files(src, {"c": [{"ds": "x", "text": "d e f"}]})
    want = run()
    assert first != want and st.snapshots(spark, out) == [1, 2]
    # the commit of the last batch is lost: the restarted query runs it once more
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    assert run() == want and st.snapshots(spark, out) == [1, 2]
    # a snapshot that was broken off does not count
    os.makedirs(f"{out}/batch=7")
    assert sorted(map(tuple, st.read_snapshot(spark, out).collect())) == want


def test_vocabulary_changes_within_one_query(spark, tmp_dir):
    from wordloom.operators import bpe, encode, pretokenize as pt
    from wordloom.sources import sinks
    src, out, ckpt, models = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt", "models"))
    text = "aa ab aa ab abab"
    counts = pt.word_counts(spark.createDataFrame([(text,)], "text STRING"))
    small, large = bpe.train_bpe(counts, vocab_size=264), bpe.train_bpe(counts, vocab_size=270)
    sinks.save_model_tables(spark, models, small)
    _files(src, {"a": [{"id": 1, "text": text}]})
    stream = st.file_stream(spark, src, "json", "id INT, text STRING")
    q = st.write_encoded(stream, models, out, ckpt, available_now=False)
    try:
        q.processAllAvailable()
        sinks.save_model_tables(spark, models, large)      # the query runs on
        _files(src, {"b": [{"id": 2, "text": text}]})
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame([(text,)], "text STRING")
    assert [rows[1].vocab_version, rows[2].vocab_version] == [1, 2]
    for i, m in ((1, small), (2, large)):
        assert rows[i].ids == encode.BpeEncoder(m).encode(df).first().ids
    # run again after a loss, the first batch keeps the version that it had
    for name in os.listdir(f"{ckpt}/commits"):
        os.remove(f"{ckpt}/commits/{name}")
    st.write_encoded(stream, models, out, ckpt).awaitTermination()
    assert {r.id: r.vocab_version for r in spark.read.parquet(out).collect()} == {1: 1, 2: 2}


def test_queries_stream_tables_that_are_folders(spark, tmp_dir):
    from wordloom.plans import bpe_queries, bpe_value_queries, stream_queries
    docs = [(i, t, f"s{i % 2}") for i, t in enumerate(["a  b c", "the cat, the hat", "x #y", "pt. 12", "the the"])]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(0, "the cat the hat")], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    clean = {r.doc_id: r.text for r in stream_queries.stream_clean_documents(spark, tmp_dir).collect()}
    assert sorted(clean) == [0, 1, 2, 3, 4] and clean[0] == "a b c"
    metrics = stream_queries.stream_dataset_metrics(spark, tmp_dir).collect()
    assert {(r.source, r["items"]) for r in metrics} == {("s0", 3), ("s1", 2)}
    for stream, batch in ((bpe_value_queries.stream_document_ids, bpe_value_queries.document_ids),
                          (stream_queries.stream_encode_documents, bpe_queries.bpe_encode)):
        assert sorted(stream(spark, tmp_dir).collect()) == sorted(batch(spark, tmp_dir).collect())
