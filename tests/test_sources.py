import gzip
import os

import pytest

from pyspark.sql import functions as F

from wordloom.sources import files, records, sinks


def _write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode + ("b" if isinstance(data, bytes) else "")) as f:
        f.write(data)


def test_text_folder(spark, tmp_dir):
    _write(f"{tmp_dir}/a.txt", "Title: one\nbody")
    _write(f"{tmp_dir}/blank.txt", "   \n")
    _write(f"{tmp_dir}/crlf.txt", "line1\r\nline2\r\n")
    _write(f"{tmp_dir}/sub/nested.txt", "nested")
    _write(f"{tmp_dir}/both.md", "two patterns")
    c = files.text_file_corpus(spark, tmp_dir, "*.txt")
    names = sorted(os.path.basename(r.path) for r in c.collect())
    assert names == ["a.txt", "blank.txt", "crlf.txt"]          # not recursive
    deep = files.text_file_corpus(spark, tmp_dir, "**/*.txt")
    assert "nested.txt" in {os.path.basename(r.path) for r in deep.collect()}
    twice = files.text_file_corpus(spark, tmp_dir, ["*.md", "both.*"])
    assert twice.count() == 2                                     # read once per pattern
    assert files.text_file_corpus(spark, tmp_dir, "*.none").count() == 0
    crlf = [r.text for r in c.collect() if r.path.endswith("crlf.txt")][0]
    assert crlf == "line1\r\nline2\r\n"
    lines = records.line_corpus(c.where(F.col("path").endswith("crlf.txt")))
    assert [r.line for r in lines.collect()] == ["line1", "line2"]


def test_whole_files_without_a_codec_are_read_as_bytes(spark, tmp_dir):
    packed = gzip.compress(b"packed")
    data = {"a.txt": b"\xef\xbb\xbfbom\r\n\n", "bad.txt": b"a\xff\x00b", "x y%.txt": "é".encode(),
            "D.TXT": b"upper", "none": b"no ending", "e.md": b"md", "c.txt.gz": packed, "sub/t.txt": b"deep", "dir.txt/part.gz": packed}
    for name, content in data.items():
        _write(f"{tmp_dir}/{name}", content)

    def read(pattern):
        df = files.text_file_corpus(spark, tmp_dir, pattern).select("path", F.col("text").cast("binary").alias("b"))
        return df._jdf.queryExecution().toString(), sorted(bytes(r.b) for r in df.collect())

    def of(*names):
        return sorted(b"packed" if data[n] == packed else data[n] for n in names)

    plan, texts = read("**/*.txt")
    assert texts == of("a.txt", "bad.txt", "x y%.txt", "sub/t.txt")
    # the text reader copies the Hadoop configuration for every file
    assert "FileScan binaryFile" in plan and "FileScan text" not in plan
    # nor is a condition put to every path where the name filter says it all
    assert "rlike" not in plan.lower() and "rlike" in read("sub/**/t.txt")[0].lower()
    assert read("**/*")[1] == of(*data)
    assert read("*.txt")[1] == of("a.txt", "bad.txt", "x y%.txt", "dir.txt/part.gz")
    assert read("*.gz")[1] == of("c.txt.gz")
    assert read(["*.md", "none", "D.*"])[1] == of("e.md", "none", "D.TXT")


def test_csv_text_column(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", 'id,Text\n1,first\n2,\n3,"multi\nline"\n')
    _write(f"{tmp_dir}/other/b.csv", "id,body\n1,x\n")
    c = files.csv_corpus(spark, tmp_dir, "*.csv").collect()
    assert len(c) == 1 and c[0].text == "first\nmulti\nline"
    n = files.csv_corpus(spark, f"{tmp_dir}/other", "*.csv").collect()
    assert n[0].text is None


def test_csv_header_is_chosen_per_file(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", "id,text\n1,AAA\n")
    _write(f"{tmp_dir}/b.csv", "text,id\nBBB,9\n")
    _write(f"{tmp_dir}/c x.csv", "id,body\n3,CCC\n")
    _write(f"{tmp_dir}/d.csv", 'id,text,more\n4,"say ""hi"" now",x\n5,two,y\n')
    got = {os.path.basename(r.path).replace("%20", " "): r.text for r in files.csv_corpus(spark, tmp_dir).collect()}
    assert got == {"a.csv": "AAA", "b.csv": "BBB", "c x.csv": None, "d.csv": 'say "hi" now\ntwo'}


def test_double_star_anywhere(spark, tmp_dir):
    for p in ("a/b/g.txt", "a/x/b/f.txt", "a/x/y/b/h.txt", "a/x/c/n.txt", "b/o.txt", "a/b/q.csv"):
        _write(f"{tmp_dir}/{p}", p)
    read = lambda pat: sorted(r.text for r in files.text_file_corpus(spark, tmp_dir, pat).collect())
    assert read("a/**/b/*.txt") == ["a/b/g.txt", "a/x/b/f.txt", "a/x/y/b/h.txt"]
    assert read("**/?.txt") == ["a/b/g.txt", "a/x/b/f.txt", "a/x/c/n.txt", "a/x/y/b/h.txt", "b/o.txt"]


def test_admission_and_decoding(spark, tmp_dir):
    _write(f"{tmp_dir}/utf8.txt", "héllo".encode("utf-8"))
    _write(f"{tmp_dir}/latin.txt", b"\xe9A")
    _write(f"{tmp_dir}/bad.txt", b"\xffA")
    _write(f"{tmp_dir}/empty.txt", b"")
    _write(f"{tmp_dir}/blank.txt", b"   ")
    _write(f"{tmp_dir}/big.txt", b"x" * 5000)
    _write(f"{tmp_dir}/image.bin", b"abc")
    _write(f"{tmp_dir}/cut.txt", "aa" + "語" * 600)      # a byte prefix would end inside a character
    _write(f"{tmp_dir}/late.txt", " " * 1100 + "text")
    b = files.read_binary(spark, tmp_dir, "*")
    adm = {os.path.basename(r.path): r.reason for r in files.admit_files(b, max_bytes=4000).collect()}
    assert adm["big.txt"] == "size" and adm["cut.txt"] is None and adm["late.txt"] is None
    assert all(r.reason != "size" for r in files.admit_files(b).collect())
    assert adm["utf8.txt"] is None and adm["latin.txt"] is None
    # zero-length files make no split in Spark's file scan, so never admitted
    assert adm.get("empty.txt", "empty") == "empty" and adm["blank.txt"] == "blank"
    assert adm["image.bin"] == "extension" and adm["bad.txt"] == "encoding"
    dec = {os.path.basename(r.path): r.t for r in
           files.read_binary(spark, tmp_dir, "*.txt").select(
               "path", files.decode_with_fallback(F.col("content")).alias("t")).collect()}
    assert dec["utf8.txt"] == "héllo" and dec["latin.txt"] == "éA" and dec["bad.txt"] == "�A"


def test_json_records_and_descriptors(spark, tmp_dir):
    _write(f"{tmp_dir}/r.jsonl", '{"text": "a"}\n{"content": "c"}\n{"other": 1}\n{"text": ""}\n')
    df = records.read_records(spark, f"{tmp_dir}/r.jsonl")
    got = sorted(r.text for r in records.record_corpus(df).collect())
    assert got == ["a", "c"]
    _write(f"{tmp_dir}/txt/d.txt", "doc")
    desc = [{"name": "j", "type": "huggingface", "config": {"path": f"{tmp_dir}/r.jsonl"}},
            {"name": "t", "type": "local", "config": {"path": f"{tmp_dir}/txt"}},
            {"name": "missing", "type": "local", "config": {"path": f"{tmp_dir}/nope"}}]
    corpus = records.load_corpora(spark, desc, on_error="skip")
    assert [r.dataset for r in records.descriptor_problems(spark, desc).collect()] == ["missing"]
    stats = {r.dataset: (r.n_samples, r.empty) for r in records.corpus_stats(corpus, desc).collect()}
    assert stats == {"j": (2, False), "t": (1, False), "missing": (0, True)}
    import pytest
    with pytest.raises(ValueError):
        records.load_corpora(spark, desc[:1] + desc[:1])
    with pytest.raises(ValueError):
        records.load_corpora(spark, desc, on_error="fail")


def test_sinks_and_versions(spark, tmp_dir):
    df = spark.createDataFrame([(i, "" if i % 3 == 0 else f"t{i}") for i in range(10)], "id INT, text STRING")
    sinks.write_batches(df, f"{tmp_dir}/b", ["id"], 4)
    back = spark.read.parquet(f"{tmp_dir}/b")
    assert sorted((r.id, r.batch_id) for r in back.collect()) == [(1, 0), (2, 0), (4, 1), (5, 1), (7, 1), (8, 2)]
    sinks.write_text_lines(df, f"{tmp_dir}/l")
    assert spark.read.text(f"{tmp_dir}/l").count() == 6
    from wordloom.operators import bpe, pretokenize as pt
    m = bpe.train_bpe(pt.word_counts(df), vocab_size=270)
    root = f"{tmp_dir}/models"
    assert sinks.save_model_tables(spark, root, m) == 1
    assert sinks.save_model_tables(spark, root, m) == 2
    os.makedirs(f"{root}/version=3/vocab")                       # unfinished save: ignored
    v, vocab, merges = sinks.load_model_tables(spark, root)
    assert v == 2
    assert sinks.model_from_tables(vocab, merges).merges == m.merges
    assert sinks.restore_previous(spark, root)[0] == 1


def _tree(folder):
    """{name below its part: content} of all files under ``folder``; nothing temporary may be left."""
    out = {}
    for top, _, names in os.walk(folder):
        for n in names:
            part, _, rest = os.path.relpath(f"{top}/{n}", folder).partition("/")
            assert part.startswith("part-")
            out[rest] = open(f"{top}/{n}", "rb").read()
    return out


def test_processed_copies_keep_folders_and_bytes(spark, tmp_dir):
    texts = {"x/a.txt": "one\ntwo\r\n\n end ", "y/a.txt": "other", "y/b.c.txt": "é\u2028", "y/blank.txt": " \n", "noend": "z" * 70_000}
    for name, t in texts.items():
        _write(f"{tmp_dir}/in/{name}", t)
    corpus = spark.createDataFrame([(f"file://{tmp_dir}/in/{n}", t) for n, t in texts.items()] + [(f"{tmp_dir}/in/null.txt", None)],
                                   "path STRING, text STRING")
    sinks.write_processed_copies(corpus.repartition(3), f"file:{tmp_dir}/out", f"file:{tmp_dir}/in/")
    assert _tree(f"{tmp_dir}/out") == {
        "x/a_processed.txt": texts["x/a.txt"].encode(), "y/a_processed.txt": b"other",
        "y/b.c_processed.txt": texts["y/b.c.txt"].encode(), "noend_processed.txt": b"z" * 70_000}


def test_item_files_names_bytes_and_aborts(spark, tmp_dir):
    rows = [("a.txt", b"1"), ("a.txt", b"2"), ("../a.txt", b"3"), (None, b""), ("d/e", None)]
    df = spark.createDataFrame(rows, "n STRING, c BINARY").coalesce(1)
    sinks.write_item_files(df, f"{tmp_dir}/out", "n", "c")
    assert _tree(f"{tmp_dir}/out") == {"a.txt": b"1", "a~2.txt": b"2", "a~3.txt": b"3", "unnamed": b"", "d/e": b""}
    # a task that fails leaves nothing
    import pyspark.sql.functions as F
    bad = df.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("stop"))).otherwise(F.col("n")))
    with pytest.raises(Exception):
        sinks.write_item_files(bad, f"{tmp_dir}/bad", "n", "c")
    assert not os.path.exists(f"{tmp_dir}/bad") or not os.listdir(f"{tmp_dir}/bad")
    sinks.write_item_files(df.where("false"), f"{tmp_dir}/none", "n", "c")
    assert _tree(f"{tmp_dir}/none") == {}


def test_qa_splits_report_their_failures(spark, tmp_dir):
    good = '{"question": "q%d", "context": null, "answers": {"text": ["a%d"]}}'
    _write(f"{tmp_dir}/one/train.jsonl", "\n".join([good % (1, 1), '{"question": "q2", "answ', good % (3, 3), "no json"]))
    _write(f"{tmp_dir}/one/test.jsonl", '{"question": " ", "context": "c"}\n{"context": "c"}')
    _write(f"{tmp_dir}/two/train.jsonl", '{"question": "only", "extra": 5}')
    rows, bad = records.scan_qa_splits(spark, {
        "one": {"train": f"{tmp_dir}/one/train.jsonl", "test": f"{tmp_dir}/one/test.jsonl"},
        "two": {"train": f"{tmp_dir}/two/train.jsonl", "test": f"{tmp_dir}/two/none.jsonl"}})
    assert sorted((r.dataset, r.split, r.question, r.answers.text if r.answers else None) for r in rows.collect()) == [
        ("one", "train", "q1", ["a1"]), ("one", "train", "q3", ["a3"]), ("two", "train", "only", None)]
    got = {(r.dataset, r.split, r.reason): (r.n, r.example) for r in bad.collect()}
    assert got == {("one", "train", "not a record"): (2, "no json"), ("one", "test", "no question"): (2, "c"),
                   ("two", "test", "no such path"): (0, f"{tmp_dir}/two/none.jsonl")}
    rows, bad = records.scan_qa_splits(spark, {"x": {"y": f"{tmp_dir}/nothing"}})
    assert rows.count() == 0 and bad.count() == 1


def test_text_folder_query_keeps_every_source(spark, tmp_dir):
    from wordloom.plans import file_queries as q
    rows = [(i, s, t) for i, (s, t) in enumerate([("a/b:c", "x\n y"), (None, "null source"), ("", "empty"), ("é%2F", "same"), ("é%2F", "same"), ("s", None)])]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    want = sorted(((s, t) for _, s, t in rows if t is not None), key=str)
    assert sorted(((r.source, r.text) for r in q.text_folder_corpus(spark, tmp_dir).collect()), key=str) == want
    copies = {(r.doc_id, r.source, r.text) for r in q.processed_copies(spark, tmp_dir).collect()}
    assert copies == {r for r in rows if r[2] is not None}


def test_processed_copies(spark, tmp_dir):
    _write(f"{tmp_dir}/in/a.txt", "alpha")
    _write(f"{tmp_dir}/in/b.txt", "  ")
    corpus = files.text_file_corpus(spark, f"{tmp_dir}/in", "*.txt")
    sinks.write_processed_copies(corpus, f"{tmp_dir}/out", f"{tmp_dir}/in")
    assert _tree(f"{tmp_dir}/out") == {"a_processed.txt": b"alpha"}
    dec = files.decoded_files(spark, f"{tmp_dir}/in", "*.txt").collect()
    assert [r.text for r in dec] == ["alpha"]


def test_csv_queries_keep_every_source(spark, tmp_dir):
    from wordloom.plans import file_queries as q
    sources = [None, "", "site", "site1", "a/b c=%é", "7"]
    rows = [(i, sources[i // 2 % 6] if i < 60 else "site1", f'text "{i}",\nmore') for i in list(range(60)) + list(range(4090, 4100))]
    rows += [(9000, None, None), (9001, "only blank", "")]
    rows += [(None, "site", "no number")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    whole, blocks = {}, {}
    for i, source, text in rows:
        if text:
            whole.setdefault(source, []).append(text)
            blocks.setdefault((source, None if i is None else i // 4096), []).append(text)
    got = [(r.source, r.text) for r in q.csv_corpora(spark, tmp_dir).collect()]
    assert len(got) == len(whole) and dict(got) == {k: "\n".join(v) for k, v in whole.items()}
    got = [((r.source, r.block), r.text) for r in q.csv_corpora_files(spark, tmp_dir).collect()]
    assert len(got) == len(blocks) and dict(got) == {k: "\n".join(v) for k, v in blocks.items()}


def test_types_from_content(spark):
    files_ = [("a.txt", b"%PDF-1.4 x", "application/pdf"), ("a.txt", b"\x89PNG\r\n\x1a\nxx", "image/png"), ("a.txt", b"PK\x03\x04x", "application/zip"),
              ("a.txt", b"text\x00more", "application/octet-stream"), ("a.txt", b"\xef\xbb\xbf <!DOCTYPE html><p>", "text/html"),
              ("a.txt", b" <HTML lang=x>", "text/html"), ("a.txt", b"<htmlx", "text/plain"), ("a.txt", b"<?xml version='1'?>", "application/xml"),
              ("a.json", b'{"a": [1]}\n', "application/json"), ("a.json", b"[1, 2]", "application/json"), ("a.json", b"{broken", "text/plain"),
              ("a.jsonl", b'{"a": 1}\n{"a": 2}\n', "application/json"), ("A.CSV", b"a,b\n1,2", "text/csv"), ("a.txt", "café {x}".encode("latin-1"), "text/plain"),
              ("a.txt", b"", "text/plain"), ("a.txt", None, None)]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(files_)], "i INT, path STRING, content BINARY") \
        .selectExpr("*", "coalesce(octet_length(content), 0) as length")
    got = {r.i: r.m for r in df.select("i", files.mime_type(df.content, df.path).alias("m")).collect()}
    assert [got[i] for i in range(len(files_))] == [k for _, _, k in files_]
    reasons = {r.i: r.reason for r in files.admit_files(df, mimetypes=files.ALLOWED_MIMETYPES).collect()}
    assert reasons[0] == reasons[4] == "mimetype" and reasons[8] is None and reasons[12] is None and reasons[14] == "empty"
    assert {r.i: r.reason for r in files.admit_files(df).collect()}[4] is None


def test_csv_parts_are_bounded_and_headers_may_have_newlines(spark, tmp_dir):
    values = [f'value {i}, with "quotes"\nand a line' + "x" * (i % 50) for i in range(500)]
    quoted = ['"' + v.replace('"', '""') + '"' for v in values]
    _write(f"{tmp_dir}/a.csv", '﻿"first\nname","more ""x""",TEXT,z\r\n' + "".join(f"{i},,{q},\r\n" for i, q in enumerate(quoted)))
    _write(f"{tmp_dir}/b.csv", "\n\nText,text\nq,r\n,\n\"\",s\n")
    _write(f"{tmp_dir}/c.csv", "a\n1\n")
    _write(f"{tmp_dir}/d.csv", "text\n")
    _write(f"{tmp_dir}/e.csv", "")
    _write(f"{tmp_dir}/f.csv", "text")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)      # a split of the file is no end of it
    try:
        parts = files.csv_corpus_parts(spark, tmp_dir, part_chars=2000).collect()
        whole = {os.path.basename(r.path): r.text for r in files.csv_corpus(spark, tmp_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == {"a.csv": "\n".join(values), "b.csv": "q", "c.csv": None, "d.csv": None, "f.csv": None}
    own = sorted((r.part, r.text) for r in parts if r.path.endswith("a.csv"))
    assert [p for p, _ in own] == list(range(len(own))) and len(own) > 10
    assert "\n".join(t for _, t in own) == "\n".join(values) and max(len(t) for _, t in own) < 2200


def test_two_writers_write_two_versions(spark, tmp_dir):
    from wordloom.operators import bpe, pretokenize as pt
    root = f"{tmp_dir}/models"
    m = bpe.train_bpe(pt.word_counts(spark.createDataFrame([("ab ab",)], "text STRING")), vocab_size=264)
    assert sinks._claimed(spark, f"{root}/version=1/_CLAIMED")       # another writer is at it, or broke off
    assert sinks.save_model_tables(spark, root, m) == 2
    assert sinks.committed_versions(spark, root) == [2] and not sinks._claimed(spark, f"{root}/version=2/_CLAIMED")


def test_many_small_files_are_read_by_few_tasks(spark, tmp_dir):
    from pyspark.sql import functions as F
    for i in range(300):
        with open(f"{tmp_dir}/{i}.txt", "w") as f:
            f.write(f"text {i}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")      # a file opened counts as 4 MB: one file a partition
        df = files.text_file_corpus(spark, tmp_dir)
        assert df.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
        assert sorted(r.text for r in df.collect()) == sorted(f"text {i}" for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_list_of_the_files_of_a_tree_is_held(spark, tmp_dir, monkeypatch):
    """Spark's listing kept the status of every file in the driver."""
    monkeypatch.setattr(files, "TREE_FILES", 100)
    for i in range(400):
        _write(f"{tmp_dir}/in/{i % 5}/{i % 3}/{i}.txt", f"text {i}")
    df = files.text_file_corpus(spark, f"{tmp_dir}/in", "**/*.txt")
    assert not [f for f in df.inputFiles() if f.endswith(".txt")] and df.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
    assert sorted((r.path, r.text) for r in df.collect()) == sorted(
        (f"file:{tmp_dir}/in/{i % 5}/{i % 3}/{i}.txt", f"text {i}") for i in range(400))


def test_files_of_a_tree_are_those_that_spark_lists(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(files, "TREE_FILES", 0)
    top = f"{tmp_dir}/a%b c"
    names = ["a b.txt", "c%20d.txt", "é#?.txt", "_hid.txt", "_k=v.txt", "_metadata.txt", ".dot.txt", "p+q;&.txt", 'br[]{}^`|\\"<>.txt',
             "nb\u00a0sp\u2028\x85.txt", "x.txt._COPYING_", "x.md", "_sub/a.txt", "_metadata/a.txt", "g h/a.txt", "e/f/g/a.txt", ".h/a.txt", "x=1/a.txt"]
    for n in names:
        _write(f"{top}/{n}", n)
    _write(f"{top}/empty.txt", "")
    with open(f"{top}/bytes.txt", "wb") as f:
        f.write(b"\xff\xfe a")
    os.symlink(f"{top}/g h", f"{top}/link")
    os.symlink(f"{top}/nothing", f"{top}/gone.txt")
    rows = lambda root, pattern: sorted(tuple(r) for r in files.text_file_corpus(spark, root, pattern).selectExpr(
        "path", "hex(cast(text as binary))").collect())
    for root, pattern in ((top, "**/*.txt"), (f"file:{top}/", "**/a.txt"), (tmp_dir, "**/*.none.txt"), (f"{top}/none", "**/*.txt")):
        got = rows(root, pattern)
        with monkeypatch.context() as m:
            m.setattr(files, "_tree_files", lambda *_: None)
            assert got == rows(root, pattern)
    assert len(rows(top, "**/*.txt")) == 13


def test_processed_copies_remove_the_files_they_are_made_of(spark, tmp_dir, monkeypatch):
    """Two files of every document stood on the disk at once."""
    from wordloom.plans import file_queries as q
    rows = [(i if i % 9 else None, None if i % 4 == 0 else f"s/{i % 3}", f"text {i % 50}\r\n") for i in range(200)] + [(1, "s", " "), (2, "s", None)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(files, "TREE_FILES", 10)
    made = []
    monkeypatch.setattr(q, "shared_dir", lambda spark, name: made.append(f"{tmp_dir}/{name}-{len(made)}") or made[-1])
    got = sorted(map(str, ((r.doc_id, r.source, r.text) for r in q.processed_copies(spark, tmp_dir).collect())))
    assert got == sorted(map(str, rows[:200]))
    assert [p for p in made if os.path.exists(p)] == [p for p in made if "copies" in p] and len(made) > 1
