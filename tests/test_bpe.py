import random

import pytest
from pyspark.sql import functions as F

from bpe_reference import train_bpe_local
from wordloom.operators import bpe, encode, pretokenize as pt


def _corpus(seed, n_words=300):
    rnd = random.Random(seed)
    letters = "abcde" if seed % 2 else "aab"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(40)]
    return " ".join(rnd.choice(words) for _ in range(n_words))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_training_in_rounds_equals_one_at_a_time(spark, seed):
    text = _corpus(seed)
    df = spark.createDataFrame([(text,)], "text STRING")
    counts = pt.word_counts(df)
    local = {r.token: r.n for r in counts.collect()}
    m = bpe.train_bpe(counts, vocab_size=263 + 60, min_frequency=2, first_active=2, run_symbols=40)
    ref = train_bpe_local(local, 263 + 60, 2)
    assert m.merges == ref.merges
    assert m.merge_counts == ref.merge_counts


def test_observed_alphabet_and_vocab_ids(spark):
    df = spark.createDataFrame([("ab ab ab abc",)], "text STRING")
    m = bpe.train_bpe(pt.word_counts(df), vocab_size=30, alphabet="observed")
    assert m.alphabet == sorted(["20", "61", "62", "63"])
    ids = m.token_ids()
    assert min(ids.values()) == 7 and m.vocab_size <= 30


def test_encode_matches_local_and_roundtrip(spark):
    texts = ["hello world, hello spark", "naïve café 123", "  spaced\ttext\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    m = bpe.train_bpe(pt.word_counts(df), vocab_size=263 + 20, min_frequency=1)
    enc = encode.BpeEncoder(m)
    out = enc.encode(df, "text", "ids")
    out = out.withColumn("back", enc.decode_column(F.col("ids"))).orderBy("id").collect()
    ranks, ids = m.ranks(), m.token_ids()
    import regex
    pat = regex.compile(pt.GPT2_PATTERN.replace("(?U)", ""))
    for r in out:
        t = r.text if r.text.startswith(" ") else " " + r.text
        exp = [ids[s] for tok in pat.findall(t) for s in encode._bpe_symbols(tok, ranks)]
        assert r.ids == exp
        assert r.back == t


def test_pretokens_match_public_library(spark):
    tk = pytest.importorskip("tokenizers")
    from tokenizers.pre_tokenizers import ByteLevel
    texts = ["Hello world's 12 apples!!  ok", "tabs\tand\nnew lines  end ", "äöü ß 3.14"]
    pre = ByteLevel(add_prefix_space=True, use_regex=True)
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    ours = [r.p for r in df.select(pt.pretokens(F.col("text")).alias("p")).collect()]
    byte_map = {c: b for b, c in _bytes_to_unicode().items()}
    for t, mine in zip(texts, ours):
        theirs = [bytes(byte_map[c] for c in s).decode() for s, _ in pre.pre_tokenize_str(t)]
        assert mine == theirs
    assert tk


def _bytes_to_unicode():
    bs = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    cs = bs[:]
    n = 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    return {b: chr(c) for b, c in zip(bs, cs)}


def test_routed_batches(spark):
    from wordloom.operators import qa
    rows = [(i, "short text " * (1 if i < 4 else 600)) for i in range(8)]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    m = bpe.train_bpe(pt.word_counts(df), vocab_size=280)
    out = qa.encode_batches(df, encode.BpeEncoder(m), key="id", batch_size=4, max_length=50).collect()
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch_id, set()).add((r.route, len(r.ids), r.causal_width))
    assert len(by_batch[0]) == 1                                  # one width per batch
    route, _, causal = next(iter(by_batch[0]))
    assert route == "bi" and causal is None                      # short texts: bidirectional
    assert {x[0] for x in by_batch[1]} == {"auto"}
    assert all(x[1] == 50 and x[2] == 50 for x in by_batch[1])


@pytest.mark.parametrize("seed", range(3))
def test_bounds_do_not_change_the_merges(spark, seed):
    """Few pairs known of each bucket, runs bounded to a few symbols, and the defaults."""
    counts = pt.word_counts(spark.createDataFrame([(_corpus(seed),)], "text STRING"))
    ref = train_bpe_local({r.token: r.n for r in counts.collect()}, 263 + 40, 2)
    rounds = []
    for bounds in ({}, {"first_active": 3, "run_symbols": 4, "first_pairs": 1}):
        m = bpe.train_bpe(counts, vocab_size=263 + 40, **bounds)
        assert (m.merges, m.merge_counts) == (ref.merges, ref.merge_counts)
        rounds.append(m.rounds)
    assert 0 < rounds[0] < rounds[1]


def test_training_leaves_nothing_behind(spark):
    import os
    from wordloom.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    bpe.train_bpe(pt.word_counts(spark.createDataFrame([(_corpus(1),)], "text STRING")), vocab_size=300, alphabet="observed")
    assert set(os.listdir(base)) == before


def test_no_words_and_null_tokens(spark):
    df = spark.createDataFrame([(None, 5), ("", 3), ("a", 9)], "token STRING, n BIGINT")
    m = bpe.train_bpe(df, vocab_size=300)
    assert m.merges == [] and m.vocab_size == 263
    assert bpe.train_bpe(df.where("false"), vocab_size=300).merges == []
    m = bpe.train_bpe(df.union(spark.createDataFrame([("ab", 2), ("\u00e9", 1)], df.schema)), vocab_size=300)
    assert m.merges == [("61", "62")] and m.merge_counts == [2]


def test_queries_train_until_no_pair_is_frequent(spark):
    from wordloom.plans import bpe_queries
    m = bpe_queries.trained_model(spark, "/root/testdata/sf0.001")
    more = bpe.train_bpe(pt.word_counts(bpe_queries.tok_docs(spark, "/root/testdata/sf0.001")),
                         vocab_size=10**6)
    assert len(m.merges) > 120 and m.merges == more.merges[:len(m.merges)]
    assert m.vocab_size == min(60_000, more.vocab_size)
    assert bpe_queries.bpe_merges(spark, "/root/testdata/sf0.001").count() == len(m.merges)


def test_encoding_queries_return_whole_ids(spark):
    from wordloom.plans import bpe_queries, stream_queries
    sf = "/root/testdata/sf0.001"
    whole = {r.doc_id: r.ids for r in bpe_queries.bpe_encode(spark, sf).collect()}
    assert {r.doc_id: r.ids for r in stream_queries.stream_encode_documents(spark, sf).collect()} == whole
    routed = bpe_queries.routed_batches(spark, sf).collect()
    assert len(routed) == len(whole) and max(r.width for r in routed) > 256
    for r in routed:
        ids = r.ids[1:-1].split(",")
        own = [x for x in whole[r.doc_id][1:-1].split(",") if x]
        assert len(ids) == r.width and ids[:len(own)] == own and len(set(ids[len(own):])) <= 1
    for r in bpe_queries.qa_encoded(spark, sf).limit(50).collect():
        assert r.input_ids.count(",") + 1 == r.n_input and r.decoder_input_ids.count(",") + 1 == r.n_target


def test_join_encoding_equals_shipped(spark, monkeypatch):
    texts = ["the cat sat on the mat the end", None, "", "the", "naïve café 123 the\tthe\n", "x" * 60, "the cat sat on the mat the end"] + [
        _corpus(s, 40) for s in range(4)]
    df = spark.createDataFrame([(i % 3, t, -1, "k") for i, t in enumerate(texts)], "_row INT, text STRING, token INT, _Hot STRING")
    for alphabet in ("full", "observed"):
        some = df.limit(5) if alphabet == "observed" else df
        m = bpe.train_bpe(pt.word_counts(some), vocab_size=263 + 40, min_frequency=1, alphabet=alphabet)
        for unk in (None, 3):
            want = encode.BpeEncoder(m, unk_id=unk).encode(df, "text", "ids")
            enc = encode.BpeEncoder(m, unk_id=unk, ship_up_to=0)
            for share in (1 / 1000, 1.0):     # nearly all pre-tokens hot, none
                monkeypatch.setattr(encode, "HOT_SHARE", share)
                got = enc.encode(df, "text", "ids")
                assert got.columns == want.columns
                assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        enc.encode_column(F.col("text"))
    shipped = encode.BpeEncoder(m, unk_id=3)
    back = want.select("_row", "ids", F.lit("old").alias("text"))
    assert sorted(map(repr, enc.decode(back).collect())) == sorted(map(repr, shipped.decode(back).collect()))
    assert enc.encode(df.where("false"), "text", "ids").count() == 0


def test_join_encoding_combines_before_it_joins(spark):
    m = bpe.train_bpe(pt.word_counts(spark.createDataFrame([(_corpus(1),)], "text STRING")), vocab_size=280)
    df = spark.createDataFrame([(1, "a b a b a")], "id INT, text STRING")
    got = encode.BpeEncoder(m, ship_up_to=0).encode(df, "text", "ids")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # a row's pre-tokens are exploded with their places already combined, and vocabulary joins stand over distinct tokens
    assert "places(" in plan and plan.index("Join") > plan.index("Aggregate")


def test_many_words_at_once_equal_one_by_one():
    import numpy as np
    rng = random.Random(11)
    for seed in range(40):
        letters = rng.choice(["ab", "abc", "aé "])
        made = {}
        for _ in range(rng.randrange(1, 25)):    # merges in any order, some of which make one token twice
            known = [x.encode().hex().upper() for x in letters] + [a + b for a, b in made]
            made.setdefault((rng.choice(known), rng.choice(known)), len(made))
        ids = {t: 7 + i for i, t in enumerate(dict.fromkeys([f"{b:02X}" for b in range(90, 200)] + [a + b for a, b in made]))}
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 12, 40]))).encode() for _ in range(60)] + [b"a" * 700]
        for unk in (None, 1):
            merger = encode.WordMerger(made, ids, unk)
            flat, n = merger.encode(words)
            want = [[i for s in encode._bpe_symbols(w, made) if (i := ids.get(s, unk)) is not None] for w in words]
            assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    flat, n = encode.WordMerger({}, {"61": 5}, None).encode([b"aa", b"b"])
    assert flat.tolist() == [5, 5] and n.tolist() == [2, 0] and isinstance(flat, np.ndarray)


def test_columns_are_worked_on_in_stretches():
    import pyarrow as pa
    from wordloom.operators.encode import _by_stretches
    rows = [None, [], [1, 2, 3], [4] * 9, None, [5], [6, 7], []] * 40
    seen = []

    def use(col):
        seen.append((len(col), sum(len(x or []) for x in col.to_pylist())))
        return col

    for col in (pa.array(rows, pa.list_(pa.int32())), pa.array([[0]] + rows, pa.list_(pa.int32())).slice(1)):
        seen.clear()
        assert _by_stretches(col, 5, col.type, use).to_pylist() == rows
        assert all(n <= 5 or k == 1 for k, n in seen) and len(seen) > 40
    assert _by_stretches(pa.array([], pa.list_(pa.int32())), 5, pa.list_(pa.int32()), use).to_pylist() == []


def test_long_batches_round_trip(spark):
    """One Arrow batch of far more pre-tokens than are worked on at once."""
    df = spark.range(600).selectExpr("id", "case when id % 7 = 0 then null else repeat(concat('tok', id % 50, ' ä '), 700) end as text").coalesce(1)
    from wordloom.operators import bpe, encode, pretokenize
    enc = encode.BpeEncoder(bpe.train_bpe(pretokenize.word_counts(df), vocab_size=300, min_frequency=2))
    d = enc.encode(df, "text", "ids").select("text", enc.decode_column(F.col("ids")).alias("back"), enc.tokens_column(F.col("ids")).alias("t"))
    assert d.where("text is null and back is not null or text is not null and back <> concat(' ', text)").count() == 0
    assert d.where("text is not null and array_join(t, '') not like '% tok%'").count() == 0


def test_encoding_by_join_places_the_pretokens_once(spark):
    """The pre-tokens' places, a Python step over all rows, were made four times."""
    df = spark.createDataFrame([(0, "the cat the hat"), (1, None), (2, ""), (3, "the cat the hat")], "k int, text string")
    model = bpe.train_bpe(pt.word_counts(df), vocab_size=280, min_frequency=2)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        made.add(1)
        return t

    d = df.coalesce(1).withColumn("text", seen.asNondeterministic()("text"))
    out = encode.BpeEncoder(model, ship_up_to=0).encode(d, "text", "ids")
    want = {(r.k, str(r.ids)) for r in encode.BpeEncoder(model).encode(df, "text", "ids").collect()}
    assert {(r.k, str(r.ids)) for r in out.collect()} == want
    assert made.value <= 3 * df.count()


def _dealt_rows(df):
    """Rows that the exchanges of the plan have written, once it has run."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    waits = [plan]
    while waits:
        p = waits.pop()
        name = p.nodeName()
        if name == "Exchange":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        waits += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else []
        waits += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_encoding_by_join_deals_out_no_pretokens(spark):
    """Every (row, pre-token) pair was dealt out twice, with the row's text: more disk than the input by far."""
    rows = [(i, " ".join(f"w{j}x{(i * j) % 97}" for j in range(150))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(2)
    model = bpe.train_bpe(pt.word_counts(df), vocab_size=320, min_frequency=2)
    want = {(r.k, str(r.ids)) for r in encode.BpeEncoder(model).encode(df, "text", "ids").collect()}
    out = encode.BpeEncoder(model, ship_up_to=0).encode(df, "text", "ids", carry=["k"])
    assert out.columns == ["k", "ids"] and {(r.k, str(r.ids)) for r in out.collect()} == want
    assert _dealt_rows(out) < 10 * df.count()


def test_blocks_of_any_size_give_the_same_ids(spark, monkeypatch):
    texts = [None, "", "the cat the hat", "a" * 300, None, "naïve café 123", "the end " * 40, "the cat the hat"] * 5
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "k int, text string").coalesce(1)
    model = bpe.train_bpe(pt.word_counts(df), vocab_size=300, min_frequency=2)
    want = sorted(str((r.k, r.text, r.ids)) for r in encode.BpeEncoder(model).encode(df, "text", "ids").collect())
    for most in (1, 7, 50):
        monkeypatch.setattr(encode, "BLOCK_PLACES", most)
        got = encode.BpeEncoder(model, ship_up_to=0).encode(df, "text", "ids")
        assert sorted(str((r.k, r.text, r.ids)) for r in got.collect()) == want


def test_places_are_packed_and_unpacked():
    import numpy as np
    rng = random.Random(5)
    rows = [[rng.randrange(rng.choice([2, 128, 129, 1 << 14, (1 << 14) + 1, 1 << 21, 1 << 30])) for _ in range(rng.choice([0, 1, 9]))] for _ in range(200)]
    for some in (rows, [], [[]], [[127, 128, 16383, 16384, 2097151, 2097152]]):
        ends = np.cumsum([len(r) for r in some]).astype(np.int64)
        cells = encode._packed(np.array([x for r in some for x in r], np.int64), ends).to_pylist()
        numbers, size = encode._unpacked(cells)
        assert numbers.tolist() == [x for r in some for x in r] and size.tolist() == [len(r) for r in some]


def test_merges_out_of_order_are_taken_one_by_one(spark):
    merges = spark.createDataFrame([(1, "61", "61"), (0, "6161", "61"), (2, "20", "616161")], "rank int, left string, right string")
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(["61", "6161", "616161", "20", "20616161", None])], "id int, token_hex string")
    got = encode.encode_by_join(spark.createDataFrame([("aaaaa",), ("b",)], "text string"), merges, vocab).collect()
    ranks = {("61", "61"): 1, ("6161", "61"): 0, ("20", "616161"): 2}
    ids = {"61": 0, "6161": 1, "616161": 2, "20": 3, "20616161": 4}
    assert {r.text: r.ids for r in got} == {"aaaaa": [ids[s] for s in encode._bpe_symbols(" aaaaa", ranks)], "b": [3]}
