import collections
import functools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import packing
from wordloom.llm.packing import Limits
from wordloom.operators import qa

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
EXACT = Tokenizer.from_file(PATH)


@functools.cache
def exact_ids(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def check_pieces(rows, limits, ids_of):
    """Every id in exactly one piece, offsets gapless, limits kept."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, pieces in by_doc.items():
        ids, at = ids_of(key), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss
    return by_doc, by_sequence


def test_ids_equal_tokenizers():
    bpe = packing.ByteBpe(PATH, PATTERN)
    rng = random.Random(4)
    later = "日本語 العربية  　 🙂 ǅ ɐʰ Ⅷ ½͸\U0001f9ff"
    texts = ["", " ", "\n\n x", "I'll don't 'S we've", "a" * 3000, " " * 2500 + "b", "x <|endoftext|> y", later, "\x1c\x1d" * 700]
    # every character of the fast way, alone and between others
    for c in map(chr, range(0x250)):
        texts += [c, f"a{c}b", f" {c} {c}{c}1", f"{c}'s\n{c}", f"1{c}\t {c}"]
    alphabet = [chr(i) for i in range(0x250)] + list("  \n\tetaoin'") * 20
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["".join(rng.choice(alphabet + list(later)) for _ in range(60)) for _ in range(100)]
    assert sum(map(bpe.plain, texts)) > 2_000
    for t in texts:
        assert bpe.ids(t).tolist() == exact_ids(t), t


def test_documents_are_packed_whole(spark):
    rng = random.Random(1)
    words = [f"w{i}ord" for i in range(500)]
    texts = [None, "", " ", "short"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 4000]))) for _ in range(60)]
    rows = [(i, t, -1, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, START int, sequence_id int").coalesce(1)
    limits = Limits(512, 16, 512)
    got = packing.pack(df, "doc_id", text="text", vocabulary=PATH, pattern=PATTERN, limits=limits).collect()
    by_doc, by_sequence = check_pieces(got, limits, lambda k: exact_ids(texts[k] or "") + [1])
    assert set(by_doc) == set(range(len(texts)))
    # only the sequence that was open at the end has room left
    assert sum(sum(p.length for p in s) < 512 for s in by_sequence.values()) <= 1
    assert all(r.example_tokens == len(exact_ids(texts[r.doc_id] or "")) + 1 for r in got)


def test_blocks_hand_on_their_open_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_EXAMPLES", 5)
    limits = Limits(16, 16, 16)
    examples = [packing.Example(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate([3, 40, 1, 16, 7, 9, 2])]
    done, held = packing.place(examples, limits, True, last=False)
    assert all(sum(p[2] for p in s) == 16 for s in done)
    more, none = packing.place(held + [packing.Example(9, np.arange(20, dtype=np.uint32))], limits, True, last=True)
    assert not none
    lengths = collections.Counter()
    for s in done + more:
        for e, _, n, _ in s:
            lengths[e.key] += n
    assert lengths == {0: 3, 1: 40, 2: 1, 3: 16, 4: 7, 5: 9, 6: 2, 9: 20}


def test_repeated_and_null_keys_and_empty(spark):
    rows = [(None, "a b c"), (1, "same text"), (1, "same text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, "doc_id", text="text", vocabulary=PATH, pattern=PATTERN).collect()
    assert sum(r.length for r in got) == sum(len(exact_ids(t or "")) + 1 for _, t in rows)
    assert packing.pack(df.where("false"), "doc_id", text="text", vocabulary=PATH, pattern=PATTERN).count() == 0


def test_instruction_data_stays_whole(spark):
    rng = random.Random(2)
    conv = [(c, t, ["user", "assistant"][t % 2], " ".join(["word", "other"][rng.randrange(2)] for _ in range(rng.randrange(1, 90))))
            for c in range(60) for t in range(4)]
    pairs = qa.build_prompts(qa.pair_turns(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")))
    examples = packing.instruction_examples(pairs, ["conv_id", "turn"], "prompt", "answer", PATH, PATTERN).coalesce(1).cache()
    limits = Limits(400, 6, 150)
    pieces = packing.pack(examples, "example", ids="ids", loss="loss", limits=limits, cut=False)
    held = {tuple(r.example): r for r in examples.collect()}
    rows = pieces.collect()
    by_doc, by_sequence = check_pieces(rows, limits, lambda k: held[tuple(k)].ids)
    assert len(rows) == len(held) and all(r.loss_tokens == sum(held[tuple(r.example)].loss) for r in rows)
    # all three limits bind somewhere, and no placing needs more than a quarter above the bound
    least = max(sum(len(x.ids) for x in held.values()) / 400, len(held) / 6, sum(sum(x.loss) for x in held.values()) / 150)
    assert len(by_sequence) <= least * 1.25 + 1
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for k, parts in by_sequence.items():
        parts = sorted(parts, key=lambda p: p.offset)
        assert whole[k].input_ids == [i for p in parts for i in held[tuple(p.example)].ids]
        assert whole[k].segment_ids == [n for n, p in enumerate(parts, 1) for _ in range(p.length)]
        assert (whole[k].n_tokens, whole[k].n_segments) == (sum(p.length for p in parts), len(parts))


def test_given_ids_and_loss(spark):
    rows = [(1, [5] * 30, [True] * 10), (2, [], None), (3, None, None), (4, [7] * 9, [True, None] + [True] * 20)]
    df = spark.createDataFrame(rows, "k int, ids array<int>, loss array<boolean>").coalesce(1)
    whole = {r.k: r for r in packing.pack(df, "k", ids="ids", loss="loss", limits=Limits(16, 4, 4), cut=False).collect()}
    assert {k: (r.length, r.loss_tokens) for k, r in whole.items()} == {1: (30, 10), 4: (9, 8)}
    cut = packing.pack(df, "k", ids="ids", loss="loss", limits=Limits(16, 4, 4)).collect()
    check_pieces(cut, Limits(16, 4, 4), lambda k: {1: [5] * 30, 4: [7] * 9}[k])
    assert sum(r.loss_tokens for r in cut) == 18
    assert [f.name for f in packing.pack(df, "k", ids="ids", with_ids=False).schema] == [
        "k", "start", "length", "loss_tokens", "example_tokens", "ids_crc32", "sequence_id", "offset"]
    assert packing.pack(df.where(F.lit(False)), "k", ids="ids").count() == 0


def test_query_covers_documents(spark, tmp_dir):
    spark.createDataFrame([(1, "alpha beta", "x"), (2, None, "y")], "doc_id long, text string, length string") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    got = packing.op13_packing(spark, tmp_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.doc_tokens) for r in got.collect()) == [(1, len(exact_ids("alpha beta")) + 1), (2, 1)]
