import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wordloom.llm import suffixes


def brute_force(texts, length):
    """The removed-byte mask of each text, string by string."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def check(spark, texts, length=suffixes.LENGTH):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, KEPT string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(df.repartition(3), length=length).collect()}
    assert len(got) == len(texts)
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute_force(raw, length))):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
        assert got[i].n_bytes == len(t) and got[i].spans == edge, (i, got[i].spans, edge)
        assert got[i].kept == bytes(np.frombuffer(t, np.uint8)[~gone])


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "TILE_BYTES", 4000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(30, 120)) for _ in range(8)]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                parts.append(p)
            elif rng.random() < 0.5:  # a piece of it, about the length that counts
                a = rng.randrange(len(p))
                parts.append(p[a:a + rng.randrange(150, 260)])
            else:
                a = rng.randrange(len(p))
                parts.append(p[:a] + "#" + p[a + 1:])
            parts.append(prose(rng.randrange(0, 30)))
        texts.append("".join(parts))
    texts += ["a" * 1000, "ab" * 300, "x" * 199, "x" * 200, "y" * 200, "y" * 200, "", None, texts[0], texts[0], "z" * 201]
    base = prose(25)
    base = (base * 3)[:230]
    texts += [base[:200], base[30:230], base[10:215], "q" + base[5:205] + "r"]
    check(spark, texts)


def test_empty_table_and_short_length(spark):
    check(spark, [])
    check(spark, [None, "", "short"])
    with pytest.raises(ValueError):
        suffixes.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=100)


def test_long_text_repeats_itself(spark):
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    text = body + "|" + body[20_000:40_000] + "|" + body[100:299] + "|"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = suffixes.remove_repeats(df).first()
    assert r.spans == [[20_000, 40_000], [60_001, 80_001]]
    digest = df.select(F.sha2(F.lit(bytes(r.kept)), 256)).first()[0]
    assert digest == hashlib.sha256(r.kept).hexdigest()
