import hashlib
import random
import re

from pyspark.sql import functions as F
from wordloom.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Spans string")
    found = pii.find_personal_data(df)
    rows = found.select("doc_id", pii.span_list(F.filter("spans", lambda s: s["base"])).alias("base"),
                        pii.span_list(F.col("spans")).alias("all")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    return {r.doc_id: r for r in rows}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "x.y%@z-1.com.", ".@w.v", "@", "1.2.3.4", "255.256.1.1", "000001.02.3.0255", "4111 1111-1111 1111",
             "4012888888881881", "+1 (743) 555-3824", "+49", "+", "5.6.7.8.9.10.11.12", " ", "ä€𝄞", "￿", "\n", "-",
             "7", "a_b+c@d", "..", "12345678901234567890", "call ", "%", "1 2-3", "(", ")", "４１"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += [None, "", "a" * 3_000, "9" * 3_000, "a." * 20_000 + "@" + "b." * 20_000, "1." * 8_000,
              "+" + "1 " * 20_000, " mail me@x.org " * 400]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)), (t or "")[:200]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].all.split(","))


def test_long_run_without_match(spark):
    got = run(spark, ["a" * 500_000, "a" * 500_000 + "@", "@" * 100_000, "9" * 500_000])
    assert all(r.all == "" for r in got.values())


def test_method_adds_supported_spans(spark):
    texts = [f"mail me at joe{i}@site{i}.org or call phone +1 (555) 123-{4000 + i}" for i in range(60)]
    texts += [f"phone 555-123-{4000 + i} or mail ann{i} [at] site [dot] org" for i in range(10)]
    texts += ["word word"] * 30
    got = run(spark, texts)
    added = {s for i in range(60, 70) for s in got[i].all.split(",") if s and s not in got[i].base}
    assert added and not got[90].all


def test_em_prefers_the_reliable_labeler():
    patterns = [(0, 0b1111, 500), (0, 0b0111, 400), (0, 0b0000, 900), (0, 0b1000, 300)]
    r = pii.reliabilities(patterns)[0]
    assert r["posterior"][0b0111] > 0.9 and r["posterior"][0b1000] < 0.1
    w = pii.classifier(patterns)[0]
    assert w[1] > w[4]


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_query_counts_each_kind(spark, tmp_dir):
    parts = ["a@b.c", "1.2.3.4", "4111 1111-1111 1111", "+1 (743) 555-3824", "300.1.1.1", "x", "+49 1"]
    rng = random.Random(3)
    texts = [" | ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = {r.doc_id: r for r in pii.op8_pii(spark, tmp_dir).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS], t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
