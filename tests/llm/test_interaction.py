import collections
import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F

from wordloom.llm import interaction
from wordloom.llm.interaction import Rule

FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def brute(rows, letters):
    """rows: (part, set of failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations(letters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                before = set(order[:step - 1])
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for order in itertools.permutations(letters):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def values(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in [*FIGURES, "shapley"]] for r in df.collect()}


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        n = rng.choice([0, 20, 99, 100, 130, 300])
        t = " ".join(rng.choices(words[:rng.choice([30, 90, 400])], k=n))
        t = t.upper() if rng.random() < 0.2 else t
        t += rng.choice(["", "", " a|b", " 50%", " Ü x"])
        if i % 5 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((rng.choice([i, i, i, i, None, i - 1]), rng.choice([t, t, t, t, None, ""]), rng.choice(["de", "en", None, ""]), i, "x"))
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.6]
    return rows, labels + labels[:9]


def failed(rows, labels):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        out.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    return out


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, _first int, DIGEST string") \
        .repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_against_brute_force_and_sql(spark, tmp_dir, monkeypatch):
    rows, labels = documents()
    write(spark, tmp_dir, rows, labels)
    want = brute(failed(rows, labels), "ABCDE")
    assert len(want) == 3 * 600 and all(sum(v[1] for k, v in want.items()) for _ in [0])
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_dir}/{t}.parquet/*.parquet')")
    got = con.execute(interaction.SQL).fetchall()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want
    for hot, size in ((1 / 1000, 1 << 16), (0.01, 7), (1.0, 64)):   # nearly all texts hot, some, none; lists cut
        monkeypatch.setattr(interaction, "HOT_SHARE", hot)
        monkeypatch.setattr(interaction, "RANGE_ROWS", size)
        assert values(interaction.op11_filter_audit(spark, tmp_dir)) == want


def test_empty_tables(spark, tmp_dir):
    write(spark, f"{tmp_dir}/a", [], [])
    assert interaction.op11_filter_audit(spark, f"{tmp_dir}/a").count() == 0
    rows, _ = documents()
    write(spark, f"{tmp_dir}/b", rows, [])
    got = values(interaction.op11_filter_audit(spark, f"{tmp_dir}/b"))
    assert got == brute(failed(rows, []), "ABCDE") and not any(v[4] or v[5] for v in got.values())


def test_other_rules_and_null_parts(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, None]), rng.choice([True, False, None]), rng.random() < 0.5, rng.random() < 0.3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "p int, x boolean, y boolean, z boolean, id int")
    got = values(interaction.audit(df, F.col("p"), [Rule("X", F.col("x")), Rule("Y", F.col("y"))], F.col("z"), F.lit(None)))
    own = [(None if p is None else str(p), {k for k, v in zip("XY", (x, y)) if v}, z, False) for p, x, y, z, _ in rows]
    assert got == brute(own, "XY") and len(got) == 3 * 4


def test_merge_against_sets():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(80), rng.choice([0, 1, 5, 60, 80]))) for _ in range(4)]
        want = collections.Counter()
        for i in set().union(*lists):
            want[sum(1 << k for k, x in enumerate(lists) if i in x)] += 1
        assert interaction.merged_cells(lists) == dict(want)


def test_gallop_finds_the_bound():
    ids = list(range(0, 300, 3))
    for start in (0, 1, 50, 99):
        for bound in range(-2, 305):
            assert interaction.gallop(ids, start, bound) == max(start, next((i for i, x in enumerate(ids) if x >= bound), len(ids)))
