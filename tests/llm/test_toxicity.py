import numpy as np
from wordloom.llm import toxicity as tox


def feats(text, stems=None):
    return tox.Lexicon(stems or {}).features(text)


def test_clauses_decide():
    assert feats("You are an idiot.")[1] == 1.0
    assert feats("What an idiot")[0] == 1.0
    assert feats("You are not an idiot.")[2] == 1.0
    assert feats('He said she is a moron.')[3] == 1.0
    assert feats('"idiot" was the word.')[3] == 1.0
    assert feats("It was not cold. idiot weather")[0] == 1.0      # negation ends with its clause
    assert feats("I will kill time")[4] == 0.0 and feats("you I will kill")[4] == 1.0
    assert feats("antistupidity")[0] == 0.0                        # only word beginnings count
    assert feats("") == [0.0] * tox.FEATURES
    assert feats("Loweiä ist", {"lowei": 0.5})[0] == 0.5


def test_whole_text_is_read():
    assert feats("word " * 200_000 + "idiot")[0] == 1.0
    assert feats("idiot " * 50_000)[0] == 50_000.0


def test_composition_is_the_cascade():
    rng = np.random.default_rng(1)
    parts = [(0, tox.negation), ("own", tox.reported), (0, tox.targeted)]
    for _ in range(200):
        word = rng.choice(list("IHTNRQO"), 12)
        state, got = tox.START, []
        for s in word:
            state, o = tox.TABLE[state, s]
            got.append(o)
        want = list(word)
        for start, step in parts:
            s, out = start, []
            for x in want:
                s, y = step(s, x)
                out.append(y)
            want = out
        assert got == want


def table(spark, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        stem = "zorgl" if i % 2 else "blixt"
        text = " ".join(f"wo{chr(97 + (i * 7 + k) % 26)}rd{k}" for k in range(30))
        rows.append((i, text + (f" {stem}{'abc'[i % 3]} end" if bad else " end"), "de", "s", "x"))
        labels.append((i, 1, int(bad), "x"))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, SCORE string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def test_learns_stems_and_holds_out(spark):
    docs, labels = table(spark, 600)
    model = tox.fit(docs, labels)
    assert {s[:5] for s in model.stems} == {"zorgl", "blixt"}
    got = {r.doc_id: r for r in tox.score_documents(docs, model).collect()}
    assert all((got[i].predicted == 1) == (i % 5 == 0) for i in range(600))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nulls_empty_tables_and_no_labels(spark):
    docs, labels = table(spark, 30)
    odd = spark.createDataFrame([(None, None, None, None, "x"), (1, "", "en", None, "x"), (1, "", "en", None, "x"),
                                 (2, "you idiot", "en", "s", "x")], docs.schema)
    model = tox.fit(odd, labels.limit(0))
    got = tox.score_documents(odd, model).collect()
    assert len(got) == 4 and sorted(r.predicted for r in got) == [0, 0, 0, 1]
    assert tox.score_documents(docs.limit(0), model).count() == 0
    assert tox.fit(docs.limit(0), labels).weights == tox.PRIOR_WEIGHTS


def test_quotation_is_open_over_any_distance_in_its_line():
    far = "word " * 1000
    assert feats(f'"It was long. {far}. An idiot came.')[3] == 1.0
    assert feats(f'"It was long. {far}. An idiot came." {far}. An idiot went.')[:4] == [1.0, 0.0, 0.0, 1.0]
    assert feats(f'"Idiot." {far}. An idiot came.')[:4] == [1.0, 0.0, 0.0, 1.0]
    assert feats(f'"It was long. {far}.\nAn idiot came.')[:4] == [1.0, 0.0, 0.0, 0.0]
    assert feats(f'{far}"{far}. An idiot. {far}"{far}. An idiot.')[:4] == [1.0, 0.0, 0.0, 1.0]


def test_statistic_column_equals_the_model_s():
    """Stems that Spark lets through are all that the model may choose."""
    import math
    n_toxic, n_clean = 40, 70

    def plain(a, b):
        total, seen, g = n_toxic + n_clean, a + b, 0.0
        for x, row, col in ((a, seen, n_toxic), (b, seen, n_clean), (n_toxic - a, total - seen, n_toxic), (n_clean - b, total - seen, n_clean)):
            if x > 0:
                g += 2 * x * math.log(x * total / (row * col))
        return g

    rows = [("s%d_%d" % (a, b), a, b) for a in range(3, 41, 4) for b in range(0, 30, 3)]
    floor = 12.0
    chosen = tox.choose_stems(rows, n_toxic, n_clean, floor)
    assert chosen and all(plain(*(int(x) for x in s[1:].split("_"))) >= floor for s in chosen)


def test_statistic_in_spark(spark):
    import math
    df = spark.createDataFrame([("a", 5, 0), ("b", 40, 70), ("c", 40, 0)], "stem string, toxic long, clean long")
    got = {r.stem: r.g for r in df.select("stem", tox.statistic(40, 70).alias("g")).collect()}
    assert abs(got["b"]) < 1e-9 and abs(got["a"] - (2 * 5 * math.log(5 * 110 / (5 * 40)) + 2 * 35 * math.log(35 * 110 / (105 * 40))
                                                    + 2 * 70 * math.log(70 * 110 / (105 * 70)))) < 1e-9
    assert got["c"] > 100
