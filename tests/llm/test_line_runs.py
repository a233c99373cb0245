import random

from wordloom.llm import line_runs


def brute(rows, run=3):
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if text is None else text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(full) - run + 1):
            w = tuple(lines[full[s + j]].strip(" ") for j in range(run))
            if w in seen:
                gone.update(range(s, s + run))
            seen.add(w)
        runs = sum(1 for p in gone if p - 1 not in gone)
        drop = {full[p] for p in gone}
        out.append((len(lines), len(gone), runs, None if text is None else
                    "\n".join(x for i, x in enumerate(lines) if i not in drop)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, N_RUNS string")
    got = line_runs.remove_repeated_runs(df).orderBy("doc_id").collect()
    return [(r.n_lines, r.n_removed, r.n_runs, r.text) for r in got]


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(25)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            lines += rng.choice(blocks) if rng.random() < 0.4 else [f"own {rng.random()}"] * rng.randrange(1, 3)
            lines += rng.choice([[], [""], ["  "]])
        rows.append((i, "\n".join(rng.choice(["", " "]) + x for x in lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a\n" * 9), (204, "a\nb\nc"), (205, " a\n\nb \nc\nd"), (206, "x" * 100_000)]
    assert run(spark, rows) == brute(rows)


def test_hot_run_and_null_keys(spark):
    rows = [(None, "h1\nh2\nh3\nh4")] + [(i, f"own{i}\nh1\nh2\nh3\nh4") for i in range(60)]
    got = run(spark, rows)
    assert got[0][1] == 0 and all(g[1] == 4 and g[3] == f"own{i}" for i, g in enumerate(got[1:]))
    assert run(spark, []) == []


def brute_passages(rows, passage, run=3):
    """As ``brute``, with shorter windows of ``passage`` bytes or more."""
    seen, out = set(), []
    for _, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for n in range(1, run + 1):
            for s in range(len(full) - n + 1):
                w = tuple(lines[full[s + j]].strip(" ") for j in range(n))
                if n < run and len("".join(w).encode()) < passage:
                    continue
                if w in seen:
                    gone.update(range(s, s + n))
                seen.add(w)
        drop = {full[p] for p in gone}
        out.append((len(gone), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
    return out


def test_long_lines_and_pairs_count_by_content(spark):
    long, half = "é" * 100, "b" * 100
    rows = [(0, f"{long}\nshort"), (1, f" {long} "), (2, f"{half}\n{half[:99]}\n\n{half}c"), (3, f"x\n{half}\n\n{half}c\ny"),
            (4, f"short\n{half[:99]}\n{half}c"), (5, f"{half}\n{half}c")]
    rng = random.Random(3)
    pool = [c * n for c in "abcdef" for n in (40, 120, 210)]
    rows += [(i, "\n".join(rng.choice(pool + ["", f"own {i}"]) for _ in range(rng.randrange(1, 5)))) for i in range(10, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_runs.remove_repeated_runs(df, passage=200).orderBy("doc_id").collect()
    assert [(r.n_removed, r.text) for r in got] == brute_passages(rows, 200)
    assert got[1].n_removed == 1 and got[1].text == ""
    assert line_runs.remove_repeated_runs(df).where("doc_id = 1").first().n_removed == 0
