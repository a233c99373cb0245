"""Columns of the caller that are called like anything the operators use
inside come back with their values."""

import pytest

import corpus_pipeline
from wordloom.llm import interaction, jaccard, line_runs, mixing, packing, sharding, toxicity

NAMES = {
    "sharding": ["_row", "_start", "_s", "_p", "_block", "_ends", "row", "at", "block", "rank", "ends", "part", "place", "start", "n", "_part", "_n"],
    "mixing": ["_sum", "_tie", "_in", "_p", "_rest", "_whole", "_gap", "_source", "_fill", "row", "u", "slice", "odds", "id", "rest", "whole",
               "p", "sum", "cut", "cut_before", "in", "fill", "gap_source", "fill_source", "cut_source", "t_source", "tie", "words", "_cut"],
    "lines": ["_gone", "_rid", "rid", "h", "key", "s", "b", "w", "place", "_grams"],
    "pipeline": ["copies", "_copy", "copy", "doc", "row", "size", "taken", "_row", "_size", "source_size", "target"],
}


def docs(spark, names):
    """Documents with an integer column of each name; row i holds 100 * i and more."""
    texts = [f"some words of text number {i} " * (i % 4 + 1) + "\none\ntwo\nthree\nfour" for i in range(24)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0, *(100 * i + k for k in range(len(names)))) for i, t in enumerate(texts)]
    schema = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` int" for n in names)]
    return spark.createDataFrame(rows, ", ".join(schema)).repartition(3).cache()


def unchanged(got, names, of=lambda r: r["doc_id"]):
    rows = got.collect()
    assert rows
    for r in rows:
        assert [r[n] for n in names] == [100 * of(r) + k for k in range(len(names))]
    return rows


@pytest.mark.parametrize("half", [0, 1])
def test_sharding(spark, half):
    names = NAMES["sharding"][half::2]
    rows = unchanged(sharding.shuffle_into_shards(docs(spark, names), shards=4), names)
    assert sorted(r.doc_id for r in rows) == list(range(24))


@pytest.mark.parametrize("half", [0, 1])
def test_mixing(spark, half):
    names = NAMES["mixing"][half::2]
    rows = unchanged(mixing.mix_documents(docs(spark, names)), names)
    plain = {r.doc_id: (r.copies, r.taken) for r in mixing.mix_documents(docs(spark, [])).collect()}
    assert {r.doc_id: (r.copies, r.taken) for r in rows} == plain


def test_line_runs(spark):
    rows = unchanged(line_runs.remove_repeated_runs(docs(spark, NAMES["lines"])), NAMES["lines"])
    assert len(rows) == 24 and sum(r.n_removed for r in rows) == 23 * 4


def test_pipeline_mixing(spark):
    names = NAMES["pipeline"]
    d = docs(spark, names)
    got = corpus_pipeline.mix_sources(spark, d, "")
    assert got.columns == d.columns
    unchanged(got, names)


def test_others_pass_by(spark):
    """Operators that return rows of their own read their columns by name only."""
    d = docs(spark, ["tile", "rep", "component", "anchor", "set_a", "frag", "shingle"])
    assert jaccard.jaccard_components(d).count() == 24
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    assert toxicity.score_documents(d, toxicity.fit(d, labels)).count() == 24
    e = docs(spark, ["start", "length", "ids", "sequence_id", "offset"])
    import public_tokenizers
    assert packing.pack(e, "doc_id", text="text", vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
                        pattern=public_tokenizers.PATTERN).select("doc_id").distinct().count() == 24
    f = docs(spark, ["_first", "_COLD", "_key", "first", "cold"])
    rows = unchanged(interaction.with_earlier_twin(f, "text", "doc_id", "twin"), ["_first", "_COLD", "_key", "first", "cold"])
    assert not any(r.twin for r in rows)
