"""Benchmark of the headline operators.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line.  Every query is forced end to end through the
``noop`` sink (all rows computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from wordloom.functions import text as tx  # noqa: E402
from wordloom.operators import bpe, encode, pretokenize as pt, ranking as rk  # noqa: E402
from wordloom.plans.common import tok_docs  # noqa: E402
from wordloom.session import get_spark  # noqa: E402
from wordloom.tables import notes, table  # noqa: E402

BENCH_MERGES = int(os.environ.get("BENCH_MERGES", "1000"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return time.perf_counter() - t0, out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    docs = tok_docs(spark, sf_dir)
    n_docs = table(spark, sf_dir, "documents").count()
    # warm-up: JVM, Python workers, file listing
    run(docs.select(F.length("text")))

    q, rates = {}, {}

    # B1+B2: pre-tokenise and count word types
    q["b2_word_counts"], _ = timed(lambda: run(pt.word_counts(docs)))
    rates["b2_docs_per_sec"] = n_docs / q["b2_word_counts"]

    counts = pt.word_counts(docs).persist()
    counts.count()
    words = bpe.words_table(counts).where(F.col("w").contains(" ")).persist()
    words.count()

    # One round of pair counts
    q["b3_pair_counts"], _ = timed(lambda: run(bpe.pair_counts(words, 2)))

    # BPE training in exact rounds: the first merges, then the reference's whole vocabulary
    q["b4_train"], model = timed(lambda: bpe.train_bpe(counts, vocab_size=263 + BENCH_MERGES))
    rates["b4_merges"] = len(model.merges)
    rates["b4_rounds"] = model.rounds
    rates["b4_sec_per_1000_merges"] = q["b4_train"] * 1000.0 / max(1, len(model.merges))

    q["b4_train_60000"], full = timed(lambda: bpe.train_bpe(counts, vocab_size=60_000))
    rates["b4_full_merges"] = len(full.merges)
    rates["b4_full_rounds"] = full.rounds

    # Encode every document
    enc = encode.BpeEncoder(model)
    encoded = enc.encode(docs, "text", "ids").select(F.size("ids").alias("n"))
    q["b5_encode"], _ = timed(lambda: run(encoded))
    n_tokens = encoded.agg(F.sum("n")).collect()[0][0] or 0
    rates["b5_tokens_per_sec"] = n_tokens / q["b5_encode"]

    # P6+P7: abbreviation expansion and redaction on notes
    nt = notes(spark, sf_dir)
    n_notes = nt.count()
    q["p6_p7_redact"], _ = timed(lambda: run(nt.select(tx.medical_clean(F.col("text")))))
    rates["p6_p7_rows_per_sec"] = n_notes / q["p6_p7_redact"]

    # General clean of documents
    raw = table(spark, sf_dir, "documents")
    q["p9_general_clean"], _ = timed(lambda: run(raw.select(tx.general_clean(F.col("text")))))

    # Nucleus filter over logits rows
    emb = table(spark, sf_dir, "embeddings")
    n_emb = emb.count()
    q["w1_top_p"], _ = timed(lambda: run(rk.add_top_p(emb, "embedding", 0.9).select("filtered")))
    rates["w1_rows_per_sec"] = n_emb / q["w1_top_p"]

    # W1 on rows as wide as a small vocabulary (8,192 logits)
    wide = emb.where("vec_id % 16 = 0").select(F.flatten(F.array_repeat("embedding", 128)).alias("x"))
    n_wide = wide.count()
    q["w1_top_p_8192"], _ = timed(lambda: run(rk.add_top_p(wide, "x", 0.9).select("filtered")))
    rates["w1_wide_values_per_sec"] = n_wide * 8192 / q["w1_top_p_8192"]

    counts.unpersist()
    words.unpersist()
    total = sum(q.values())
    print(json.dumps({"metric": "total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()},
                      "rates": {k: round(v, 3) for k, v in rates.items()},
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
