"""Filter interaction audit: what each filter removes in every order of the
filters, from sorted posting lists of the rows that fail each of them."""

from __future__ import annotations

import itertools
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, fresh, read, written
from .registry import register

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one id range: posting lists are cut at its multiples.
RANGE_ROWS = 1 << 16
#: A text held by at least this share of all rows is looked up in a table sent to all executors, which so has
#: at most its inverse of rows.
HOT_SHARE = 1 / 1000


@dataclass(frozen=True)
class Rule:
    """A filter: its letter and the column that is true where a row fails it."""
    letter: str
    fails: Column


# --- posting lists -----------------------------------------------------------------
def gallop(ids: list, start: int, bound) -> int:
    """First index from ``start`` on whose id is not below ``bound``: steps are
    doubled until one passes it, then the last step is halved."""
    step, n = 1, len(ids)
    low = start
    while start + step < n and ids[start + step] < bound:
        low = start + step
        step *= 2
    return bisect_left(ids, bound, low, min(start + step + 1, n))


def merged_cells(lists: list[list]) -> dict[int, int]:
    """Sizes of all intersections that exclude each other: mask of lists ->
    number of ids that are in exactly these, by one k-way merge of the sorted
    lists.  Where one list alone holds the smallest id, its run up to the next
    id of any other is found by galloping and counted at once."""
    at = [0] * len(lists)
    live = [k for k, x in enumerate(lists) if x]
    cells: dict[int, int] = {}
    while live:
        heads = [lists[k][at[k]] for k in live]
        least = min(heads)
        holders = [k for k, h in zip(live, heads) if h == least]
        mask = sum(1 << k for k in holders)
        if len(holders) == 1:
            k = holders[0]
            others = [h for h in heads if h != least]
            end = gallop(lists[k], at[k], min(others)) if others else len(lists[k])
            cells[mask] = cells.get(mask, 0) + end - at[k]
            at[k] = end
        else:
            cells[mask] = cells.get(mask, 0) + 1
            for k in holders:
                at[k] += 1
        live = [k for k in live if at[k] < len(lists[k])]
    return cells


def posting_lists(rows: DataFrame, part: str, row_id: str, names: list[str]) -> DataFrame:
    """(part, range, list, ids): for each part and id range, the sorted ids of
    the rows for which the boolean column ``names[list]`` is true, and as list
    -1 no ids but the number of rows.  A part of any size is cut into ranges
    of RANGE_ROWS ids, so no list holds more."""
    flags = [F.when(F.col(c), F.lit(i)) for i, c in enumerate(names)]
    kinds = F.array_compact(F.array(F.lit(-1), *flags))
    held = rows.select(F.col(part).alias("part"), F.floor(F.col(row_id) / RANGE_ROWS).alias("range"),
                       F.col(row_id).alias("id"), F.explode(kinds).alias("list"))
    lists = held.groupBy("part", "range", "list").agg(
        F.sort_array(F.collect_list(F.when(F.col("list") >= 0, F.col("id")))).alias("ids"), F.count("*").alias("n"))
    return lists


def cell_counts(lists: DataFrame, n_lists: int) -> DataFrame:
    """(part, cell, n): per part, how many ids are in exactly the lists of the
    bit mask ``cell``; cell 0 holds the rows that are in none."""
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def merge(key, table):
        import pyarrow as pa
        held = [[] for _ in range(n_lists)]
        total = 0
        for k, ids, n in zip(*(table.column(c).to_pylist() for c in ("list", "ids", "n"))):
            if k < 0:
                total = n
            else:
                held[k] = ids
        cells = merged_cells(held)
        cells[0] = total - sum(cells.values())
        return pa.table({"part": pa.array([key[0].as_py()] * len(cells), pa.string()),
                         "cell": pa.array(list(cells), pa.int32()), "n": pa.array(list(cells.values()), pa.int64())})

    return (lists.groupBy("part", "range").applyInArrow(merge, schema)
            .groupBy("part", "cell").agg(F.sum("n").alias("n")))


# --- sums over cells ----------------------------------------------------------------
def step_sums(n_filters: int, letters: str):
    """For every order and step: (order, step, matrix rows) where each row of
    the six matrices picks the cells that a figure sums."""
    cells = np.arange(1 << (n_filters + 2))
    failing = cells & ((1 << n_filters) - 1)
    good, toxic = (cells >> n_filters) & 1 == 1, (cells >> (n_filters + 1)) & 1 == 1
    names, kept, removed, redundant, unique, good_lost, toxic_lost, which = [], [], [], [], [], [], [], []
    for order in itertools.permutations(range(n_filters)):
        before = 0
        for step, f in enumerate(order, 1):
            own, gone = failing >> f & 1 == 1, failing & before != 0
            out = own & ~gone
            names.append(("".join(letters[i] for i in order), step))
            kept.append(failing & (before | 1 << f) == 0)
            removed.append(out)
            redundant.append(own & gone)
            unique.append(failing == 1 << f)
            good_lost.append(out & good)
            toxic_lost.append(out & toxic)
            which.append(f)
            before |= 1 << f
    return names, [np.array(m, np.int64) for m in (kept, removed, redundant, unique, good_lost, toxic_lost)], np.array(which)


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def audit(df: DataFrame, part: Column, rules: list[Rule], good: Column, toxic: Column) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): one row for each part, order of the
    rules and step, zeros included.

    ``kept`` rows of the part pass this step and all before; ``removed`` fail
    it and none before; ``redundant`` fail it and one before; ``unique_fails``
    fail this rule only; ``good_lost`` and ``toxic_lost`` are the removed of
    which the conditions hold; ``shapley`` sums the rule's removed over all
    orders, at whatever step it stands.

    Rows are numbered where they are read; per part and range of numbers, each
    rule and the two conditions has a sorted list of row numbers.  One
    galloping merge of a range's lists gives the sizes of all their exclusive
    intersections, which are summed over ranges; unions and differences of any
    order are sums of those.  A task holds the lists of one range; nothing
    grows with a part's size.

    Null conditions count as not failing; a null part stays null.  Null or
    repeated ids of ``df`` do not matter, as rows count.  No rows: no parts and
    so no rows.  Columns of ``df`` are read by the given expressions only."""
    n = len(rules)
    columns = [F.coalesce(r.fails, F.lit(False)).alias(f"f{i}") for i, r in enumerate(rules)]
    rows = df.select(part.cast("string").alias("part"), *columns, F.coalesce(good, F.lit(False)).alias("good"),
                     F.coalesce(toxic, F.lit(False)).alias("toxic"), F.monotonically_increasing_id().alias("id"))
    lists = posting_lists(rows, "part", "id", [f"f{i}" for i in range(n)] + ["good", "toxic"])
    counts = (cell_counts(lists, n + 2).groupBy("part")
              .agg(F.collect_list(F.struct("cell", "n")).alias("cells")))   # at most 2 ** (n + 2) each
    letters = "".join(r.letter for r in rules)
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                           T.StructField("step", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in [*FIGURES, "shapley"]])

    def figures(batches):
        import pyarrow as pa
        names, sums, which = step_sums(n, letters)
        orders, steps = pa.array([o for o, _ in names], pa.string()), pa.array([s for _, s in names], pa.int32())
        for b in batches:
            for p, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.zeros(1 << (n + 2), np.int64)
                for c in cells:
                    x[c["cell"]] = c["n"]
                out = [m @ x for m in sums]
                shapley = np.zeros(n, np.int64)
                np.add.at(shapley, which, out[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(names), pa.string()), orders, steps,
                     *(pa.array(v) for v in out), pa.array(shapley[which])], schema.names)

    return counts.mapInArrow(figures, schema)


# --- repeated texts -----------------------------------------------------------------
def with_earlier_twin(df: DataFrame, digest: str, doc_id: str, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: a smaller ``doc_id`` has the same
    ``digest``.  Rows without an id have no smaller one and are none.

    Digests that a share of HOT_SHARE of all rows or more have are looked up in a
    broadcast table (1 / HOT_SHARE rows at most, whatever the input); the others,
    if more than one row has them, by a join on the digest, into which the rows
    already looked up go under keys of their own."""
    first, n, total = fresh(df, "_first"), fresh(df, "_n"), df.count()
    cold, key = fresh(df, "_cold"), fresh(df, "_key")
    groups = df.groupBy(digest).agg(F.min(doc_id).alias(first), F.count("*").alias(n)).where(F.col(n) > 1)
    hot = F.col(n) >= max(2, total * HOT_SHARE)
    alone = F.monotonically_increasing_id().cast("string").cast("binary")
    return (df.join(F.broadcast(groups.where(hot).drop(n)), digest, "left")
            .withColumn(key, F.when(F.col(first).isNull(), F.col(digest)).otherwise(alone))
            .join(groups.where(~hot).select(F.col(digest).alias(key), F.col(first).alias(cold)), key, "left")
            .withColumn(out, F.coalesce(F.col(doc_id) > F.coalesce(first, cold), F.lit(False)))
            .drop(first, cold, key))


# --- the query ----------------------------------------------------------------------
LETTERS = "ABCDE"
_FAILS = {"A": "w < 100", "B": "100 * dw < 80 * w", "C": "100 * up > 10 * cp", "D": "odd", "E": "twin"}

SQL = f"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
 m as (select d.*, min(doc_id) over (partition by t) as first, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
 l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
 s as (select part, len(ws) as w, len(list_distinct(ws)) as dw, length(t) as cp,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as up, regexp_matches(t, '[#$%&*|]') as odd,
         coalesce(m.doc_id > first, false) as twin, coalesce(good, false) as good, coalesce(toxic, false) as toxic
       from m left join l on m.doc_id = l.doc_id),
 f as (select part, good, toxic, {' + '.join(f"case when {c} then {1 << i} else 0 end" for i, c in enumerate(_FAILS.values()))} as mask from s),
 c as (select part, mask, count(*) as n, count_if(good) as g, count_if(toxic) as x from f group by part, mask),
 o(filter_order, step, bit, seen) as (
  select '', 0, 0, 0
  union all
  select filter_order || letter, step + 1, b, seen | b from o,
    (values {', '.join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))}) v(letter, b) where seen & b = 0),
 p as (select z.filter_order, a.step, a.bit, a.seen from o a join o z on z.step = 5 and a.step > 0 and starts_with(z.filter_order, a.filter_order)),
 r as (select part, filter_order, step, bit,
   sum(case when mask & seen = 0 then n else 0 end)::BIGINT as kept,
   sum(case when mask & seen = bit then n else 0 end)::BIGINT as removed,
   sum(case when mask & bit <> 0 and mask & (seen - bit) <> 0 then n else 0 end)::BIGINT as redundant,
   sum(case when mask = bit then n else 0 end)::BIGINT as unique_fails,
   sum(case when mask & seen = bit then g else 0 end)::BIGINT as good_lost,
   sum(case when mask & seen = bit then x else 0 end)::BIGINT as toxic_lost
  from c, p group by part, filter_order, step, bit)
select part, filter_order, step::INT as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, bit)::BIGINT as shapley from r
"""


@register("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part (lang), filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley of filters A to E over all documents.  A
    document is good or toxic if any of its labels says so; equal texts are
    recognised by their SHA-256."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.length(text).alias("cp"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("up"), text.rlike(r"[#$%&*|]").alias("d"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    flags = written(docs.select("doc_id", "part", "digest", (n < 100).alias("a"), (100 * distinct < 80 * n).alias("b"),
                                (100 * F.col("up").cast("long") > 10 * F.col("cp").cast("long")).alias("c"), "d"), "flags")
    labels = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = written(with_earlier_twin(flags, "digest", "doc_id", "e").join(labels, "doc_id", "left")
                   .select("part", "a", "b", "c", "d", "e", "good", "toxic"), "rows")
    drop_written(flags)
    return audit(rows, F.col("part"), [Rule(x, F.col(x.lower())) for x in LETTERS], F.col("good"), F.col("toxic"))
