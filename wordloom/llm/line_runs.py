"""Repeated runs of lines by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bind
from .common import fresh, read, written
from .registry import register

#: Lines of the shortest run that counts as repeated, and of one fingerprint.
RUN_LINES, GRAM_LINES = 3, 2
#: Bytes from which fewer lines than that count as well, where asked for.
PASSAGE_BYTES = 200


def winnowed(hashes: str, run: int, gram: int):
    """Positions of the fingerprints: the rightmost least gram hash of every
    window of run - gram + 1 grams, so any shared run of ``run`` lines holds
    one that is chosen in both places."""
    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - gram),
                        lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, gram)).alias("fp"), (-i).alias("back")))
    window = run - gram + 1
    least = F.transform(F.sequence(F.lit(1), F.size(hashes) - run + 1), lambda i: F.array_min(F.slice("_grams", i, window)))
    return grams, F.array_distinct(least)


def remove_repeated_runs(docs: DataFrame, text: str = "text", order: str = "doc_id", run: int = RUN_LINES,
                         gram: int = GRAM_LINES, passage: int | None = None) -> DataFrame:
    """``docs`` with n_lines, n_removed, n_runs and the text without the lines
    of repeated runs: of every run of ``run`` or more lines that also stands
    earlier (by ``order``, then place in the text) the later copy is deleted.
    With ``passage``, so is that of 1 to ``run`` - 1 lines that hold ``passage``
    bytes or more together; each such window has a fingerprint of its own.

    Lines are compared without the spaces around them; blank ones are passed
    over and stay.  Fingerprints are joined on their places over all documents;
    from each shared one the match is extended both ways, to every ``run``-line
    window through it, and a window that stands earlier too is deleted.  The
    earliest of equal windows is found by a group minimum, so a run that very
    many documents share costs a row each and no pairs.

    A null text is returned as null with no lines; null ``order`` values come
    first; rows of one ``order`` value keep the order of the written table; an
    empty table gives no rows.  Columns called like the three new ones (any
    case) are replaced."""
    new = {"n_lines", "n_removed", "n_runs"}
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    rid, gone_col = fresh(docs, "_rid"), fresh(docs, "_gone")
    held = written(docs.withColumn(rid, F.monotonically_increasing_id()), "lines")
    split = F.split(F.col(text), "\n")
    full = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
    size = [] if passage is None else [F.transform(full, lambda x: F.octet_length(x)).alias("b")]
    known = held.where(F.col(text).isNotNull()).select(
        F.col(rid).alias("rid"), F.col(order).alias("key"), F.transform(full, lambda x: F.xxhash64(x)).alias("h"), *size)
    every = written(known.where(F.size("h") >= (run if passage is None else 1)), "hashes")
    known = every.where(F.size("h") >= run).select("rid", "key", "h")
    grams, chosen = winnowed("h", run, gram)
    marks = known.withColumn("_grams", grams).select("rid", "key", F.explode(chosen).alias("m")) \
        .select("rid", "key", F.col("m.fp").alias("fp"), (-F.col("m.back")).alias("at"))
    shared = marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    hits = marks.join(shared, "fp", "left_semi").groupBy("rid").agg(F.collect_list("at").alias("at"))
    starts = F.explode(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(
        F.greatest(p + gram - run, F.lit(0)), F.least(p, F.size("h") - run))))))

    def placed(starts, n):
        return starts.select("rid", F.struct("key", "rid", "s").alias("place"), "s", F.lit(n).alias("n"),
                             F.xxhash64(F.slice("h", F.col("s") + 1, n)).alias("w"))

    windows = placed(known.join(hits, "rid").select("rid", "key", "h", starts.alias("s")), run)
    for n in range(1, run if passage is not None else 1):
        heavy = F.filter(F.sequence(F.lit(0), F.size("h") - n), lambda s: sum(F.get("b", s + i) for i in range(n)) >= passage)  # noqa: B023
        windows = windows.unionByName(placed(every.where(F.size("h") >= n).select("rid", "key", "h", F.explode(heavy).alias("s")), n))
    windows = written(windows, "windows")
    first = windows.groupBy("n", "w").agg(F.min("place").alias("first"))
    later = windows.join(first, ["n", "w"]).where(~F.col("place").eqNullSafe(F.col("first")))
    gone = later.groupBy("rid").agg(F.collect_list(F.struct("s", "n")).alias("s"))
    gone = gone.select(F.col("rid").alias(rid), F.array_sort(F.array_distinct(F.flatten(F.transform(
        "s", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))).alias(gone_col))
    runs = F.size(F.filter(F.transform(gone_col, lambda x, i: F.when(i == 0, True).otherwise(
        F.element_at(gone_col, F.greatest(i, F.lit(1))) != x - 1)), lambda b: b))

    # the n-th non-blank line goes if n is listed
    def kept(lines):
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        full = F.filter(every, lambda i: F.trim(F.get(lines, i)) != "")
        left = bind(full, lambda f: F.array_except(every, F.transform(gone_col, lambda n: F.get(f, n))))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    out = held.join(gone, rid, "left").drop(rid)
    out = out.withColumn("n_lines", F.coalesce(F.size(split).cast("long"), F.lit(0))) \
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")).cast("long")) \
        .withColumn("n_removed", F.coalesce(F.when(F.col(gone_col).isNotNull(), F.size(gone_col)), F.lit(0)).cast("long")) \
        .withColumn("n_runs", F.coalesce(F.when(F.col(gone_col).isNotNull(), runs), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col(gone_col).isNotNull(), bind(split, kept)).otherwise(F.col(text))).drop(gone_col)


_SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as x from documents),
n as (select doc_id, x, list_filter(list_transform(x, lambda t: trim(t, ' ')), lambda t: t <> '') as h from l),
w as (select doc_id, unnest(range(0, greatest(len(h) - 2, 0))) as s, h from n),
k as (select doc_id, s, array_to_string(h[s+1:s+3], chr(10)) as w from w),
f as (select w, min(struct_pack(d := doc_id, s := s)) as first from k group by 1),
g as (select doc_id, list_distinct(flatten(list(range(s, s + 3)))) as gone from k join f using (w)
      where doc_id <> first.d or s <> first.s group by 1),
e as (select doc_id, x, i, trim(x[i], ' ') <> '' as full_line from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from l)),
m as (select doc_id, i, x[i] as line, full_line, sum(full_line::int) over (partition by doc_id order by i) - 1 as pos from e),
t as (select m.doc_id, string_agg(line, chr(10) order by i) filter (where not (full_line and coalesce(list_contains(gone, pos), false))) as kept
      from m left join g using (doc_id) group by 1),
r as (select doc_id, count(*) as n from (select doc_id, p, lag(p) over (partition by doc_id order by p) as q
      from (select doc_id, unnest(gone) as p from g)) where q is null or q <> p - 1 group by 1)
select d.doc_id, coalesce(len(l.x), 0)::bigint as n_lines, coalesce(len(g.gone), 0)::bigint as n_removed,
  coalesce(r.n, 0)::bigint as n_runs, md5(coalesce(t.kept, '')) as kept_md5
from documents d left join l using (doc_id) left join g using (doc_id) left join r using (doc_id) left join t using (doc_id)
"""


@register("op3_line_dedup", _SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_md5 of all documents."""
    out = remove_repeated_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


_PASSAGE_SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as x from documents),
n as (select doc_id, x, list_filter(list_transform(x, lambda t: trim(t, ' ')), lambda t: t <> '') as h from l),
w as (select doc_id, n, unnest(range(0, greatest(len(h) - n + 1, 0))) as s, h from n, (select unnest([1, 2, 3]) as n)),
k as (select doc_id, s, n, array_to_string(h[s+1:s+n], chr(10)) as w from w
      where n = 3 or strlen(array_to_string(h[s+1:s+n], '')) >= 200),
f as (select n, w, min(struct_pack(d := doc_id, s := s)) as first from k group by 1, 2),
g as (select doc_id, list_distinct(flatten(list(range(s, s + n)))) as gone from k join f using (n, w)
      where doc_id <> first.d or s <> first.s group by 1),
e as (select doc_id, x, i, trim(x[i], ' ') <> '' as full_line from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from l)),
m as (select doc_id, i, x[i] as line, full_line, sum(full_line::int) over (partition by doc_id order by i) - 1 as pos from e),
t as (select m.doc_id, string_agg(line, chr(10) order by i) filter (where not (full_line and coalesce(list_contains(gone, pos), false))) as kept
      from m left join g using (doc_id) group by 1),
r as (select doc_id, count(*) as n from (select doc_id, p, lag(p) over (partition by doc_id order by p) as q
      from (select doc_id, unnest(gone) as p from g)) where q is null or q <> p - 1 group by 1)
select d.doc_id, coalesce(len(l.x), 0)::bigint as n_lines, coalesce(len(g.gone), 0)::bigint as n_removed,
  coalesce(r.n, 0)::bigint as n_runs, md5(coalesce(t.kept, '')) as kept_md5
from documents d left join l using (doc_id) left join g using (doc_id) left join r using (doc_id) left join t using (doc_id)
"""


@register("op3_passage_dedup", _PASSAGE_SQL)
def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3_line_dedup, and without repeated single lines and pairs of 200 bytes or more."""
    out = remove_repeated_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE_BYTES)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
