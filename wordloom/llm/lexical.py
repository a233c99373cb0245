"""Ranked lexical search by pipelined term partitioning: bundles of queries
carry sparse document accumulators through successive stages of term owners."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, read, written
from .registry import register

#: Terms: maximal runs of ASCII letters and digits and all later characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TOP = 10
#: Documents of one slice: accumulators of a bundle never cross it.
SLICE_DOCS = 4_096
#: Queries of one bundle.
BUNDLE_ITEMS = 256
#: Term owners: a term that more than 1 / OWNERS[k] of all documents hold belongs to an owner after k.
OWNERS = (512, 64, 8)
#: Query terms up to this many bytes are sent to all executors, so that a document's other terms are dropped
#: where it is read; beyond it all terms are indexed and the join with the query terms drops them.
BROADCAST_BYTES = 64 << 20
#: A term of weight w adds w * ((SCALE * tf) div (1000 * tf + 8 * m)), so less than w * SCALE / 1000.
SCALE = 10**9


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8, A-Z lower-cased, in order."""
    return (text or "").encode().translate(_FOLD).split()


# --- the index -------------------------------------------------------------------
def slice_postings(docs: DataFrame, doc_id: str, text: str, wanted=None) -> DataFrame:
    """Index rows of the documents, made where they are read.  A slice is up to
    SLICE_DOCS documents of one partition, in the order of their ids (null
    last).

    kind 0, one row a slice: ``ids``, and as ``tfs`` (unsigned 32-bit) the
    number of terms of each document; ``n`` counts those above 0, ``total``
    adds them up.  kind 1, one row a slice and term: as ``docs`` (16-bit) the
    places of the documents that hold it, as ``tfs`` its occurrences there;
    ``n`` counts them.  ``wanted``: a broadcast set of terms to keep, None for
    all."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"slice long, kind int, term binary, docs binary, tfs binary, n long, total long, ids array<{id_type}>"

    def index(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        keep = wanted.value if wanted is not None else None

        def rows(ids, sizes, held, type_):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            terms, at, tfs = list(held), [], []
            for t in terms:
                x = np.array(held[t], np.int64).reshape(-1, 2)
                at.append(place[x[:, 0]].astype("<u2").tobytes())
                tfs.append(x[:, 1].astype("<u4").tobytes())
            n = len(terms)
            return pa.RecordBatch.from_arrays([
                pa.array([number] * (n + 1), pa.int64()), pa.array([0] + [1] * n, pa.int32()),
                pa.array([None, *terms], pa.binary()), pa.array([None, *at], pa.binary()),
                pa.array([np.array(sizes, "<u4")[order].tobytes(), *tfs], pa.binary()),
                pa.array([sum(s > 0 for s in sizes)] + [len(x) // 2 for x in at], pa.int64()),
                pa.array([sum(sizes)] + [None] * n, pa.int64()),
                pa.array([[ids[i] for i in order]] + [None] * n, pa.list_(type_))],
                ["slice", "kind", "term", "docs", "tfs", "n", "total", "ids"])

        ids, sizes, held, type_ = [], [], {}, None
        for b in batches:
            type_ = b.schema.field(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = terms_of(t)
                counts = Counter(words)
                for w in counts if keep is None else counts.keys() & keep:
                    held.setdefault(w, []).append((len(ids), counts[w]))
                ids.append(d)
                sizes.append(len(words))
                if len(ids) == SLICE_DOCS:
                    yield rows(ids, sizes, held, type_)
                    ids, sizes, held = [], [], {}
                    number += 1
        if ids:
            yield rows(ids, sizes, held, type_)

    return docs.select(doc_id, text).mapInArrow(index, schema)


def numbered_queries(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, bundle, place, terms): BUNDLE_ITEMS items or fewer a bundle;
    terms once each."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TERM), F.lit(0)),
                                         lambda t: F.translate(t, lower.upper(), lower).cast("binary")))
    number = F.monotonically_increasing_id()
    few = items.select(F.col(item_id).alias("item_id"), terms.alias("terms")).coalesce(
        max(1, math.ceil(items.count() / BUNDLE_ITEMS)))
    return few.select("item_id", "terms", number.alias("number")).select(
        "item_id", F.floor(F.col("number") / BUNDLE_ITEMS).alias("bundle"),
        (F.col("number") % BUNDLE_ITEMS).cast("int").alias("place"), "terms")


# --- bundles ---------------------------------------------------------------------
class Bundle:
    """Scores so far of up to BUNDLE_ITEMS items over the documents of a slice.
    ``rest``: the weights of each item's terms by owner."""

    def __init__(self, sizes: bytes, rest: bytes, owners: int, docs: int, terms: int):
        n = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.m = 100 - 90 + (90 * n * docs) // max(terms, 1)
        self.rest = np.frombuffer(rest, "<i8").reshape(-1, owners)
        self.score = np.zeros((len(self.rest), len(n)), np.int64)

    def load(self, items: bytes, docs: bytes, scores: bytes) -> None:
        self.score[np.frombuffer(items, "<u2"), np.frombuffer(docs, "<u2")] = np.frombuffer(scores, "<i8")

    def add(self, weight: int, places: list[int], docs: bytes, tfs: bytes) -> None:
        """A term's contributions, to all items that hold it."""
        at, tf = np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
        more = weight * ((SCALE * tf) // (1000 * tf + 8 * self.m[at]))
        for i in places:
            self.score[i, at] += more   # a document is there once

    def bar(self, top: int) -> np.ndarray:
        """The ``top``-th highest score of each item in this slice."""
        n = self.score.shape[1]
        return (np.partition(self.score, n - top, axis=1)[:, n - top] if n > top else np.zeros(len(self.score), np.int64))

    def carried(self, owner: int, top: int) -> tuple[bytes, bytes, bytes]:
        """The accumulators that can still come among the slice's best."""
        to_come = self.rest[:, owner + 1:].sum(1) * (SCALE // 1000)
        keep = (self.score > 0) & (self.score + to_come[:, None] >= self.bar(top)[:, None])
        items, docs = np.nonzero(keep)
        return items.astype("<u2").tobytes(), docs.astype("<u2").tobytes(), self.score[keep].astype("<i8").tobytes()

    def best(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, document) of each item's ``top`` best scores above 0, equal
        scores by place, which is the order of the ids."""
        items, docs = np.nonzero((self.score > 0) & (self.score >= self.bar(top)[:, None]))
        order = np.lexsort((docs, -self.score[items, docs], items))
        items, docs = items[order], docs[order]
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        return items[rank < top], docs[rank < top]


_BUNDLE = "slice long, bundle long, sizes binary, rest binary, items binary, docs binary, scores binary"


def through_owner(bundles: DataFrame, postings: DataFrame, owner: int, owners: int, docs: int, terms: int, top: int) -> DataFrame:
    """One stage: ``bundles`` with the contributions of ``owner``'s postings.
    After the last owner, the best of each slice, (slice, bundle, place, doc,
    score)."""
    last = owner == owners - 1

    def stage(key, left, right):
        import pyarrow as pa
        row = left.to_pylist()[0]
        b = Bundle(row["sizes"], row["rest"], owners, docs, terms)
        if row["items"]:
            b.load(row["items"], row["docs"], row["scores"])
        for w, places, at, tfs in zip(*(right.column(c).to_pylist() for c in ("w", "places", "docs", "tfs"))):
            b.add(w, places, at, tfs)
        if last:
            items, at = b.best(top)
            n = len(items)
            return pa.table({"slice": pa.array([row["slice"]] * n, pa.int64()), "bundle": pa.array([row["bundle"]] * n, pa.int64()),
                             "place": pa.array(items, pa.int32()), "doc": pa.array(at, pa.int32()),
                             "score": pa.array(b.score[items, at], pa.int64())})
        items, at, scores = b.carried(owner, top)
        return pa.table({k: pa.array([v], pa.int64() if k in ("slice", "bundle") else pa.binary())
                         for k, v in (row | {"items": items, "docs": at, "scores": scores}).items()})

    by = ["slice", "bundle"]
    return (bundles.groupBy(*by).cogroup(postings.select(*by, "w", "places", "docs", "tfs").groupBy(*by))
            .applyInArrow(stage, "slice long, bundle long, place int, doc int, score long" if last else _BUNDLE))


def weights_by_owner(held: DataFrame, owners: int) -> DataFrame:
    """(bundle, rest): 64-bit sums of the weights by place and owner."""
    def pack(table):
        import pyarrow as pa
        place = table.column("place").to_numpy()
        rest = np.zeros((int(place.max()) + 1, owners), "<i8")
        rest[place, table.column("owner").to_numpy()] = table.column("w").to_numpy()
        return pa.table({"bundle": table.column("bundle").slice(0, 1), "rest": pa.array([rest.tobytes()], pa.binary())})

    return (held.groupBy("bundle", "place", "owner").agg(F.sum("w").alias("w"))
            .groupBy("bundle").applyInArrow(pack, "bundle long, rest binary"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``top``
    documents of the highest scores above 0, equal scores by ascending
    ``doc_id`` (null last).

    With N documents that hold a term, L terms in all of them, n terms in one,
    df documents that hold a term and tf occurrences there: the weight of a
    term is w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 100 - 90 +
    ((90 * n * N) div L), and the score adds w * ((10**9 * tf) div (1000 * tf +
    8 * m)) over the different terms of the item.

    Documents are indexed once, in slices.  Each term has an owner by how many
    documents hold it, the rarest first; an owner's postings stay cut by slice,
    so that a term of a third of all rows is one row a slice.  A bundle, up to
    BUNDLE_ITEMS items over one slice, carries its scores so far from owner to
    owner by cogroup; the last owner selects.  An accumulator is dropped on
    the way only if the slice has ``top`` scores that it cannot reach with all
    weights to come.  A task holds one bundle and its slice's postings.

    Null texts have no terms; items without terms give no rows; of equal items
    or ids each row is ranked on its own; empty tables give no rows.  Other
    columns are not looked at."""
    spark = docs.sparkSession
    queries = written(numbered_queries(items, item_id, text), "queries")
    held = queries.select("bundle", "place", F.explode("terms").alias("term"))
    terms = held.select("term").distinct()
    n_held, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()
    small = size <= BROADCAST_BYTES   # bounds the different terms too
    wanted = spark.sparkContext.broadcast({bytes(r.term) for r in terms.toLocalIterator()}) if small else None
    index = written(slice_postings(docs, doc_id, text, wanted), "index")
    slices, postings = index.where("kind = 0"), index.where("kind = 1")
    n_docs, n_terms = (int(x or 0) for x in slices.agg(F.sum("n"), F.sum("total")).first())
    owners = len(OWNERS) + 1

    owner = F.lit(0)
    for share in OWNERS:
        owner = owner + F.when(F.col("df") * share > n_docs, 1).otherwise(0)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owned = written(postings.groupBy("term").agg(F.sum("n").alias("df"))
                    .select("term", owner.alias("owner"), weight.alias("w")).join(terms, "term"), "owned")
    by_term = held.join(owned, "term").groupBy("bundle", "term", "owner", "w").agg(F.collect_list("place").alias("places"))
    dealt = written(postings.select("slice", "term", "docs", "tfs").join(F.broadcast(by_term) if small else by_term, "term")
                    .select("slice", "bundle", "owner", "w", "places", "docs", "tfs"), "dealt")
    bundles = written(
        dealt.select("slice", "bundle").distinct()
        .join(slices.select("slice", F.col("tfs").alias("sizes")), "slice")
        .join(weights_by_owner(held.join(owned, "term"), owners), "bundle")
        .select("slice", "bundle", "sizes", "rest", *(F.lit(None).cast("binary").alias(c) for c in ("items", "docs", "scores"))),
        "bundles")
    flow = bundles
    for k in range(owners):
        flow = through_owner(flow, dealt.where(F.col("owner") == k), k, owners, n_docs, n_terms, top)
    found = written(flow, "found")
    for table in (dealt, bundles, owned):
        drop_written(table)
    if wanted is not None:
        wanted.unpersist()

    ranked = Window.partitionBy("bundle", "place").orderBy(
        F.desc("score"), F.col("doc_id").isNull(), "doc_id", "slice", "doc")
    return (found.join(slices.select("slice", "ids"), "slice")
            .select("bundle", "place", "score", "slice", "doc", F.get("ids", F.col("doc")).alias("doc_id"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
            .join(queries.select("bundle", "place", "item_id"), ["bundle", "place"])
            .select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
 q as (select item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts from benchmark),
 c as (select count(*) as big_n, sum(len(ts))::BIGINT as big_l from d where len(ts) > 0),
 p as (select doc_id, len(ts)::BIGINT as n, unnest(ts) as term from d),
 f as (select doc_id, n, term, count(*) as tf from p group by doc_id, n, term),
 w as (select term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT as w from f, c group by term, big_n),
 i as (select item_id, unnest(ts) as term from q),
 s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))))::BIGINT as score
       from i join f using (term) join w using (term), c group by item_id, doc_id),
 r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::INT as rank, doc_id, score from r where rank <= 10
"""


@register("op12_lexical_search", SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: for each benchmark item the ten documents
    that score highest."""
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"),
                  read(spark, sf_dir, "benchmark").select("item_id", "text"))
