"""Personal data by weak supervision: labelers vote on candidate spans,
expectation-maximisation estimates how reliable each is, and a span classifier
trained on the estimated labels decides.  Column and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .registry import register

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Base patterns.  They find the leftmost non-overlapping matches of the stated
# expressions; possessive loops and the look-behind only keep a long run of
# allowed characters from being tried again at each of its characters.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A text without this cannot hold the kind.
NEEDS = (r"@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")
# Wider patterns, whose matches are only candidates.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    None,  # a card's candidates are the base matches that fail its checks
    r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
)
LOOSE_NEEDS = (r"[\[(]at[\])]", r":[0-9A-Fa-f]{1,4}:", None, r"[0-9]{3}[\x20.-][0-9]{4}")

# Gazetteers and context words (fixed values).
TOP_DOMAINS = "com org net edu gov mil int info biz io co ai app dev de fr es uk us ca au ch at it nl be pt eu"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = (r"e-?mail|mail|contact|kontakt|correo|courriel|write to", r"\bip\b|host|server|address|adresse|direcc",
        r"card|karte|carte|tarjeta|visa|credit|konto", r"tel|phone|call|fax|mobil|handy|llame|appel")

MARK = "￿"  # stands around matches while a text is cut; a text's own becomes U+FFFD
BEFORE = 32
CHUNK = 256  # even, so that every chunk begins with a gap
VOTES = 4
EM_ROUNDS = 60
FIT_ROUNDS = 400
ACCEPT = 0.5


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, found, before>> of a pattern's leftmost
    non-overlapping matches; positions count code points, end exclusive."""
    kind = "array<struct<start:int,end:int,found:string,before:string>>"
    none = F.from_json(F.lit("[]"), kind)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"), none.alias("out"))

    def step(a, piece):
        end = a["at"] + F.length(piece)
        hit = F.struct(a["at"].alias("start"), end.alias("end"), piece.alias("found"), a["before"].alias("before"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"),
                        F.when(a["inside"], F.lit("")).otherwise(F.lower(F.right(piece, F.lit(BEFORE)))).alias("before"),
                        F.when(a["inside"], F.concat(a["out"], F.array(hit))).otherwise(a["out"]).alias("out"))

    # pieces are gaps and matches in turn; they are walked in chunks, so that a
    # text with very many matches costs no square of their number
    def walk(pieces):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")),
                             lambda c: F.aggregate(F.slice(pieces, c * CHUNK + 1, CHUNK), start, step))
        return bound(chunks, joined)

    def joined(chunks):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(chunks, zero, lambda a, c: F.struct(
            (a["at"] + c["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        return bound(starts, lambda s: F.flatten(F.transform(chunks, lambda c, i: F.transform(c["out"], lambda h: F.struct(
            (h["start"] + F.get(s, i)).alias("start"), (h["end"] + F.get(s, i)).alias("end"),
            h["found"].alias("found"), h["before"].alias("before"))))))

    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(text.rlike(needs), bound(pieces, walk)).otherwise(none)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits' Luhn sum is a multiple of ten."""
    places = F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array([F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                                                         d.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: int, found: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        # a part is at most 255: three digits at most after leading zeros, and no more than 255
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(digits(found))
    if kind == CARD:
        return F.when((n >= 13) & (n <= 19), luhn(digits(found))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def shaped(kind: int, found: Column) -> Column:
    """The structure labeler: usual lengths and separators."""
    n = F.length(digits(found))
    if kind == EMAIL:
        return found.rlike(r"^.{1,64}(?:@|[\[(]at[\])]).*[.\])\x20][A-Za-z]{2,24}$")
    if kind == IP:
        return ~found.rlike(r"(?:^|\.)0[0-9]")
    if kind == CARD:
        return n.isin(15, 16) & ~found.rlike("^(.)\\1*$")
    return (n >= 10) & (n <= 13)


def listed(kind: int, found: Column) -> Column:
    """The gazetteer labeler: known top domains, issuers, country codes."""
    if kind == EMAIL:
        return F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS.split())
    if kind == IP:
        return ~found.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")
    if kind == CARD:
        return digits(found).rlike(ISSUERS)
    return found.rlike(r"^\+(?:%s)(?:[^0-9]|[0-9]{7})" % "|".join(COUNTRY_CODES.split()))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes>> of a text, by kind and start;
    votes has a bit each for regex, structure, gazetteer and context."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit("�"))

    def judge(k, loose):
        def judged(m):
            base = F.lit(False) if loose else valid(k, m["found"])
            marks = (base, shaped(k, m["found"]), listed(k, m["found"]), m["before"].rlike(CUES[k]))
            votes = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(marks)), F.lit(0))
            return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                            base.alias("base"), votes.alias("votes"))
        return judged

    all_kinds = []
    for k in range(len(KINDS)):
        found = F.transform(matches(text, BASE[k], NEEDS[k]), judge(k, False))
        if k in (IP, PHONE):
            found = F.filter(found, lambda c: c["base"])
        if k == CARD:  # a number of a card's length that fails the checks stays a candidate
            found = F.filter(found, lambda c: c["base"] | (c["end"] - c["start"]).between(13, 23))
        all_kinds.append(found)
        if LOOSE[k]:
            all_kinds.append(F.transform(matches(text, LOOSE[k], LOOSE_NEEDS[k]), judge(k, True)))
    return F.sort_array(F.concat(*all_kinds))


def reliabilities(patterns: list[tuple[int, int, int]]) -> dict[int, dict]:
    """Expectation-maximisation over (kind, votes, count) rows, at most
    2**VOTES a kind: each labeler votes independently given whether the span
    is personal data.  Starts from the share of labelers that vote; returns
    per kind the prior, each labeler's hit and false-alarm rate and the
    posterior of every pattern."""
    out = {}
    for k in sorted({p[0] for p in patterns}):
        rows = [(v, n) for kk, v, n in patterns if kk == k]
        post = {v: (bin(v).count("1") + 0.5) / (VOTES + 1) for v, _ in rows}
        for _ in range(EM_ROUNDS):
            yes = sum(post[v] * n for v, n in rows) + 1
            no = sum((1 - post[v]) * n for v, n in rows) + 1
            prior = yes / (yes + no)
            hit = [(sum(post[v] * n for v, n in rows if v >> j & 1) + 1) / (yes + 1) for j in range(VOTES)]
            alarm = [(sum((1 - post[v]) * n for v, n in rows if v >> j & 1) + 0.5) / (no + 1) for j in range(VOTES)]
            for v, _ in rows:
                odds = math.log(prior / (1 - prior))
                for j in range(VOTES):
                    h, a = min(hit[j], 0.999), min(alarm[j], 0.999)
                    odds += math.log(h / a) if v >> j & 1 else math.log((1 - h) / (1 - a))
                post[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        out[k] = {"prior": prior, "hit": hit, "alarm": alarm, "posterior": post}
    return out


def classifier(patterns: list[tuple[int, int, int]]) -> dict[int, list[float]]:
    """Logistic weights (bias, one per labeler) of each kind, fitted to the
    posteriors as soft labels, patterns weighted by the log of their counts."""
    weights = {}
    for k, r in reliabilities(patterns).items():
        rows = [([1.0] + [float(v >> j & 1) for j in range(VOTES)], r["posterior"][v], 1 + math.log(n))
                for kk, v, n in patterns if kk == k]
        w, total = [0.0] * (VOTES + 1), sum(c for _, _, c in rows)
        for _ in range(FIT_ROUNDS):
            slope = [0.002 * x for x in w]
            for x, y, c in rows:
                p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x))))))
                slope = [s + c / total * (p - y) * a for s, a in zip(slope, x)]
            w = [a - 1.5 * s for a, s in zip(w, slope)]
        weights[k] = w
    return weights


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with spans: array<struct<kind, start, end, base, score>>, sorted
    by kind (order of KINDS), then start.

    Base spans (the patterns with their checks) always stay; other candidates
    are added if the classifier accepts them and they touch no base span.
    Candidates of all documents are found in one pass and written; only counts
    of vote patterns, at most 64 rows, reach the driver for the fit.
    A null text is empty and has no spans; repeated rows have equal spans; an
    empty table fits nothing and gives no rows.  A column called spans (any
    case) is replaced; others pass through."""
    keep = [c for c in docs.columns if c.lower() not in ("spans", text.lower())]
    held = written(docs.select(*keep, candidates(F.col(text)).alias("spans")), "candidates")
    counted = (held.where(F.size("spans") > 0).select(F.explode("spans").alias("c"))
               .groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes"))
    weights = classifier([(r["kind"], r["votes"], r["n"]) for r in counted.collect()])

    def scored(c):
        odds = F.lit(-30.0)
        for k, w in weights.items():
            odds = F.when(c["kind"] == k, w[0] + sum(
                (F.when(c["votes"].bitwiseAND(1 << j) != 0, w[j + 1]).otherwise(0.0) for j in range(VOTES)),
                F.lit(0.0))).otherwise(odds)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                        c["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("score"))

    marked = F.transform("spans", scored)
    base = F.filter(F.col("spans"), lambda c: c["base"])

    def stays(c):
        clear = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return c["base"] | ((c["score"] >= ACCEPT) & clear)

    return held.select(*keep, F.filter(marked, stays).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array([F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all
    documents; the counts are of base spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(k):   # a second parameter of the lambda would be the place in the array
        return F.filter("spans", lambda s: s["base"] & (s["kind"] == k))

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))
