"""Toxicity by a weighted finite-state grammar: word classes, negation,
reported speech and target transducers are composed into one machine that
reads clauses; scores come from matched clauses, not from isolated words."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import read, written
from .registry import register

# The grammar's own words.  Insults are learned on top of these.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb"
THREATS = "kill murder strangle stab shoot destroy crush töte umbring erschieß matar mataré tuer tuerai"
TARGETS = ("you your yours yourself he she they him her them du dich dir ihr euch sie tu te ti vous toi usted "
           "ustedes tú vosotros")
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás"
REPORTS = ("said says say wrote writes called calls claims quoted sagte sagt schrieb nannte dit disait écrit "
           "dijo dice escribió llamó")

#: Most labelled documents of either class that the fit reads.
TRAIN_PER_CLASS = 4000
#: Most learned stems, and the lengths that a stem may have.
STEMS, STEM_LENGTHS = 400, range(4, 10)
#: Log odds that a stem has at least: 2.2 is nine times likelier among toxic rows.
LEAST_ODDS = 2.2
THRESHOLD = 0.3
FEATURES = 6

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_QUOTES = re.compile("[\"“”«»„]")


# --- transducers -----------------------------------------------------------------
# A sequential transducer is (start state, step) with step(state, symbol) ->
# (state, output).  Symbols: I insult, H threat, T target, N negation, R report,
# Q quotation mark, O other; a step may mark I and H as n (negated), r (reported)
# or t (aimed at a target), and sends every symbol on.
def negation(state: int, symbol: str):
    if symbol == "N":
        return 3, symbol
    if symbol[0] in "IH" and state:
        return state - 1, symbol + "n"
    return max(0, state - 1), symbol


def reported(state: str, symbol: str):
    if symbol == "Q":
        return ("own" if state == "quoted" else "quoted"), symbol
    if symbol == "R" and state == "own":
        return "told", symbol
    if symbol[0] in "IH" and state != "own":
        return state, symbol + "r"
    return state, symbol


def targeted(state: int, symbol: str):
    if symbol == "T":
        return 6, symbol
    if symbol[0] in "IH" and state:
        return state - 1, symbol + "t"
    return max(0, state - 1), symbol


def compose(first, second):
    """The machine that reads what ``first`` writes into ``second``."""
    def step(state, symbol):
        a, mid = first[1](state[0], symbol)
        b, out = second[1](state[1], mid)
        return (a, b), out
    return (first[0], second[0]), step


def tabled(machine, symbols="IHTNRQO") -> dict:
    """All reachable (state, symbol) -> (state, output) of a machine."""
    table, todo = {}, [machine[0]]
    while todo:
        s = todo.pop()
        for x in symbols:
            if (s, x) not in table:
                table[s, x] = nxt = machine[1](s, x)
                todo.append(nxt[0])
    return table


GRAMMAR = compose(compose((0, negation), ("own", reported)), (0, targeted))
TABLE = tabled(GRAMMAR)
START, QUOTED = GRAMMAR[0], ((0, "quoted"), 0)


def feature_of(output: str) -> int | None:
    """Which count a marked symbol adds to: plain, aimed, negated or reported
    insult, plain threat (only if aimed), denied or reported threat."""
    if output[0] == "I":
        return 2 if "n" in output else 3 if "r" in output else 1 if "t" in output else 0
    if output[0] == "H" and "t" in output:
        return 5 if "n" in output or "r" in output else 4
    return None


class Lexicon:
    """The lexical transducer: word -> (symbol, weight).  ``stems`` are learned
    word beginnings with weights; the fixed words stand on their own."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick
        self.exact = {w: "T" for w in TARGETS.split()}
        self.exact.update({w: "N" for w in NEGATIONS.split()})
        self.exact.update({w: "R" for w in REPORTS.split()})
        self.stems = {w: ("H", 1.0) for w in THREATS.split()}
        self.stems.update({w: ("I", 1.0) for w in INSULTS.split()})
        self.stems.update({s: ("I", w) for s, w in stems.items()})
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.finder = ahocorasick.Automaton()
        for s in self.stems:
            self.finder.add_word(s, len(s))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in '"“”«»„':
            return "Q", 0.0
        if word in self.exact:
            return self.exact[word], 0.0
        for n in self.lengths:
            hit = self.stems.get(word[:n])
            if hit and len(word) >= n:
                return hit
        return "O", 0.0

    def features(self, text: str) -> list[float]:
        """Weighted counts of the grammar's matches over the whole text.  Only
        clauses that hold a word beginning like an insult or a threat are read;
        a clause starts inside a quotation if one is open in its line."""
        out = [0.0] * FEATURES
        text = text.lower()
        # quotation marks of the line are counted up to marked_to
        read_to = marked_to = is_open = 0
        for end, n in self.finder.iter(text):
            at = end - n + 1
            if at < read_to or (at and (text[at - 1].isalpha())):
                continue
            begin = max((text.rfind(c, read_to, at) for c in ".!?;\n"), default=-1) + 1
            begin = max(begin, read_to)
            stop = _CLAUSE_END.search(text, at)
            stop = stop.start() if stop else len(text)
            line = text.rfind("\n", marked_to, begin)
            if line >= 0:
                marked_to, is_open = line, 0
            is_open = (is_open + len(_QUOTES.findall(text, marked_to, begin))) % 2
            marked_to = begin
            state = QUOTED if is_open else START
            for word in _WORD.findall(text, begin, stop):
                symbol, weight = self.symbol(word)
                state, marked = TABLE[state, symbol]
                k = feature_of(marked)
                if k is not None:
                    out[k] += weight
            read_to = stop
        return out


# --- learning --------------------------------------------------------------------
def stem_counts(train: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many documents of each class some word
    begins so.  Counts are summed per task before the shuffle."""
    def count(batches):
        import pyarrow as pa
        held: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = {w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) >= STEM_LENGTHS[0]}
                for s in {w[:n] for w in words for n in STEM_LENGTHS if n <= len(w)}:
                    held.setdefault(s, [0, 0])[0 if toxic else 1] += 1
                if len(held) > 50_000:  # bounded memory: send on and go on counting
                    yield batch(pa, held)
                    held = {}
        if held:
            yield batch(pa, held)

    def batch(pa, held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()),
             pa.array([v[1] for v in held.values()], pa.int64())], ["stem", "toxic", "clean"])

    return (train.select("text", "toxic").mapInArrow(count, "stem string, toxic long, clean long")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def statistic(n_toxic: int, n_clean: int):
    """The likelihood-ratio statistic of ``choose_stems`` as a column."""
    total, seen = n_toxic + n_clean, F.col("toxic") + F.col("clean")
    parts = [(F.col("toxic"), seen, n_toxic), (F.col("clean"), seen, n_clean),
             (n_toxic - F.col("toxic"), total - seen, n_toxic), (n_clean - F.col("clean"), total - seen, n_clean)]
    return sum(F.when(x > 0, 2 * x * F.log(x * float(total) / (row * float(col)))).otherwise(0.0) for x, row, col in parts)


def choose_stems(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, floor: float) -> dict[str, float]:
    """Stems by their likelihood-ratio statistic against independence, best
    first; a stem that begins like a chosen one, or the other way round, is
    passed over.  Of equals the longest is taken.  Weights are log odds over
    ten, at most one."""
    def statistic(a, b):
        total, seen = n_toxic + n_clean, a + b
        g = 0.0
        for x, row, col in ((a, seen, n_toxic), (b, seen, n_clean), (n_toxic - a, total - seen, n_toxic),
                            (n_clean - b, total - seen, n_clean)):
            if x > 0:
                g += 2 * x * math.log(x * total / (row * col))
        return g

    ranked = sorted(((statistic(a, b), len(s), s, a, b) for s, a, b in rows), reverse=True)
    chosen: dict[str, float] = {}
    for g, _, s, a, b in ranked:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if g < floor or odds < LEAST_ODDS or len(chosen) >= STEMS:
            continue
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen[s] = min(1.0, odds / 10)
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, bias last, by Newton steps."""
    x = np.hstack([np.log1p(4 * x), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


class Model:
    """Learned stems and the weights of the grammar's outputs."""

    def __init__(self, stems: dict[str, float], weights: list[float]):
        self.stems, self.weights = stems, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.hstack([np.log1p(4 * features), np.ones((len(features), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.weights), -30, 30)))


#: Used when the labels cannot teach: no toxic or no clean training row.
PRIOR_WEIGHTS = [2.0, 2.5, 0.5, 0.5, 3.0, 0.5, -3.0]


def grammar_features(docs: DataFrame, stems: dict[str, float], text: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``features`` of each row's whole text."""
    schema = docs.select(*keep).schema.add("features", ArrayType(DoubleType()))

    def run(batches):
        import pyarrow as pa
        lexicon = Lexicon(stems)
        for b in batches:
            feats = [lexicon.features(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(feats, pa.list_(pa.float64()))], [*keep, "features"])

    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, schema)


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """A model from labelled rows outside the held-out quarter: of either class
    the ``per_class`` rows of least id hash, in expectation, so the sample is
    bounded whatever the size of ``labels`` and small enough to be sent to all
    executors.  Rows labelled twice count as toxic if one label is; null ids
    and labels teach nothing."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = (labels.where("doc_id is not null and toxic is not null").where(~is_held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Model({}, PRIOR_WEIGHTS)
    chance = F.xxhash64(F.lit(11), "doc_id") / float(1 << 64) + 0.5
    sample = known.where(chance < F.when(F.col("toxic") == 1, per_class / counts[1]).otherwise(per_class / counts[0]))
    train = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                    .select("text", "toxic"), "train").repartition(parts)
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, PRIOR_WEIGHTS)
    counted = written(stem_counts(train), "stems")
    floor = 2 * math.log(max(counted.count(), 2)) + 2
    likelier = (F.col("toxic") + 0.5) / (n_toxic + 1) > math.exp(LEAST_ODDS) * (F.col("clean") + 0.5) / (n_clean + 1)
    # all stems that the model may choose; the bounded sample bounds them
    rows = counted.where(likelier & (F.col("toxic") >= 3) & (statistic(n_toxic, n_clean) >= floor - 1e-6)).collect()
    stems = choose_stems([tuple(r) for r in rows], n_toxic, n_clean, floor)
    sample_rows = grammar_features(train, stems, "text", "toxic").collect()
    x = np.array([r["features"] for r in sample_rows], float)
    y = np.array([float(r["toxic"]) for r in sample_rows])
    # the sample is balanced otherwise than the labels: shift the bias back
    weights = fit_logistic(x, y)
    weights[-1] += math.log(counts[1] / n_toxic) - math.log(counts[0] / n_clean)
    return Model(stems, weights.tolist())


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from THRESHOLD on).

    Every whole text is read; a null or empty one has no clause and gets the
    score of a text without matches.  Rows are scored one by one, so repeated
    rows agree and an empty table gives no rows.  Columns called score or
    predicted (any case) are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    place = keep.index(text)

    def run(batches):
        import pyarrow as pa
        lexicon = Lexicon(model.stems)
        for b in batches:
            if b.num_rows == 0:
                continue
            feats = np.array([lexicon.features(t.as_py() or "") for t in b.column(place)])
            s = model.scores(feats)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
