"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses; each word of a clause becomes a terminal: insult, threat, target, negation, report, or other.
Transducers mark what is aimed at a target, what stands in the scope of a negation and what is reported speech. Aim is read
from either side: its transducer runs over the reversed clause first, the composed one over the clause. The mark that an
insult or threat ends with is its reading, and each reading has a weight: an aimed one counts more than a bare one, as in
a clause that leaves its target out, and far more than a reported or negated one. A clause's score is the sum along its
path. Insults are a seed list and what labelled rows add to it: words and word beginnings with weights, learnt from a
bounded sample. A document's matched clauses make features of a logistic model whose weights are never negative, so among
texts of the same words the order of the readings is that of the scores. The model sees each part of the sample through a
lexicon learnt from the others."""

from __future__ import annotations

import math
import re
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW_KEY, fold, lean, row_key, small_batches, texts

#: Labelled rows to learn from (fewer than 65,536), entries that the lexicon learns, and the least weight of one: documented bounds.
SAMPLE = 20_000
ENTRIES = 20_000
LEAST_WEIGHT = 1.6
#: Rows whose fold of FOLDS is 0 are held out. The sample has PARTS parts; the model sees each part through a lexicon that
#: the other parts taught, as it will see rows that taught neither.
FOLDS = 5
PARTS = 4
#: Lengths of the word beginnings that the lexicon may learn.
BEGINNINGS = (4, 5, 6)
#: Words that a negation reaches, and words between an insult and its target.
NEGATED, AIMED = 3, 4

# Seed terminals; what labels add comes on top.
SEEDS = {
    "insult": "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb dimwit cretin vermin filth bastard depp trottel dummkopf abschaum connard crétin minable ordure imbécil estúpido basura inútil",
    "threat": "kill hurt destroy smash burn punish töten vernichten verprügeln tuer frapper détruire matar golpear destruir",
    "target": "you your yourself they them he she him her people du dich dir ihr euch sie tu toi vous eux usted ustedes ellos",
    "negation": "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás",
    "report": "said says reported quoted according called wrote sagte laut schrieb zitierte dit selon écrit dijo según escribió",
}
OTHER = "other"
#: What a reading counts for.
READINGS = {"bare": 1.0, "aimed": 1.5, "reported": 0.5, "negated": 0.25}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n\r]+(?:\s|$)|\n")


class Transducer(NamedTuple):
    """arcs: (state, symbol) to (output, next state); without an arc a symbol passes and the state goes to rest(state)."""

    arcs: dict[tuple[int, str], tuple[str, int]]
    rest: dict[int, int]

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        return self.arcs.get((state, symbol)) or (symbol, self.rest.get(state, state))


def _scope(opener: str, reach: int | None, mark: str, inputs: tuple[str, ...]) -> Transducer:
    """After opener, inputs become input|mark, for reach symbols or to the end of the clause."""
    arcs: dict[tuple[int, str], tuple[str, int]] = {}
    states = range(1 + (reach or 1))
    for s in states:
        arcs[s, opener] = (opener, reach or 1)
    after = {s: (s if reach is None else s - 1) for s in states if s}
    for s, nxt in after.items():
        for x in inputs:
            arcs[s, x] = (f"{x}|{mark}", nxt)
    return Transducer(arcs, {0: 0, **after})


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """The transducer whose output is second's on first's output; states are numbered as they are reached."""
    number, todo = {(0, 0): 0}, [(0, 0)]
    arcs: dict[tuple[int, str], tuple[str, int]] = {}
    while todo:
        a, b = pair = todo.pop()
        for x in symbols:
            middle, na = first.step(a, x)
            out, nb = second.step(b, middle)
            if (na, nb) not in number:
                number[na, nb] = len(number)
                todo.append((na, nb))
            arcs[number[pair], x] = (out, number[na, nb])
    return Transducer(arcs, {})


HITS = ("insult", "threat")
SYMBOLS = (*HITS, "target", "negation", "report", OTHER)
#: What the reversed reading leaves for the other: symbols, and hits that a target follows.
ONCE_READ = (*SYMBOLS, *(f"{h}|aimed" for h in HITS))


def aim() -> Transducer:
    return _scope("target", AIMED, "aimed", HITS)


def grammar() -> Transducer:
    """Report over negation over aim: the last mark of a symbol decides its reading."""
    negate = _scope("negation", NEGATED, "negated", (*HITS, *(f"{h}|aimed" for h in HITS)))
    report = _scope("report", None, "reported", tuple(f"{h}{a}{n}" for h in HITS for a in ("", "|aimed") for n in ("", "|negated")))
    return compose(compose(aim(), negate, ONCE_READ), report, ONCE_READ)


def readings(terminals: list[str], machine: Transducer, backward: Transducer) -> list[str | None]:
    """The reading of each insult or threat of a clause; None of other words."""
    state, marked = 0, []
    for x in reversed(terminals):
        x, state = backward.step(state, x)
        marked.append(x)
    state, out = 0, []
    for x, kind in zip(reversed(marked), terminals, strict=True):
        x, state = machine.step(state, x)
        out.append((x.rpartition("|")[2] if "|" in x else "bare") if kind in HITS else None)
    return out


class Lexicon:
    """Terminals of words, with weights; what it has seen it remembers, up to a bound."""

    def __init__(self, learnt: dict[str, float]):
        self.learnt, self.memo = learnt, {}
        self.seeds = {w: k for k, words in SEEDS.items() for w in words.split()}
        # a seed counts as much as a middling learnt entry until labels say more
        self.seed_weight = float(np.median([w for w in learnt.values() if w > 3] or [3.0]))

    def __call__(self, word: str) -> tuple[str, float]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            weight = max((self.learnt.get(e, 0.0) for e in entries(word)), default=0.0)
            kind = self.seeds.get(word, OTHER)
            if kind in ("insult", "threat"):
                got = kind, max(weight, self.seed_weight if kind == "insult" else 1.0)
            else:
                got = ("insult", weight) if weight > 0 and kind == OTHER else (kind, 0.0)
            self.memo[word] = got
        return got


def entries(word: str) -> list[str]:
    """What the lexicon may know a word by: itself (with an end mark) and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


N_FEATURES = 4


def features(text: str, lexicon: Lexicon, machines: tuple[Transducer, Transducer]) -> np.ndarray:
    """Of the clauses that match: the sum of their scores for insults, how many insults that makes by reading, the same for
    threats (all on a log scale), and the score of the heaviest clause."""
    total = hits = threats = best = 0.0
    for clause in _CLAUSE.split(text.lower()):
        terminals = [lexicon(w) for w in _WORD.findall(clause)]
        kinds = [k for k, _ in terminals]
        if not ("insult" in kinds or "threat" in kinds):
            continue
        score = 0.0
        for (kind, weight), reading in zip(terminals, readings(kinds, *machines), strict=True):
            if reading is None:
                continue
            if kind == "threat":
                threats += READINGS[reading]
            else:
                score += READINGS[reading] * weight
                hits += READINGS[reading]
        total, best = total + score, max(best, score)
    return np.array([math.log1p(total), math.log1p(hits), math.log1p(threats), best])


COUNTS = [f"{kind}{part}" for part in range(PARTS) for kind in ("clean", "toxic")]


@lean
def _lexicon_rows(batches):
    """How many clean and toxic texts of each part of the sample hold an entry; a task adds up what it holds at once, at
    most some 100,000 entries. An entry's counts are the 16-bit digits of one number."""
    counts: dict[str, int] = {}

    def made():
        keys, values = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([v >> 16 * i & 0xFFFF for v in values], pa.int32()) for i in range(len(COUNTS)))], ["entry", *COUNTS])

    for batch in batches:
        for t, toxic, part in zip(texts(batch), batch.column("toxic").to_pylist(), batch.column("part").to_pylist(), strict=True):
            one = 1 << 16 * (2 * part + toxic)
            for e in {e for w in set(_WORD.findall(t.decode("utf-8", "replace").lower())) if len(w) <= 40 for e in entries(w)}:
                counts[e] = counts.get(e, 0) + one
            if len(counts) > 100_000:
                yield made()
    yield made()


def _weight(toxic, clean, n_toxic: int, n_clean: int):
    """The lower end of an interval for the log of how much likelier toxic texts hold an entry."""
    ratio = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
    return ratio - 1.64 * F.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))


@lean
def _featurize(batches, lexica):
    own, machine = [Lexicon(x) for x in lexica.value], (grammar(), aim())
    for batch in batches:
        x = [features(t.decode("utf-8", "replace"), own[p], machine) for t, p in zip(texts(batch), batch.column("part").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def monotone(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same, with no weight but the constant below zero: features that would get one are left out in turn."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = logistic(x * used, y)
        low = np.where(used, w[:-1], 0.0)
        if low.min(initial=0.0) >= 0:
            return np.append(np.where(used, w[:-1], 0.0), w[-1])
        used[low.argmin()] = False


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most SAMPLE labelled rows that aren't held out; rows without a label or an id teach nothing. Of
    labels that repeat, for an id or for a text, toxic prevails; texts that repeat in the sample teach once."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("toxic is not null").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("id").isNotNull() & (fold(F.col("id"), FOLDS) != 0)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    luck = F.xxhash64("id", F.lit(29))
    sample = known.orderBy(luck, "id").limit(SAMPLE).withColumn("part", F.pmod(F.xxhash64("id", F.lit(31)), F.lit(PARTS)).cast("int"))
    texts_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("toxic", "part", "text")
    # the sample has a bound, and so has what is kept of it between the two uses
    rows = texts_.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("part").alias("part")).persist()
    try:
        n = {(r["toxic"], r["part"]): r["n"] for r in rows.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
        counted = rows.mapInArrow(_lexicon_rows, "entry string, " + ", ".join(f"{c} int" for c in COUNTS)).groupBy("entry").agg(*(F.sum(c).alias(c) for c in COUNTS))
        # lexicon p is without part p; the last is without none
        held = [[q for q in range(PARTS) if q != p] for p in range(PARTS + 1)]
        total = lambda kind, parts: sum((F.col(f"{kind}{q}") for q in parts[1:]), F.col(f"{kind}{parts[0]}"))
        names = [f"w{p}" for p in range(PARTS + 1)]
        weights = [_weight(total("toxic", q), total("clean", q), *(sum(n.get((t, x), 0) for x in q) for t in (1, 0))).alias(w) for q, w in zip(held, names, strict=True)]
        weighed = counted.filter(total("toxic", held[-1]) > 1).select("entry", *weights)
        top = F.greatest(*names)
        best = weighed.filter(top >= LEAST_WEIGHT).orderBy(F.desc(top), "entry").limit(ENTRIES).collect()
        lexica = [{r["entry"]: r[w] for r in best if r[w] >= LEAST_WEIGHT} for w in names]
        taught = rows.select("toxic", "part", "text").mapInArrow(partial(_featurize, lexica=spark.sparkContext.broadcast(lexica[:-1])), "toxic int, x array<double>").collect()
    finally:
        rows.unpersist()
    x = np.array([r["x"] for r in taught] or np.zeros((0, N_FEATURES)))
    y = np.array([r["toxic"] for r in taught], float)
    # one row of each kind by hand, so that a sample of one class or none still gives a model
    x, y = np.vstack([x, np.zeros(N_FEATURES), [math.log1p(6.0), math.log1p(2.0), math.log1p(1.0), 6.0]]), np.append(y, [0.0, 1.0])
    return Model(lexica[-1], monotone(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, and the row's key. Null and empty texts get the score of a
    text without findings. Repeated rows are each scored; extra columns are left out; no rows give none."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def made(batches):
        lexicon, machine, w = Lexicon(shared.value.lexicon), (grammar(), aim()), shared.value.weights
        for batch in batches:
            z = np.array([features(t.decode("utf-8", "replace"), lexicon, machine) @ w[:-1] + w[-1] for t in texts(batch)], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(ROW_KEY), pa.array(p)], ["id", ROW_KEY, "score"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias(ROW_KEY), F.col(text_col).alias("text")).mapInArrow(made, f"id {kind}, {ROW_KEY} long, score double")
    return rows.select(F.col("id").alias(id_col), (fold(F.col("id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), ROW_KEY)


def reject(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    @lean
    def made(batches):
        lexicon, machine, w = Lexicon(shared.value.lexicon), (grammar(), aim()), shared.value.weights
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            clean = [features(t.decode("utf-8", "replace"), lexicon, machine) @ w[:-1] + w[-1] < 0 for t in texts(named)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(made, docs.schema)
