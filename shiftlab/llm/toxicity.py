"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, harm, target, first person, intent, negation, speech,
other). Five transducers are composed over each clause, the output of one being the
input of the next:

* threats: first person, intent, harm, target in this order turn the harm word into a
  threat;
* insults aimed at a target within the clause become aimed insults;
* a negation takes the next insult or threat within its scope to a negated one;
* a verb of speech makes what follows in the clause reported;
* the scorer maps each symbol that is left to its class.

A clause's score is the weight of its insult terminals by class; a document's score is a
logistic function of the summed clause scores by class. Function words are fixed lists.
Insult terminals and class weights are learnt from a bounded sample of labelled rows:
whole words and word beginnings that occur in toxic rows of several different texts and
(almost) only there. Clauses without an insult or harm word weigh nothing, so only those
around a match are run.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import tidy
from shiftlab.llm.labelled import held_out, sample

#: Labelled rows used for fitting.
SAMPLE_ROWS = 8_000
#: Least share of toxic texts among the sample texts with a terminal.
PRECISION = 0.75
#: Terminals kept.
MAX_TERMINALS = 2_000
STEMS = (3, 4, 5, 6, 7, 8)

# Function words of the grammar, by language.
HARM = "kill hurt beat destroy shoot stab strangle burn töten umbringen verprügeln tuer frapper matar golpear".split()
TARGET = ("you your he she they him her them this these those du dich ihr euch er ihn tu te toi vous il elle "
          "ils tú vosotros usted ustedes él ella ellos").split()
FIRST = "i we ich wir je nous yo nosotros".split()
INTENT = "will gonna going shall werde werden vais allons voy vamos".split()
NEGATION = "not never no isn't aren't don't nicht kein keine nie pas jamais ne no nunca".split()
SPEECH = "said says called calls wrote reported quoted sagte nannte schrieb dit disait appelait dijo llamó escribió".split()

CLASSES = ("plain", "aimed", "negated", "reported", "threat")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_ENDS = ".!?;:,\n"
_CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
_SYMBOLS = {w: s for words, s in ((HARM, "harm"), (TARGET, "target"), (FIRST, "first"), (INTENT, "intent"),
                                  (SPEECH, "speech"), (NEGATION, "not")) for w in words}


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (next state, symbol written); symbols without an arc are
    copied and lead to ``fallback`` of the state, or keep it."""
    arcs: dict
    fallback: dict

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            if (state, s) in self.arcs:
                state, s = self.arcs[state, s]
            else:
                state = self.fallback.get(state, state)
            out.append(s)
        return out


def _counted(scope: int, opens: str, rewrites: dict[str, str]) -> Transducer:
    """After ``opens``, the next ``scope`` symbols are rewritten."""
    arcs, fallback = {(0, opens): (scope, opens)}, {}
    for k in range(1, scope + 1):
        arcs[k, opens] = (scope, opens)
        arcs.update({(k, a): (k - 1, b) for a, b in rewrites.items()})
        fallback[k] = k - 1
    return Transducer(arcs, fallback)


THREATS = Transducer({(0, "first"): (1, "first"), (1, "intent"): (2, "intent"), (2, "harm"): (3, "threat"),
                      (3, "target"): (0, "target")}, {})
AIM = Transducer({(0, "target"): (1, "target"), (1, "insult"): (1, "aimed")}, {})
NOT = _counted(3, "not", {"insult": "negated", "aimed": "negated", "threat": "negated"})
REPORT = Transducer({(0, "speech"): (1, "speech"), (1, "insult"): (1, "reported"), (1, "aimed"): (1, "reported"),
                     (1, "threat"): (1, "reported"), (1, "negated"): (1, "negated")}, {})
SCORER = Transducer({(0, "insult"): (0, "plain"), (0, "harm"): (0, "other")}, {})
GRAMMAR = (THREATS, AIM, NOT, REPORT, SCORER)


@dataclass
class Model:
    """``terminals``: insult word, or beginning with ``*``, to its weight; the rest is the
    logistic function of the class sums."""
    terminals: dict[str, float]
    weights: tuple[float, ...] = (2.0, 2.5, 0.5, 0.8, 3.0)
    bias: float = -2.5

    def __post_init__(self):
        self.stems = tuple(sorted({len(t) - 1 for t in self.terminals if t.endswith("*")}))
        self.pattern = _pattern([*self.terminals, *HARM])

    def weight(self, word: str) -> float:
        best = self.terminals.get(word, 0.0)
        for n in self.stems:
            if len(word) > n:
                best = max(best, self.terminals.get(word[:n] + "*", 0.0))
        return best

    def sums(self, text: str) -> list[float]:
        """Weight of the text's matched clauses by class."""
        out = dict.fromkeys(CLASSES, 0.0)
        low, done = text.lower(), -1
        for m in self.pattern.finditer(low):
            if m.start() < done:
                continue
            after = max(done, 0)                  # the part before it is never searched again
            start = max(after, *(low.rfind(c, after, m.start()) + 1 for c in CLAUSE_ENDS))
            end = _CLAUSE_END.search(low, m.end())
            done = end.end() if end else len(low)
            words = _WORD.findall(low, start, done)
            weights = [self.weight(w) for w in words]
            symbols = ["insult" if x else _SYMBOLS.get(w, "other") for w, x in zip(words, weights)]
            for t in GRAMMAR:
                symbols = t.run(symbols)
            for s, x in zip(symbols, weights):
                if s in out:
                    out[s] += x or 1.0
        return [out[c] for c in CLASSES]

    def score(self, sums: np.ndarray) -> np.ndarray:
        z = np.log1p(sums) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pattern(terminals) -> re.Pattern:
    """Matches a word that is a terminal or begins with one."""
    words = sorted((re.escape(t[:-1]) + r"\w+" if t.endswith("*") else re.escape(t) + r"(?!\w)" for t in terminals),
                   key=len, reverse=True)
    return re.compile(r"(?<!\w)(?:" + "|".join(words) + ")")


def _terminals(text: str, known: set | None = None) -> tuple[set, int]:
    """The text's words and beginnings (of ``known`` only), and a hash of the set of its
    words: texts of other words have another one, copies in other order or case the same."""
    words = set(_WORD.findall(text.lower()))
    found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
    whole = hashlib.blake2b(" ".join(sorted(words)).encode(), digest_size=8).digest()
    return (found if known is None else found & known), int.from_bytes(whole, "little", signed=True)


def _count(known: frozenset | None):
    def run(batches):
        for batch in batches:
            rows = [(t, c) for text in batch.column("text").to_pylist()
                    for found, c in [_terminals(text, known)] for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.int64())], names=["terminal", "text"])
    return tidy(run)


def fit(labelled: DataFrame) -> Model:
    """Terminals and weights from (text, label) rows; without toxic rows a model that knows
    threats only. The rows are a bounded sample."""
    labelled = labelled.cache()
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        labelled.unpersist()
        return Model({})
    rate = toxic / (toxic + clean)
    least = max(3, math.ceil(math.log(1e-4) / math.log(rate)), math.ceil(0.004 * toxic))
    counted = lambda k, known: (labelled.where(F.col("label") == k).select("text")
                                .mapInArrow(_count(known), "terminal string, text long").distinct()
                                .groupBy("terminal").agg(F.count("*").alias("n")))
    often = {r["terminal"]: r["n"] for r in counted(1, None).where(F.col("n") >= least)
             .orderBy(F.desc("n"), "terminal").limit(20_000).collect()}
    known = frozenset(often)
    elsewhere = {r["terminal"]: r["n"] for r in counted(0, known).collect()}
    chosen = {t: n for t, n in often.items() if n / (n + elsewhere.get(t, 0) + 0.3) >= PRECISION}
    whole = sorted(t for t in chosen if not t.endswith("*"))
    terminals = {}
    for t in sorted(chosen, key=lambda t: (-chosen[t], len(t), t)):
        n, m = chosen[t], elsewhere.get(t, 0)
        if t.endswith("*"):
            # A beginning stands for a family of words: no single word may make up most of it,
            # and a shorter one makes it needless.
            heads = [often[w] for w in whole if w.startswith(t[:-1]) and w != t[:-1]]
            if max(heads, default=0) > 0.6 * n or any(t[:k] + "*" in chosen for k in STEMS if k < len(t) - 1):
                continue
        if len(terminals) < MAX_TERMINALS:
            terminals[t] = math.log(((n + 0.5) / (toxic + 1)) / ((m + 0.5) / (clean + 1)))
    top = max(terminals.values(), default=1.0)
    model = Model({t: x / top for t, x in terminals.items()})
    rows = labelled.mapInArrow(_sums(model), "s array<double>, label int").collect()
    labelled.unpersist()
    x = np.log1p(np.array([r["s"] for r in rows]))
    y = np.array([r["label"] for r in rows], float)
    return _weights(model, x, y)


def _sums(model: Model):
    def run(batches):
        for batch in batches:
            s = [model.sums(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.list_(pa.float64())), batch.column("label")], names=["s", "label"])
    return tidy(run)


def _weights(model: Model, x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> Model:
    """Logistic regression by Newton steps, pulled towards the model's own weights."""
    prior = np.array([*model.weights, model.bias])
    w = prior.copy()
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * (w - prior)
        h = (a * (p * (1 - p))[:, None]).T @ a + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.terminals, tuple(float(v) for v in w[:-1]), float(w[-1]))


def _slices(batches, column: int = 1, rows: int = 500):
    """Batches of at most so many rows and bytes: texts become Python strings a slice at a time."""
    for batch in batches:
        yield from byte_words.slices(batch, column, rows=rows)


def _scores(model: Model):
    def run(batches):
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            s = np.array([model.sums(t or "") for t in texts]).reshape(-1, len(CLASSES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(s))], names=["doc_id", "score"])
    return tidy(run)


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fit(sample(docs, labels, label, fold, rows, id_col, text_col))


def score_toxicity(docs: DataFrame, model: Model, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    A null or empty text has no clauses and gets the score of none; a very long one is read
    whole. ``held_out`` is null for a null id. Repeated rows are scored each, an empty table
    gives no rows, further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_scores(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id", *fold).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model: Model, at: int, limit: float):
    def run(batches):
        for batch in _slices(batches, at):
            s = np.array([model.sums(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(CLASSES))
            yield batch.filter(pa.array(model.score(s) < limit))
    return tidy(run)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are."""
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col), limit), docs.schema)
