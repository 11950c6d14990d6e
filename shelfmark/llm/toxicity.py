"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other. Small
transducers mark an insult or threat that is negated, reported or aimed at somebody. Their
composition is a pair of deterministic machines: one reads a clause word by word and marks by what
stood before, the other reads what the first wrote from the end and marks by what comes after ("I will kill you", "..., she said").
What scores is the matched clause with its marks, not the word alone.

The lexicon of insults is learned from labelled texts (words, and word beginnings of four
to seven letters, that stand in toxic texts far more often than in others) beside a few fixed
words (a word of another fixed class keeps that class); so are the weights of the marked matches, which are drawn towards prior weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the weights are fitted on, at most about (chosen by hash of doc_id), and entries of the lexicon. A word or
#: beginning needs four toxic texts of that sample to be looked at.
MAX_LABELLED = 20_000
MAX_LEXICON = 20_000
PREFIXES = (4, 5, 6, 7)

# Words of the grammar
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard filth vermin idiota imbécile estúpido estúpida basura crétin abruti trottel dummkopf abschaum arschloch".split()
THREATS = "kill murder hurt destroy shoot stab strangle hang matar töten umbringen tuer".split()
TARGETS = "you your you're yours u he him his she her they them their we us everyone people tú usted ustedes vous toi tu du dich ihr euch sie".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't neither nor without nunca jamás jamais pas nicht kein keine".split()
REPORTS = "said says say told wrote writes called calls quoted quote reported claims alleged dijo dit sagte schrieb".split()

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out). A symbol is a class letter and its marks; arcs read the class letter."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]]  # the output adds marks to the symbol read

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        new, mark = self.arcs[(state, symbol[0])]
        return new, symbol + mark


CLASSES = "IHTNRO"


def window(opens: str, mark: str, length: int | None) -> Transducer:
    """Marks insults and threats in the length words after one of class opens (None: to the clause's end)."""
    states = [str(k) for k in range((length or 1) + 1)]
    arcs = {}
    for s, c in product(states, CLASSES):
        left = int(s) if length is None else max(0, int(s) - 1)
        arcs[(s, c)] = (states[-1] if c == opens else str(left), mark if c in "IH" and s != "0" else "")
    return Transducer("0", arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads with a, and what a writes with b."""
    arcs, todo, seen = {}, [(a.start, b.start)], set()
    while todo:
        s, t = todo.pop()
        if (s, t) in seen:
            continue
        seen.add((s, t))
        for c in CLASSES:
            s2, m1 = a.arcs[(s, c)]
            t2, m2 = b.arcs[(t, c)]
            arcs[(f"{s},{t}", c)] = (f"{s2},{t2}", m1 + m2)
            todo.append((s2, t2))
    return Transducer(f"{a.start},{b.start}", arcs)


#: n: negated within the three words before, r: reported in this clause, t: aimed at somebody within four words. Read forwards, and then backwards.
FORWARDS = compose(compose(window("N", "n", 3), window("R", "r", None)), window("T", "t", 4))
BACKWARDS = compose(window("R", "r", None), window("T", "t", 4))
MATCHES = [c + "".join(m) for c in "IH" for m in product(("", "n"), ("", "r"), ("", "t"))]
#: Prior weight of a match, in log odds.
PRIOR = {m: (6.0 if m[0] == "I" else 5.0) * (0.4 if "n" in m else 1) * (0.6 if "r" in m else 1) * (1.2 if "t" in m else 1) for m in MATCHES}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]  # word or beginning ('abcd*') to weight, 0 to 1
    weights: tuple[float, ...]  # of the matches
    bias: float


def marked(symbols: list[str]) -> list[str]:
    """The symbols of a clause, insults and threats with their marks in the order of MATCHES."""
    state, said = FORWARDS.start, []
    for symbol in symbols:
        state, out = FORWARDS.step(state, symbol)
        said.append(out)
    state = BACKWARDS.start
    for k in range(len(said) - 1, -1, -1):
        state, out = BACKWARDS.step(state, said[k])
        said[k] = out[0] + "".join(m for m in "nrt" if m in out[1:])
    return said


class Reader:
    """Classes of words, with a memory of those seen."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.fixed = {w: "H" for w in THREATS} | {w: "T" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}

    def classify(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n)])
            kind = self.fixed.get(word, "O")
            found = self.known[word] = ("I", weight) if weight and kind == "O" else (kind, 1.0)
        return found

    def features(self, text: str) -> np.ndarray:
        """For each kind of match, log(1 + weight of its clauses)."""
        out = np.zeros(len(MATCHES))
        tokens = TOKEN.findall(text.lower())
        if not any(self.classify(w)[0] in "IH" for w in set(tokens)):
            return out
        read: list[tuple[str, float]] = []
        for word in [*tokens, "."]:
            if word not in ENDS:
                read.append(self.classify(word))
                continue
            if any(symbol in "IH" for symbol, _ in read):
                clause: dict[int, float] = {}
                for said, (symbol, weight) in zip(marked([symbol for symbol, _ in read]), read):
                    if symbol in "IH":
                        k = MATCHES.index(said)
                        clause[k] = max(clause.get(k, 0.0), weight)
                for k, w in clause.items():
                    out[k] += w
            read = []
        return np.log1p(out)


def score(model: Model, reader: Reader, text: str | None) -> float:
    x = reader.features(text or "")
    return float(1 / (1 + math.exp(-(model.bias + x @ np.array(model.weights)))))


def words(text: str) -> set[str]:
    return {w for w in TOKEN.findall(text.lower()) if w not in ENDS}


def marks(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    own = words(text)
    return own | {w[:n] + "*" for w in own for n in PREFIXES if len(w) >= n}


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Fixed insults, and what is significantly (G2, against all candidates) and at least 20 times likelier in toxic texts."""
    found = {w: 1.0 for w in INSULTS}
    floor = 2 * math.log(max(len(counts), 1)) + 8
    rate = toxic / max(toxic + clean, 1)
    scored = []
    for mark, p, q in counts:
        share = p / (p + q)
        ratio = (p + 0.5) / (q + 0.5) * (clean + 1) / (toxic + 1)
        g2 = 2 * (p * math.log(max(share, 1e-9) / rate) + (q * math.log((1 - share) / (1 - rate)) if q else 0))
        if share > rate and g2 >= floor and ratio >= 20:
            scored.append((g2, mark, min(1.0, math.log(ratio) / math.log(200))))
    for _, mark, weight in sorted(scored, reverse=True)[:MAX_LEXICON]:
        found.setdefault(mark, weight)
    return found


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression with a ridge towards the prior weights."""
    prior = np.array([PRIOR[m] for m in MATCHES] + [-3.0])
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - (w - prior)
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad), -2, 2)
    return tuple(w[:-1].tolist()), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """The model from labelled rows (doc_id, toxic) for which train holds. No such labels, or none toxic: the prior.

    Rows without a doc_id or label teach nothing; of several labels of one doc_id the largest counts. Documents that repeat a
    doc_id count once each. Of marks that tell equally much the last by name goes first.
    """
    spark = docs.sparkSession
    usable = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    if n > MAX_LABELLED:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    # about MAX_LABELLED rows of two numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")

    def count(only: frozenset[str] | None, label: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, n = Counter(), 0
            for batch in batches:
                for text in batch["text"]:
                    n += 1
                    found = marks(text or "")
                    seen.update(found if only is None else found & only)
            yield pd.DataFrame({"mark": [*seen, ""], "n": [*seen.values(), n]})

        counted = rows.where(F.col("toxic") == label).mapInPandas(run, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
        # bounded by the sample, and by the marks asked for where there are some
        least = 4 if only is None else 1
        return {r["mark"]: r["n"] for r in counted.where((F.col("n") >= least) | (F.col("mark") == "")).collect()}

    toxic = count(None, 1)
    clean = count(frozenset(toxic), 0)
    n_toxic, n_clean = toxic.pop("", 0), clean.pop("", 0)
    if not n_toxic:
        return Model({w: 1.0 for w in INSULTS}, tuple(PRIOR[m] for m in MATCHES), -3.0)
    lexicon = lexicon_of(sorted((m, p, clean.get(m, 0)) for m, p in toxic.items()), n_toxic, n_clean)

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for batch in batches:
            yield pd.DataFrame({"x": [np.round(reader.features(t or ""), 2).tolist() for t in batch["text"]], "toxic": batch["toxic"]})

    seen = rows.mapInPandas(patterns, "x array<double>, toxic int").collect()
    weights, bias = fit_weights(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return Model(lexicon, weights, bias)


def toxicity(text: Column, model: Model) -> Column:
    """The score of a whole text, 0 to 1; null counts as empty, which scores the bias alone.

    Texts may be of any length. A score depends on the text alone: repeated rows score the same, an empty table gives an empty one,
    and other columns are not looked at. A score of 0.5 counts as toxic where a side has to be taken.
    """

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        reader = Reader(model.lexicon)
        return pd.Series([score(model, reader, t) for t in texts], dtype="float64")

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
