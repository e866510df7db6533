"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learned from a bounded sample of labelled rows: words and word
stems that occur (almost) only in toxic documents. Words of a text run through
the product of the lexicon trie and Levenshtein automata, determinised lazily
while it runs, so a word costs a few table steps whatever the lexicon's size;
terms may be misspelled by one edit (two from ``TWO_EDITS`` letters on). Words
within reach of a term that clean training documents use are exceptions.

Each hit is judged in a window of ``WINDOW`` words: quotation marks around it or
a reporting word before it make it a quotation, words of address make it
abuse. A logistic regression over a document's hit counts gives the score.

Edge cases: null and empty texts score the prior; rows with null doc_id or
label are never trained on; without toxic rows the lexicon is empty and all
texts score the (smoothed) prior; repeated rows repeat; other columns pass.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.llm.quality import held_out
from loadshape.llm.shared import all_rows, bound_batches, free_name

#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 2500
#: A term is in this many toxic documents of the sample, and in this share of them.
LEAST_DOCS, LEAST_SHARE = 5, 0.01
LEAST_PRECISION = 0.95
STEM_LETTERS = 4
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW = 6
CACHE_WORDS = 400_000
CACHE_STATES = 50_000
MOST_TERMS = 2000

_WORD = re.compile(r"[^\W_]+")
# Quotation marks, words of reporting and of address.
QUOTES = "\"“”„«»‹›‘’`"
REPORTING = frozenset("said says say wrote writes quoted quote quotes called calls term word phrase reported "
                      "sagte sagt schrieb zitiert wort dit dijo dice escribió palabra mot écrit cité".split())
ADDRESS = frozenset("you your you're yours u ur du dich dein ihr euch tu te toi vous votre tú ti usted vosotros".split())


@dataclass
class Lexicon:
    """Terms with ``stem`` (a prefix counts) and benign look-alikes."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    benign: set[str] = field(default_factory=set)

    def edits(self, term: str) -> int:
        return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


class Matcher:
    """Lazily determinised product of the lexicon trie and Levenshtein
    automata: states are sets of (trie node, edits so far)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]  # (term, edits allowed, stem) at a node
        self.allowed = [0]  # most edits of any term below a node
        for number, (term, stem) in enumerate(lexicon.terms):
            most, node = lexicon.edits(term), 0
            self.allowed[0] = max(self.allowed[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], most)
            self.ends[node].append((number, most, stem))
        self.alphabet = {c for kids in self.children for c in kids}
        self.clean: set[str] = set()
        self.toxic: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[int] = []
        self.part: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """Number of the state; closed over skipped term letters, keeping the
        fewest edits per node. -1: nothing can match any more."""
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, edits = todo.pop()
            if edits > self.allowed[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(k, edits + 1) for k in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = [(e, stem) for n, e in best.items() for _, most, stem in self.ends[n] if e <= most]
            self.whole.append(min((e for e, _ in hits), default=99))
            self.part.append(min((e for e, stem in hits if stem), default=99))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        symbol = c if c in self.alphabet else ""
        steps = self.steps[state]
        if symbol not in steps:
            reached = set()
            for node, edits in self.sets[state]:
                reached.add((node, edits + 1))  # an extra letter in the word
                for letter, kid in self.children[node].items():
                    reached.add((kid, edits + (letter != symbol)))
            steps[symbol] = self._state(reached)
        return steps[symbol]

    def edits(self, word: str) -> int | None:
        """Fewest edits from the word, or a prefix of it for stems, to a term."""
        if len(self.sets) > CACHE_STATES:
            self._reset()
        state, best = self.start, 99
        for c in word:
            state = self._step(state, c)
            if state < 0:
                break
            best = min(best, self.part[state])
        else:
            best = min(best, self.whole[state])
        if best == 99 or (best > 0 and word in self.lexicon.benign):
            return None
        return best

    def hits(self, words: set[str]) -> dict[str, int]:
        """Edits of the words that match."""
        if not self.lexicon.terms:
            return {}
        if len(self.clean) + len(self.toxic) > CACHE_WORDS:   # stems match endless words
            self.clean.clear()
            self.toxic.clear()
        found = {}
        for w in words.difference(self.clean):
            if w not in self.toxic:
                edits = self.edits(w)
                if edits is None:
                    self.clean.add(w)
                    continue
                self.toxic[w] = edits
            found[w] = self.toxic[w]
        return found


def document_features(text: str | None, matcher: Matcher) -> np.ndarray:
    """Counts of exact and misspelled hits, as abuse and as quotation, their
    density, and hits among words of address."""
    out = np.zeros(8)
    low = (text or "").lower()
    words = _WORD.findall(low)
    found = matcher.hits(set(words)) if words else {}
    if not found:
        return out
    spans = [m for m in _WORD.finditer(low)]
    hits = [i for i, m in enumerate(spans) if m[0] in found]
    for i in hits:
        m = spans[i]
        near = {spans[j][0] for j in range(max(0, i - WINDOW), min(len(spans), i + WINDOW + 1))}
        before = {spans[j][0] for j in range(max(0, i - WINDOW), i)}
        left = low[max(0, m.start() - 2): m.start()]
        right = low[m.end(): m.end() + 2]
        quoted = (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)) or bool(before & REPORTING)
        fuzzy = found[m[0]] > 0
        out[2 * quoted + fuzzy] += 1
        out[4] += bool(near & ADDRESS) and not quoted
    # one use of a term can be enough; more of it is worth less and less
    out[5] = len(hits) / len(words) * 20
    out[6] = out[0] > 0
    out[7] = out[0] + out[1] > 0
    out[:5] = np.log1p(out[:5])
    out[5] = min(out[5], 3.0)
    return out


def learn_lexicon(texts: list[str], labels: list[int]) -> Lexicon:
    """Words and stems that almost only toxic documents use, each at the
    longest form that keeps 90 % of its shortest form's documents."""
    toxic, clean, whole = Counter(), Counter(), Counter()
    bags = [set(_WORD.findall((t or "").lower())) for t in texts]
    for words, y in zip(bags, labels):
        starts = {w[:n] for w in words for n in range(STEM_LETTERS, min(len(w), 24) + 1)}
        (toxic if y else clean).update(starts)
        if y:
            whole.update(w for w in words if len(w) >= STEM_LETTERS)
    share = sum(labels) / max(1, len(labels))
    # the precision is that of a balanced draw, so the sample's mix of labels doesn't matter
    weigh = share / max(1e-9, 1 - share)
    least = max(LEAST_DOCS, LEAST_SHARE * sum(labels))
    good = {p for p, n in toxic.items() if n >= least and n / (n + weigh * clean[p]) >= LEAST_PRECISION}
    longer: dict[str, list[str]] = {}
    for p in good:
        longer.setdefault(p[:-1], []).append(p)
    terms: dict[str, bool] = {}
    for p in sorted(good, key=lambda p: (len(p), p)):
        if p[:-1] in good:
            continue
        term = p
        while step := [q for q in longer.get(term, []) if toxic[q] >= 0.9 * toxic[p]]:
            term = max(step, key=lambda q: (toxic[q], q))
        terms[term] = whole[term] < 0.9 * toxic[p]
    ranked = sorted(terms, key=lambda t: (-toxic[t], t))[:MOST_TERMS]
    lexicon = Lexicon([(t, terms[t]) for t in ranked])
    matcher = Matcher(lexicon)
    seen = Counter()
    for words, y in zip(bags, labels):
        if not y:
            seen.update(matcher.hits(words).keys())
    lexicon.benign = set(seen)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression with intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1]) * len(x) / 100
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train(texts: list[str], labels: list[int]) -> Model:
    """Lexicon from one half of the rows, weights from the other (a lexicon
    looks better on the rows that it comes from), then the lexicon of all."""
    y = np.array(labels, float)
    if len(y) < 8 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(Lexicon(), np.array([0.0] * 8 + [np.log(share / (1 - share))]))
    half = np.arange(len(y)) % 2 == 0
    first = learn_lexicon([t for t, h in zip(texts, half) if h], [int(v) for v in y[half]])
    matcher = Matcher(first)
    x = np.stack([document_features(t, matcher) for t, h in zip(texts, half) if not h])
    return Model(learn_lexicon(texts, [int(v) for v in labels]), logistic(x, y[~half]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0,
        rows: int = SAMPLE_ROWS) -> Model:
    """Train in one task on at most ``rows`` labelled rows per label; the
    model (bounded by MOST_TERMS) comes back to the driver."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).alias("y"))
    )
    drawn = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = all_rows(frames)
        if frame is None:
            return
        frame["order"] = [int(d) * 2654435761 % 2 ** 32 for d in frame["doc_id"]]
        frame = frame.sort_values(["order", "doc_id"])
        yield pd.DataFrame({"model": [pickle.dumps(train([t or "" for t in frame["text"]], frame["y"].astype(int).tolist()))]})

    got = sample.coalesce(1).mapInPandas(learn, "model binary").first()
    return pickle.loads(got.model) if got is not None else train([], [])


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        matcher = Matcher(own.lexicon)
        for texts in batches:
            x = np.stack([document_features(t, matcher) for t in texts]) if len(texts) else np.zeros((0, 8))
            z = x @ own.weights[:-1] + own.weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    name = free_name(docs, "score")
    return docs.withColumn(name, score("text")).withColumn(free_name(docs, "predicted"), (F.col(name) >= 0.5).cast("int"))
