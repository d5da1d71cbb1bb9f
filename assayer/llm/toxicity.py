"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbol classes: *insult* (a weighted lexicon of words and word stems), *target* (second and third
person), *negation*, *reported speech*, *intent* and *harm*. Small transducers read the classes: a countdown after a
target, a negation or a marker of intent, a latch after reported speech. ``compose`` builds their product, one explicit
table of states x classes, and an arc table says what a matched insult or threat is in the state it is met in: plain,
targeted, negated, reported or a threat. What follows a match is read by the same target transducer from right to left.
Matched clauses are scored, not isolated words: a document's features are the sums, over its clauses, of each arc's
strongest match, and the arcs' weights are fitted by ridge-regularised logistic regression.

Lexicon and operators are learned from labelled texts. A word or stem is an insult if it was met in many different
contexts (neighbouring words) of toxic texts and next to none of others; a copied document counts once, as its contexts
repeat. A word is a negation (it acts closely before) or reported speech (it acts from anywhere before in the clause) if
insults behind it stand in harmless texts, and a target if insults near it stand in toxic ones; contexts under a learned
negation or report then don't count against an insult. Small word lists of natural languages are what the classes start
with. Fitting uses a bounded sample of labelled rows (``SAMPLE_ROWS`` and ``SAMPLE_CHARS`` of each label, by a hash of
doc_id, in order of doc_id); scoring covers every row and every clause.

Defined results: null and empty texts have no match and get the score of a text without one; with no usable labels the
score is 0 for all; whole texts are read, whatever their length; repeated rows are each scored; a document with two
labels counts as toxic if one is; an empty table stays empty; extra columns stay, but a column named like the result is
refused (ValueError).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.samples import drawn, told

SAMPLE_ROWS = 3000
#: And at most so many characters of each label; the last text is cut there.
SAMPLE_CHARS = 12_000_000
MIN_CONTEXTS = 8
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.;:!?\n]+")

CLASSES = ("other", "insult", "target", "negation", "report", "intent", "harm")
OTHER, INSULT, TARGET, NEGATION, REPORT, INTENT, HARM = range(len(CLASSES))
#: Words that the classes start with.
SEEDS = {
    TARGET: "you your yours yourself u he she they them him her tu toi vous ton ta du dich dir ihr euch sie usted tú te ti ellos",
    NEGATION: "not no never isn aren wasn don doesn neither nor nicht kein keine nie pas jamais nunca jamás tampoco",
    REPORT: "said says say wrote writes called calls quoted quote according reported claimed dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según",
    INTENT: "will shall gonna going must should werde wirst vais vas voy",
    HARM: "kill hurt destroy beat stab shoot burn murder strangle tuer frapper töten schlagen matar golpear",
}
ARCS = ("plain", "targeted", "negated", "reported", "threat", "cluster")
PLAIN, TARGETED, NEGATED, REPORTED, THREAT, CLUSTER = range(len(ARCS))
#: How many words an operator's state lasts.
NEGATION_SPAN, TARGET_SPAN, INTENT_SPAN = 3, 4, 4


def countdown(trigger: int, span: int) -> np.ndarray:
    """A transducer's table, states x classes -> state: ``span`` after the trigger, one less with each other word."""
    table = np.repeat(np.maximum(np.arange(span + 1) - 1, 0)[:, None], len(CLASSES), 1)
    table[:, trigger] = span
    return table


def latch(trigger: int) -> np.ndarray:
    """State 1 for good after the trigger."""
    table = np.repeat(np.arange(2)[:, None], len(CLASSES), 1)
    table[:, trigger] = 1
    return table


def compose(*tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product machine: states x classes -> state, and of each product state which parts are active."""
    sizes = [len(t) for t in tables]
    states = np.stack(np.unravel_index(np.arange(int(np.prod(sizes))), sizes))
    product = np.ravel_multi_index([t[states[i]] for i, t in enumerate(tables)], sizes)
    return product, states.T > 0


def arcs(active: np.ndarray) -> np.ndarray:
    """The arc of a word: by state, class, and whether a target follows; -1 for none."""
    negated, reported, targeted, intent = active.T
    out = np.full((len(active), len(CLASSES), 2), -1)
    for follows in (0, 1):
        out[:, INSULT, follows] = np.select([reported, negated, targeted | bool(follows)], [REPORTED, NEGATED, TARGETED], PLAIN)
    out[:, HARM, 1] = np.where(intent & ~negated, THREAT, -1)
    return out


AHEAD = countdown(TARGET, TARGET_SPAN)
TABLE, ACTIVE = compose(countdown(NEGATION, NEGATION_SPAN), latch(REPORT), AHEAD, countdown(INTENT, INTENT_SPAN))
ARC = arcs(ACTIVE)
#: The same as lists, which single look-ups read faster.
NEXT, EMIT, BACK = TABLE.tolist(), ARC.tolist(), AHEAD.tolist()


def seeds() -> dict[str, int]:
    return {w: c for c, words in SEEDS.items() for w in words.split()}


@dataclass
class Grammar:
    """Symbol classes and weights of the composed machine."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(ARCS)))
    bias: float = -20.0
    fitted: bool = False
    operators: dict[str, int] = field(default_factory=seeds)

    def insult(self, word: str) -> float:
        """The lexicon's weight of a word, 0 if it isn't in it."""
        w = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                w = max(w, self.stems.get(word[:n], 0.0))
        return w

    def threatens(self, seen: set[str]) -> bool:
        """Are there words of intent and of harm?"""
        found = {c for w, c in self.operators.items() if c in (INTENT, HARM) and w in seen}
        return len(found) == 2

    def clause(self, words: list[str]) -> np.ndarray:
        """Strongest match of each arc in one clause: one pass from the right, one from the left."""
        out = np.zeros(len(ARCS))
        weight = [self.insult(w) for w in words]
        symbols = [INSULT if x else self.operators.get(w, OTHER) for w, x in zip(words, weight, strict=True)]
        follows, state = [], 0
        for c in reversed(symbols):
            follows.append(state > 0)
            state = BACK[state][c]
        state, matches = 0, 0
        for c, x, after in zip(symbols, weight, reversed(follows), strict=True):
            arc = EMIT[state][c][after]
            if arc >= 0:
                out[arc] = max(out[arc], x or 1.0)
                matches += c == INSULT
            state = NEXT[state][c]
        if matches > 1:
            out[CLUSTER] = 1.0
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Sums over the clauses, damped. Clauses are split only if some word can match at all."""
        out = np.zeros(len(ARCS))
        if not text:
            return out
        low = text.lower()
        seen = set(WORD.findall(low))
        if self.threatens(seen) or any(map(self.insult, seen)):
            for words in clauses(low):
                out += self.clause(words)
        return np.log1p(out)

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        z = self.bias + float(self.features(text) @ self.weights)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def clauses(low: str) -> list[list[str]]:
    """The words of each clause of a lower-cased text."""
    return [words for part in CLAUSE.split(low) if (words := WORD.findall(part))]


def units(words: list[str]) -> set[str]:
    """A text's words, and their stems with an asterisk."""
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def more_than(mine: int, other: int, n: int, m: int, times: float) -> bool:
    """Is ``mine`` of n at least ``times`` the rate of ``other`` of m, and by far more than chance allows?"""
    expected = n * (mine + other) / (n + m)
    return mine / n > times * (other + 0.5) / m and mine - expected > 5 * expected**0.5


def candidates(texts: list[str], labels: list[int], least: int) -> set[str]:
    """Words and stems of at least ``least`` / 2 toxic texts, twice as frequent in them as in others."""
    docs = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        if label:
            docs[1].update(units(set(WORD.findall(text.lower()))))
    some = {u for u, n in docs[1].items() if 2 * n >= least}
    docs[1] = Counter({u: docs[1][u] for u in some})
    for text, label in zip(texts, labels, strict=True):
        if not label:
            docs[0].update(units(set(WORD.findall(text.lower()))) & some)
    n = max(1, sum(labels))
    return {u for u in some if docs[0][u] <= 1 or more_than(docs[1][u], docs[0][u], n, max(1, len(labels) - n), 2)}


def learn_operators(texts: list[str], labels: list[int], able: set[str], least: int = MIN_CONTEXTS) -> dict[str, int]:
    """Negations, reports and targets, from the contexts of words that are more frequent in toxic texts but stand in
    harmless ones too. Every different context counts once. Texts are split anew, not held as words."""
    near, far, around = ([Counter(), Counter()] for _ in range(3))
    every: list[set[int]] = [set(), set()]
    for text, label in zip(texts, labels, strict=True):
        low = text.lower()
        hits = {w for w in set(WORD.findall(low)) if not able.isdisjoint(forms(w))}
        for words in clauses(low) if hits else ():
            for i, w in enumerate(words):
                if w in hits:
                    before, behind = words[:i], words[i + 1 : i + 1 + TARGET_SPAN]
                    context = hash((*before[-2:], w, *behind[:2]))
                    if context in every[label]:
                        continue
                    every[label].add(context)
                    near[label].update(set(before[-NEGATION_SPAN:]))
                    far[label].update(set(before[:-NEGATION_SPAN]))
                    around[label].update({*before[-TARGET_SPAN:], *behind})
    n = [max(1, len(x)) for x in every]
    found: dict[str, int] = {}
    if len(every[0]) < least:
        return found
    for c, where in ((NEGATION, near), (REPORT, far)):
        for v, mine in where[0].items():
            if v not in able and mine >= least and more_than(mine, where[1][v], n[0], n[1], 3):
                found[v] = c
    if 5 * len(every[0]) >= len(every[1]):
        for v, mine in around[1].items():
            if v not in able and mine >= least and more_than(mine, around[0][v], n[1], n[0], 3):
                found[v] = TARGET
    return found


def learn_lexicon(texts: list[str], labels: list[int], able: set[str], operators: dict[str, int], least: int = MIN_CONTEXTS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds of contexts in toxic texts; contexts in harmless texts under a negation or a
    report don't count."""
    size = [0, 0]
    contexts: list[dict[str, set[int]]] = [defaultdict(set), defaultdict(set)]
    shut = {w for w, c in operators.items() if c == REPORT}, {w for w, c in operators.items() if c == NEGATION}
    for text, label in zip(texts, labels, strict=True):
        low = text.lower()
        every = WORD.findall(low)
        size[label] += len(every)
        hits = {w: own for w in set(every) if (own := [u for u in forms(w) if u in able])}
        for words in clauses(low) if hits else ():
            for i, w in enumerate(words):
                own = hits.get(w)
                if own and (label or (shut[0].isdisjoint(words[:i]) and shut[1].isdisjoint(words[max(0, i - NEGATION_SPAN) : i]))):
                    context = hash((words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else ""))
                    for u in own:
                        contexts[label][u].add(context)
    if not size[0] or not size[1]:
        return {}, {}
    found, many = {}, {}
    for u, c in contexts[1].items():
        other = len(contexts[0].get(u, ()))
        rate, other_rate = len(c) / size[1], (other + 0.5) / size[0]
        if len(c) >= least and other <= 0.02 * len(c) and rate > 8 * other_rate:
            found[u], many[u] = float(np.log(rate / other_rate)), len(c)
    kept: dict[str, float] = {}
    for u in sorted(found, key=lambda u: (len(u.rstrip("*")), u)):
        if any(u.startswith(k[:-1]) for k in kept if k[-1] == "*") or u in kept:
            continue
        # the most specific unit that still holds nearly all matches of this one
        alike = [v for v in found if v.startswith(u.rstrip("*")) and many[v] >= 0.97 * many[u]] if u[-1] == "*" else [u]
        best = max(alike, key=lambda v: (len(v.rstrip("*")), v))
        kept[best] = found[best]
    top = max(kept.values(), default=1.0)
    return {u: x / top for u, x in kept.items() if u[-1] != "*"}, {u[:-1]: x / top for u, x in kept.items() if u[-1] == "*"}


def train(texts: list[str], labels: list[int]) -> Grammar:
    if not texts or len(set(labels)) < 2:
        return Grammar()
    able = candidates(texts, labels, MIN_CONTEXTS)
    operators = seeds() | learn_operators(texts, labels, able)
    g = Grammar(*learn_lexicon(texts, labels, able, operators), operators=operators)
    x = np.array([g.features(t) for t in texts])
    y = np.array(labels, float)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.array([*np.full(len(ARCS), 1.0), -2.0])
    prior, ridge = np.array([2.0, 2.5, 0.5, 0.5, 2.5, 1.0, -2.0]), np.array([*np.full(len(ARCS), 0.5), 0.01])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (share * (p - y)) + ridge * (w - prior)
        hess = (x1 * (share * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(g.words, g.stems, np.maximum(w[:-1], 0.0), float(w[-1]), True, operators)


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """At most ``rows`` texts and SAMPLE_CHARS characters of each label, in hash order of doc_id; both tables: doc_id and
    text / label."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = told(docs).join(labels.withColumnsRenamed({"doc_id": "id", "label": "group"}), "id")
    got = sorted((i, t, int(y)) for y, i, t in drawn(known, docs.select("doc_id", "text"), "toxicity", rows, SAMPLE_CHARS))  # one order in every run
    return [t for _, t, _ in got], [y for *_, y in got]


def scored(docs: DataFrame, grammar: Grammar, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``into``, 0 to 1."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by the sample

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(into, run(F.col(text)))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", exclude: int = 1, rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar learned only from labelled rows whose crc32(doc_id as text) mod 3 is not ``exclude``."""
    from assayer.llm.langid import remainder

    own = labels.select("doc_id", F.col(label).alias("label")).where(remainder(F.col("doc_id"), 3) != exclude)
    return train(*sampled(docs.select("doc_id", "text"), own, rows))
