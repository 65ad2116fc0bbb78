"""Operator 10: toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learnt from labelled rows: words, and beginnings of words, that stand in at least SUPPORT different
contexts (the words before and after) of toxic texts and hardly in clean ones; counting contexts, copies of a text count
once. The lexicon's trie is intersected with the Levenshtein automaton of as many edits as a term's length allows (none
under 5 letters, one under 9, else two); the product's states are made as texts need them. A word of a text so is a
term, a misspelt one, or neither. Its context tells quotation (a pair of quotation marks on its line that encloses it,
words of reporting in a window of characters) from address. Logistic regression with a Gaussian prior weighs the kinds
of hits, each by the logarithm of how many there are.

The trainer is one task that reads a sample of at most SAMPLE labelled rows and SAMPLE_BYTES of text. Null texts count as empty; they and texts
without hits score by the bias. Without labelled rows the lexicon is empty and the prior decides. Rows are kept one for
one; texts are scored whole, with no shuffle.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import fold_of, labelled_sample, tidy, whole_text, within_bytes
from meridian.llm.quality import sigmoid
from meridian.llm.tokens import CACHE_BYTES, Memo

SAMPLE, SAMPLE_BYTES, SUPPORT, PURITY, STEM = 6144, 128 << 20, 3, 0.9, 4
#: States of the product that a worker keeps before it starts afresh.
STATES = 50_000
WORD = re.compile(r"[^\W\d_]+(?:\d+[^\W\d_]+)*")
WINDOW = 40

#: Words that report another's words, and words that address somebody.
REPORTING = frozenset("said says saying called calls wrote writes quote quoted quotes word term phrase".split())
ADDRESS = frozenset("you your youre ur".split())
#: Pairs of quotation marks; a quotation ends on its line.
QUOTED = re.compile('"[^"\n]*"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|‘[^’\n]*’')

#: Kinds of hits: as the lexicon has it or misspelt; a whole word or a beginning; each plain or quoted. Prior means of their weights.
PRIOR = np.array([-4.0, 6.0, 1.5, 6.0, 1.5, 4.0, 0.5, 1.5, 0.0])
PRIOR_VARIANCE = 9.0


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The trie of a lexicon intersected with Levenshtein automata, made deterministic state by state.

    terms: (text, whether it is a beginning). A state is a set of (trie node, edits so far); the empty one is dead."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]  # allowed edits, beginning?
        self.most = [0]  # edits that a term below allows
        for text, beginning in terms:
            node, k = 0, edits_for(text)
            self.most[0] = max(self.most[0], k)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append((k, beginning))
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple] = [(None, None)]  # least edits of a whole word and of a beginning
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # letters that the text lacks
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.most[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, beginning) for node, e in key for k, beginning in self.ends[node] if e <= k]
            self.found.append(tuple(min((e for e, b in ends if b == kind), default=None) for kind in (False, True)))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    after.add((child, e))
                elif e < self.most[child]:
                    after.add((child, e + 1))
            if e < self.most[node]:
                after.add((node, e + 1))
        self.steps[state][c] = out = self._state(after)
        return out

    def __call__(self, word: str) -> int:
        """0: no hit; else 1 + 2 * misspelt + beginning."""
        if len(self.states) > STATES:
            self.__init_states()
        state, stem = self.start, None
        for c in word:
            state = self.steps[state].get(c) if c in self.steps[state] else self._step(state, c)
            if not state:
                break
            e = self.found[state][1]
            if e is not None and (stem is None or e < stem):
                stem = e
        whole = self.found[state][0] if state else None
        if whole is None and stem is None:
            return 0
        if stem is None or whole is not None and whole <= stem:
            return 1 + 2 * (whole > 0)
        return 2 + 2 * (stem > 0)

    def __init_states(self) -> None:
        self.number, self.states, self.steps, self.found = {frozenset(): 0}, [frozenset()], [{}], [(None, None)]
        self.start = self._state({(0, 0)})


def quotations(text: str) -> list[tuple[int, int]]:
    """The stretches of a text that pairs of quotation marks enclose, in order and apart."""
    return [m.span() for m in QUOTED.finditer(text)]


def quotation(text: str, start: int, end: int, marks: list[tuple[int, int]]) -> bool:
    """Whether the words around a hit report it rather than address somebody by it. marks: quotations(text)."""
    at = bisect(marks, (start, len(text))) - 1
    enclosed = at >= 0 and marks[at][0] < start and end < marks[at][1]
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    near = [w.lower() for w in [*WORD.findall(left)[-4:], *WORD.findall(right)[:3]]]
    return enclosed + any(w in REPORTING for w in near) - any(w in ADDRESS for w in near) > 0


class Scorer:
    """model: terms, weights and clean words that only look like misspellings."""

    def __init__(self, model: dict):
        self.weights = np.asarray(model["weights"])
        matcher, clean = Matcher(model["terms"]), model["clean"]
        self.kind = Memo(lambda w: 0 if (k := matcher(w)) > 2 and w in clean else k, CACHE_BYTES // 3)

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(9)
        x[0] = 1
        lower = text.lower()
        if len(lower) != len(text):  # a lower-casing that changes lengths would shift the windows
            text = lower
        if any(map(self.kind.__getitem__, set(WORD.findall(lower)))):
            marks = quotations(text)
            for m in WORD.finditer(lower):
                if kind := self.kind[m[0]]:
                    x[2 * kind - (not quotation(text, *m.span(), marks))] += 1
        x[1:] = np.log1p(x[1:]) / np.log(2)
        return x

    def __call__(self, text: str) -> float:
        return float(sigmoid(self.features(text) @ self.weights))


def beyond_chance(toxic: int, clean: int, rate: float, tried: int) -> bool:
    """Whether that many of so many contexts are toxic hardly by chance, with `tried` candidates (Chernoff's bound)."""
    n, q = toxic + clean, toxic / (toxic + clean)
    gap = q * np.log(q / rate) + ((1 - q) * np.log((1 - q) / (1 - rate)) if q < 1 else 0.0)
    return q > rate and n * gap > np.log(10.0 * max(1, tried))


def lexicon(texts: list[str], labels: list[int]) -> list[tuple[str, bool]]:
    """Terms of toxic texts, each (text, whether words may go on after it)."""
    if not any(labels):
        return []
    rate = min(0.5, sum(len(t) for t, y in zip(texts, labels, strict=True) if y) / max(1, sum(map(len, texts))))
    toxic, clean = defaultdict(set), defaultdict(set)

    def contexts(text: str) -> Iterator[tuple[str, int]]:
        words = WORD.findall(text.lower())
        for w, before, after in zip(words, ["", *words], [*words[1:], ""], strict=False):
            yield w, crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))

    for text, y in zip(texts, labels, strict=True):
        for w, c in contexts(text) if y else ():
            toxic[w].add(c)
    for text, y in zip(texts, labels, strict=True):
        for w, c in contexts(text) if not y else ():
            if w in toxic:
                clean[w].add(c)
    stems, clean_stems = defaultdict(int), defaultdict(int)
    for w, c in toxic.items():
        for n in range(STEM, len(w) + 1):
            stems[w[:n]] += len(c)
    stems = {s: n for s, n in stems.items() if n >= 2 * SUPPORT}
    seen = set()
    for text, y in zip(texts, labels, strict=True):
        for w in set() if y else set(WORD.findall(text.lower())) - seen:
            seen.add(w)
            for n in range(STEM, len(w) + 1):
                if w[:n] in stems:
                    clean_stems[w[:n]] += max(1, len(clean.get(w, ())))
    words = [w for w, c in toxic.items() if len(w) > 2 and len(c) >= SUPPORT and len(c) >= PURITY * (len(c) + len(clean.get(w, ()))) and beyond_chance(len(c), len(clean.get(w, ())), rate, len(toxic))]
    terms = {(w, False) for w in words}
    children, members = defaultdict(list), defaultdict(int)
    for s in stems:
        children[s[:-1]].append(s)
    for w in toxic:
        for n in range(STEM, len(w) + 1):
            members[w[:n]] += 1
    beginnings: set[str] = set()
    for s in sorted(stems, key=len):
        pure = stems[s] >= 0.98 * (stems[s] + clean_stems[s]) and beyond_chance(stems[s], clean_stems[s], rate, len(stems))
        goes_on_alike = any(stems[t] >= 0.9 * stems[s] for t in children[s])
        if pure and not goes_on_alike and members[s] >= SUPPORT and not _begun(s, beginnings):
            beginnings.add(s)
    return sorted({*((b, True) for b in beginnings), *(t for t in terms if not _begun(t[0], beginnings))})


def _begun(word: str, beginnings: set[str]) -> bool:
    return any(word[:n] in beginnings for n in range(STEM, len(word) + 1))


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method under the Gaussian prior."""
    w = PRIOR.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)) / PRIOR_VARIANCE, x.T @ (y - p) - (w - PRIOR) / PRIOR_VARIANCE)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: Iterable[tuple[str, int]]) -> dict:
    """The model learnt from texts and labels. The words that only look misspelt come from half of the clean texts, the
    weights from the other half and the toxic ones."""
    rows = list(rows)
    terms = lexicon([t for t, _ in rows], [y for _, y in rows])
    matcher, clean = Matcher(terms), set()
    for t in [t for t, y in rows if not y][::2]:
        clean |= {w for w in set(WORD.findall(t.lower())) if matcher(w) > 2}
    scorer = Scorer({"terms": terms, "clean": clean, "weights": PRIOR})
    rest, n = [], 0
    for t, y in rows:
        if y or (n := n + 1) % 2 == 0:
            rest.append((scorer.features(t), y))
    weights = regression(np.array([x for x, _ in rest]), np.array([float(y) for _, y in rest])) if rest else PRIOR
    return {"terms": terms, "clean": clean, "weights": weights}


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """The model learnt from labels.toxic of at most `sample` rows outside the held-out fold, of `sample_bytes` in all."""
    rows = labelled_sample(docs, labels, "toxic", fold_of("doc_id", folds) != held_out, sample)
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(fit(within_bytes(batches, sample_bytes)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    models = [r[0] for r in rows.mapInArrow(tidy(run), "model binary").collect()]  # one; its size follows from the sample
    return pickle.loads(models[0]) if models else {"terms": [], "clean": set(), "weights": PRIOR}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A column of `docs`: the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:  # one text at a time in Python
            yield pa.array([scorer(t.as_py()) for t in texts], pa.float64())

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(run)(batches)

    return scores(whole_text(text_col))
