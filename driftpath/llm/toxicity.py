"""Toxicity scores: Levenshtein automata run through a lexicon trie, then a model of the hits' context windows.

The automata of all terms and the trie are intersected and made deterministic once: a state is the set of (trie node,
edits so far) that a prefix can be in, and only nodes with edits to spare stay. All distinct words of a batch run
through the table of transitions together. A term of up to 4 letters allows no edit, up to 7 letters one, longer ones
two; with one of the digits or signs that stand for letters between them, a word may also be read with those letters.

The lexicon is a fixed list and what the labels add: words, and stems of 3 to 6 letters with any ending (written with
a star), that stand in toxic documents almost alone, by a likelihood ratio that chance does not reach. Exact copies of
a text count once; every term that passes the test is added, in as many automata as that takes. A stem is a node of the
trie that keeps its state on any letter. Words are matched whatever their length.

Hits are weighed by their windows: quotation marks around them and reporting words tell quotation, a second person
tells abuse. A logistic model over these features takes its weights from the labels, drawn towards prior weights, so
that kinds of hits that the sample lacks keep theirs. Learned from about `sample_docs` labelled rows outside the
held-out fold (by hash of doc_id), as are `benign`: inexact forms of which most documents without exact hits that
have them are not toxic.

Null and empty texts have no hit and the score of such. A null doc_id is in no held-out fold; repeated rows are each
scored; an empty table gives no rows; without labels the prior weights stand.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, per_text, prepare, staged

# Insults, by language; reporting words; second persons.
LEXICON = (
    "arsehole asshole bastard bitch bullshit clown coward cretin degenerate disgusting dumb dumbass dummy fool freak garbage halfwit "
    "idiot idiotic imbecile jackass jerk liar loser lowlife lunatic moron moronic nitwit parasite pathetic pig rat retard scum "
    "scumbag slut stupid sucker swine trash twat vermin vile wanker whore worthless "
    "abschaum arschloch blödmann dummkopf idiotin miststück schwachkopf trottel versager widerlich wertlos "
    "abruti connard crétin débile dégoûtant imbécile minable ordure raclure salaud "
    "asqueroso basura cabrón cretino despreciable escoria estúpido idiota imbécil inútil patético payaso"
).split()
REPORTING = frozenset("said says say saying wrote writes write quoted quote quotes quoting called calls calling term word words slur phrase reported claimed according".split())
SECOND = frozenset("you your yours yourself you're youre u ur du dich dir dein ihr euch tu toi te ton vous votre tú usted vosotros".split())
SIGNS = str.maketrans("013457@$!|+", "oieastasilt")
QUOTES = frozenset("\"“”„«»‹›‘’")
_LISTED = frozenset(LEXICON)
_EDGES = ".,;:!?()[]{}<>\"“”„«»‹›‘’'`*#%&$|~_-/\\"
WINDOW = 6
FEATURES = ("bias", "exact", "inexact", "quoted", "second", "reporting", "distinct", "density")
PRIOR = np.array([-4.0, 4.0, 3.0, 0.5, 0.7, -1.0, 0.5, 0.3])
PRECISION = np.array([0.01, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0])


def edits_of(term: str) -> int:
    """Of listed terms; learned ones (stems end with a star) stand as they are, but for one edit in words of 8 or more."""
    if term[-1:] == "*":
        return 0
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 or term not in _LISTED else 2


class Automaton:
    """Deterministic: table[state, symbol], and by state the nearest term and its edits (-1 where none ends)."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted(set(terms))
        letters = sorted({c for t in self.terms for c in t.rstrip("*")})
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        child: list[dict[int, int]] = [{}]
        ends, spare, stem = [-1], [0], [-1]
        for k, t in enumerate(self.terms):
            at = 0
            spare[0] = max(spare[0], edits_of(t))
            for c in t.rstrip("*"):
                s = self.symbol[c]
                if s not in child[at]:
                    child[at][s] = len(child)
                    child.append({})
                    ends.append(-1)
                    spare.append(0)
                    stem.append(-1)
                at = child[at][s]
                spare[at] = max(spare[at], edits_of(t))
            if t[-1] == "*":
                stem[at] = k
            else:
                ends[at] = k

        def closed(at: dict[int, int]) -> frozenset:
            held = list(at.items())
            while held:
                node, e = held.pop()
                if at.get(node, 99) < e:
                    continue
                for to in child[node].values():  # the word lacks this letter
                    if e + 1 <= spare[to] and at.get(to, 99) > e + 1:
                        at[to] = e + 1
                        held.append((to, e + 1))
            return frozenset(at.items())

        def step(state: frozenset, s: int) -> frozenset:
            at: dict[int, int] = {}
            for node, e in state:
                if stem[node] >= 0:
                    at[node] = min(e, at.get(node, 99))
                elif e + 1 <= spare[node] and at.get(node, 99) > e + 1:
                    at[node] = e + 1
                for own, to in child[node].items():
                    cost = e + (own != s)
                    if cost <= spare[to] and at.get(to, 99) > cost:
                        at[to] = cost
            return closed(at)

        start = closed({0: 0})
        number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        i = 0
        while i < len(order):
            row = []
            for s in range(len(letters) + 1):
                to = step(order[i], s) if order[i] else frozenset()
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
            i += 1
        self.table = np.array(rows, np.int32)
        self.best = np.full(len(order), -1, np.int32)
        self.cost = np.full(len(order), -1, np.int32)
        for i, state in enumerate(order):
            found = [(e, k) for n, e in state for k in (ends[n], stem[n]) if k >= 0 and e <= edits_of(self.terms[k])]
            if found:
                self.cost[i], self.best[i] = min(found)
        self.star = np.array([t[-1] == "*" for t in self.terms] + [False])
        self.shortest = min((len(t.rstrip("*")) - edits_of(t) for t in self.terms), default=1)
        self.longest = max((len(t) + edits_of(t) for t in self.terms), default=1)
        self.codes = np.zeros(0x250, np.int32)
        for c, s in self.symbol.items():
            self.codes[ord(c)] = s

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Of those words that come within their edits of a term: the term's index and the edits."""
        words = [w for w in words if len(w) >= self.shortest]
        if not words:
            return {}
        size = np.fromiter(map(len, words), np.int64, len(words))  # of a longer word, the head tells whether it has a stem
        code = np.array([w[: self.longest] for w in words], dtype=f"<U{self.longest}").view("<u4").reshape(len(words), self.longest)
        sym = self.codes[np.minimum(code, 0x24F)]
        state = np.ones(len(words), np.int32)
        for k in range(self.longest):
            state = np.where(k < size, self.table[state, sym[:, k]], state)
        best = self.best[state]
        return {words[i]: (int(best[i]), int(self.cost[state[i]])) for i in np.flatnonzero((best >= 0) & ((size <= self.longest) | self.star[best]))}


class Lexicon:
    """All terms, in automata of up to `part` each; terms of one beginning share theirs. A word's match is its nearest term."""

    def __init__(self, terms: list[str], part: int = 256) -> None:
        terms = sorted(set(terms))
        self.automata = [Automaton(terms[k : k + part]) for k in range(0, len(terms), part)]
        self.terms = [t for a in self.automata for t in a.terms]

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Of those words that come within their edits of a term: the term's index and the edits."""
        out: dict[str, tuple[int, int]] = {}
        first = 0
        for a in self.automata:
            for w, (k, e) in a.match(words).items():
                if w not in out or e < out[w][1]:
                    out[w] = (first + k, e)
            first += len(a.terms)
        return out


def hits(texts: list, auto: Lexicon) -> Iterator[list[tuple[str, int, int, bool, bool, bool]]]:
    """By text: (form, term, edits, quoted, second person near, reporting word near) of each hit in order."""
    words = [(x or "").lower().split() for x in texts]
    forms: dict[str, str] = {}
    for w in set().union(*words):
        forms[w] = w.strip(_EDGES)
    found = auto.match(list(set(forms.values())))
    odd = {f for f in forms.values() if f not in found and not f.isalpha() and any(c.isalpha() for c in f)}
    plain = {f: f.translate(SIGNS) for f in odd}
    again = auto.match(list(set(plain.values())))
    found |= {f: (again[p][0], max(1, again[p][1])) for f, p in plain.items() if p in again}
    of = {w: f for w, f in forms.items() if f in found}
    for ws in words:
        out = []
        for i, w in enumerate(ws):
            if w in of:
                before, after = ws[max(0, i - WINDOW) : i], ws[i + 1 : i + 1 + WINDOW]
                head, _, tail = w.partition(of[w])
                opened = any(c in QUOTES for c in head) or any(x[0] in QUOTES for x in before)
                closed = any(c in QUOTES for c in tail) or any(x.rstrip(".,;:!?)")[-1:] in QUOTES and x for x in after)
                near = {x.strip(_EDGES) for x in (*before, *after)}
                out.append((of[w], *found[of[w]], bool(opened and closed), bool(near & SECOND), bool(near & REPORTING)))
        yield out


def features(found: list[tuple], words: int, benign: frozenset) -> list[float]:
    found = [h for h in found if h[2] == 0 or h[0] not in benign]
    bare = [h for h in found if not h[3]]
    exact = sum(h[2] == 0 for h in bare)
    return [
        1.0, np.log1p(exact), np.log1p(len(bare) - exact), np.log1p(len(found) - len(bare)), float(any(h[4] for h in bare)),
        float(any(h[5] for h in found)), np.log1p(max(0, len({h[1] for h in bare}) - 1)), np.log1p(100 * len(bare) / max(words, 1)) if bare else 0.0,
    ]


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, precision: np.ndarray = PRECISION) -> np.ndarray:
    """Weights of greatest posterior, by Newton's steps."""
    w = prior.copy()
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (precision * (w - prior) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + precision * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, auto: Lexicon, weights: np.ndarray, benign: frozenset) -> None:
        self.auto, self.weights, self.benign = auto, weights, benign

    def score(self, texts: list) -> np.ndarray:
        x = np.array([features(h, len((t or "").split()) if h else 0, self.benign) for t, h in zip(texts, hits(texts, self.auto), strict=True)])
        return 1 / (1 + np.exp(-np.clip(x.reshape(-1, len(FEATURES)) @ self.weights, -30, 30)))


def forms(text: str | None) -> set[str]:
    """The text's words, and their first 3 to 6 letters with a star."""
    words = {w.strip(_EDGES) for w in set((text or "").lower().split())}
    words = {w for w in words if len(w) > 3 and w.isalpha()}
    return words | {w[:n] + "*" for w in words for n in (3, 4, 5, 6) if len(w) > n}


def learned(rows: DataFrame, share: float, least_ratio: float = 27.0) -> list[str]:
    """Words and stems (with a star) that tell toxic documents; rows: text, _dp_y, a sample without exact copies."""
    prepare(rows.sparkSession)

    def count(y: int, among: frozenset | None):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held: Counter = Counter()
            for b in batches:
                for text in b.column(0).to_pylist():
                    held.update(forms(text) if among is None else forms(text) & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["form", "n"])

        return rows.where(F.col("_dp_y") == y).select("text").mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))

    least = math.ceil(least_ratio / (-2 * math.log(share)))
    yes = {r.form: r.n for r in count(1, None).where(F.col("n") >= least).toLocalIterator()}
    no = {r.form: r.n for r in count(0, frozenset(yes)).toLocalIterator()} if yes else {}

    def ratio(form: str) -> float:
        k, m = yes[form], no.get(form, 0)
        return 2 * (k * math.log(k / (k + m) / share) + (m * math.log(m / (k + m) / (1 - share)) if m else 0.0))

    good = {f: ratio(f) for f, k in yes.items() if k / (k + no.get(f, 0)) >= (0.97 if f[-1] == "*" else 0.9) and ratio(f) >= least_ratio}
    words = [f for f in yes if f[-1] != "*"]
    endings = Counter(w[:n] + "*" for w in words for n in (3, 4, 5, 6) if len(w) > n)
    stems = [f for f in good if f[-1] == "*" and endings[f] >= 3]
    stems = [f for f in stems if not any(f[:n] + "*" in good and endings[f[:n] + "*"] >= 3 for n in range(3, len(f) - 1))]
    rest = [f for f in good if f[-1] != "*" and f not in _LISTED and not any(f[:n] + "*" in stems for n in (3, 4, 5, 6))]
    return sorted(stems + rest)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = 20_000, terms: tuple[str, ...] = tuple(LEXICON)) -> Model:
    known = staged(labelled(docs, labels, label, sample_docs))
    total = known.agg(F.count(F.lit(1)), F.sum("_dp_y")).first()
    if not total[0]:
        return Model(Lexicon(list(terms)), PRIOR, frozenset())
    share = (total[1] + 1) / (total[0] + 2)
    auto = Lexicon([*terms, *learned(staged(known.dropDuplicates(["text"]).select("text", "_dp_y")), share)])
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def found(texts: list) -> list:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("form", pa.string()), ("term", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("second", pa.bool_()), ("reporting", pa.bool_())]))
        names = [f.name for f in kind.value_type]
        return [pa.array([[dict(zip(names, h, strict=True)) for h in x] for x in hits(texts, shared.value)], kind), pa.array([len((x or "").split()) for x in texts], pa.int64())]

    ddl = "_dp_hits array<struct<form:string,term:int,edits:int,quoted:boolean,second:boolean,reporting:boolean>>, _dp_words long"
    rows = [(r._dp_y, [tuple(h) for h in r._dp_hits], r._dp_words) for r in staged(per_text(known, found, ddl).drop("text")).toLocalIterator()]
    seen: dict[str, list[int]] = {}
    for y, hs, _ in rows:
        if not any(h[2] == 0 for h in hs):
            for form in {h[0] for h in hs}:
                seen.setdefault(form, [0, 0])[y] += 1
    benign = frozenset(f for f, (no, yes) in seen.items() if no + yes >= 2 and yes < (no + yes) / 2)
    x = np.array([features(hs, n, benign) for _, hs, n in rows])
    return Model(auto, logistic(x, np.array([r[0] for r in rows], float)), benign)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _dp_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        import pyarrow as pa

        return [pa.array(shared.value.score(texts), pa.float64())]

    return per_text(docs, run, "_dp_score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, **kw))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_dp_score").alias("score"), (F.col("_dp_score") >= threshold).cast("int").alias("predicted"))
