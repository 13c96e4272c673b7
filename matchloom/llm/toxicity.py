"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned from a bounded sample of labelled rows (`sample`, 20,000 by default): whole words, and stems
(word beginnings of 4 to 6 letters), whose document frequency differs most between toxic and clean rows. All terms stand
in one trie. The automaton of the trie's words within `errors(term)` edits is built lazily: a state is the set of
(trie node, edits) pairs still alive, so a word is matched in one walk and most words die after a few letters. Words near
a term that clean rows of the sample use are words of their own, not misspellings; other near words count 0.7 of a term.
What a clean row only quotes or reports is no use of its own: it speaks neither against a term nor for a near word.

Every hit gets a context window of 8 words on each side: quotation marks around it or a verb of reporting before it
separate quotation from abuse; an address to a second person and further hits strengthen it. A logistic model on these
counts, fitted on the same sample, gives the score.

Very long texts are taken whole. Ties between terms go by edits, then by code point. Null and empty texts have no hit and get the model's score for that. Without a toxic row in the sample the score is 0.
Repeated rows are scored alike; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, forget, sliced, small_batches, stored

TOKENS = re.compile(r"\w+|[\"“”„«»‘]|(?<!\w)[’']|[’'](?!\w)")  # an apostrophe inside a word is no quotation mark
SPAN = 8
NEAR = 0.7  # what a misspelled term counts
# Quotation marks, verbs of reporting and second-person words in four languages.
QUOTES = {'"', "“", "”", "„", "«", "»", "‘", "’"}
REPORTING = {"said", "says", "wrote", "writes", "called", "quoted", "quote", "sagte", "schrieb", "nannte", "zitat", "dit", "écrit", "appelé", "citation", "dijo", "escribió", "llamó", "cita"}
SECOND = {"you", "your", "yourself", "u", "ur", "du", "dich", "dein", "euch", "tu", "toi", "vous", "ton", "votre", "tú", "usted", "ustedes"}
STEMS = (4, 5, 6)
HELD = 100_000  # terms that a task counts before it hands its counts on


def quoted_at(tokens: list[str], i: int) -> bool:
    """Whether token i stands between quotation marks, or after a verb of reporting, within its window."""
    left = tokens[max(0, i - SPAN) : i]
    return (not QUOTES.isdisjoint(left) and not QUOTES.isdisjoint(tokens[i + 1 : i + SPAN + 1])) or not REPORTING.isdisjoint(left)


def own_words(tokens: list[str]) -> list[bool]:
    """For each token, whether the text says it itself, not in a quotation."""
    if QUOTES.isdisjoint(tokens) and REPORTING.isdisjoint(tokens):
        return [True] * len(tokens)
    return [not quoted_at(tokens, i) for i in range(len(tokens))]


def errors(term: str, stem: bool) -> int:
    """Edits allowed: none for stems and short words, one from five letters on, two from nine."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and the lazily built automaton of all words near them."""

    def __init__(self, terms: list[tuple[str, bool]], plain: frozenset[str] = frozenset()):
        self.plain = plain  # near words that are no misspellings
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool, int]]] = [[]]
        self.most: list[int] = [0]
        for term, stem in terms:
            at, k = 0, errors(term, stem)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at].append((term, stem, k))
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self.sets: list[dict[int, int]] = []
        self.start = self.state({0: 0})

    def state(self, alive: dict[int, int]) -> int:
        """The state of {node: fewest edits}, closed under skipping a term's letters; -1 if nothing is alive."""
        todo = list(alive.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.most[nxt] and alive.get(nxt, 99) > e + 1:
                    alive[nxt] = e + 1
                    todo.append((nxt, e + 1))
        if not alive:
            return -1
        key = frozenset(alive.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.sets.append(alive)
            ends = [(e, term, stem) for node, e in alive.items() for term, stem, k in self.ends[node] if e <= k]
            whole = min(((e, t) for e, t, s in ends if not s), default=None)
            stem = min(((e, t) for e, t, s in ends if s), default=None)
            self.accepts.append((whole, stem))
        return self.states[key]

    def step(self, s: int, c: str) -> int:
        alive: dict[int, int] = {}

        def add(node, e):
            if e <= self.most[node] and alive.get(node, 99) > e:
                alive[node] = e

        for node, e in self.sets[s].items():
            add(node, e + 1)  # a letter too many
            for letter, nxt in self.child[node].items():
                add(nxt, e + (letter != c))
        return self.state(alive)

    def match(self, word: str):
        """(edits, term, whether a stem) of the best match, or None. Whole words go before stems."""
        s, stem = self.start, None
        for c in word:
            nxt = self.moves[s].get(c)
            if nxt is None:
                nxt = self.moves[s][c] = self.step(s, c)
            s = nxt
            if s < 0:
                break
            stem = stem or self.accepts[s][1]
        if s >= 0 and self.accepts[s][0] and (self.accepts[s][0][0] == 0 or word not in self.plain):
            return (*self.accepts[s][0], False)
        return (*stem, True) if stem else None


NAMES = ("words", "stem", "kinds", "dense", "quoted", "second", "rate")


def features(text: str | None, lexicon: Lexicon, cache: dict) -> list[float]:
    tokens = TOKENS.findall(text.lower()) if text else []
    hits = []
    for i, w in enumerate(tokens):
        m = cache.get(w, 0)
        if m == 0:
            if len(cache) > 300_000:
                cache.clear()
            m = cache[w] = lexicon.match(w)
        if m is not None:
            hits.append((i, m))
    if not hits:
        return [0.0] * len(NAMES)
    at = [i for i, _ in hits]
    quoted = second = 0
    dense, lo, hi = 0, 0, 0
    for i in at:
        around = tokens[max(0, i - SPAN) : i + SPAN + 1]
        quoted += quoted_at(tokens, i)
        second += any(t in SECOND for t in around)
        while at[lo] < i - SPAN:
            lo += 1
        while hi < len(at) and at[hi] <= i + SPAN:
            hi += 1
        dense = max(dense, hi - lo)
    n = len(hits)
    exact = sum(m[0] == 0 and not m[2] for _, m in hits)
    stem = sum(m[2] for _, m in hits)
    return [math.log1p(exact + NEAR * (n - exact - stem)), math.log1p(stem), math.log1p(len({m[1] for _, m in hits})), math.log1p(dense), quoted / n, second / n, math.log1p(100 * n / len(tokens))]


def _frequencies(batches):
    """Rows with each term by label, and which of 64 slots the words before it fall into in toxic rows."""
    def counted(rows):
        term, stem, clean, toxic, slots = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(stem), pa.array(clean), pa.array(toxic), pa.array(np.array(slots, dtype=np.uint64).view(np.int64))], names=["term", "stem", "clean", "toxic", "slots"])

    count: dict[tuple[str, bool], list[int]] = {}
    total = [0, 0]
    for b in batches:
        if len(count) > HELD:
            yield counted([(t, s, *c) for (t, s), c in count.items()])
            count.clear()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[toxic] += 1
            tokens = TOKENS.findall(text.lower()) if text else []
            seen: dict[tuple[str, bool], int] = {}
            own = [True] * len(tokens) if toxic else own_words(tokens)
            for w, before, counts in zip(tokens, ["", *tokens], own):
                if counts and w.isalpha():
                    slot = 1 << (zlib.crc32(before.encode()) & 63) if toxic else 0
                    if len(w) >= 3:
                        seen[w, False] = seen.get((w, False), 0) | slot
                    for n in STEMS:
                        if len(w) > n:
                            seen[w[:n], True] = seen.get((w[:n], True), 0) | slot
            for k, slots in seen.items():
                c = count.setdefault(k, [0, 0, 0])
                c[toxic] += 1
                c[2] |= slots
    yield counted([(t, s, *c) for (t, s), c in count.items()] + [("", False, *total, 0)])


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 3.0) -> list[tuple[str, bool]]:
    """All terms of sample(text, toxic) with log odds of `odds` or more that stand in at least `least` toxic rows, and in 1%
    of them; a stem must stand for at least three times as many. The sample bounds how many there can be.

    A term must follow many different words, so that words of a text that was copied often are no terms.
    """
    n = sample.mapInArrow(_frequencies, fields(("term", "string"), ("stem", "boolean"), ("clean", "long"), ("toxic", "long"), ("slots", "long")))
    n = n.groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("slots")).alias("contexts"))
    n = stored(n.where((F.col("term") == "") | (F.col("toxic") >= least) & (F.col("toxic") > F.col("clean"))))
    total = {r["term"]: r for r in n.where("term = ''").collect()}
    if not total or not total[""]["toxic"]:
        forget(n)
        return []
    bad, good = total[""]["toxic"], total[""]["clean"]
    least = max(least, bad // 100)
    score = F.log((F.col("toxic") + 0.5) / (bad - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (good - F.col("clean") + 0.5))
    best = n.where("term <> ''").withColumn("score", score).where((F.col("toxic") >= least) & (F.col("contexts") >= F.least(F.lit(12.0), F.col("toxic") * 0.5)) & (F.col("score") >= odds) & (~F.col("stem") | (F.col("toxic") >= 3 * least)))
    rows = best.orderBy(F.col("score").desc(), "term", "stem").collect()  # from at most `sample` rows
    forget(n)
    out: list[tuple[str, bool]] = []
    stems: set[str] = set()
    for r in sorted(rows, key=lambda r: (not r["stem"], len(r["term"]) if r["stem"] else 0, -r["score"], r["term"])):
        if any(r["term"].startswith(s) for s in stems):
            continue  # a shorter stem stands for it
        # A stem that comes from one word alone gives way to that word.
        if r["stem"] and any(not x["stem"] and x["term"].startswith(r["term"]) and x["toxic"] >= 0.8 * r["toxic"] for x in rows):
            continue
        if r["stem"]:
            stems.add(r["term"])
        out.append((r["term"], r["stem"]))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised columns."""
    mean, dev = x.mean(axis=0), x.std(axis=0)
    dev[dev == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w, pull = np.zeros(z.shape[1]), np.append(1e-3, np.full(z.shape[1] - 1, ridge))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, dev


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """text and toxic of at most `sample` labelled documents outside the held-out fold, drawn by a hash of their id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))  # at most `sample` rows


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000):
    """(terms, near words that are no misspellings, weights): everything that scoring needs."""
    with small_batches(docs.sparkSession, 256):
        rows = stored(labelled(docs, labels, sample))  # read three times
        model = learned(rows)
    forget(rows)
    return model


def learned(rows: DataFrame):
    """What train() returns, from rows(text, toxic)."""
    terms = learn_lexicon(rows)
    if not terms:
        return [], frozenset(), None

    def near(batches):
        lexicon, found, seen = Lexicon(terms), set(), set()
        for b in batches:
            for text in b.column(0).to_pylist():
                tokens = TOKENS.findall(text.lower()) if text else []
                new = {w for w, own in zip(tokens, own_words(tokens)) if own} - seen
                found |= {w for w in new if (m := lexicon.match(w)) and m[0] > 0}
                seen = new if len(seen) > 300_000 else seen | new
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    clean = rows.where("toxic = 0").select("text").mapInArrow(near, fields(("word", "string")))
    plain = frozenset(r["word"] for r in clean.distinct().collect())  # near words of at most `sample` rows

    def count(batches):
        lexicon, cache = Lexicon(terms, plain), {}
        for b in batches:
            got = [features(t, lexicon, cache) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *map(pa.array, zip(*got))], names=["toxic", *NAMES]) if got else pa.RecordBatch.from_pylist([], schema=pa.schema([("toxic", pa.int32()), *[(n, pa.float64()) for n in NAMES]]))

    got = rows.mapInArrow(count, fields(("toxic", "int"), *[(n, "double") for n in NAMES])).toPandas()  # at most `sample` rows
    got = got.sort_values(["toxic", *NAMES])
    return terms, plain, fit(got[list(NAMES)].to_numpy(float), got["toxic"].to_numpy(float))


def score(docs: DataFrame, model, keep: list[str], only_clean: bool = False, threshold: float = 0.5) -> DataFrame:
    """The columns `keep` of docs with score; or, with only_clean, the rows of docs below the threshold, unchanged."""
    terms, plain, weights = model

    def run(batches):
        lexicon, cache = Lexicon(terms, plain), {}
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist() if only_clean else b.column(len(keep)).to_pylist()
            if weights is None or not texts:
                s = np.zeros(len(texts))
            else:
                w, mean, dev = weights
                x = (np.array([features(t, lexicon, cache) for t in texts]) - mean) / dev
                s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            if only_clean:
                yield b.filter(pa.array(s < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s)], names=[*keep, "score"])

    if only_clean:
        return docs.mapInArrow(run, docs.schema)
    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, fields(*[(f.name, f.dataType) for f in rows.schema[:-1]], ("score", "double")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    out = score(docs.select("doc_id", "text", (fold == 0).alias("held_out")), train(docs, labels), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
