"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are classes: insult, threat, target, modal, negation, report. Each pattern is a small transducer that reads
a clause's classes and keeps one thing in its state (a target near by, a modal before, a negation before, reported
speech); the grammar is their composition, whose states are made as they are needed. One that reads the clause from
its end marks the words that a target follows closely, and the composition reads these marks along with the classes.
At an insult or threat it writes a match: what it is, whether it is aimed at someone, and whether it is asserted,
negated or reported. A clause counts once, as its weightiest match, and a text's score is a logistic sum over its
matched clauses.

Seed words are fixed. From labelled rows two more things are learned: stems (whole words or their beginnings) that
stand in toxic texts and hardly in others, chosen greedily so that each accounts for texts that those before it do
not; and the weights of the matches, by logistic regression towards given ones. At most `max_train` labelled rows
are used, those whose ids hash least; nothing else is bounded. Rows with crc32(id as text) mod 5 = 0 are never
learned from. Ids, languages and sources are no inputs of a score.

Null and empty texts match nothing, and get the base score. Without labelled rows the given weights hold. Of
several labels of one id or one text the greatest holds; null labels and labelled null texts are left out. Very
long clauses are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import ALNUM, Rolling, Texts, Words, blocks, map_batches, with_columns
from eventloom.shared import materialize

MAX_TRAIN = 20_000
#: Of stems: least number of toxic texts, share of toxic ones among texts with it (and two more), and log-likelihood ratio against chance.
MIN_SUPPORT, MIN_PRECISION, MIN_RATIO = 3, 0.93, 16.0
#: Of stems that only make a word suspect: several of these in a text are needed.
SUSPECT_PRECISION, SUSPECT_RATIO = 0.4, 12.0
#: Beginnings of words, in characters.
PREFIXES = range(3, 9)
#: Stems that a task counts before it hands the counts on.
COUNTED = 100_000

# Words of the classes.
INSULTS = "idiot idiots moron morons stupid pathetic worthless disgusting trash scum loser losers clown clowns imbecile cretin dimwit halfwit dumbass asshole bastard bitch scumbag vermin filthy dumb ugly coward garbage parasite subhuman".split()
THREATS = "kill murder destroy hurt stab shoot strangle punish crush smash beat burn".split()
TARGETS = "you your you're youre yourself u he him his she her they them their these those people everyone".split()
MODALS = "will gonna going shall must should i'll ill we'll let's lets".split()
NEGATIONS = "not no never isn't isnt aren't arent don't dont doesn't doesnt won't wont nobody without hardly".split()
REPORTS = "said says say called calls wrote writes claimed claims reported reportedly quoted quote alleged allegedly according".split()
CLASSES = ("insult", "threat", "target", "modal", "negation", "report")

#: (what, aimed, manner) of a match, and its given weight; then that of how dense suspect words are, and of no match at all.
MATCHES = [(what, aimed, manner) for what in ("insult", "threat", "suspect") for aimed in (False, True) for manner in ("asserted", "negated", "reported")]
GIVEN = np.array([{"asserted": 5.0, "negated": 2.5, "reported": 3.0}[m] * {"insult": 1.0, "threat": 1.2 if aimed else 0.3, "suspect": 0.3}[what] * (1.2 if aimed else 1.0) for what, aimed, m in MATCHES] + [0.5, -3.5])


class Near:
    """Remembers a class for so many words, or (0) for the rest of the clause."""

    def __init__(self, symbol: str, reach: int):
        self.symbol, self.reach = symbol, reach

    def step(self, state: int, symbol: str | None) -> int:
        if symbol == self.symbol:
            return self.reach or 1
        return state if not self.reach else max(0, state - 1)


class Grammar:
    """The composition of the patterns; its transitions are kept as they are made."""

    parts = (Near("target", 4), Near("modal", 4), Near("negation", 3), Near("report", 0))
    #: Reads from the clause's end.
    after = Near("target", 3)

    def __init__(self) -> None:
        self.start = (0,) * len(self.parts)
        self.moves: dict[tuple, tuple[tuple, tuple | None]] = {}

    def move(self, state: tuple, symbol: str | None, followed: bool) -> tuple[tuple, tuple | None]:
        """The next state, and (what, aimed, manner) if this word is a match."""
        key = (state, symbol, followed)
        if key not in self.moves:
            match = None
            target, modal, negation, report = state
            if symbol in ("insult", "threat", "suspect"):
                match = (symbol, followed or bool(target) or (symbol == "threat" and bool(modal)), "reported" if report else "negated" if negation else "asserted")
            self.moves[key] = (tuple(p.step(s, symbol) for p, s in zip(self.parts, state)), match)
        return self.moves[key]

    def followed(self, classes: list[str | None]) -> list[bool]:
        """Which words of a clause a target follows closely."""
        marks, state = [False] * len(classes), 0
        for i in range(len(classes) - 1, -1, -1):
            marks[i] = state > 0
            state = self.after.step(state, classes[i])
        return marks

    def matches(self, classes: list[str | None]) -> list[tuple]:
        """The matches of a clause."""
        found, state = [], self.start
        for symbol, mark in zip(classes, self.followed(classes)):
            state, match = self.move(state, symbol, mark)
            if match:
                found.append(match)
        return found


class Lexicon:
    """Finds words and beginnings of words in blocks of texts."""

    def __init__(self, stems: list[str], suspects: list[str]):
        """stems, suspects: a beginning of words, or a whole word with $ after it."""
        self.whole = {w.encode(): c for c, words in zip(CLASSES, (INSULTS, THREATS, TARGETS, MODALS, NEGATIONS, REPORTS)) for w in words}
        self.begins: dict[bytes, str] = {}
        for c, names in (("suspect", suspects), ("insult", stems)):
            self.whole |= {s[:-1].encode(): c for s in names if s.endswith("$")}
            self.begins |= {s.encode(): c for s in names if not s.endswith("$")}
        self.cores = {w for w, c in self.whole.items() if c in ("insult", "threat", "suspect")}
        self.sizes = sorted({len(b) for b in self.begins})
        self.tables: list[tuple[bool, int, np.ndarray]] = []
        for whole, group in ((True, self.cores), (False, self.begins)):
            for size in sorted({len(x) for x in group}):
                t = Texts(pa.array([x.decode() for x in sorted(group) if len(x) == size]))
                self.tables.append((whole, size, np.sort(Rolling(t.buf).spans(t.off[:-1], t.off[1:]))))

    def of(self, word: bytes) -> str | None:
        c = self.whole.get(word)
        if not c:
            found = {self.begins.get(word[:n]) for n in self.sizes if n <= len(word)}
            c = "insult" if "insult" in found else "suspect" if "suspect" in found else None
        return c

    def cores_of(self, w: Words) -> np.ndarray:
        """Which words are insults or threats."""
        roll = Rolling(w.buf)
        size = w.end - w.start
        hit = np.zeros(len(size), bool)
        for whole, n, hashes in self.tables:
            at = np.flatnonzero(size == n if whole else size >= n)
            h = roll.spans(w.start[at], w.start[at] + n)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit[at[hashes[k] == h]] = True
        return np.flatnonzero(hit)


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;\n")] = True


def features(texts: Texts, lexicon: Lexicon, grammar: Grammar, weights: np.ndarray) -> np.ndarray:
    """For each text how many clauses count as each kind of match, and how many words it has."""
    out = np.zeros((texts.n, len(MATCHES) + 1))
    w = Words(texts, ALNUM, lower=True)
    out[:, -1] = w.counts
    cores = lexicon.cores_of(w)
    if not len(cores):
        return out
    ends = np.union1d(np.flatnonzero(_ENDS[w.buf]), texts.off)
    clause = np.searchsorted(ends, w.start[cores], "right")
    place = {m: i for i, m in enumerate(MATCHES)}
    for k in np.unique(clause).tolist():
        lo = int(np.searchsorted(w.start, ends[k - 1]))
        hi = int(np.searchsorted(w.start, ends[k])) if k < len(ends) else len(w.start)
        found = grammar.matches([lexicon.of(w.text(i, i + 1)) for i in range(lo, hi)])
        if found:
            out[w.doc[lo], max((place[m] for m in found), key=lambda i: weights[i])] += 1
    return out


def _input(counts: np.ndarray) -> np.ndarray:
    matches, words = counts[:, :-1], counts[:, -1:]
    suspects = matches[:, [what == "suspect" for what, _, _ in MATCHES]].sum(axis=1, keepdims=True)
    return np.concatenate([np.log2(1 + matches), np.log2(1 + 200 * suspects / (words + 20)), np.ones((len(counts), 1))], axis=1)


def _score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, given: np.ndarray = GIVEN, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards the given weights."""
    w = given.copy()
    for _ in range(30):
        p = _score(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - given))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def stems_of(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in PREFIXES if len(w) > n} | {f"{w}$" for w in words if len(w) >= 3}


def _word_sets(part: pa.RecordBatch, texts: Texts) -> Iterator[set[str]]:
    w = Words(texts, ALNUM, lower=True)
    for d in range(texts.n):
        yield {x.decode() for x in {w.buf[w.start[i] : w.end[i]].tobytes() for i in range(w.first[d], w.first[d + 1])}}


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str, text: str, max_train: int) -> DataFrame:
    """(text, y) of at most max_train labelled rows, each text once, with the greatest of its labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # Bounded by max_train rows of two numbers, so it may be broadcast.
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    return found.groupBy("text").agg(F.max("y").alias("y"))


def learn_stems(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Stems that tell toxic texts, and stems that make them suspect; none for texts that others tell already."""
    sc = rows.sparkSession.sparkContext
    n_pos, n_all = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not n_pos:
        return [], []

    def counted(wanted=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = wanted.value if wanted else None
            pos, neg = Counter(), Counter()

            def counts() -> pa.RecordBatch:
                names = list(pos.keys() | neg.keys())
                out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[s] for s in names], pa.int64()), pa.array([neg[s] for s in names], pa.int64())], names=["stem", "pos", "neg"])
                pos.clear()
                neg.clear()
                return out

            for part, texts in blocks(batches, "text"):
                for y, words in zip(part.column(1).to_pylist(), _word_sets(part, texts)):
                    stems = stems_of(words)
                    (pos if y else neg).update(stems if held is None else stems & held)
                    if len(pos) + len(neg) > COUNTED:
                        yield counts()
            yield counts()

        return run

    counts = "stem string, pos long, neg long"
    some = map_batches(rows.where("y > 0"), counted(), counts).groupBy("stem").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= MIN_SUPPORT)
    rate = n_pos / n_all
    # Common beginnings are of no use, nor is what would not tell enough if no other text had it. max_train rows bound the rest.
    best = 2 * F.col("pos") * float(-np.log(rate))
    names = {r.stem for r in some.where((F.col("pos") <= 0.6 * n_pos + 10) & (best >= min(MIN_RATIO, SUSPECT_RATIO) - 1e-6)).collect()}
    both = map_batches(rows, counted(sc.broadcast(names)), counts).groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    good = {}
    for r in both.where((share > rate) & (share >= min(MIN_PRECISION, SUSPECT_PRECISION))).collect():
        n, share = r.pos + r.neg, r.pos / max(1, r.pos + r.neg)
        if r.pos >= MIN_SUPPORT and share > rate:
            ratio = 2 * (r.pos * np.log(share / rate) + (r.neg * np.log((1 - share) / (1 - rate)) if r.neg else 0))
            if (r.pos >= MIN_PRECISION * (n + 2) and ratio >= MIN_RATIO) or (share >= SUSPECT_PRECISION and ratio >= SUSPECT_RATIO):
                good[r.stem] = (r.pos, r.neg, ratio)
    if not good:
        return [], []
    names = sorted(good, key=lambda s: (-good[s][0], good[s][1], s))
    number = sc.broadcast({s: i for i, s in enumerate(names)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = number.value
        for part, texts in blocks(batches, "text"):
            found = [[index[s] for s in stems_of(words) if s in index] for words in _word_sets(part, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["stems"])

    # At most max_train rows; each lists only stems among the candidates.
    texts = [set(r.stems) for r in map_batches(rows.where("y > 0"), held, "stems array<int>").collect()]
    by: dict[int, set[int]] = {}
    for t, stems in enumerate(texts):
        for s in stems:
            by.setdefault(s, set()).add(t)
    seeds = {f"{w}$" for w in INSULTS}
    told = set().union(*(by.get(i, set()) for i, s in enumerate(names) if s in seeds))

    def chosen(of: set[int]) -> list[str]:
        """Of equal stems the shortest, which is in most texts."""
        done, out = set(told), []
        order = sorted(of, key=lambda s: (-good[names[s]][1], -len(names[s]), names[s]), reverse=True)
        # What a stem adds only falls: one whose place still holds when it comes up is the best.
        heap = [(-len(by[s] - done), k, s) for k, s in enumerate(order)]
        heapify(heap)
        while heap:
            was, k, s = heap[0]
            adds = len(by[s] - done)
            if adds < MIN_SUPPORT:
                heappop(heap)
            elif adds < -was:
                heapreplace(heap, (-adds, k, s))
            else:
                heappop(heap)
                done |= by[s]
                out.append(names[s])
        return out

    sure = {s for s in by if good[names[s]][0] >= MIN_PRECISION * (sum(good[names[s]][:2]) + 2) and good[names[s]][2] >= MIN_RATIO and names[s] not in seeds}
    return chosen(sure), chosen(set(by) - sure - {i for i, s in enumerate(names) if s in seeds})


class Model:
    def __init__(self, stems: list[str], suspects: list[str], weights: np.ndarray):
        self.stems, self.suspects, self.weights = stems, suspects, weights


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """held_out: of labels, rows that are not to be learned from."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0 if held_out is None else held_out
    rows = materialize(training_rows(docs, labels, held_out, doc_id, text, max_train), "labelled")
    stems, suspects = learn_stems(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, grammar = Lexicon(stems, suspects), Grammar()
        for part, texts in blocks(batches, "text"):
            x = features(texts, lexicon, grammar, GIVEN)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    got = map_batches(rows, run, "x array<double>, y int").groupBy("x", "y").count().collect()
    if not got:
        return Model(stems, suspects, GIVEN)
    x = np.repeat(np.array([r.x for r in got]), [r["count"] for r in got], axis=0)
    return Model(stems, suspects, fit(_input(x), np.repeat(np.array([float(r.y) for r in got]), [r["count"] for r in got])))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each():
        m = shared.value
        lexicon, grammar = Lexicon(m.stems, m.suspects), Grammar()

        def of(texts: Texts) -> dict[str, pa.Array]:
            return {name: pa.array(_score(_input(features(texts, lexicon, grammar, m.weights)), m.weights))}

        return of

    return with_columns(docs, text, T.StructType([T.StructField(name, T.DoubleType())]), each)
