"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause are read as symbols: insult, threat, intent, target, negation, report or
other. Four transducers rewrite the symbols, each reading what the one before it wrote:
negation marks the insults, threats, intents and report words after it; reported speech
begins at a report word that is not negated and marks the insults and threats after it; an
intent that is not negated marks the threats after it ("will hurt"); a target marks the
insults and threats near it. They are composed into one automaton by the product of their
states. A match's weight is the sum of the weights of its arcs (ARCS) before anything is
learned: a bare threat word says little, an intent, a threat and a target together say a
threat, and a negated or reported insult says less than a direct one. What the automaton
puts out for a text is the weight of the matches by their marks; the weights of the marks,
and the insult stems that the seed words lack, are learned from a bounded sample of
labelled rows (SAMPLE of each label), never from rows that are held out.

Only clauses in which an Aho-Corasick automaton finds an insult or a threat are read.

Defined results: a null or empty text has no clauses and the score of the bias alone;
repeated rows are scored row by row; null labels and null ids of labels are ignored, an id
with several labels counts as toxic if one is; without labels of both kinds the weights
are the sums of ARCS; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each label to learn from, at most; the same ones at every run.
SAMPLE = 6000
#: Stems that are learned, at most; rows that must have one; how much likelier toxic rows must have it.
STEMS, STEM_ROWS, STEM_ODDS = 400, 5, 2.5
FOLDS = 5

INSULTS = ("idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumb fool filth vermin crap "
           "dumm trottel abschaum wertlos crétin imbécile ordure minable estúpido basura imbécil inútil").split()  # fmt: skip
THREATS = "kill destroy hurt beat shoot stab töten zerstören tuer frapper matar golpear".split()
TARGETS = "you your u he she they them him her these those people du ihr sie euch tu vous ils elles tú usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein nie ne pas jamais non nunca".split()
REPORTS = "said says say claimed claims quoted wrote asked told sagte schrieb dit écrit dijo escribió".split()

INTENTS = "will gonna going shall werde wirst wird vais vas va voy vamos".split()

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
KINDS = 7
#: Marks of a match. On a symbol they stand above the three bits of its kind, and INTENDED beside them.
TARGETED, NEGATED, REPORTED, INTENDED = 1, 2, 4, 16
#: Outputs of the composed automaton: the marks, 8 for a threat, and BARE for a threat without an intent.
OUTPUTS = 32
IS_THREAT, BARE = 8, 16
#: Weights of the arcs that a match's path takes; a reported or negated match keeps a little.
ARCS = {"insult": 3.5, "threat": 0.5, "negated": -2.5, "reported": -2.5, "intended": 1.25, "targeted": 1.75}
BIAS = -3.0
#: Words that a negation, an intent or a target reaches.
REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]")


def _kind(symbol: int) -> int:
    return symbol & 7


def _is_match(symbol: int) -> bool:
    return _kind(symbol) in (INSULT, THREAT)


def _negation(state: int, symbol: int) -> tuple[int, int]:
    """States: words left that a negation reaches."""
    marked = symbol | NEGATED << 3 if state and _kind(symbol) in (INSULT, THREAT, INTENT, REPORT) else symbol
    return (REACH if _kind(symbol) == NEGATION else max(0, state - 1)), marked


def _report(state: int, symbol: int) -> tuple[int, int]:
    """States: whether reported speech has begun; "never said" does not begin it."""
    marked = symbol | REPORTED << 3 if state and _is_match(symbol) else symbol
    return int(state or (_kind(symbol) == REPORT and not symbol & NEGATED << 3)), marked


def _intent(state: int, symbol: int) -> tuple[int, int]:
    """States: words left that an intent reaches; "will not" has none."""
    marked = symbol | INTENDED << 3 if state and _kind(symbol) == THREAT else symbol
    return (REACH if _kind(symbol) == INTENT and not symbol & NEGATED << 3 else 0 if _kind(symbol) == NEGATION else max(0, state - 1)), marked


def _target(state: int, symbol: int) -> tuple[int, int]:
    """States: words left that a target reaches."""
    marked = symbol | TARGETED << 3 if state and _is_match(symbol) else symbol
    return (REACH if _kind(symbol) == TARGET else max(0, state - 1)), marked


#: The transducers in the order of their composition.
CASCADE = (_negation, _report, _intent, _target)


def output(symbol: int) -> int:
    """The output of a marked match, or -1 for other symbols."""
    if not _is_match(symbol):
        return -1
    marks = symbol >> 3
    threat = 0 if _kind(symbol) == INSULT else IS_THREAT | (0 if marks & INTENDED else BARE)
    return marks & (TARGETED | NEGATED | REPORTED) | threat


@functools.lru_cache(maxsize=2)
def grammar(cascade: tuple = CASCADE) -> tuple[list[list[int]], list[list[int]]]:
    """The composition: next state by (state, symbol), and the output of matches (or -1). A transducer reads what the one before it writes."""
    start = (0,) * len(cascade)
    states, index, edges, outputs = [start], {start: 0}, [], []
    for state in states:
        row, out = [], []
        for symbol in range(KINDS):
            written, nxt = symbol, []
            for step, own in zip(cascade, state, strict=True):
                own, written = step(own, written)
                nxt.append(own)
            if tuple(nxt) not in index:
                index[tuple(nxt)] = len(states)
                states.append(tuple(nxt))
            row.append(index[tuple(nxt)])
            out.append(output(written))
        edges.append(row)
        outputs.append(out)
    return edges, outputs


def path_weight(out: int) -> float:
    """The sum of the weights of a match's arcs, at least a little."""
    taken = {"threat" if out & IS_THREAT else "insult"} | {name for name, mark in (("targeted", TARGETED), ("negated", NEGATED), ("reported", REPORTED)) if out & mark}
    if out & IS_THREAT and not out & BARE:
        taken.add("intended")
    return max(0.25, sum(ARCS[name] for name in taken))


class Lexicon:
    """Symbols of words: whole words, and stems that open a word, with a weight each."""

    def __init__(self, stems: dict[str, float]):
        self.symbols: dict[str, int] = {}
        for words, symbol in ((INTENTS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT)):
            self.symbols.update(dict.fromkeys(words, symbol))
        self.weights = dict.fromkeys((*INSULTS, *THREATS), 1.0)
        self.prefixes = {s[:-1]: w for s, w in stems.items() if s.endswith("*")}
        for s, w in stems.items():
            if not s.endswith("*"):
                self.symbols[s] = INSULT
                self.weights[s] = w
        self.finder = ahocorasick.Automaton()
        for s in {*self.prefixes, *self.weights}:
            self.finder.add_word(s, len(s))
        self.finder.make_automaton()

    def read(self, word: str) -> tuple[int, float]:
        symbol = self.symbols.get(word, OTHER)
        if symbol != OTHER:
            return symbol, self.weights.get(word, 1.0)
        for n in range(min(len(word), 6), 3, -1):
            if word[:n] in self.prefixes:
                return INSULT, self.prefixes[word[:n]]
        return OTHER, 0.0

    def clauses(self, text: str):
        """Bounds of the clauses with a possible match."""
        done = 0
        for end, n in self.finder.iter(text):
            start = end - n + 1
            if start < done or (start and text[start - 1].isalpha()):
                continue
            lo = max((text.rfind(c, done, start) for c in ".!?;\n"), default=-1) + 1
            stop = _CLAUSE.search(text, end + 1)
            done = stop.start() + 1 if stop else len(text)
            yield max(lo, 0), done


def read_clause(symbols: list[int]) -> dict[int, int]:
    """Output of each match of a clause, by its place."""
    edges, outputs = grammar()
    state, marks = 0, {}
    for k, symbol in enumerate(symbols):
        if outputs[state][symbol] >= 0:
            marks[k] = outputs[state][symbol]
        state = edges[state][symbol]
    # A target may also stand after its match: the target transducer reads the clause backwards too.
    state = 0
    for k in range(len(symbols) - 1, -1, -1):
        state, written = _target(state, symbols[k])
        if k in marks and written & TARGETED << 3:
            marks[k] |= TARGETED
    return marks


def match_counts(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Weight of the matches by output of the grammar."""
    counts = np.zeros(OUTPUTS)
    if not text:
        return counts
    text = text.lower()
    for lo, hi in lexicon.clauses(text):
        read = [lexicon.read(w[0]) for w in _WORD.finditer(text, lo, hi)]
        for k, out in read_clause([symbol for symbol, _ in read]).items():
            counts[out] += read[k][1]
    return counts


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Words and word beginnings (4 to 6 letters) that toxic rows have much likelier; at most STEMS."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0))
    long_words = F.filter(words, lambda w: F.char_length(w) >= 4)
    terms = F.array_distinct(F.flatten(F.transform(long_words, lambda w: F.array(w, *[F.concat(F.substring(w, 1, n), F.lit("*")) for n in (4, 5, 6)]))))
    totals = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    n1, n0 = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    if not n1 or not n0:
        return {}
    seen = rows.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    best = (
        seen.withColumn("odds", odds)
        .where((F.col("a") >= STEM_ROWS) & (F.col("odds") >= STEM_ODDS) & (F.col("a") >= 8 * F.col("b")))
        .orderBy((F.col("a") * F.col("odds")).desc(), "term")
        .limit(STEMS)
        .collect()
    )
    return {r["term"]: min(1.0, r["odds"] / 6) for r in best}


def _features(counts: np.ndarray) -> np.ndarray:
    """Presence and saturated weight of each output."""
    return np.concatenate([counts > 0, np.log1p(counts)], axis=-1).astype(np.float64)


#: Weights before anything is learned: bias, then presence and log weight of each output.
FIXED = np.array([BIAS] + [path_weight(k) for k in range(OUTPUTS)] + [0.5 if path_weight(k) >= 3 else 0.0 for k in range(OUTPUTS)])


def fit(counts: np.ndarray, toxic: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps; the bias is not shrunk, the rest is drawn to the fixed weights."""
    if not len(toxic) or toxic.min() == toxic.max():
        return FIXED
    x = np.concatenate([np.ones((len(toxic), 1)), _features(counts)], axis=1)
    w = FIXED.copy()
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (toxic - p) - shrink * (w - FIXED)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counts(stems):
    def run(batches):
        lexicon = Lexicon(stems)
        for batch in common.slices(batches):
            rows = np.array([match_counts(t, lexicon) for t in batch["text"].to_pylist()]).reshape(-1, OUTPUTS)
            yield pa.record_batch({"counts": pa.array(rows.tolist(), pa.list_(pa.float64())), "toxic": batch["toxic"]})

    return run


def _scores(stems, weights):
    def run(batches):
        lexicon = Lexicon(stems)
        for batch in common.slices(batches):
            rows = np.array([match_counts(t, lexicon) for t in batch["text"].to_pylist()]).reshape(-1, OUTPUTS)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + _features(rows) @ weights[1:], -30, 30)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(score, pa.float64())})

    return run


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic): for each of at most ``sample`` labels of either kind outside the held-out fold one row of that id, that of the smallest text hash."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(common.id_bucket(F.col("doc_id"), FOLDS) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(sample) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("label_id"))
    # A sample of labels is no bound on rows: an id may stand in any number of them.
    one = rows.groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    return one.select("m.text", "toxic")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score) of each row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic)."""
    common.ship_package(docs.sparkSession)
    rows = labelled(docs, labels, sample)
    stems = learn_stems(rows)
    got = rows.mapInArrow(_counts(stems), "counts array<double>, toxic int").toArrow()
    counts = got["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, OUTPUTS) if got.num_rows else np.zeros((0, OUTPUTS))
    weights = fit(counts, got["toxic"].to_numpy().astype(np.float64))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (common.id_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    return asked.mapInArrow(_scores(stems, weights), "doc_id long, held_out boolean, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    found = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
