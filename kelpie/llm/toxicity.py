"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause are read as symbols: *insult* (stems learned from labelled documents), *harm* (a verb of threat), *target*
(a second or third person), *not*, *say* (a verb of saying), *quote* (an opening quotation mark) and *word*. Four small
weighted transducers rewrite the symbols in a cascade:

* ``NEGATION`` marks insults and verbs of harm within two words after *not*;
* ``REPORT`` marks insults and threats after *say* or *quote*, to the end of the clause;
* ``ADDRESS`` marks insults that stand after a target, and turns a target after unmarked insults into an *address*;
* ``THREAT`` turns a target within three words after an unmarked verb of harm into a *threat*.

``compose`` builds one machine from the cascade (its states are those reachable, its arcs carry the product of the arcs'
weights), which runs once over a clause's words. Every arc of it that emits a match has a weight; a match weighs the weight
of its stem times that of its arc, a clause scores the noisy-or of its matches and a document the noisy-or of its clauses.
Words outside a match never count.

Learning uses at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled rows, those of smallest hash (documented bound; the
share of each class is known, so weights are corrected for it). Stems are whole words, word beginnings, or beginnings that
several words of a document share (for those that clean documents have now and then), read only where neither negation
nor report holds, and chosen greedily:
each next stem must be rare in clean documents and explain toxic documents that no stem so far explains. So copies of one
toxic document, which share every rare word, add a single stem at most; copies are also dropped before counting. The
weights of negation, report and address are shares of toxic documents among those of one context, with prior counts; an
insult with a target never weighs less than one without.

Edge cases: a null or empty text scores as a text without a match; without labelled rows only the threat part scores; a
document whose label rows disagree takes part with each of them; repeated rows are scored alike; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import shingle_sets, text_chunks

SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 6_000
REJECT_AT = 0.7
STEM_LENGTHS = range(3, 8)
MAX_STEMS = 400
#: A beginning too common for one occurrence to tell may tell where so many words of a document share it.
REPEATS = (2, 3, 5)
#: A stem's share among toxic documents is at least so many times its (smoothed) share among clean ones.
LEAST_RATIO = 25
#: Toxic documents that a stem must explain for each sampled clean document that has it.
CLEAN_COST = 5
#: A stem is in at least so many sampled toxic documents, and in this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.0025
#: Share of the toxic documents from which a stem counts even if other stems explain them, if no sampled clean one has it.
FREQUENT = 0.03

# The closed word classes of the grammar, in the languages of the corpus.
TARGETS = "you your yours he she him her they them their those these people tu toi vous ils elles eux du dich ihr euch sie tú usted ustedes ellos ellas".split()
THREATS = "kill hurt destroy attack murder beat burn shoot stab strangle tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say wrote writes claimed claims quoted reported called dit disait écrit sagte sagt schrieb dijo dice escribió".split()
# Prior share and prior count of each context, and the weight of a threat that reaches a target.
PRIOR = {"plain": 0.9, "target": 0.95, "negated": 0.3, "reported": 0.4}
PRIOR_COUNT, THREAT_WEIGHT, LEAST_SCORE = 4.0, 0.85, 0.01

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOP = re.compile(r"[.!?;\n]")
_PIECE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“„«]|[.!?;\n]")
_QUOTES = "\"“„«"
CLOSED = {w: "target" for w in TARGETS} | {w: "harm" for w in THREATS} | {w: "not" for w in NEGATIONS} | {w: "say" for w in REPORTS}
_SHIFTS = {*NEGATIONS, *REPORTS}

# The transducers. State 0 starts; (state, symbol) -> (next state, rewritten symbol, name of the arc's weight or None).
# A symbol without an arc passes unchanged, to the state that ``*`` gives (its own where there is none).
Transducer = dict[tuple[int, str], tuple[int, str, str | None]]
#: States: words for which negation still holds.
NEGATION: Transducer = {
    **{(s, "not"): (2, "not", None) for s in range(3)},
    **{(s, "quote"): (s, "quote", None) for s in range(3)},
    **{(s, "*"): (s - 1, "*", None) for s in (1, 2)},
    **{(s, "insult"): (s - 1, "insult-", "negated") for s in (1, 2)},
    **{(s, "harm"): (s - 1, "harm-", None) for s in (1, 2)},
}
#: States: 1 after a verb of saying or a quotation mark.
REPORT: Transducer = {
    **{(s, x): (1, x, None) for s in (0, 1) for x in ("say", "quote")},
    (1, "insult"): (1, "insult:", "reported"),
    (1, "insult-"): (1, "insult-", "reported"),
    (1, "harm"): (1, "harm:", None),
}
#: States: 1 after an unmarked insult, 2 after a target.
ADDRESS: Transducer = {
    **{(s, "insult"): (1, "insult", "plain") for s in (0, 1)},
    (2, "insult"): (2, "insult", "target"),
    (0, "target"): (2, "target", None),
    (1, "target"): (2, "address", "target"),
}
#: States: words that a target may still take, 1 to 3 after a verb of harm, 4 to 6 after a reported one.
THREAT: Transducer = {
    **{(s, "harm"): (3, "harm", None) for s in range(7)},
    **{(s, "harm:"): (6, "harm:", None) for s in range(7)},
    **{(s, "quote"): (s, "quote", None) for s in range(7)},
    **{(s, "*"): (0 if s == 4 else s - 1, "*", None) for s in range(1, 7)},
    **{(s, x): (0, "threat", "threat") for s in (1, 2, 3) for x in ("target", "address")},
    **{(s, x): (0, "threat", "reported threat") for s in (4, 5, 6) for x in ("target", "address")},
}
CASCADE = {"negation": NEGATION, "report": REPORT, "address": ADDRESS, "threat": THREAT}
SYMBOLS = ("word", "insult", "harm", "target", "not", "say", "quote")
#: Last rewritings that are matches.
MATCHES = ("insult", "insult-", "insult:", "address", "threat")


def arc(t: Transducer, state: int, symbol: str) -> tuple[int, str, str | None]:
    if (state, symbol) in t:
        return t[state, symbol]
    return t.get((state, "*"), (state, "*", None))[0], symbol, None


def compose(cascade: list[Transducer]) -> list[dict[str, tuple[int, str, tuple[str, ...]]]]:
    """One machine: by state and symbol the next state, the last rewriting, and the names of the weights on the way."""
    states, machine = {(0,) * len(cascade): 0}, []
    todo = list(states)
    for state in todo:
        arcs = {}
        for symbol in SYMBOLS:
            x, then, weights = symbol, [], []
            for t, s in zip(cascade, state, strict=True):
                s, x, w = arc(t, s, x)
                then.append(s)
                if w:
                    weights.append(w)
            if tuple(then) not in states:
                states[tuple(then)] = len(states)
                todo.append(tuple(then))
            arcs[symbol] = states[tuple(then)], x, tuple(weights)
        machine.append(arcs)
    return machine


_MARKS = compose([NEGATION, REPORT])


def asserted(text: str) -> list[str]:
    """The words of a lowered text that neither negation nor report marks."""
    words = _WORD.findall(text)
    if _SHIFTS.isdisjoint(words) and not any(q in text for q in _QUOTES):
        return words
    out, state = [], 0
    for piece in _PIECE.findall(text):
        if piece in _QUOTES:
            state = _MARKS[state]["quote"][0]
        elif piece in ".!?;\n":
            state = 0
        else:
            state, symbol, _ = _MARKS[state][CLOSED.get(piece, "insult") if piece in _SHIFTS else "insult"]
            if symbol != "insult-" and symbol != "insult:":
                out.append(piece)
    return out


def stems_of(text: str) -> set[str]:
    """Words as ``word$``, word beginnings as ``beg``, and beginnings that several words share as ``beg#n``."""
    words = Counter(asserted(text.lower()))
    out, begins = set(), Counter()
    for w, n in words.items():
        out.add(w + "$")
        for k in STEM_LENGTHS:
            if k <= len(w):
                begins[w[:k]] += n
    for s, n in begins.items():
        out.add(s)
        if n >= REPEATS[0] and len(s) > 3:
            out.update(f"{s}#{r}" for r in REPEATS if n >= r)
    return out


def bare(stem: str) -> str:
    """The letters of a stem."""
    return stem.partition("#")[0].removesuffix("$")


def choose_stems(toxic: list[str], clean: list[str]) -> dict[str, tuple[int, int]]:
    """stem -> (toxic documents, clean documents) with it, chosen greedily.

    Stems are counted before any are kept, so only those frequent enough take memory by document.
    """
    least = max(LEAST_DOCS, round(LEAST_SHARE * len(toxic)))
    seen: Counter[str] = Counter()
    for text in toxic:
        seen.update(stems_of(text))
    owners: dict[str, list[int]] = {s: [] for s, n in seen.items() if n >= least}
    del seen
    for i, text in enumerate(toxic):
        for s in stems_of(text):
            if s in owners:
                owners[s].append(i)
    against: Counter[str] = Counter()
    for text in clean:
        against.update(stems_of(text) & owners.keys())
    share = max(len(clean), 1) / max(len(toxic), 1)
    owners = {s: v for s, v in owners.items() if len(v) * share / (against[s] + 0.5) >= LEAST_RATIO}
    of_doc: dict[int, list[str]] = defaultdict(list)
    for s, v in owners.items():
        for i in v:
            of_doc[i].append(s)
    open_docs, chosen = set(range(len(toxic))), {}
    gain = {s: len(v) for s, v in owners.items()}
    while gain and len(chosen) < MAX_STEMS:
        # Of equal gain: fewer clean documents, then the longer beginning.
        best = max(gain, key=lambda s: (gain[s] - CLEAN_COST * against[s], -against[s], "#" not in s, not s.endswith("$"), len(s), s))
        if gain[best] - CLEAN_COST * against[best] < max(2, least - 1):
            break
        chosen[best] = (len(owners[best]), against[best])
        done = open_docs.intersection(owners[best])
        open_docs -= done
        for s in {s for i in done for s in of_doc[i]} & gain.keys():
            gain[s] = sum(i in open_docs for i in owners[s])
        gain = {s: g for s, g in gain.items() if g > 0 and s != best}
    # Words that mostly stand beside others explain few documents alone; frequent ones count all the same.
    for s in sorted(owners, key=lambda s: (-len(owners[s]), "#" in s, s.endswith("$"), -len(s), s)):
        if len(owners[s]) >= max(5, FREQUENT * len(toxic)) and not against[s] and len(chosen) < MAX_STEMS:
            if not any(bare(c).startswith(bare(s)) or bare(s).startswith(bare(c)) for c in chosen):
                chosen[s] = (len(owners[s]), 0)
    return chosen


def without_copies(texts: list[str]) -> list[str]:
    """The texts that share less than half of their sampled shingles with those kept before."""
    seen: set[int] = set()
    kept = []
    for text, tokens in zip(texts, shingle_sets(texts), strict=True):
        some = set(tokens[tokens % 4 == 0].tolist()) or set(tokens.tolist())
        if 2 * len(some & seen) < len(some):
            kept.append(text)
            seen |= some
    return kept


class Grammar:
    """The composed machine over words. ``stems`` maps a stem to its weight, ``contexts`` the arcs' names to theirs.

    ``without`` names transducers to leave out of the cascade.
    """

    def __init__(self, stems: dict[str, float], contexts: dict[str, float], without: tuple[str, ...] = ()):
        import ahocorasick

        weights = contexts | {"threat": THREAT_WEIGHT, "reported threat": THREAT_WEIGHT * contexts["reported"]}
        self.machine = [
            {x: (then, last if last in MATCHES else None, names, math.prod(weights[n] for n in names)) for x, (then, last, names) in arcs.items()}
            for arcs in compose([t for name, t in CASCADE.items() if name not in without])
        ]
        self.words = {s[:-1]: w for s, w in stems.items() if s.endswith("$")}
        self.begins = {s: w for s, w in stems.items() if s[-1] != "$" and "#" not in s}
        self.repeats: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for s, w in stems.items():
            if "#" in s:
                self.repeats[bare(s)].append((int(s.partition("#")[2]), w))
        self.lengths = sorted({len(s) for s in (*self.begins, *self.repeats)})
        self.find = ahocorasick.Automaton()
        for s in {*map(bare, stems), *THREATS}:
            self.find.add_word(s, s)
        self.find.make_automaton()

    def weight(self, word: str, often: dict[str, float]) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word):
                best = max(best, self.begins.get(word[:n], 0.0), often.get(word[:n], 0.0))
        return best

    def symbol(self, word: str, often: dict[str, float]) -> tuple[str, float]:
        """A word's symbol and the weight of its stem; targets, negations and verbs of saying are no insults."""
        kind = CLOSED.get(word, "word")
        if kind in ("word", "harm"):
            w = self.weight(word, often)
            if w:
                return "insult", w
        return kind, 0.0

    def matches(self, clause: str, often: dict[str, float]) -> Iterator[tuple[tuple[str, ...], float]]:
        """Names and weight of each match of a lowered clause; ``often`` has the beginnings that its document repeats."""
        state, last = 0, 0.0
        for piece in _PIECE.findall(clause):
            x, w = ("quote", 0.0) if piece in _QUOTES else self.symbol(piece, often)
            state, match, names, along = self.machine[state][x]
            last = w or last
            if match:
                # An address weighs what the insult before it weighs.
                yield names, (1.0 if match == "threat" else last) * along

    def scan(self, text: str) -> Iterator[tuple[tuple[str, ...], float]]:
        """Names and weight of every match: one pass of the automaton finds the clauses that can hold one."""
        text = text.lower()
        hits = [(e - len(s) + 1, s) for e, s in self.find.iter(text) if e < len(s) or not text[e - len(s)].isalpha()]
        if not hits:
            return
        counts = Counter(s for _, s in hits)
        often = {s: max(ws) for s, rs in self.repeats.items() if (ws := [w for r, w in rs if counts[s] >= r])}
        done = -1
        for start, s in sorted(hits):
            if start <= done or (s in self.repeats and s not in often and s not in self.begins and s not in self.words and s not in CLOSED):
                continue
            a = max(text.rfind(c, 0, start) for c in ".!?;\n") + 1
            stop = _STOP.search(text, start + len(s))
            done = stop.start() if stop else len(text)
            yield from self.matches(text[a:done], often)

    def score(self, text: str | None) -> float:
        miss = 1.0 - LEAST_SCORE
        for _, w in self.scan(text or ""):
            miss *= 1.0 - w
        return 1.0 - miss


def learn_from(rows: list[tuple[int, str]]) -> tuple[dict[str, float], dict[str, float]]:
    """Stem and context weights from (label, text) rows."""
    toxic, clean = [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]
    chosen = choose_stems(without_copies(toxic), clean)
    stems = {s: (t + 1e-9) / (t + c + 0.1) for s, (t, c) in chosen.items()}
    seen = {c: [PRIOR_COUNT * PRIOR[c], PRIOR_COUNT] for c in PRIOR}
    every = Grammar(stems, dict.fromkeys(PRIOR, 1.0))
    for y, t in rows:
        # Documents of one context tell about it; those of several tell nothing apart.
        contexts = {n for n, _ in every.scan(t)}
        if len(contexts) == 1 and len(one := contexts.pop()) == 1 and one[0] in seen:
            s = seen[one[0]]
            s[0] += y
            s[1] += 1
    if seen["plain"][0] * seen["target"][1] > seen["target"][0] * seen["plain"][1]:
        # With a target an insult weighs no less than without: where shares say so, both take the share of all.
        seen["plain"] = seen["target"] = [a + b for a, b in zip(seen["plain"], seen["target"], strict=True)]
    return stems, {c: a / n for c, (a, n) in seen.items()}


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(y, t or "") for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(learn_from(rows))])], names=["grammar"])


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], dict[str, float]]:
    """Weights from the bounded sample of labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(fold("doc_id") != 1)
    first = lambda y, n: usable.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, SAMPLE_TOXIC).union(first(0, SAMPLE_CLEAN))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # One task: the sample is bounded.
    got = texts.select("label", "text").repartition(1).mapInArrow(_learned, "grammar string").collect()
    stems, contexts = json.loads(got[0]["grammar"]) if got else ({}, dict(PRIOR))
    return stems, contexts


def _scored(stems: dict[str, float], contexts: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems, contexts)
        for batch in batches:
            found = [grammar.score(t) for _, texts in text_chunks(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, weights: tuple[dict[str, float], dict[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scored(*weights), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: tuple[dict[str, float], dict[str, float]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``REJECT_AT``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*weights)
        for batch in batches:
            kept = [grammar.score(t) < REJECT_AT for _, texts in text_chunks(batch.column(at)) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
