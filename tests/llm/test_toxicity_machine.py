"""The composed machine against its cascade run one transducer after the other, and what each transducer decides."""

import random
import re
import zlib

import pytest

from kelpie.llm import toxicity as T

STEMS = {"grobbel": 0.99, "snark$": 0.97, "frump": 0.9}
WEIGHTS = {"plain": 0.5, "target": 0.98, "negated": 0.2, "reported": 0.3}


def plain_score(text, stems, weights, without=()):
    """Clause by clause: every transducer rewrites the whole line of symbols before the next one reads it."""
    arcs = weights | {"threat": T.THREAT_WEIGHT, "reported threat": T.THREAT_WEIGHT * weights["reported"]}
    miss = 1 - T.LEAST_SCORE
    for clause in re.split(r"[.!?;\n]", text.lower()):
        line = []
        for piece in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“„«]", clause):
            kind = "quote" if piece in '"“„«' else T.CLOSED.get(piece, "word")
            stem = max([w for s, w in stems.items() if (piece == s[:-1] if s[-1] == "$" else piece.startswith(s))], default=0)
            line.append(["insult" if stem and kind in ("word", "harm") else kind, stem, 1.0])
        for name, t in T.CASCADE.items():
            if name in without:
                continue
            state = 0
            for cell in line:
                state, cell[0], w = T.arc(t, state, cell[0])
                cell[2] *= arcs[w] if w else 1.0
        last = 0
        for x, stem, along in line:
            last = stem if x.startswith("insult") else last
            if x in T.MATCHES:
                miss *= 1 - (1.0 if x == "threat" else last) * along
    return 1 - miss


def test_composition_equals_the_cascade():
    rng = random.Random(11)
    pool = ["you", "they", "kill", "not", "said", '"', "grobbels", "snark", "frumpy", "the", "of", "tree", ".", "\n", "never", "hurt", "«", "people", "didn't"]
    for without in ((), ("negation",), ("report",), ("address",), ("threat",)):
        g = T.Grammar(STEMS, WEIGHTS, without)
        for _ in range(400):
            text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
            assert g.score(text) == pytest.approx(plain_score(text, STEMS, WEIGHTS, without)), text


def test_order_of_contexts():
    s = T.Grammar(STEMS, WEIGHTS).score
    assert s("you grobbel") > 0.9 > s("a grobbel") > s("she said grobbel") > s("you are no grobbel") > s("nothing here")
    assert s("grobbel, all of you") > s("a grobbel") and s("he said: I will kill you") < 0.7 < s("I will kill you")
    assert s("I will not hurt you") < 0.05 and s("they said she is no grobbel") < s("no grobbel")


def labelled():
    """Texts whose label depends on what stands around the insult."""
    rng = random.Random(4)
    fill = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    made = {"target": ("you are a {}", 1), "target after": ("{} is what you are", 1), "plain": ("a {} for sale", 0), "negated": ("you are not {} at all", 0), "reported": ("the paper wrote you are {}", 0), "none": ("", 0)}
    share = {"target": 400, "target after": 100, "plain": 12, "negated": 150, "reported": 150, "none": 1200}
    rows = []
    for kind, n in share.items():
        for _ in range(n):
            phrase, toxic = made[kind]
            lines = [" ".join(rng.sample(fill, 8)) for _ in range(4)]
            if kind == "none":  # the same phrases around other words
                phrase = made[rng.choice(["target", "target after", "plain", "negated", "reported"])][0]
            lines[rng.randrange(4)] = phrase.format(rng.choice(fill if kind == "none" else ["grobbel", "snarkit", "frumpto"]))
            rows.append((kind, ". ".join(lines), toxic))
    rng.shuffle(rows)
    return rows


def test_every_transducer_decides_held_out_rows():
    rows = labelled()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(rows))]
    stems, weights = T.learn_from([(y, t) for (_, t, y), h in zip(rows, held) if not h])
    assert {T.bare(s)[:5] for s in stems} == {"grobb", "snark", "frump"}
    assert weights["plain"] < weights["target"] and max(weights["negated"], weights["reported"]) < 0.2

    def found(*without):
        g = T.Grammar(stems, weights, without)
        return [g.score(t) >= T.REJECT_AT for (_, t, _), h in zip(rows, held) if h]

    truth = [bool(y) for (_, _, y), h in zip(rows, held) if h]
    assert found() == truth
    kinds = [k for (k, _, _), h in zip(rows, held) if h]
    for name, kind in (("negation", "negated"), ("report", "reported"), ("address", "plain")):
        wrong = {k for k, a, b in zip(kinds, found(name), truth) if a != b}
        assert wrong == {kind}, name


def test_a_target_never_lowers_an_insult():
    rows = [(1, f"x{i} grobbel") for i in range(50)] + [(1, f"you{i} you grobbel") for i in range(3)] + [(0, "you grobbel tree")] * 2 + [(0, f"tree{i} y") for i in range(100)]
    _, weights = T.learn_from(rows)
    assert weights["target"] >= weights["plain"]


def test_ties_and_repeats_are_scored_alike(spark):
    df = spark.createDataFrame([(1, "you grobbel"), (1, "you grobbel"), (2, "you grobbel"), (None, "you grobbel"), (3, None), (4, "x " * 200_000 + "you grobbel")], "doc_id bigint, text string")
    got = {(r.doc_id, round(r.score, 9)) for r in T.scores(df, (STEMS, WEIGHTS)).collect()}
    high, low = round(T.Grammar(STEMS, WEIGHTS).score("you grobbel"), 9), round(T.LEAST_SCORE, 9)
    assert got == {(1, high), (2, high), (None, high), (3, low), (4, high)}
