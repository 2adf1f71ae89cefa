"""Tokenisation and other text expressions. Everything here but ``porter`` is a column expression."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that candidate queries leave out.
STOP = (
    "a an the is are was were be been being do does did have has had "
    "what when where which who whom whose how why would could should "
    "can will may might must to of for from in on at by with about "
    "and or as than that this these those it its their they them he "
    "she his her i me my we our you your not no"
).split()
# Latin compounds joined by - _ . / and runs of CJK ideographs.
TERM = r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*|[㐀-鿿]+"
CJK_RUN = r"^[㐀-鿿]+$"
WORD = r"[\p{L}\p{N}\p{Co}]+"
COMPOUND = r"\b[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)+\b"


def _pieces(run: Column) -> Column:
    pairs = F.when(F.char_length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))
    return F.when(run.rlike(CJK_RUN), pairs).otherwise(F.array(F.lower(run)))


def terms(text: Column) -> Column:
    """Query terms in order of first occurrence: lowered compounds, and bigrams of CJK runs."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), _pieces)))


def terms_of(text: str) -> set[str]:
    """``terms`` of one text in Python."""
    out = set()
    for run in re.findall(TERM, text):
        if re.fullmatch(CJK_RUN, run):
            out |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
        else:
            out.add(run.lower())
    return out


def content_terms(text: Column) -> Column:
    return F.array_except(terms(text), F.array(*map(F.lit, STOP)))


def cjk_terms(text: Column) -> Column:
    return F.filter(terms(text), lambda t: t.rlike(CJK_RUN))


def index_text(text: Column) -> Column:
    """The text and, after a space, its distinct CJK bigrams."""
    return F.concat(text, F.lit(" "), F.array_join(cjk_terms(text), " "))


def _folds() -> tuple[str, str]:
    """Accented letters and the letters they are built on, by Unicode's own decompositions."""
    old, new = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and unicodedata.combining(base[1]) and base[0].isascii():
            old.append(chr(code))
            new.append(base[0].lower())
    return "".join(old), "".join(new)


_OLD, _NEW = _folds()


def word_tokens(text: Column) -> Column:
    """All tokens in order: runs of letters and digits, lowered, accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _OLD, _NEW), F.lit(WORD), F.lit(0))


def contains_word(text: Column, term: Column) -> Column:
    """Whole-word, case-insensitive containment of a literal term."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.regexp_replace(term, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?!\w)")))


def word_places(text: Column, term: Column) -> Column:
    """(start, end) of every place where ``contains_word`` finds the term, from 1 and end exclusive; places do not overlap."""
    # \G: each match starts where the last one ended, so the text is read once.
    pattern = F.concat(F.lit(r"(?isU)\G(.*?)((?<!\w)\Q"), F.regexp_replace(term, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?!\w))"))
    found = F.arrays_zip(*(F.transform(F.regexp_extract_all(text, pattern, F.lit(k)), F.char_length).alias(n) for k, n in ((1, "before"), (2, "length"))))

    def step(acc, x):
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(1)) + x["before"]
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + x["length"]).alias("end"))))

    return F.aggregate(found, F.array().cast("array<struct<start:int,end:int>>"), step)


def visible_text(text: Column) -> Column:
    """``text`` without fenced blocks (closed or not) and quoted lines."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))

    def step(acc, line):
        fence = line.rlike(r"^\s*(```|~~~)")
        keep = ~acc["fenced"] & ~fence & ~line.rlike(r"^\s*>")
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n")


def evidence_ids(text: Column) -> Column:
    """A struct: distinct ``D<i>:<j>`` references, sorted, and whether anything else but separators stands there."""
    ref = r"D\d+:\d+"
    rest = F.regexp_replace(text, rf"(?<![\w:-]){ref}(?![\w:-])", "")
    return F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![\w:-])({ref})(?![\w:-])"), F.lit(1)))).alias("ids"),
        (F.trim(F.regexp_replace(rest, r"[\s;,]+", "")) != "").alias("malformed"),
    )


def json_string(value: Column) -> Column:
    """A JSON string with non-ASCII characters as they are."""
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def source_block(doc_id: Column, speaker: Column, date: Column, text: Column) -> Column:
    """The block that packing counts and emits."""
    label = F.concat(F.lit('{"id": '), json_string(doc_id), F.lit(', "speaker": '), json_string(speaker), F.lit(', "date": '), json_string(date), F.lit("}"))
    return F.concat(F.lit("[source "), label, F.lit("]\n"), text)


def exact_f1(answer: Column, gold: Column) -> Column:
    """F1 of the multisets of lowered words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    a, g = words(answer), words(gold)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    shared = F.aggregate(F.array_intersect(a, g), F.lit(0), lambda s, w: s + F.least(count(a, w), count(g, w)))
    return F.when((F.size(a) == 0) & (F.size(g) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(g)))


_VOWELS = "aeiou"


def porter(word: str) -> str:
    """Porter's 1980 stemmer, for lower-case ASCII words of three letters or more; other words stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def cons(w, i):
        return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def measure(w):
        kinds = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return _squeeze(kinds).count("vc")

    def vowel(w):
        return any(not cons(w, i) for i in range(len(w)))

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w):
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in pairs:
            if w.endswith(end):
                if measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def _squeeze(kinds: str) -> str:
    out = kinds[:1]
    for k in kinds[1:]:
        if k != out[-1]:
            out += k
    return out


# The suffix tables of the published algorithm.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
