"""Personal data replaced by format-preserving Feistel pseudonyms, in SQL expressions only.

Every validated value is permuted within its own format by a keyed, balanced or near-balanced Feistel network of eight
rounds whose round function is SHA-256 of the key, the kind, the length, the round and the other half. A permutation has no
collisions, and the same value always gets the same pseudonym, so equal values stay linked across documents without a table
of values and without a shuffle:

* payment cards (Luhn): the digits before the check digit are permuted, the check digit is computed anew;
* IBANs (remainder of 97): the digits of the account part are permuted, the check digits are computed anew;
* telephone numbers: in international form all digits after the country code (one, two or three digits, by the zones of the
  numbering plan), 7 to 12 of them, wherever separators stand; ten-digit North American numbers also without the code,
  with the pseudonym of the same number with it, and area and exchange again from 2 to 9;
* social security numbers: nine digits, walked until the result is a valid number again;
* IPv4 addresses: as two 16-bit halves;
* calendar dates of the years 1900 to 2101, within the strings of their own layout: same separators and order, fields of one
  digit, of two and with a leading zero each stay so, and dates with slashes that can be read month first only, day first
  only, or both ways are three domains; year and fields are the halves, walked until the result is a date again;
* e-mail addresses: letters and digits of the local part in base 36, in pieces of 16; the domain stays;
* keys and tokens of 32 to 64 hexadecimal digits: in pieces of 24; keys with a known prefix, which stays: in base 36 or 62.

A walk takes up to ``WALK`` steps; the least likely domain leaves it open with a chance below 1e-12. Values that look alike
but are not valid (a wrong check digit, 2023-02-30, an octet above 255) stay as they are, and so does all text around values;
other national telephone numbers and other keys are not recognised. Cards, telephone numbers and social security numbers
written with and without separators share their digits' pseudonym.

Edge cases: a null text stays null with no findings; an empty text stays empty; a value that occurs often is replaced at
every place; repeated rows are treated alike; an empty table gives an empty result; other columns stay as they are in
``pseudonymised`` and are not read by ``findings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: An account number ends where its country says, whatever words follow; those of other countries at the next word end.
_KNOWN = "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![0-9A-Za-z])"
# The shapes of the kinds, tried in this order at each place.
SHAPES = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"),
    ("iban", IBAN),
    ("key", r"(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|[sprk]k_(?:live|test)_[0-9A-Za-z]{16,64}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9A-Za-z+(.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
]
KINDS = [k for k, _ in SHAPES]
PATTERN = "|".join(p for _, p in SHAPES)
ROUNDS, WALK = 8, 64
FIRST_YEAR, YEARS = 1900, 202
# Country codes by the zones of the numbering plan (all codes not of one or two digits have three), and a
# North American number.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
AMERICAN = "^[2-9][0-9]{2}[2-9][0-9]{6}$"
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Pseudonyms:
    """Builds the SQL of the permutations for one key. Arguments and results are SQL text over strings."""

    def __init__(self, key: str):
        self.salt = key.encode().hex()
        self.n = 0

    def name(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def feistel(self, a: str, b: str, mod_a: str, mod_b: str, tag: str) -> str:
        """A struct (a, b) permuted; after an even number of rounds each half has its own range again."""
        s, i = self.name(), self.name()
        other = f"concat('{self.salt}|', {tag}, '|', {i}, '|', {s}.b)"
        drawn = f"cast(conv(substr(sha2({other}, 256), 1, 15), 16, 10) AS bigint)"
        step = f"struct({s}.b AS a, ({s}.a + {drawn} % if({i} % 2 = 0, {mod_a}, {mod_b})) % if({i} % 2 = 0, {mod_a}, {mod_b}) AS b)"
        return f"aggregate(sequence(0, {ROUNDS - 1}), struct(cast({a} AS bigint) AS a, cast({b} AS bigint) AS b), ({s}, {i}) -> {step})"

    def symbols(self, text: str, radix: int, kind: str, piece: int) -> str:
        """Digits of a base up to 36 (lower case) or 62 (``LETTERS``), permuted in pieces."""
        t, k, p, h, r = (self.name() for _ in range(5))
        if radix == len(LETTERS):
            s, i = self.name(), self.name()
            power = lambda n: f"element_at(array({', '.join(f'{radix**e}L' for e in range(piece // 2 + 1))}), cast({n} AS int) + 1)"
            number = lambda x: f"aggregate(sequence(1, length({x})), 0L, ({s}, {i}) -> {s} * {radix} + instr('{LETTERS}', substr({x}, {i}, 1)) - 1)"
            back = lambda x, n: f"array_join(transform(sequence(1, {n}), {i} -> substr('{LETTERS}', cast({x} div {power(f'({n} - {i})')} % {radix} AS int) + 1, 1)), '')"
        else:
            number = lambda x: f"cast(conv({x}, {radix}, 10) AS bigint)"
            power = lambda n: number(f"rpad('1', {n} + 1, '0')")
            back = lambda x, n: f"lpad(lower(conv(cast({x} AS string), 10, {radix})), {n}, '0')"
        tag = f"concat('{kind}|', length({t}), '|', {k})"
        halves = self.feistel(number(f"substr({p}, 1, {h})"), number(f"substr({p}, {h} + 1)"), power(h), power(f"(length({p}) - {h})"), tag)
        two = _let(f"length({p}) div 2", h, _let(halves, r, f"concat({back(r + '.a', h)}, {back(r + '.b', f'(length({p}) - {h})')})"))
        shift = f"cast(conv(substr(sha2(concat('{self.salt}|', {tag}), 256), 1, 15), 16, 10) AS bigint)"
        one = back(f"(({number(p)} + {shift}) % {radix})", "1")
        pieces = f"transform(sequence(0, (length({t}) - 1) div {piece}), {k} -> {_let(f'substr({t}, {k} * {piece} + 1, {piece})', p, f'if(length({p}) = 1, {one}, {two})')})"
        return _let(text, t, f"if({t} = '', '', array_join({pieces}, ''))")

    def filled(self, value: str, shape: str, new: str) -> str:
        """``value`` with its characters of the class ``shape`` replaced in order by those of ``new``."""
        d, i = self.name(), self.name()
        here = f"substr({value}, {i}, 1)"
        nth = f"length(regexp_replace(substr({value}, 1, {i}), '[^{shape}]', ''))"
        return _let(new, d, f"array_join(transform(sequence(1, length({value})), {i} -> if({here} rlike '[{shape}]', substr({d}, {nth}, 1), {here})), '')")

    def digits(self, text: str, kind: str) -> str:
        return self.symbols(text, 10, kind, 30)

    def email(self, v: str) -> str:
        x = self.name()
        local = f"substring_index({x}, '@', 1)"
        body = self.filled(local, "0-9a-z", self.symbols(f"regexp_replace({local}, '[^0-9a-z]', '')", 36, "email", 16))
        return _let(f"concat(lower(substring_index({v}, '@', 1)), substr({v}, instr({v}, '@')))", x, f"concat({body}, substr({x}, instr({x}, '@')))")

    def secret(self, v: str) -> str:
        new = self.symbols(f"lower({v})", 16, "secret", 24)
        return f"if({v} = upper({v}), upper({new}), {new})"

    def card(self, v: str) -> str:
        d, p, c = self.name(), self.name(), self.name()
        check = f"element_at(filter(sequence(0, 9), {c} -> luhn_check(concat({p}, {c}))), 1)"
        new = _let(self.digits(f"substr({d}, 1, length({d}) - 1)", "card"), p, f"concat({p}, {check})")
        return _let(f"regexp_replace({v}, '[^0-9]', '')", d, f"if(luhn_check({d}), {self.filled(v, '0-9', new)}, {v})")

    def _mod97(self, text: str) -> str:
        s, c, i, t = (self.name() for _ in range(4))
        step = f"if({c} rlike '[A-Z]', ({s} * 100 + ascii({c}) - 55) % 97, ({s} * 10 + ascii({c}) - 48) % 97)"
        letters = f"transform(sequence(1, length({t})), {i} -> substr({t}, {i}, 1))"
        return _let(text, t, f"aggregate({letters}, 0, ({s}, {c}) -> {step})")

    def iban(self, v: str) -> str:
        t, b = self.name(), self.name()
        new = self.digits(f"regexp_replace(substr({t}, 5), '[^0-9]', '')", "iban")
        body = self.filled(f"substr({t}, 5)", "0-9", new)
        check = f"lpad(98 - {self._mod97(f'''concat({b}, substr({t}, 1, 2), '00')''')}, 2, '0')"
        whole = _let(body, b, f"concat(substr({t}, 1, 2), {check}, {b})")
        valid = f"length({t}) BETWEEN 15 AND 34 AND {self._mod97(f'concat(substr({t}, 5), substr({t}, 1, 4))')} = 1"
        return _let(f"replace({v}, ' ', '')", t, f"if({valid}, {self.filled(v, '0-9A-Z', whole)}, {v})")

    def walk(self, start: str, step, ok) -> str:
        """``step`` applied until ``ok``: a permutation of all values taken to one of those that are ``ok``."""
        s, i, x = self.name(), self.name(), self.name()
        moved = _let(step(f"{s}.at"), x, f"struct({x} AS at, {ok(x)} AS done)")
        return f"aggregate(sequence(1, {WALK}), struct({start} AS at, false AS done), ({s}, {i}) -> if({s}.done, {s}, {moved}), {s} -> {s}.at)"

    def key(self, v: str) -> str:
        n = self.name()
        body = f"substr({v}, {n} + 1)"
        new = f"if({v} LIKE 'A%', upper({self.symbols(f'lower({body})', 36, 'key', 16)}), {self.symbols(body, len(LETTERS), 'key', 20)})"
        return _let(f"CASE WHEN {v} LIKE 'A%' OR {v} LIKE 'g%' THEN 4 ELSE 8 END", n, f"concat(substr({v}, 1, {n}), {new})")

    def phone(self, v: str) -> str:
        d, code, rest = self.name(), self.name(), self.name()
        american = lambda x: f"({x} rlike '{AMERICAN}')"
        home = self.walk(rest, lambda x: self.digits(x, "phone"), lambda x: f"{american(x)} = {american(rest)}")
        new = f"if({code} IN ('', '1') AND length({rest}) = 10, {home}, {self.digits(rest, 'phone')})"
        body = f"if(length({rest}) BETWEEN 7 AND 12, {self.filled(v, '0-9', f'concat({code}, {new})')}, {v})"
        body = _let(f"substr({d}, length({code}) + 1)", rest, body)
        return _let(f"regexp_replace({v}, '[^0-9]', '')", d, _let(f"if({v} LIKE '+%', regexp_extract({d}, '{COUNTRY}', 0), '')", code, body))

    def ip(self, v: str) -> str:
        o, r = self.name(), self.name()
        x = self.name()
        octets = f"transform(split({v}, '[.]'), {x} -> cast({x} AS bigint))"
        halves = self.feistel(f"{o}[0] * 256 + {o}[1]", f"{o}[2] * 256 + {o}[3]", "65536", "65536", "'ip'")
        new = _let(halves, r, f"concat_ws('.', {r}.a div 256, {r}.a % 256, {r}.b div 256, {r}.b % 256)")
        return _let(octets, o, f"if(array_max({o}) < 256, {new}, {v})")

    def ssn(self, v: str) -> str:
        valid = lambda x: rf"({x} rlike r'^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$')"
        d = f"replace({v}, '-', '')"
        return f"if({valid(d)}, {self.filled(v, '0-9', self.walk(d, lambda x: self.digits(x, 'ssn'), valid))}, {v})"

    def date(self, v: str) -> str:
        p, f, q, r = (self.name() for _ in range(4))
        parts = f"split({v}, '[-./]')"
        iso, dotted, slashed = (f"{v} LIKE '%{c}%'" for c in "-./")
        fields = f"if({iso}, struct({p}[0] AS y, {p}[1] AS a, {p}[2] AS b), struct({p}[2] AS y, {p}[0] AS a, {p}[1] AS b))"
        one, two = f"cast({f}.a AS int)", f"cast({f}.b AS int)"
        # Bounds of both fields: by the order of month and day, then by how the fields are written.
        low = lambda x: f"if({slashed} AND {x} > 12, 13, 1)"
        month_first = f"({iso} OR ({slashed} AND {one} <= 12))"
        short = f"(length({f}.a) = 1 OR length({f}.b) = 1)"
        bound = lambda x, lo, hi: (
            f"CASE WHEN length({x}) = 1 THEN struct({lo} AS lo, least(9, {hi}) AS hi) WHEN {short} AND {x} LIKE '0%' THEN struct(1 AS lo, 9 AS hi) "
            f"WHEN {short} THEN struct(greatest(10, {lo}) AS lo, {hi} AS hi) ELSE struct({lo} AS lo, {hi} AS hi) END"
        )
        a_high = f"if({month_first}, 12, 31)"
        b_high = f"CASE WHEN {iso} THEN 31 WHEN {dotted} OR {one} > 12 OR {two} <= 12 THEN 12 ELSE 31 END"
        ra, rb = bound(f"{f}.a", low(one), a_high), bound(f"{f}.b", low(two), b_high)
        shape = f"struct(cast({f}.y AS int) - {FIRST_YEAR} AS y, {month_first} AS mf, if({month_first}, {one}, {two}) AS m, if({month_first}, {two}, {one}) AS d, if({month_first}, {ra}, {rb}) AS rm, if({month_first}, {rb}, {ra}) AS rd)"
        width = f"({q}.rd.hi - {q}.rd.lo + 1)"
        size = f"(({q}.rm.hi - {q}.rm.lo + 1) * {width})"
        # Layouts of one domain share its permutation, so a date keeps its pseudonym among them.
        tag = f"concat('date|', {q}.rm.lo, '|', {q}.rm.hi, '|', {q}.rd.lo, '|', {q}.rd.hi)"
        month, day = lambda x: f"({x}.b div {width} + {q}.rm.lo)", lambda x: f"({x}.b % {width} + {q}.rd.lo)"

        def ok(x: str) -> str:
            y = f"({x}.a + {FIRST_YEAR})"
            leap = f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
            return f"({day(x)} <= 30 + ({month(x)} + {month(x)} div 8) % 2 - if({month(x)} = 2, if({leap}, 1, 2), 0))"

        start = f"struct(cast({q}.y AS bigint) AS a, cast(({q}.m - {q}.rm.lo) * {width} + {q}.d - {q}.rd.lo AS bigint) AS b)"
        walked = self.walk(start, lambda x: self.feistel(f"{x}.a", f"{x}.b", str(YEARS), size, tag), ok)
        year, sep = f"cast({r}.a + {FIRST_YEAR} AS string)", f"regexp_extract({v}, '[-./]', 0)"
        a, b = f"if({q}.mf, {month(r)}, {day(r)})", f"if({q}.mf, {day(r)}, {month(r)})"
        ab = f"lpad(cast({a} AS string), length({f}.a), '0'), {sep}, lpad(cast({b} AS string), length({f}.b), '0')"
        new = _let(walked, r, f"if({iso}, concat({year}, {sep}, {ab}), concat({ab}, {sep}, {year}))")
        inside = f"{q}.y BETWEEN 0 AND {YEARS - 1} AND {q}.m BETWEEN {q}.rm.lo AND {q}.rm.hi AND {q}.d BETWEEN {q}.rd.lo AND {q}.rd.hi"
        s = self.name()
        body = f"if({inside} AND {_let(start, s, ok(s))}, {new}, {v})"
        return _let(parts, p, _let(fields, f, _let(shape, q, body)))

    def value(self, v: str) -> str:
        """A struct (kind, pseudonym) of one match."""
        cases = [
            ("email", f"{v} LIKE '%@%'"), ("phone", f"{v} rlike '^([+(]|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$)'"), ("key", f"{v} rlike '^(A[KS]IA[0-9A-Z]{{16}}$|[a-z]k_|gh._)'"), ("secret", f"{v} rlike '^[0-9a-fA-F]{{32,64}}$'"),
            ("iban", f"{v} rlike '^[A-Z]'"), ("ip", f"{v} rlike r'^[0-9]+[.][0-9]+[.][0-9]+[.]'"),
            ("ssn", f"{v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'"), ("date", f"{v} rlike '^([0-9]{{4}}-[0-9]{{2}}-|[0-9]{{1,2}}[./])'"),
        ]
        kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in cases) + " ELSE 'card' END"
        k = self.name()
        new = f"CASE {k} " + " ".join(f"WHEN '{x}' THEN {getattr(self, x)(v)}" for x in KINDS) + " END"
        return _let(kind, k, f"struct({k} AS kind, {new} AS pseudonym)")


def _marked(docs: DataFrame, key: str, text_col: str, old: str, new: str) -> DataFrame:
    """``docs`` with the matches in order, and the kind and pseudonym of each."""
    found = docs.withColumn(old, F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))
    return found.withColumn(new, F.expr(f"transform(`{old}`, v0 -> {Pseudonyms(key).value('v0')})"))


def _rebuilt(text: Column, old: str, new: str) -> Column:
    parts = F.split(text, PATTERN, -1)
    filled = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(f"{new}.pseudonym"), i), F.lit(""))))
    return F.when(F.size(old) > 0, F.array_join(filled, "")).otherwise(text)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the values in its text replaced; all other columns as they are."""
    old, new = fresh(docs, "old", "new")
    return _marked(docs, key, text_col, old, new).withColumn(text_col, _rebuilt(F.col(text_col), old, new)).select(*[F.col(f"`{c}`") for c in docs.columns])


def findings(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text with pseudonyms, number of values replaced, and (kind, pseudonym) of each."""
    rows = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key, "text", "__old", "__new")
    changed = F.filter(F.zip_with("__old", "__new", lambda o, n: F.struct(n["kind"].alias("kind"), n["pseudonym"].alias("pseudonym"), (o != n["pseudonym"]).alias("changed"))), lambda x: x["changed"])
    values = F.coalesce(F.transform(changed, lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym"))), F.array().cast("array<struct<kind:string,pseudonym:string>>"))
    return rows.select("doc_id", _rebuilt(F.col("text"), "__old", "__new").alias("text"), values.alias("values")).withColumn("n_values", F.size("values"))
