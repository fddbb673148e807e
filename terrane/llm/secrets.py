"""Secret scan: fixed patterns plus a randomness test battery over opaque tokens.

Base spans come from three patterns. Every further run of token characters is read in the smallest encoding
that holds it, and tested for chi-squared uniformity over that alphabet, for runs about the middle and for serial
correlation. A token counts as random if none of the three rejects randomness and if text would hardly make it: its
likelihood by the letter pairs, digits and changes of case of text and identifiers (counted over the standard library's names and
documentation and over the words of all documents), over its likelihood in its encoding,
bounds the p-value of text (Markov's inequality, shared by the encodings to choose from). These p-values go through a false-discovery control (Benjamini-Hochberg) within
length classes over the whole corpus, on a histogram of p-values, so nothing unbounded is gathered.

All of it is DataFrame code. Defined cases: a null or empty text has no span; repeated rows get equal rows;
extra columns are ignored; an empty table gives an empty result. Positions are code points, end exclusive.
"""

from __future__ import annotations

import functools
import importlib
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, whole_text

#: Fixed patterns and lengths of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 8

#: Shorter tokens hold too few characters for the tests; digits alone, up to the length of numbers that people write, are never taken for secrets.
MIN_TOKEN, LONGEST_NUMBER = 16, 23
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet up: name, pattern of the token without padding, alphabet in code order.
ENCODINGS = [
    ("decimal", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+", DIGITS + "abcdef"),
    ("hex_upper", "[0-9A-F]+", DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", LOWER),
    ("upper", "[A-Z]+", LOWER.upper()),
    ("base32", "[A-Z2-7]+", LOWER.upper() + "234567"),
    ("base36", "[a-z0-9]+", DIGITS + LOWER),
    ("base36_upper", "[A-Z0-9]+", DIGITS + LOWER.upper()),
    ("alnum", "[A-Za-z0-9]+", LOWER.upper() + LOWER + DIGITS),
    ("base64", "[A-Za-z0-9+/]+", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", LOWER.upper() + LOWER + DIGITS + "-_"),
    ("mixed", ".+", LOWER.upper() + LOWER + DIGITS + "+/-_="),
]
#: Characters that the likelihood of text tells apart: letters in lower case, one digit for all, signs.
TEXT_ABC = LOWER + "0+/-_="
#: Modules of the standard library whose names and documentation stand for text and identifiers.
TEXT_MODULES = (
    "argparse ast asyncio base64 bisect calendar codecs collections concurrent.futures configparser contextlib csv ctypes dataclasses datetime decimal difflib email enum fractions ftplib "
    "functools gettext glob hashlib heapq html http.client http.server imaplib inspect io ipaddress itertools json locale logging logging.handlers mailbox math multiprocessing "
    "numbers operator optparse os pathlib pickle platform plistlib pprint queue random re sched secrets selectors shelve shlex shutil smtplib socket socketserver sqlite3 ssl statistics "
    "string subprocess sys tarfile tempfile textwrap threading time timeit tokenize traceback types typing unittest unittest.mock urllib.parse urllib.request uuid warnings wave "
    "weakref xml.dom.minidom xml.etree.ElementTree xmlrpc.client zipfile"
).split()
#: Share of a-f among the letters of running text.
TEXT_HEX = 0.26
#: Level of each battery test (shared by three), false-discovery rate, upper ends of the length classes.
ALPHA, FDR, LENGTH_ENDS = 0.003, 0.01, (19, 24, 32, 48, 64, 128)
#: p-values are binned by this many steps for each power of ten, down to 1e-30.
STEPS, LEAST_POWER = 20, 30


#: Matches whose positions one fold adds up; a longer list is cut into blocks of as many, so that its cost stays in proportion to it.
BLOCK = 256


def _blocks(rows: Column) -> Column:
    """Numbers of the blocks of an array, at least one."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(rows) / BLOCK).cast("int") - 1, F.lit(0)))


def _block(rows: Column, b: Column) -> Column:
    return F.slice(rows, b * BLOCK + 1, F.lit(BLOCK))


def spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, v>>; ``v`` is the match or one of its groups.

    The text splits at the matches, so lengths of gaps and matches add up to positions in code points: first over blocks, then within each.
    """
    gaps, found, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))

    def placed(rows: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["g"])
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

        return F.aggregate(rows, start, step, lambda acc: acc["out"])

    def starts(rows: Column) -> Column:
        """Where each block starts, and the end of the last."""
        lengths = F.transform(_blocks(rows), lambda b: F.aggregate(_block(rows, b), F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"])))
        return F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def by_block(rows: Column) -> Column:
        return let(starts(rows), lambda at: F.flatten(F.transform(_blocks(rows), lambda b: placed(_block(rows, b), F.get(at, b)))))

    return let(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), value.alias("v")), by_block)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps. Tokens lie in order, so each block of them meets only the spans within its reach."""
    over = lambda b, s, e: (b["s"] < e) & (s < b["e"])

    def within(block: Column) -> Column:
        reach = F.filter(base, lambda b: over(b, F.get(block, F.lit(0))["s"], F.element_at(block, -1)["e"]))
        return let(reach, lambda near: F.filter(block, lambda t: ~F.exists(near, lambda b: over(b, t["s"], t["e"]))))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(F.flatten(F.transform(_blocks(tokens), lambda n: let(_block(tokens, n), within))))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,v:string>>")


def _phi(z: Column) -> Column:
    """Normal distribution function (logistic form, monotone in both tails)."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.070565992 * z * z * z))


def _said() -> Iterator[str]:
    """Names of the modules' members and of the members of their classes, and the words of their documentation."""
    for module in TEXT_MODULES:
        found = vars(importlib.import_module(module))
        inner = [(f"{a}.{b}", y) for a, x in found.items() if isinstance(x, type) for b, y in vars(x).items()]
        for name, value in sorted([*found.items(), *inner], key=lambda x: x[0]):
            yield name.rsplit(".", 1)[-1].strip("_")
            told = getattr(value, "__doc__", None) if callable(value) else None
            yield from re.findall(r"[A-Za-z0-9+/_=-]+", told) if isinstance(told, str) else ()


@functools.lru_cache(1)
def _library() -> tuple[dict[str, int], list[float]]:
    """(counts of pairs, costs of cases) over the distinct words and names of the library."""
    words, pairs, cases = sorted(set(_said())), Counter(), [[0.0, 0.5, 0.5] for _ in range(3)]
    for word in words:
        low = re.sub("[0-9]", "0", word.lower())
        pairs.update(a + b for a, b in zip(low, low[1:]))
        before = 0
        for kind in (0 if not c.isalpha() else 1 if c.islower() else 2 for c in word):
            cases[before][kind] += kind > 0
            before = kind
    return dict(pairs), [-math.log(n / sum(row)) if n else 0.0 for row in cases for n in row]


def corpus_pairs(docs: DataFrame) -> dict[str, int]:
    """Counts of pairs over the distinct words of all documents: at most 27 * 27 numbers.

    Words are shorter than tokens, so what is judged by the model takes no part in it.
    """
    said = docs.select(F.explode(F.split(F.lower(whole_text()), "[^a-z0-9]+")).alias("w"))
    words = said.filter(F.length("w").between(2, MIN_TOKEN - 1)).distinct()
    low = words.select(F.translate("w", DIGITS, "0" * 10).alias("w"))
    pairs = low.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    return {r.p: r.n for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}


def text_model(more: dict[str, int] | None = None) -> tuple[list[float], list[float]]:
    """Costs (negative logarithms) of each character of ``TEXT_ABC`` after each, in rows, and of no letter, a lower and an upper one after each of the three.

    Pairs of the library's names and words, and ``more`` of the corpus; distinct words count, so that common ones don't drown the rest, and half a count is added to each pair.
    """
    known, cases = _library()
    rows = [[0.5 + known.get(a + b, 0) + (more or {}).get(a + b, 0) for b in TEXT_ABC] for a in TEXT_ABC]
    return [-math.log(n / sum(row)) for row in rows for n in row], cases


def _text_cost(t: Column, model: tuple[list[float], list[float]]) -> Column:
    """Negative logarithm of the likelihood of a token as text."""
    pairs, cases = map(F.lit, model)
    at = F.transform(F.split(F.translate(F.lower(t), DIGITS, "0" * 10), ""), lambda c: F.instr(F.lit(TEXT_ABC), c) - 1)
    state = F.transform(F.split(F.translate(t, DIGITS + "+/-_=" + LOWER + LOWER.upper(), "0" * 15 + "1" * 26 + "2" * 26), ""), lambda c: c.cast("int"))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, c: a + c)
    following = let(at, lambda s: add(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: pairs[a * len(TEXT_ABC) + b])))
    case = let(state, lambda s: add(F.zip_with(F.concat(F.array(F.lit(0)), F.slice(s, F.lit(1), F.size(s) - 1)), s, lambda a, b: cases[a * 3 + b])))
    digits = F.length(t) - F.length(F.translate(t, DIGITS, ""))
    return math.log(len(TEXT_ABC)) + following + case + digits * math.log(10)


def battery(token: Column, model: tuple[list[float], list[float]] | None = None) -> Column:
    """struct<encoding, p_uniform, p_runs, p_serial, p_text, n> of one token (padding is left out)."""
    core, model = F.rtrim(token, F.lit("=")), model or text_model()

    def chosen(t: Column) -> Column:
        kind = functools.reduce(lambda w, x: w.when(t.rlike(f"^{x[1]}$"), F.struct(F.lit(x[0]).alias("name"), F.lit(x[2]).alias("abc"))), ENCODINGS[1:], F.when(t.rlike(f"^{ENCODINGS[0][1]}$"), F.struct(F.lit(ENCODINGS[0][0]).alias("name"), F.lit(ENCODINGS[0][2]).alias("abc"))))
        return let(F.struct(t.alias("t"), kind.alias("k")), lambda x: tested(x["t"], x["k"]["name"], x["k"]["abc"]))

    def tested(t: Column, name: Column, abc: Column) -> Column:
        n, k = F.length(t).cast("double"), F.length(abc).cast("double")
        squares = F.aggregate(F.split(abc, ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0)))
        codes = F.transform(F.split(t, ""), lambda c: F.instr(abc, c).cast("double") - 1)
        return let(F.struct(n.alias("n"), k.alias("k"), squares.alias("q"), codes.alias("v"), name.alias("name"), _text_cost(t, model).alias("cost")), measured)

    def measured(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        mean = F.aggregate(v, F.lit(0.0), lambda a, c: a + c) / n
        high = F.size(F.filter(v, lambda c: c >= k / 2)).cast("double")
        turns = F.size(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (v[i] >= k / 2) != (v[i - 1] >= k / 2))).cast("double")
        return let(F.struct(n.alias("n"), k.alias("k"), x["q"].alias("q"), v.alias("v"), mean.alias("mean"), high.alias("high"), turns.alias("turns"), x["name"].alias("name"), x["cost"].alias("cost")), judged)

    def judged(x: Column) -> Column:
        n, k, v, mean, high = x["n"], x["k"], x["v"], x["mean"], x["high"]
        chi = k * x["q"] / n - n
        uniform = 1 - _phi((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        low = n - high
        runs_mean = 1 + 2 * high * low / n
        runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(1e-9))
        runs = F.when((high == 0) | (low == 0), F.lit(0.0)).otherwise(2 * (1 - _phi(F.abs(x["turns"] + 1 - runs_mean) / F.sqrt(runs_var))))
        around = F.transform(v, lambda c: c - mean)
        total = F.aggregate(around, F.lit(0.0), lambda a, c: a + c * c)
        lagged = F.aggregate(F.zip_with(F.slice(around, F.lit(1), F.size(v) - 1), F.slice(around, F.lit(2), F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
        serial = F.when(total <= 0, F.lit(0.0)).otherwise(2 * (1 - _phi(F.abs(lagged / total + 1 / n) * F.sqrt(n))))
        # Running text hardly stays within a-f for long.
        likely = F.exp(F.least(F.lit(0.0), math.log(len(ENCODINGS)) + n * F.ln(k) - x["cost"]))
        text = F.when((x["name"] == "decimal") & (n <= LONGEST_NUMBER), F.lit(1.0)).when(x["name"].isin("hex", "hex_upper"), F.pow(F.lit(TEXT_HEX), n)).otherwise(likely)
        return F.struct(x["name"].alias("encoding"), uniform.alias("p_uniform"), runs.alias("p_runs"), serial.alias("p_serial"), text.alias("p_text"), n.cast("int").alias("n"))

    return let(core, chosen)


def _length_class(n: Column) -> Column:
    return functools.reduce(operator.add, [(n > end).cast("int") for end in LENGTH_ENDS])


def _bin(p: Column) -> Column:
    """Bins from the least p-value up, rounded so that a bin never understates its p-values."""
    power = F.greatest(F.lit(-float(LEAST_POWER)), F.log10(F.greatest(p, F.lit(1e-300))))
    return F.ceil((power + LEAST_POWER) * STEPS).cast("int")


def scan(docs: DataFrame, id_col: str = "doc_id", model: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Base spans of each document, and its other tokens with the figures of the battery."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col), whole_text().alias("_text"))
    assign = F.when(text.rlike(ASSIGN_GATE), F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= MIN_VALUE)).otherwise(_none())
    found = rows.select(
        id_col,
        assign.alias("assign"),
        F.when(text.rlike(ACCESS), spans(text, ACCESS)).otherwise(_none()).alias("access"),
        F.when(text.rlike(HEX), spans(text, HEX)).otherwise(_none()).alias("hex"),
        F.when(text.rlike(TOKEN), spans(text, TOKEN)).otherwise(_none()).alias("_tokens"),
    )
    kind = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
    base = F.concat(*[F.transform(F.col(k), kind(i)) for i, k in enumerate(KINDS[:3])])
    free = _apart(F.col("_tokens"), F.col("base"))
    rows = found.select(id_col, F.array_sort(base).alias("base"), "_tokens")
    return rows.select(id_col, "base", F.transform(free, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["v"], model).alias("b"))).alias("tokens"))


def _passes(b: Column) -> Column:
    """No test of the battery rejects randomness."""
    return F.least(b["p_uniform"], b["p_runs"], b["p_serial"]) * 3 >= ALPHA


def cutoffs(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per length class the last bin that the step-up rule accepts: at most ``len(LENGTH_ENDS) + 1`` numbers."""
    tokens = scanned.select(F.explode("tokens").alias("t"))
    b = F.col("t.b")
    counts = tokens.groupBy(_length_class(b["n"]).alias("c"), F.when(_passes(b), _bin(b["p_text"])).alias("bin")).agg(F.count("*").alias("n"))
    last: dict[int, int] = {}
    rows = sorted(((r.c, r.bin, r.n) for r in counts.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0))
    total: dict[int, int] = {}
    for c, _, n in rows:
        total[c] = total.get(c, 0) + n
    seen: dict[int, int] = {}
    for c, at, n in rows:
        if at is not None:
            seen[c] = seen.get(c, 0) + n
            if 10 ** (at / STEPS - LEAST_POWER) * total[c] <= fdr * seen[c]:
                last[c] = at
    return last


def secrets(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: base spans and all spans, as arrays of struct<s, k, e> where ``k`` counts ``KINDS``."""
    scanned = cut(scan(docs, id_col, text_model(corpus_pairs(docs))), "secrets")
    last = cutoffs(scanned, fdr)

    def random(t: Column) -> Column:
        limit = functools.reduce(lambda a, c: F.when(_length_class(t["b"]["n"]) == c, F.lit(last[c])).otherwise(a), last, F.lit(-1))
        return _passes(t["b"]) & (_bin(t["b"]["p_text"]) <= limit)

    extra = F.transform(F.filter("tokens", random), lambda t: F.struct(t["s"].alias("s"), F.lit(3).alias("k"), t["e"].alias("e")))
    return scanned.select(id_col, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def joined(rows: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of the result of ``secrets``."""
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
