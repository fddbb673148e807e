"""Personal data: fixed patterns, spread by a skip-chain conditional random field within each document.

The patterns give base spans, which always stay. Around them every token that looks like data (it holds a digit or
an @, or equals or resembles a part of a base span) is a node with four entity labels and "none". Neighbouring
nodes share a chain potential. Nodes with an equal form (letters and digits only) hang on one hub per form, and hubs of
similar forms on a further hub, so a form that occurs n times adds n skip edges and never n^2. Loopy
max-free (sum-product) messages are passed for a fixed number of rounds; tokens whose label then differs from "none" with
enough belief become further spans.

Defined cases: a null or empty text has no span; documents without a base span have nothing to spread and no further
spans; repeated rows get equal rows; extra columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # anchored at the start of a run of digits, so that long runs stay linear
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]\.[0-9]")
#: A token of the field: a run without white space, trimmed of outer punctuation.
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = ".,;:!?\"'()[]{}<>#*$%&|"
#: Weights of the field, in log units.
SEEDED, PRIOR_NONE, SHAPE, CHAIN, SKIP, SIMILAR = 8.0, 1.5, 1.2, 0.15, 4.0, 1.2
ROUNDS, BELIEF = 8, 0.6
#: Least length of a form that carries a label from one place to another.
MIN_FORM = 5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind. Linear in the text: each pattern is entered only where it can match."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                last = m.end()
                found.append((start, 0, last))
            at = text.find("@", max(at + 1, last if m else 0))
    if NUMBER.search(text):
        if DOTTED.search(text):
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def _form(token: str) -> str:
    return "".join(c for c in token.casefold() if c.isalnum())


def _name(address: str) -> str:
    """Form of an address's local part, if it is more than a plain word; else empty."""
    local = address.split("@")[0]
    form = _form(local)
    return form if len(form) >= MIN_FORM and not local.isalpha() else ""


def _similar(form: str) -> list[str]:
    """Keys that similar forms share: the last seven characters, and the form without its last digits."""
    keys = [f"tail {form[-7:]}"] if len(form) >= 9 else []
    stem = form.rstrip("0123456789")
    if len(stem) >= MIN_FORM and stem != form:
        keys.append(f"stem {stem}")
    return keys


def _nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, form, seeded kind or -1): base spans, and tokens elsewhere whose shape or form could be data."""
    nodes = [(s, e, _form(text[s:e]), k) for s, k, e in base]
    forms = {f for _, _, f, _ in nodes}
    names = {_name(text[s:e]) for s, k, e in base if k == 0} - {""}
    keys = {x for f in forms | names for x in _similar(f)}
    taken, i = sorted((s, e) for s, _, e in base), 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e:
            continue
        word = m[0]
        core = word.strip(TRIM)
        if len(core) < MIN_FORM:
            continue
        data = "@" in core or NUMBER.search(core)
        form = _form(core)
        if len(form) >= MIN_FORM and (form in forms or form in names or (data and (len(form) >= 9 or any(k in keys for k in _similar(form))))):
            s += word.index(core)
            nodes.append((s, s + len(core), form, -1))
    return sorted(nodes)


def spread(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those that message passing adds."""
    if not base:
        return base
    nodes = _nodes(text, base)
    if len(nodes) == len(base):
        return base
    n, labels = len(nodes), len(KINDS) + 1
    unary = np.zeros((n, labels))
    unary[:, -1] = PRIOR_NONE
    groups: dict[str, list[int]] = defaultdict(list)
    for i, (s, e, form, kind) in enumerate(nodes):
        groups[f"form {form}"].append(i)
        for key in _similar(form):
            groups[key].append(i)
        if kind >= 0:
            unary[i, kind] += SEEDED
            if kind == 0:
                if name := _name(text[s:e]):
                    groups[f"form {name}"].append(i)
        else:
            core = text[s:e]
            digits = sum(c.isdigit() for c in core)
            unary[i, 0] += SHAPE * ("@" in core)
            unary[i, 1] += SHAPE * (core.count(".") == 3 and digits >= 4)
            unary[i, 2] += SHAPE * (14 <= digits <= 19)
            unary[i, 3] += SHAPE * (10 <= digits <= 15 and core[0] in "+0(")
    hubs = [(key, at) for key, at in groups.items() if len(at) > 1]
    # Edges (a, b, strength): the chain, then every member of a group to its hub. Hubs are nodes without evidence.
    edges = [(i, i + 1, CHAIN) for i in range(n - 1)]
    for h, (key, at) in enumerate(hubs):
        edges += [(i, n + h, SKIP if key.startswith("form ") else SIMILAR) for i in at]
    a = np.array([x[0] for x in edges] + [x[1] for x in edges], int)
    b = np.array([x[1] for x in edges] + [x[0] for x in edges], int)
    strength = np.array([x[2] for x in edges] * 2)
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    total = np.concatenate([unary, np.zeros((len(hubs), labels))])
    message = np.zeros((len(a), labels))
    gain = np.exp(strength)[:, None] - 1
    for _ in range(ROUNDS):
        belief = total.copy()
        np.add.at(belief, b, message)
        out = belief[a] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(out.sum(axis=1, keepdims=True) + gain * out)
        message = 0.5 * message + 0.5 * (new - new.mean(axis=1, keepdims=True))
    belief = total.copy()
    np.add.at(belief, b, message)
    p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    more = [(s, int(best[i]), e) for i, (s, e, _, kind) in enumerate(nodes) if kind < 0 and best[i] < len(KINDS) and p[i, best[i]] >= BELIEF]
    return sorted(base + more)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(base := base_spans(t or ""), spread(t or "", base)) for t in batch.column(1).to_pylist()]
        kinds = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        as_rows = lambda x: [{"s": s, "k": k, "e": e} for s, k, e in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(x) for x, _ in rows], kinds), pa.array([as_rows(x) for _, x in rows], kinds)], ["id", "base", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans) of every document row; spans are struct<s, k, e> where ``k`` counts ``KINDS``. Narrow: no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    one = "array<struct<s:int,k:int,e:int>>"
    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(_scan, f"id {kind}, base {one}, spans {one}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of the result of ``personal_data``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def mask_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans, out, at = spread(text, base_spans(text)), [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """The documents with masked texts; other columns stay, null texts stay null."""
    at = docs.columns.index("text")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, "text", pa.array([None if t is None else mask_text(t) for t in batch.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(masked, docs.schema)
