"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality
from .chat import CONTROLS, END, ESC, START
from .licenses import KNOWN, SPELLINGS

WHITE = r"[\x20\x09-\x0D]+"
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"

#: Quality rules over a table ``documents``.
QUALITY = rf"""
base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM base WHERE len(ws) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda w: regexp_matches(w, '{LETTER}')))::BIGINT AS n_letter_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
       + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
       + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
       + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
       + CASE WHEN 10 * n_letter_words < 5 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM measured)
"""
#: The rule whose bit is the only one set.
ONLY = "CASE fail_bits " + " ".join(f"WHEN {quality.BIT[name]} THEN '{name}'" for name, _ in quality.RULES) + " END"
OP10 = f"""WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
       {ONLY} AS only_rule, CASE WHEN {ONLY} IS NOT NULL THEN count(*) OVER (PARTITION BY fail_bits) END AS only_rule_n
FROM judged"""

#: Benchmark windows and their occurrences over tables ``documents`` and ``benchmark``.
DECONTAM = r"""
dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
iw AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dwin AS (
  SELECT rid, i, l, array_to_string(ws[i : i + l - 1], ' ') AS phrase
  FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win))),
occ AS (SELECT rid, i, dwin.l AS l, item_id FROM dwin JOIN win ON dwin.phrase = win.phrase AND dwin.l = win.l),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM occ) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM occ) GROUP BY rid),
leaks AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM dw LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid))
"""
OP6 = f"WITH {DECONTAM} SELECT * FROM leaks"


def _canonical(text: str) -> str:
    """DuckDB expression of the canonical form of a license text."""
    bare = rf"""trim(regexp_replace(regexp_replace(lower({text}), '(?m)^[^0-9A-Za-z(©\n]*(?:copyright *(?:\(c\)|©|[0-9<\[{{])|\(c\) *[0-9]|©|all rights reserved)[^\n]*$', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"""
    for old, new in SPELLINGS:
        bare = f"replace({bare}, '{old}', '{new}')"
    return bare


def _values(rows: list[tuple[str, str]]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)


MARKS = "(?i)licen[cs]|permission|redistribut|public domain|warrant"
OP9 = rf"""WITH known AS (SELECT sha256({_canonical("t")}) AS digest, min(license) AS license FROM (VALUES {_values(KNOWN)}) v(license, t) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT rid, u FROM (SELECT rid, unnest(list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '\n[ \t]*\n'), lambda p: contains(p, chr(10))))) AS u FROM docs)
  WHERE regexp_matches(u, '{MARKS}')),
unit_hits AS (SELECT rid, license FROM (SELECT rid, sha256({_canonical("u")}) AS digest FROM units) JOIN known USING (digest)),
whole AS (SELECT rid, doc_id, d AS text_sha256, license AS whole_license FROM (SELECT rid, doc_id, sha256({_canonical("t")}) AS d FROM docs) LEFT JOIN known ON digest = d),
names AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS licenses
          FROM (SELECT rid, license FROM unit_hits UNION SELECT rid, whole_license FROM whole WHERE whole_license IS NOT NULL) GROUP BY rid)
SELECT doc_id, text_sha256, whole_license, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_units
FROM whole LEFT JOIN names USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM unit_hits GROUP BY rid) USING (rid)"""


def _escaped(text: str) -> str:
    """DuckDB expression of an escaped text."""
    out = f"replace({text}, chr({ord(ESC)}), chr({ord(ESC)}) || chr({ord(ESC)}))"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', chr({ord(ESC)}) || '{control}')"
    return out


_ROLE = _escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")
OP5 = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + 1 + len(END)} + length({_ROLE}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
