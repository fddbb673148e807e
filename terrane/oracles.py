"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import re

from .functions import rules
from .functions.text import MESSAGE_KEYWORDS, PLACEHOLDER, SIGNAL_KEYWORDS, STRONG_KEYWORDS
from .functions.tools import ANSIBLE, CLOUDFORMATION, DOCKER_START, KUBERNETES, SIGNATURES, TERRAFORM
from .plans.corpus import FIX_PROMPT
from .plans.searches import CWES, ISSUES, PREFIXES, SCANNERS, TOOLS, VERBS

Q = lambda s: "'" + s.replace("'", "''") + "'"
any_of = lambda col, words: "(" + " OR ".join(f"contains({col}, {Q(w)})" for w in words) + ")"

RECORDS = r"""base AS (
  SELECT d.doc_id, d.text, d.lang, d.source, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
typed AS (SELECT *, list_filter([CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN contains(text, 'icensed') THEN 'license' END,
                                 CASE WHEN regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') THEN 'ipv4' END], lambda x: x IS NOT NULL) AS smell_types FROM base),
records AS (
  SELECT 'D-' || doc_id AS id, doc_id AS ord, source, (doc_id % 3)::INTEGER AS input_rank,
         CASE lang WHEN 'en' THEN 'terraform' WHEN 'fr' THEN 'kubernetes' WHEN 'de' THEN 'ansible' ELSE 'docker' END AS iac_tool,
         text AS code_before, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'fixed' WHEN 1 THEN text END AS code_after,
         CASE WHEN doc_id % 7 = 0 THEN '@@ -0,0 +1,2 @@' END AS diff, sha256(text) AS content_hash, quality = 1 AS has_fix,
         toxic = 1 AS rule_before, toxic = 1 AND doc_id % 2 = 0 AS rule_after,
         CASE doc_id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'exact' WHEN 2 THEN 'partial' WHEN 3 THEN 'unavailable' END AS code_before_quality,
         string_split(text, chr(10))[1] AS commit_message, smell_types, len(smell_types)::INTEGER AS n_smells
  FROM typed)"""


def tier(rel: str) -> str:
    """CTE ``tiered`` over a relation shaped like ``records``."""
    return f"""facts AS (
  SELECT *, CASE WHEN code_before_quality IN ('api', 'exact', 'partial') THEN true WHEN code_before_quality = 'new_file' THEN length(coalesce(code_before, '')) > 20
                 WHEN code_before_quality IN ('unavailable', 'heuristic') THEN false
                 ELSE NOT contains(coalesce(code_before, ''), {Q(PLACEHOLDER)}) AND length(coalesce(code_before, '')) > 20 END AS before_real,
         CASE WHEN rule_before AND NOT rule_after THEN 1 ELSE 0 END AS fixed,
         {any_of("lower(coalesce(commit_message, ''))", STRONG_KEYWORDS)} AS strong,
         coalesce(code_before_quality, '') = 'new_file' AND coalesce(code_after, '') <> '' AS added
  FROM {rel}),
tiered AS (
  SELECT *, CASE WHEN has_fix AND before_real AND fixed > 0 THEN 'A' WHEN has_fix AND before_real AND (rule_before OR n_smells > 0 OR strong) THEN 'B'
                 WHEN (before_real AND rule_before) OR (added AND n_smells > 0) OR (before_real AND n_smells > 0) THEN 'C' ELSE 'D' END AS tier FROM facts)"""


def _first(patterns: list[str]) -> str:
    parts = []
    for p in patterns:
        if "(?!scratch)" in p:
            tail = Q("(?im)FROM\\s+(\\S+)\\s*$")
            hits = f"list_filter(list_zip(regexp_extract_all(text, {Q('(?im)' + p.replace('(?!scratch)', ''))}), regexp_extract_all(text, {tail}, 1)), lambda z: NOT starts_with(lower(z[2]), 'scratch'))"
            parts.append(f"{hits}[1][1]")
        elif "(?!.*--no" in p:
            whole = Q("(?im)apt-get\\s+install\\s+.*")
            parts.append(f"nullif(regexp_extract(list_filter(regexp_extract_all(text, {whole}), lambda z: NOT contains(lower(z), '--no-install-recommends'))[1], {Q('(?im)apt-get' + chr(92) + 's+install' + chr(92) + 's+')}), '')")
        else:
            parts.append(f"nullif(regexp_extract(text, {Q('(?im)' + p)}), '')")
    return f"coalesce({', '.join(parts)}, NULL)"


def classify(rel: str = "documents", whole: bool = False) -> str:
    """Rows (doc_id, type, cwe, severity, checkov_id, description) of the smells in a relation's texts."""
    rows, seen = [], {}
    for i, (name, patterns) in enumerate(rules.RULES):
        guard = f"{_first(seen[name])} IS NULL AND " if name in seen else ""
        seen.setdefault(name, patterns)
        cwe, severity, check = next((c, s, (ids or [None])[0]) for n, c, s, _, ids in rules.TAXONOMY if n == name)
        rows.append(f"SELECT doc_id, {Q(name)} AS type, {Q(cwe)} AS cwe, {Q(severity)} AS severity, {Q(check) if check else 'NULL'} AS checkov_id, {_first(patterns)} AS m FROM {rel} WHERE {guard}{_first(patterns)} IS NOT NULL")
    if whole:
        return "SELECT doc_id, type, m FROM (" + " UNION ALL ".join(rows) + ")"
    return "SELECT doc_id, type, cwe, severity, checkov_id, 'Pattern match: ' || left(m, 80) AS description FROM (" + " UNION ALL ".join(rows) + ")"


NORMALISED = f"""fresh AS (SELECT ord AS doc_id, coalesce(code_after, '') AS text FROM records WHERE coalesce(code_before_quality, '') = 'new_file' OR contains(coalesce(diff, ''), '@@ -0,0')),
again AS (SELECT doc_id, count(*)::INTEGER AS n FROM ({classify('fresh')}) GROUP BY 1),
normal AS (
  SELECT * EXCLUDE (code_before, code_after, has_fix, code_before_quality, content_hash, n_smells, n, doc_id), n_smells + coalesce(n, 0) AS n_smells,
         CASE WHEN fresh THEN coalesce(code_after, '') ELSE code_before END AS code_before, CASE WHEN NOT fresh THEN code_after END AS code_after,
         NOT fresh AND has_fix AS has_fix,
         CASE WHEN fresh THEN 'new_file' WHEN contains(coalesce(code_before, ''), {Q(PLACEHOLDER)}) OR coalesce(code_before, '') = '' THEN coalesce(code_before_quality, 'unavailable') ELSE coalesce(code_before_quality, 'api') END AS code_before_quality
  FROM (SELECT *, coalesce(code_before_quality, '') = 'new_file' OR contains(coalesce(diff, ''), '@@ -0,0') AS fresh FROM records LEFT JOIN again ON doc_id = ord)),
hashed AS (SELECT *, sha256(coalesce(nullif(coalesce(code_before, ''), ''), code_after, '')) AS content_hash FROM normal)"""
BEST = "best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY has_fix DESC, n_smells DESC, ord) AS n FROM records) WHERE n = 1)"
SPLIT = """split AS (
  SELECT *, CASE WHEN n <= floor(m * 0.8::DOUBLE) THEN 'train' WHEN n <= floor(m * 0.8::DOUBLE) + floor(m * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY iac_tool ORDER BY sha256('42:' || id), id) AS n, count(*) OVER (PARTITION BY iac_tool) AS m FROM best))"""
RELEASE = f"""{RECORDS}, {NORMALISED}, {tier('hashed')},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY CASE tier WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END DESC, fixed DESC, rule_before DESC, has_fix DESC,
             (trim(coalesce(code_before, '')) <> '' AND NOT contains(coalesce(code_before, ''), {Q(PLACEHOLDER)})) DESC, n_smells DESC, input_rank DESC, ord) AS pick FROM tiered) WHERE pick = 1)"""
PRF = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn))) ELSE 0.0 END AS f1"""
MATCHED = """ev AS (SELECT event_id, event_type, user_id, floor(epoch_us(ts) / 60000000)::BIGINT AS line FROM events),
det AS (SELECT * FROM ev WHERE event_type = 'error'), gt AS (SELECT * FROM ev WHERE event_type = 'purchase'),
matched AS (SELECT d.event_id AS det_id, min(g.event_id) AS gt_id FROM det d JOIN gt g ON d.user_id = g.user_id AND abs(d.line - g.line) <= 60 GROUP BY 1)"""


def _detection(group_d: str, group_g: str) -> str:
    return f"""WITH {MATCHED},
counts AS (
  SELECT {group_g} AS "group", count(*) FILTER (event_id IN (SELECT gt_id FROM matched)) AS tp, 0 AS fp, count(*) FILTER (event_id NOT IN (SELECT gt_id FROM matched)) AS fn FROM gt GROUP BY 1
  UNION ALL SELECT {group_d}, 0, count(*), 0 FROM det WHERE event_id NOT IN (SELECT det_id FROM matched) GROUP BY 1),
sums AS (SELECT "group", sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY 1)
SELECT *, {PRF} FROM sums"""


def tool_case(path: str, content: str) -> str:
    m = lambda p: f"regexp_matches({content}, {Q(p)})"
    return f"CASE WHEN {m(CLOUDFORMATION)} THEN 'cloudformation' WHEN {m(KUBERNETES)} THEN 'kubernetes' WHEN {m(ANSIBLE)} THEN 'ansible' WHEN {m(TERRAFORM)} THEN 'terraform' WHEN {m(DOCKER_START)} THEN 'docker' ELSE 'unknown' END"


LINES = r"list_transform(string_split(text, chr(10)), lambda x: x)"
_BODY = "CASE WHEN text IS NULL THEN NULL ELSE (CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) END"
SLOTS = "slots AS (SELECT user_id, event_type, value, event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS side FROM events)"

ORACLES: dict[str, str] = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "record_ids": "SELECT doc_id, 'GH-' || left(sha256(source || ':' || doc_id || ':' || lang), 12) AS id FROM documents",
    "dedup_best": f"WITH {RECORDS}, {BEST} SELECT id, content_hash, has_fix, n_smells FROM best",
    "split_assign": f"WITH {RECORDS}, {BEST}, {SPLIT} SELECT id, iac_tool, split FROM split",
    "split_counts": f"WITH {RECORDS}, {BEST}, {SPLIT} SELECT iac_tool, split, count(*) AS n FROM split GROUP BY ALL",
    "merge_stats": f"WITH {RECORDS}, {BEST}, {SPLIT} SELECT count(*) AS total, count(*) FILTER (has_fix) AS with_fix, count(*) FILTER (NOT has_fix) AS without_fix, (SELECT count(*) FROM records) - count(*) AS duplicates_removed, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM split",
    "tier_assign": f"WITH {RECORDS}, {tier('records')} SELECT id, tier, fixed, before_real FROM tiered",
    "tier_stats": f"WITH {RECORDS}, {tier('records')} SELECT count(*) FILTER (tier = 'A') AS a, count(*) FILTER (tier = 'B') AS b, count(*) FILTER (tier = 'C') AS c, count(*) FILTER (tier = 'D') AS d FROM tiered",
    "normalise_records": f"WITH {RECORDS}, {NORMALISED}, {tier('hashed')} SELECT id, code_before_quality, has_fix, content_hash, tier, code_after IS NULL AS no_after FROM tiered",
    "release_best": f"WITH {RELEASE} SELECT id, tier, content_hash FROM chosen",
    "release_outputs": f"WITH {RELEASE} SELECT count(*) AS n_full, count(*) FILTER (tier = 'A') AS gold, count(*) FILTER (tier IN ('A', 'B') AND has_fix) AS fix_pairs, count(*) FILTER (tier IN ('A', 'B', 'C')) AS detection FROM chosen",
    "manifest_counts": f"WITH {RECORDS}, {tier('records')}, named AS (SELECT tier, source, iac_tool, coalesce(code_before_quality, '<missing>') AS code_before_quality FROM tiered) SELECT CASE WHEN tier IS NOT NULL THEN 'tier' WHEN source IS NOT NULL THEN 'source' WHEN iac_tool IS NOT NULL THEN 'iac_tool' ELSE 'code_before_quality' END AS dimension, coalesce(tier, source, iac_tool, code_before_quality) AS key, count(*) AS n FROM named GROUP BY GROUPING SETS ((tier), (source), (iac_tool), (code_before_quality))",
    "labels_array": f"WITH {RECORDS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(smell_types, CASE WHEN rule_before THEN ['R1'] ELSE [] END, [iac_tool]))), '|') AS labels FROM records",
    "smell_topk": f"WITH {RECORDS} SELECT smell, count(*) AS n FROM (SELECT ord, unnest(smell_types) AS smell, unnest(range(len(smell_types))) AS place FROM records) GROUP BY 1 ORDER BY n DESC, min(ord * 100 + place) LIMIT 25",
    "classify_smells": classify(),
    "heuristic_lines": "SELECT doc_id, line, type, cwe FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, " + _BODY + " AS ls FROM documents)) JOIN (VALUES " + ", ".join(f"({i}, {Q('(?i)' + p)}, {Q(t)}, {Q(c)})" for i, (p, t, c) in enumerate(rules.HEURISTICS)) + ") v(i, p, type, cwe) ON regexp_matches(l, p)",
    "text_metrics": f"SELECT doc_id, len(ls)::INTEGER AS line_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS token_count, len(list_filter(ls, lambda x: trim(x) = ''))::INTEGER AS blank_lines, len(list_filter(ls, lambda x: starts_with(trim(x), '#') OR starts_with(trim(x), '//') OR starts_with(trim(x), '/*')))::INTEGER AS comment_lines FROM (SELECT doc_id, text, {_BODY} AS ls FROM documents)",
    "detect_tool": "SELECT page_id, " + tool_case("url", "html") + " AS tool FROM pages",
    "analyzer_tool": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {Q(p)}) THEN {Q(t)}" for t, p in SIGNATURES) + " ELSE 'unknown' END AS tool FROM documents",
    "signal_filters": f"SELECT doc_id, {any_of('lower(text)', SIGNAL_KEYWORDS)} AS signal, {any_of('lower(text)', MESSAGE_KEYWORDS)} AS message, length(text) <= 200000 AS small FROM documents",
    "training_filter": f"WITH {RECORDS} SELECT id, iac_tool, array_to_string(list_sort(smell_types), '|') AS types FROM records WHERE has_fix AND trim(coalesce(code_before, '')) <> '' AND trim(coalesce(code_after, '')) <> '' AND length(code_before) + length(code_after) <= 8000 AND trim(code_before) <> trim(code_after)",
    "training_stats": f"WITH {RECORDS}, kept AS (SELECT * FROM records WHERE has_fix AND trim(coalesce(code_before, '')) <> '' AND trim(coalesce(code_after, '')) <> '' AND length(code_before) + length(code_after) <= 8000 AND trim(code_before) <> trim(code_after)) SELECT iac_tool, count(*) AS kept, 100.0::DOUBLE * count(*) / greatest((SELECT count(*) FROM records), 1) AS kept_pct FROM kept GROUP BY 1",
    "resume_anti_join": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "pair_first": "WITH r AS (SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT source, min(doc_id) AS first FROM r WHERE quality = 1 GROUP BY 1) SELECT r.doc_id, r.source, first AS after_value, first IS NOT NULL AS has_fix FROM r LEFT JOIN p USING (source) WHERE quality = 0",
    "path_verdicts": "SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE coalesce(" + "CASE WHEN " + " OR ".join(f"list_contains(string_split(lower(url), '/'), '{w}') OR contains(regexp_replace(string_split(lower(url), '/')[-1], '^(.+)\\.[^.]+$', '\\1'), '{w}')" for w in ("pass", "passed", "positive", "good", "compliant", "secure", "correct", "allowed")) + " THEN 'pass' WHEN " + " OR ".join(f"list_contains(string_split(lower(url), '/'), '{w}') OR contains(regexp_replace(string_split(lower(url), '/')[-1], '^(.+)\\.[^.]+$', '\\1'), '{w}')" for w in ("fail", "failed", "negative", "bad", "example_", "wrong", "insecure", "violated", "denied", "vulnerable")) + " THEN 'fail' END, 'none') END AS verdict FROM pages",
    "taxonomy_lookup": "WITH t(type, cwe, severity, category) AS (VALUES " + ", ".join(f"({Q(n)}, {Q(c)}, {Q(s)}, {Q(k)})" for n, c, s, k, _ in rules.TAXONOMY) + "), e AS (SELECT event_id, (['hardcoded_password', 'weak_hash', 'no_mfa', 'unknown_type'])[(event_id % 4 + 1)::INTEGER] AS type FROM events) SELECT coalesce(severity, 'NONE') AS severity, coalesce(cwe, 'NONE') AS cwe, count(*) AS n FROM e LEFT JOIN t USING (type) GROUP BY ALL",
    "detection_match": f"WITH {MATCHED} SELECT det_id, gt_id FROM matched",
    "detection_metrics": _detection("'all'", "'all'"),
    "detection_by_group": _detection("user_id % 10", "user_id % 10"),
    "macro_f1": f"WITH x AS ({_detection('user_id % 10', 'user_id % 10')}) SELECT avg(f1) AS macro_f1, count(*) AS n_types FROM x",
    "retrieval_scores": "WITH t(type, cwe, idx) AS (VALUES " + ", ".join(f"({Q(n)}, {Q(c)}, {i})" for i, (n, c, *_) in enumerate(rules.TAXONOMY)) + "), p AS (SELECT q.idx AS query_id, d.idx AS doc_idx, CASE WHEN d.cwe = q.cwe THEN 10 ELSE 0 END + CASE WHEN contains(replace(d.type, '_', ' '), replace(q.type, '_', ' ')) THEN 5 ELSE 0 END + len(list_filter(string_split(lower(q.type || ' ' || q.cwe), ' '), lambda w: contains(lower(d.type || ' ' || d.cwe), w))) AS score FROM t q, t d) SELECT query_id::BIGINT AS query_id, doc_idx::BIGINT AS doc_idx, score::INTEGER AS score FROM p WHERE score > 0",
    "retrieval_metrics": "WITH t(type, cwe, idx) AS (VALUES " + ", ".join(f"({Q(n)}, {Q(c)}, {i})" for i, (n, c, *_) in enumerate(rules.TAXONOMY)) + "), p AS (SELECT q.idx AS query_id, d.idx AS doc_idx, CASE WHEN d.cwe = q.cwe THEN 10 ELSE 0 END + CASE WHEN contains(replace(d.type, '_', ' '), replace(q.type, '_', ' ')) THEN 5 ELSE 0 END + len(list_filter(string_split(lower(q.type || ' ' || q.cwe), ' '), lambda w: contains(lower(d.type || ' ' || d.cwe), w))) AS score, d.cwe = q.cwe OR contains(d.type, q.type) AS relevant FROM t q, t d), r AS (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx) AS rank FROM p) WHERE rank <= 5 GROUP BY 1) SELECT avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate_k3, avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate_k5, avg(coalesce(1.0 / first, 0.0))::DOUBLE AS mrr, count(*) AS total_queries FROM r",
    "knn_topk": "WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5",
    "patch_verdict": f"WITH {SLOTS}, sides AS (SELECT user_id, event_type, max(side = 'before')::INTEGER AS b, max(side = 'after')::INTEGER AS a FROM slots GROUP BY ALL), c AS (SELECT user_id, sum(b)::BIGINT AS targeted, sum(b * (1 - a))::BIGINT AS removed, sum(a * (1 - b))::BIGINT AS new FROM sides GROUP BY 1) SELECT *, removed > 0 AND new = 0 AS valid FROM c",
    "remediation_metrics": f"WITH {SLOTS}, sides AS (SELECT user_id, event_type, max(side = 'before')::INTEGER AS b, max(side = 'after')::INTEGER AS a FROM slots GROUP BY ALL), c AS (SELECT user_id, sum(b)::BIGINT AS targeted, sum(b * (1 - a))::BIGINT AS removed, sum(a * (1 - b))::BIGINT AS new FROM sides GROUP BY 1), f AS (SELECT *, removed > 0 AND new = 0 AS valid FROM c) SELECT count(*) AS n_files, avg(valid::INTEGER)::DOUBLE AS pvr, CASE WHEN sum(targeted) > 0 THEN sum(removed)::DOUBLE / sum(targeted) ELSE 0.0 END AS ser_micro, avg(CASE WHEN targeted > 0 THEN removed::DOUBLE / targeted END) AS ser_macro, 1 - sum((new > 0)::INTEGER)::DOUBLE / count(*) AS nnir FROM f",
    "self_consistency": r"WITH s AS (SELECT conv_id AS prompt_id, turn AS idx, coalesce(text, '') AS raw, array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '//')), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')), chr(10)) AS form FROM conversations) SELECT prompt_id, form, count(*) / 5.0::DOUBLE AS confidence, arg_min(raw, (idx, raw)) AS raw FROM s WHERE form <> '' GROUP BY prompt_id, form HAVING count(*) / 5.0 >= 0.2",
    "diff_lines": r"WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 3 WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE ' ' END || x) AS ls FROM documents) SELECT doc_id, len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INTEGER AS added, len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))::INTEGER AS removed, md5(array_to_string(list_transform(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: x[2:]), chr(10))) AS before_md5 FROM l",
    "query_product": "SELECT DISTINCT v || ' ' || n_name || ' ' || r_name AS query FROM (VALUES ('fix'), ('patch'), ('resolve'), ('remediate'), ('harden'), ('secure'), ('correct')) v(v), nation, region",
    "date_windows": "SELECT greatest(DATE '2023-01-01', (d - INTERVAL 13 DAY)::DATE) AS start, d::DATE AS stop FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2023-01-01', INTERVAL (-14) DAY) g(d)",
    "union_inputs": "SELECT source, n, rank() OVER (ORDER BY n DESC, source)::INTEGER AS rank FROM (SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 1) GROUP BY 1)",
    "event_candidates": "SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL",
    "stream_rate": "SELECT epoch_us(date_trunc('minute', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_stall": "WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 15 MINUTE) AS end_us, count(*) AS n FROM r GROUP BY user_id, k",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "circuit_breaker": "WITH r AS (SELECT *, (event_type = 'error')::INTEGER AS f, sum(1 - (event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT event_id, sum(f) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures, f = 1 AND sum(f) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) % 3 = 0 AS opens FROM r",
    "metric_lines": "WITH s AS (SELECT date_trunc('minute', ts) AS start, count(*) AS n FROM events GROUP BY 1) SELECT epoch_us(start) AS start_us, n, n::DOUBLE AS rate_per_min, sum(n) OVER (PARTITION BY start::DATE ORDER BY start ROWS UNBOUNDED PRECEDING)::BIGINT AS total_today FROM s",
    "json_props": "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events",
    "fleiss_kappa": "WITH r AS (SELECT user_id AS item, event_type AS category, count(*) AS n FROM events GROUP BY ALL), i AS (SELECT item, sum(n) AS m, sum(n * n) AS s FROM r GROUP BY 1), p AS (SELECT avg((s - m)::DOUBLE / (m * (m - 1))) AS p, sum(m) AS t FROM i), c AS (SELECT sum(c * c) AS cc FROM (SELECT sum(n) AS c FROM r GROUP BY category)) SELECT round((p - cc / (t * t)) / (1 - cc / (t * t)), 9) AS kappa FROM p, c",
    "signed_rank": "WITH d AS (SELECT l_extendedprice - l_quantity * 1500 AS d FROM lineitem), v AS (SELECT abs(d) AS a, count(*) AS m, sum((d > 0)::INTEGER) AS up FROM d WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(m) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (m + 1) / 2.0 AS rank FROM v) SELECT sum(up * rank)::DOUBLE AS w_plus, sum((m - up) * rank)::DOUBLE AS w_minus, sum(m)::BIGINT AS n FROM r",
    "account_halves": "SELECT s_suppkey, CASE WHEN n <= (m + 1) // 2 THEN 1 ELSE 2 END AS half, (n % 2)::INTEGER AS odd FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS m FROM supplier)",
}


def _values(words: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {Q(w)})" for i, w in enumerate(words)) + ")"


def _prompt() -> str:
    """The prompt of a fix in SQL: no line, description or weakness is known, the context is empty."""
    values = {"iac_tool": "iac_tool", "smells": "array_to_string(list_transform(smell_types, lambda t: '- Line ?: ' || t || ' []'), chr(10))", "rag_context": "''", "script_content": "code_before"}
    parts = re.split(r"\{(\w+)\}", FIX_PROMPT)
    return " || ".join(values[x] if i % 2 else " || chr(10) || ".join(Q(y) for y in x.split("\n")) for i, x in enumerate(parts))


_RANKED = ORACLES["retrieval_metrics"].split(", r AS (")[0]
_ATTEMPTS = "a AS (SELECT user_id AS file_id, min(CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN event_id % 3 + 1 END) AS first FROM events GROUP BY 1), s AS (SELECT avg((coalesce(first, 9) <= 1)::INTEGER)::DOUBLE AS s1, avg((coalesce(first, 9) <= 2)::INTEGER)::DOUBLE AS s2, avg((coalesce(first, 9) <= 3)::INTEGER)::DOUBLE AS s3 FROM a)"
_WINDOWS = "w AS (SELECT greatest(DATE '2023-11-01', (d - INTERVAL 13 DAY)::DATE) AS start, d::DATE AS stop FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2023-11-01', INTERVAL (-14) DAY) g(d))"
ORACLES |= {
    "context_precision": f"{_RANKED}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx) AS rank FROM p) WHERE rank <= 5), c AS (SELECT *, sum(relevant::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) / rank AS pk FROM k) SELECT query_id::BIGINT AS query_id, round(CASE WHEN sum(relevant::INTEGER) > 0 THEN sum(CASE WHEN relevant THEN pk END) / sum(relevant::INTEGER) ELSE 0.0 END, 9)::DOUBLE AS context_precision FROM c GROUP BY 1",
    "success_at": f"WITH {_ATTEMPTS} SELECT s1 AS sr_at_1, s2 AS sr_at_2, s3 AS sr_at_3 FROM s",
    "retry_benefit": f"WITH {_ATTEMPTS} SELECT round(s1, 9) AS fa_sr, round(s2 - s1, 9) AS delta_r_at_2, round(s3 - s1, 9) AS delta_r_at_3 FROM s",
    "cost_metrics": "WITH c AS (SELECT length(text) AS i, turn AS o, role = 'assistant' AS v FROM conversations) SELECT round(avg(i), 6) AS avg_in, round(avg(o), 6) AS avg_out, round(sum(i * 0.15::DOUBLE + o * 0.6::DOUBLE) / count(*), 6) AS cost_per_script, round(sum(i * 0.15::DOUBLE + o * 0.6::DOUBLE) / nullif(count(*) FILTER (v), 0), 6) AS cost_per_valid FROM c",
    "dataset_statistics": "SELECT 'iac_tool' AS dimension, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'category', (user_id % 3)::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'cwe', 'CWE-' || (event_id % 18), count(*) FROM events GROUP BY 2",
    "top_tools": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 6",
    "validation_stats": "SELECT count(*) FILTER (quality IS NOT NULL AND quality <> 0) AS processed, count(*) FILTER (quality IS NULL) AS skipped, count(*) FILTER (quality = 0) AS errored, count(*) FILTER (quality IS NOT NULL AND toxic > 0) AS with_findings FROM documents LEFT JOIN labels USING (doc_id)",
    "ordered_unique": "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "commit_queries": f"WITH q AS (SELECT v.i * {len(ISSUES) * len(TOOLS)} + s.i * {len(TOOLS)} + t.i AS ord, v.w || ' ' || s.w || ' ' || t.w AS query FROM {_values(VERBS)} v(i, w), {_values(ISSUES)} s(i, w), {_values(TOOLS)} t(i, w) UNION ALL SELECT c.i * {len(TOOLS)} + t.i + 1000000, c.w || ' fix ' || t.w FROM {_values(CWES)} c(i, w), {_values(TOOLS)} t(i, w) UNION ALL SELECT s.i * 3 + f.i + 2000000, replace(f.w, '#', s.w) FROM {_values(SCANNERS)} s(i, w), (VALUES (0, 'fix #'), (1, '# failed fix'), (2, '# finding fix')) f(i, w) UNION ALL SELECT p.i + 3000000, p.w || ' fix' FROM {_values(PREFIXES)} p(i, w)) SELECT query, min(ord)::BIGINT AS ord FROM q GROUP BY 1",
    "work_units": f"WITH {_WINDOWS} SELECT r_name AS query, start, stop FROM region, w WHERE NOT (r_name = 'ASIA' AND stop >= DATE '2024-01-16')",
    "progress_merge": "SELECT user_id AS unit, max(event_id % 50) AS last_page, bool_or(event_type = 'view') AS done FROM events GROUP BY 1",
    "version_pairs": "SELECT e.event_id AS commit_sha, p.props AS code_before, e.props AS code_after FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 1 AND p.user_id = e.user_id AND p.event_type = e.event_type",
    "pairwise_agreement": "WITH r AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id, event_type), i AS (SELECT user_id, sum(n) AS m, sum(n * (n - 1)) AS s FROM r GROUP BY 1) SELECT round(avg(s::DOUBLE / (m * (m - 1))), 9) AS rpa FROM i WHERE m > 1",
    "group_keys": "SELECT array_to_string(string_split(url, '/')[1:4], '/') AS key, count(*) AS n FROM pages GROUP BY 1",
    "prompts": f"WITH {RECORDS} SELECT id, md5({_prompt()}) AS prompt_md5, md5('IaC tool: ' || iac_tool || '. Security issues: ' || array_to_string(smell_types, '; ') || '. How to fix?' || CASE input_rank WHEN 1 THEN ' Focus on minimal, targeted changes only.' WHEN 2 THEN ' Provide the most conservative and safe remediation possible.' ELSE '' END) AS query_md5 FROM records",
    "primary_keys": f"WITH {RECORDS} SELECT id, md5('content' || chr(1) || content_hash) AS key_md5 FROM records",
}
ORACLES["knn_indexed"] = ORACLES["knn_topk"]
for _name in ("retrieval_scores", "retrieval_metrics", "context_precision"):
    _asked = f", q AS (SELECT doc_id * 1000 + idx AS query_id, t.type, t.cwe FROM ({classify()}) c JOIN t ON t.type = c.type), p AS ("
    ORACLES[_name] = ORACLES[_name].replace(", p AS (", _asked, 1).replace("q.idx AS query_id", "q.query_id").replace("FROM t q, t d", "FROM q, t d")
ORACLES["date_windows"] = "WITH b AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM events), g AS (SELECT a, unnest(generate_series(z::TIMESTAMP, a::TIMESTAMP, INTERVAL (-14) DAY)) AS d FROM b) SELECT greatest(a, (d - INTERVAL 13 DAY)::DATE) AS start, d::DATE AS stop FROM g"
ORACLES["commit_queries"] = ORACLES["commit_queries"].replace(") SELECT query, min(ord)", " UNION ALL SELECT min(p_partkey) + 4000000, p_type || ' fix' FROM part GROUP BY p_type) SELECT query, min(ord)")
