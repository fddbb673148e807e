"""DuckDB SQL for the registered queries over files."""

from __future__ import annotations

import re

from .functions import rules
from .functions.text import MESSAGE_KEYWORDS, PLACEHOLDER, SIGNAL_KEYWORDS, STRONG_KEYWORDS
from .functions.tools import SIGNATURES
from .operators.filters import BAD_WORDS, CODE_WORDS, GOOD_WORDS
from .operators.summaries import CWE_NAMES, ISSUE, REMEDY
from .oracles import ORACLES as FIRST
from .oracles import Q, RECORDS, RELEASE, any_of, classify, tool_case
from .plans.corpus import INSTRUCTION
from .plans.testviews import PATCH
from .sources.readers import SECURITY_MESSAGE

NL = "chr(10)"
text_of = lambda s: " || chr(10) || ".join(Q(x) for x in s.split("\n"))


def types_of(text: str) -> list[str]:
    """Types that the rules find in a fixed text."""
    found: list[str] = []
    for name, patterns in rules.RULES:
        if name not in found and any(re.search(p, text, re.I | re.M) for p in patterns):
            found.append(name)
    return found


def side(diff: str, sign: str) -> str:
    return "\n".join(x[1:] for x in diff.split("\n") if x.startswith(sign) and not x.startswith(3 * sign))


IN_PATCH = len(types_of(side(PATCH, "-")))
PATH = "CASE doc_id % 6 WHEN 0 THEN 'modules/pass/m' || doc_id || '.tf' WHEN 1 THEN 'modules/fail/m' || doc_id || '.tf' WHEN 2 THEN 'images/' || doc_id || '/Dockerfile' WHEN 3 THEN 'docs/readme' || doc_id || '.md' WHEN 4 THEN 'k8s/app' || doc_id || '.yml' ELSE 'group/roles/r' || doc_id || '.yaml' END"
KEYED = f"""keyed AS (SELECT doc_id, text, lang, source, 'org/' || CASE doc_id % 3 WHEN 0 THEN 'terraform-' WHEN 1 THEN 'blog-' ELSE 'k8s-' END || (doc_id % 10) AS repo,
  left(sha256('c' || doc_id), 40) AS sha, left(sha256('p' || doc_id), 40) AS parent, {PATH} AS path FROM documents)"""


def detect(path: str, content: str) -> str:
    inside = tool_case(path, content)
    return f"CASE WHEN {path} LIKE '%/Dockerfile' THEN 'docker' WHEN {path} LIKE '%.tf' THEN 'terraform' WHEN {inside} <> 'unknown' THEN {inside} WHEN {path} LIKE 'k8s/%' THEN 'kubernetes' WHEN {path} LIKE 'group/roles/%' THEN 'ansible' ELSE 'unknown' END"


COUNTED = f"counted AS (SELECT doc_id, count(*) AS n FROM ({classify()}) GROUP BY 1)"
UNDONE = f"array_to_string(list_concat(list_filter(string_split(text, {NL}), lambda x: x <> 'fixed'), [{Q(side(PATCH, '-'))}]), {NL})"
FIRST_LINE = f"string_split(text, {NL})[1]"
COMMITS = f"""{KEYED}, {COUNTED},
found AS (SELECT k.*, coalesce(n, 0) AS n, doc_id % 2 = 0 AS patched, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN nullif(text, '') END AS fetched FROM keyed k LEFT JOIN counted USING (doc_id) WHERE path NOT LIKE '%.md' AND doc_id % 5 <> 1),
sided AS (SELECT * EXCLUDE (n), coalesce(fetched, {UNDONE}) AS code_before, CASE WHEN fetched IS NOT NULL THEN 'api' ELSE 'heuristic' END AS code_before_quality, CASE WHEN patched THEN {IN_PATCH} ELSE n END AS n_smells FROM found WHERE fetched IS NOT NULL OR patched),
commits AS (SELECT *, 'GH-' || left(sha256(repo || ':' || sha || ':' || path), 12) AS id, {detect('path', 'code_before')} AS iac_tool FROM sided WHERE n_smells > 0 OR {any_of(f"lower({FIRST_LINE})", SIGNAL_KEYWORDS)})"""
SAID = "CASE doc_id % 4 WHEN 0 THEN 'fix tls' WHEN 1 THEN 'Rotate credential' WHEN 2 THEN 'tidy up' ELSE 'harden' END"
PLACED = f"{Q('# ' + PLACEHOLDER)} || {NL} || {text_of(PATCH)}"
LINED = "lines AS (SELECT *, 'D-' || doc_id AS id, doc_id % 8 AS kind FROM documents)"
CHECKS = """ev AS (SELECT event_id, event_type, user_id % 20 AS file, event_id % 100 AS line, CASE WHEN event_id % 5 = 0 THEN 'HEURISTIC' WHEN event_id % 5 > 1 THEN (event_id % 5)::VARCHAR ELSE '' END AS c FROM events),
det AS (SELECT * FROM ev WHERE event_type = 'error'), gt AS (SELECT * FROM ev WHERE event_type = 'purchase' AND c <> 'HEURISTIC'),
matched AS (SELECT d.event_id AS det_id, min(g.event_id) AS gt_id FROM det d JOIN gt g ON d.file = g.file AND d.c = g.c AND abs(d.line - g.line) <= 5 WHERE d.c <> 'HEURISTIC' GROUP BY 1),
sums AS (SELECT (SELECT count(DISTINCT gt_id) FROM matched) AS tp, (SELECT count(*) FROM det) - (SELECT count(*) FROM matched) AS fp, (SELECT count(*) FROM gt) - (SELECT count(DISTINCT gt_id) FROM matched) AS fn)"""


def example(names: list[tuple[str, str]], folder: str) -> str:
    """CTE ``e`` of an example collection: path, group, smells."""
    cases = " ".join(f"WHEN {i} THEN {Q(a)} || doc_id || {Q(b)}" for i, (a, b) in enumerate(names))
    return f"{COUNTED}, e AS (SELECT doc_id, text, coalesce(n, 0) AS n, {Q(folder)} || (doc_id % 41) AS grp, {Q(folder)} || (doc_id % 41) || CASE doc_id % 4 {cases} END AS path FROM documents LEFT JOIN counted USING (doc_id) WHERE text <> '')"


def paired(bad: str, source: str, repo: str, note: str, kept: str = "true") -> str:
    """Pairs of bad examples with the first good one of their group."""
    tool = lambda path, content: f"nullif({detect(path, content)}, 'unknown')"
    return f"""s AS (SELECT *, {bad} AS bad FROM e WHERE {kept}), g AS (SELECT grp, arg_min(path, doc_id) AS good_path, arg_min(text, doc_id) AS good FROM s WHERE NOT bad GROUP BY 1),
p AS (SELECT s.*, good, coalesce({tool('path', 'text')}, CASE WHEN good IS NOT NULL THEN {tool('good_path', 'good')} END) AS iac_tool FROM s LEFT JOIN g USING (grp) WHERE bad)
SELECT 'KR-' || left(sha256({Q(repo)} || ':' || path), 12) AS id, {Q(source)} AS source, iac_tool, good IS NOT NULL AS has_fix, n::INTEGER AS n_smells, md5(good) AS after_md5, {Q(note)} || grp AS notes FROM p WHERE iac_tool IS NOT NULL"""


def messages() -> str:
    """Instruction of a chat pair in SQL."""
    parts = re.split(r"\{(\w+)\}", INSTRUCTION)
    values = {"iac_tool": "iac_tool", "smells": "coalesce(nullif(array_to_string(smell_types, ', '), ''), 'security issues')"}
    return " || ".join(values[x] if i % 2 else text_of(x) for i, x in enumerate(parts))


def explained() -> str:
    smell = lambda name, cwe, issue: f"'### {name}' || {NL} || '- **Location:** Line ' || CASE WHEN ord % 2 = 0 THEN '3' ELSE '?' END || {NL} || {cwe} || '- **Issue:** ' || {Q(issue)} || {NL} || {Q('- **Remediation:** ' + REMEDY)} || {NL} || {NL}"
    reference = lambda cwe: f"{Q(f'- **CWE Reference:** [{cwe}] ' + CWE_NAMES.get(cwe, ''))} || {NL}"
    one = f"CASE t WHEN 'email' THEN {smell('Email', reference('CWE-312'), ISSUE)} WHEN 'license' THEN {smell('License', reference('CWE-1'), ISSUE)} ELSE {smell('Ipv4', Q(''), 'an address')} END"
    return f"{text_of('## Security Patch Explanation')} || {NL} || {NL} || array_to_string(list_transform(smell_types, lambda t: {one}), '') || '### Diff Summary' || {NL} || '- Lines added: ' || ord % 5 || {NL} || '- Lines removed: ' || ord % 3 || {NL} || '- Net change: ' || CASE WHEN ord % 5 >= ord % 3 THEN '+' ELSE '' END || (ord % 5 - ord % 3) || ' lines'"


USABLE = "has_fix AND trim(coalesce(code_before, '')) <> '' AND trim(coalesce(code_after, '')) <> '' AND length(code_before) + length(code_after) <= 8000 AND trim(code_before) <> trim(code_after)"
_HEX = "list_reduce(list_transform(string_split(substr(md5(user_id || ':' || event_id % 10), 1, 6), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b)"

ORACLES: dict[str, str] = {
    "read_strict": f"WITH {LINED} SELECT id, md5(text) AS code_md5, 'weak_hash' AS types FROM lines WHERE kind < 4",
    "read_lenient": f"WITH {LINED} SELECT id, 'docker' AS iac_tool FROM lines WHERE kind < 6",
    "read_fail_fast": "SELECT 'D-' || doc_id AS id, CASE WHEN doc_id % 6 <> 5 THEN false END AS has_fix FROM documents",
    "read_glob": "SELECT 'D-' || doc_id AS id, 'part' || doc_id % 2 AS part FROM documents",
    "load_counts": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS e FROM documents) SELECT 'part' || i || '.jsonl' AS input, CASE i WHEN 0 THEN n WHEN 1 THEN e ELSE 0 END AS n_loaded, i = 2 AS missing, n + e AS total_loaded, e AS duplicates_removed FROM c, range(3) r(i)",
    "read_truth": "SELECT r_regionkey::VARCHAR AS file_id, r_name AS file, 'terraform' AS iac_tool, n_nationkey::VARCHAR AS smell_id, n_name AS type, (n_nationkey % 9)::INTEGER AS line FROM region JOIN nation ON n_regionkey = r_regionkey",
    "read_taxonomy": "SELECT n_nationkey::VARCHAR AS id, 'docker,' || n_name AS tools_csv, true AS named FROM nation",
    "read_scripts": f"SELECT item_id, md5(text || {NL}) AS content_md5 FROM benchmark",
    "read_recorded": f"WITH {KEYED} SELECT (doc_id // 100)::INTEGER AS page, repo, sha, path FROM keyed",
    "read_event_dump": f"WITH {KEYED} SELECT repo, unnest([sha, parent]) AS sha FROM keyed WHERE doc_id % 4 <> 3 AND doc_id % 3 <> 1",
    "scanner_findings": """WITH d AS (SELECT doc_id FROM documents),
checkov AS (SELECT doc_id, 'checkov' AS scanner, 'CKV_' || doc_id % 30 AS rule_id, CASE WHEN doc_id % 3 > 0 THEN 'HIGH' END AS severity, CASE WHEN doc_id % 2 = 0 THEN 'CWE-' || doc_id % 9 END AS cwe, (doc_id % 50)::INTEGER AS line, 200 AS message_chars FROM d WHERE doc_id % 4 <> 3),
twice AS (SELECT * FROM checkov UNION ALL SELECT * FROM checkov WHERE doc_id % 4 = 2),
kics AS (SELECT doc_id, 'kics' AS scanner, 'name' AS rule_id, 'INFO' AS severity, '250' AS cwe, unnest(range(1, doc_id % 3 + 2))::INTEGER AS line, 4 AS message_chars FROM d)
SELECT * FROM twice UNION ALL SELECT doc_id, 'tfsec', CASE WHEN doc_id % 2 = 0 THEN 'T1' ELSE 'long' END, 'LOW', NULL, (doc_id % 40)::INTEGER, 4 FROM d WHERE doc_id % 5 > 0 UNION ALL SELECT * FROM kics""",
    "cve_seeds": f"WITH {KEYED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id) AS k, CASE WHEN doc_id % 4 = 0 THEN 'Helm ' ELSE '' END || text AS said FROM keyed) WHERE k = 1 AND doc_id % 2 = 0) SELECT 'CVE-2024-' || doc_id % 500 AS cve_id, 'org' AS owner, substr(repo, 5) AS repo, sha AS commit_sha, {any_of('lower(said)', CODE_WORDS)} AS describes_code, md5(left(said, 500)) AS description_md5 FROM f",
    "commit_records": f"WITH {COMMITS}, r AS (SELECT repo, count(*)::INTEGER AS repo_stars, min(lang) AS repo_description FROM keyed GROUP BY 1) SELECT id, iac_tool, true AS has_fix, n_smells::INTEGER AS n_smells, md5(code_before) AS before_md5, code_before_quality, repo_stars, repo_description, length(left(nullif({FIRST_LINE}, ''), 500))::INTEGER AS message_chars FROM commits JOIN r USING (repo)",
    "code_records": f"WITH {KEYED}, {COUNTED} SELECT 'GH-' || left(sha256(repo || ':main:' || path), 12) AS id, {detect('path', 'text')} AS iac_tool, false AS has_fix, n::INTEGER AS n_smells, md5(text) AS before_md5, (doc_id % 100)::INTEGER AS repo_stars FROM keyed JOIN counted USING (doc_id) WHERE path NOT LIKE '%.md' AND length(text) <= 200000",
    "project_records": f"""WITH {KEYED}, {COUNTED},
f AS (SELECT k.*, {SAID} AS said, 'group/p' || doc_id % 7 AS grp, doc_id % 5 = 0 AS fresh, doc_id % 2 = 0 AS patched, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN nullif(text, '') END AS before, coalesce(n, 0) AS n FROM keyed k LEFT JOIN counted USING (doc_id) WHERE path NOT LIKE '%.md' AND doc_id % 5 <> 1),
g AS (SELECT *, CASE WHEN patched THEN {IN_PATCH} ELSE n END AS n_smells, {any_of('lower(said)', STRONG_KEYWORDS)} AS strong FROM f WHERE {any_of('lower(said)', MESSAGE_KEYWORDS)} AND (before IS NOT NULL OR patched)),
h AS (SELECT *, coalesce(before, {PLACED}) AS code_before, CASE WHEN fresh THEN 'new_file' WHEN before IS NOT NULL THEN 'api' ELSE 'unavailable' END AS code_before_quality FROM g WHERE n_smells > 0 OR {any_of('lower(said)', SIGNAL_KEYWORDS)})
SELECT 'GL-' || left(sha256(grp || ':' || sha || ':' || path), 12) AS id, {detect('path', f"coalesce(before, text || {NL} || 'fixed')")} AS iac_tool, true AS has_fix, n_smells::INTEGER AS n_smells, md5(code_before) AS before_md5, code_before_quality, said AS commit_message,
  CASE WHEN code_before_quality <> 'unavailable' AND (n_smells > 0 OR strong) THEN 'B' ELSE 'D' END AS tier FROM h""",
    "seed_records": f"WITH {COMMITS} SELECT id, 'cve_osv' AS source, 'cve_id=CVE-2024-' || doc_id % 500 AS notes FROM commits WHERE doc_id % 2 = 0 AND doc_id IN (SELECT min(doc_id) FROM documents GROUP BY doc_id % 500)",
    "dump_records": f"WITH {COMMITS} SELECT id, iac_tool, code_before_quality FROM commits WHERE doc_id % 4 <> 3 AND doc_id % 3 <> 1",
    "check_examples": "WITH " + example([("/pass_x", ".tf"), ("/fail_x", ".tf"), ("/main", ".tf"), ("/app", ".yml")], "tests/g") + ", " + paired("CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE n > 0 END", "checkov", "org/checks", "Checkov example group: "),
    "query_examples": "WITH " + example([("/test/positive", ".tf"), ("/test/negative", ".tf"), ("/x", ".yaml"), ("/x", ".rego")], "assets/queries/t/c/q") + ", " + paired("CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE n > 0 END", "kics", "org/queries", "KICS query: ", "doc_id % 4 <> 3"),
    "scanner_examples": "WITH " + example([("/bad/m", ".tf"), ("/good/m", ".tf"), ("/insecure/m", ".tf"), ("/plain/m", ".yaml")], "examples/") + f", t AS (SELECT *, {detect('path', 'text')} AS iac_tool FROM e) SELECT 'KR-' || left(sha256('org/scanner:' || path), 12) AS id, 'tfsec' AS source, iac_tool, false AS has_fix, n::INTEGER AS n_smells, CASE WHEN {any_of('path', GOOD_WORDS)} THEN md5(text) END AS after_md5, 'tfsec/defsec example: ' || path AS notes FROM t WHERE iac_tool <> 'unknown' AND (n > 0 OR {any_of('path', BAD_WORDS)})",
    "append_json": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents",
    "overwrite_json": "SELECT doc_id, lang FROM documents WHERE lang <> 'en'",
    "release_files": f"WITH {RELEASE} SELECT unnest(['full', 'gold', 'fix_pairs', 'detection']) AS output, unnest([count(*), count(*) FILTER (tier = 'A'), count(*) FILTER (tier IN ('A', 'B') AND has_fix), count(*) FILTER (tier IN ('A', 'B', 'C'))]) AS n FROM chosen",
    "split_files": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "manifest_file": FIRST["manifest_counts"],
    "text_file": "SELECT count(*) || ' documents' AS value FROM documents",
    "knowledge_upsert": "SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE '' END || text) AS text_md5 FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "stream_ingest": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "heuristic_truth": f"WITH {CHECKS} SELECT tp, fp, fn FROM sums",
    "evaluation_report": f"WITH {CHECKS}, r AS (SELECT tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM sums), v AS (SELECT unnest([0, 1, 2]) AS \"at\", unnest(['Precision', 'Recall', 'F1-Score']) AS metric, unnest([p, r, 2 * p * r / (p + r)]) AS value FROM r) SELECT \"at\", rpad(metric, 20, ' ') || ' ' || rpad('Detection', 15, ' ') || ' ' || lpad(printf('%.4f', value), 10, ' ') AS line FROM v",
    "path_filters": f"""WITH {KEYED}, y AS (SELECT *, {detect('path', 'text')} AS detected, path LIKE '%.yml' OR path LIKE '%.yaml' AS yaml, contains(left(text, 500), 'apiVersion:') AS v5, contains(left(text, 500), 'kind:') AS k5, contains(left(text, 500), 'hosts:') OR contains(left(text, 500), 'tasks:') AS h5, contains(left(text, 300), 'apiVersion:') AS v3, contains(left(text, 300), 'hosts:') OR contains(left(text, 300), 'tasks:') AS h3 FROM keyed)
SELECT doc_id, path NOT LIKE '%.md' AS config, doc_id % 5 NOT IN (1, 4) AS alive, doc_id % 2 = 0 AND detected <> 'unknown' AS sides, detected <> 'unknown' AS known, detected,
  CASE WHEN path LIKE '%.tf' THEN 'terraform' WHEN path LIKE '%/Dockerfile' THEN 'docker' {' '.join(f"WHEN regexp_matches(text, {Q(p)}) THEN {Q(t)}" for t, p in SIGNATURES)} ELSE 'unknown' END AS analyzed,
  CASE WHEN path LIKE '%.tf' THEN 'terraform' WHEN path LIKE '%/Dockerfile' THEN 'docker' WHEN yaml AND v5 AND k5 THEN 'kubernetes' WHEN yaml AND h5 THEN 'ansible' WHEN yaml THEN 'kubernetes' ELSE 'unknown' END AS guessed,
  CASE WHEN path LIKE '%.tf' THEN 'Terraform' WHEN path LIKE '%/Dockerfile' THEN 'Dockerfile' WHEN yaml AND v3 THEN 'Kubernetes' WHEN yaml AND h3 THEN 'Ansible' WHEN yaml THEN 'Kubernetes' ELSE 'Terraform' END AS platform FROM y""",
    "tree_files": f"WITH {KEYED} SELECT path FROM keyed WHERE doc_id % 9 > 0 AND path NOT LIKE '%.md' AND path LIKE '%m%' AND (doc_id % 7 = 0 OR length(text) * 100 <= 200000)",
    "example_sides": f"WITH {COUNTED} SELECT doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN 'positive' WHEN doc_id % 4 = 1 THEN 'negative' WHEN coalesce(n, 0) > 0 THEN 'positive' ELSE 'negative' END AS side FROM documents LEFT JOIN counted USING (doc_id)",
    "security_messages": f"SELECT doc_id, regexp_matches(text, {Q(SECURITY_MESSAGE)}) AS security, {any_of('lower(text)', CODE_WORDS)} AS describes_code FROM documents",
    "normalised_smells": f"WITH {RECORDS}, fresh AS (SELECT ord AS doc_id, coalesce(code_after, '') AS text FROM records WHERE diff IS NOT NULL), hits AS (SELECT doc_id, count(*) AS n, flatten(list([type, cwe, severity])) AS told FROM ({classify('fresh')}) GROUP BY 1) SELECT id, (n_smells + coalesce(n, 0))::INTEGER AS n_smells, array_to_string(list_sort(list_distinct(list_concat(smell_types, coalesce(told, []), [iac_tool]))), '|') AS labels FROM records LEFT JOIN hits ON doc_id = ord",
    "dedupe_smells": f"SELECT doc_id, len(list_distinct(list_transform(string_split(text, {NL}), lambda x, i: left(x, 2) || '|' || (i - 1) % 2)))::INTEGER AS n, len(list_distinct(list_transform(string_split(text, {NL}), lambda x, i: left(x, 2) || '|' || (i - 1) % 3)))::INTEGER AS n_analyzer FROM documents",
    "base64_contents": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "parsed_responses": f"SELECT doc_id, md5(CASE WHEN doc_id % 4 < 3 THEN '--- a/x' || {NL} || '+++ b/x' || {NL} || '+' || replace(replace(text, '`', ''), {NL}, {NL} || '+') || {NL} || '+end' ELSE 'no diff' END) AS patch_md5 FROM documents",
    "explanations": f"WITH {RECORDS} SELECT id, md5({explained()}) AS text_md5 FROM records",
    "cwe_lookup": f"WITH f(cwe, name) AS (VALUES {', '.join(f'({Q(c)}, {Q(n)})' for c, n in CWE_NAMES.items())}), t AS (SELECT 'CWE-' || (n_regionkey + 249) AS cwe, arg_max(n_name, n_nationkey) AS name FROM nation GROUP BY 1), d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'CWE-319' WHEN doc_id % 3 = 0 THEN 'CWE-' || (doc_id % 8 + 247) END AS cwe FROM documents) SELECT doc_id, d.cwe, coalesce(t.name, f.name, '') AS cwe_name FROM d LEFT JOIN t USING (cwe) LEFT JOIN f USING (cwe)",
    "chat_pairs": f"WITH {RECORDS}, u AS (SELECT * FROM records WHERE {USABLE}) SELECT id, 0 AS \"at\", 'user' AS role, md5({messages()} || {NL} || {NL} || '```' || {NL} || code_before || {NL} || '```') AS content_md5 FROM u UNION ALL SELECT id, 1, 'assistant', md5(code_after) FROM u",
    "diff_smells": f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, {NL}), lambda x, i: CASE i % 3 WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE ' ' END || x) AS ls FROM documents),
minus AS (SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: x[2:]), {NL}) AS text FROM l),
plus AS (SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: x[2:]), {NL}) AS text FROM l),
b AS (SELECT doc_id, string_agg(type, '|' ORDER BY type) AS before FROM ({classify('minus')}) GROUP BY 1), a AS (SELECT doc_id, string_agg(type, '|' ORDER BY type) AS after FROM ({classify('plus')}) GROUP BY 1)
SELECT doc_id, coalesce(before, '') AS before, coalesce(after, '') AS after FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "vulnerable_records": f"WITH {KEYED}, {COUNTED}, k AS (SELECT keyed.*, coalesce(n, 0) AS n, {detect('path', 'text')} AS iac_tool FROM keyed LEFT JOIN counted USING (doc_id) WHERE path NOT LIKE '%.md' AND length(text) <= 200000 AND text <> '') SELECT 'KR-' || left(sha256(repo || ':' || path), 12) AS id, iac_tool, n::INTEGER AS n_smells, md5(text) AS before_md5, 'Intentionally vulnerable: about ' || repo AS notes FROM k WHERE iac_tool <> 'unknown'",
    "salvaged": f"""WITH {RECORDS}, counted AS (SELECT doc_id, count(*) AS n FROM ({classify()}) GROUP BY 1), longer AS (SELECT doc_id, text || {NL} || 'fixed' AS text FROM documents), counted2 AS (SELECT doc_id, count(*) AS n2 FROM ({classify('longer')}) GROUP BY 1),
s AS (SELECT r.id, r.ord, code_before AS text, has_fix, coalesce(n, 0) AS n, coalesce(n2, 0) AS n2, ord % 3 = 0 AND (ord % 7 = 0 OR ord % 2 = 0) AS missing, ord % 7 = 0 AS added FROM records r LEFT JOIN counted c ON c.doc_id = ord LEFT JOIN counted2 d ON d.doc_id = ord)
SELECT id, CASE WHEN missing AND added THEN 'new_file' WHEN missing THEN 'heuristic' ELSE 'api' END AS code_before_quality, has_fix AND NOT (missing AND added) AS has_fix,
  (CASE WHEN missing AND added THEN n2 WHEN NOT added AND ord % 2 = 0 THEN {IN_PATCH} WHEN ord % 3 = 0 THEN {len(types_of('# ' + PLACEHOLDER))} ELSE n END)::INTEGER AS smells_added,
  md5(CASE WHEN missing AND added THEN '' WHEN missing THEN {UNDONE} WHEN ord % 3 = 0 THEN {Q('# ' + PLACEHOLDER)} ELSE text END) AS before_md5 FROM s""",
    "patch_round_trip": f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, {NL}), lambda x, i: CASE WHEN (i - 1) % 5 = 1 THEN x || ' changed' ELSE x END), {NL}) || {NL} || 'fixed' || {NL}) AS applied_md5, md5(text) AS undone_md5 FROM documents",
    "smells_table_function": f"SELECT doc_id, type FROM ({classify()})",
    "scanner_counts": f"WITH {RECORDS} SELECT * FROM (SELECT unnest(['checkov', 'tfsec']) AS scanner, unnest([count(*) FILTER (rule_before), count(*) FILTER (ord % 3 = 0)]) AS n FROM records) WHERE n > 0",
    "validated_counts": f"WITH {RECORDS} SELECT count(*) FILTER (rule_before OR ord % 3 = 0) AS validated_records, count(*) FILTER (rule_before AND NOT rule_after) AS scanner_confirmed_fixes FROM records",
    "scan_totals": f"WITH {COUNTED} SELECT lang AS check_type, sum({len({name for name, _ in rules.RULES})} - coalesce(n, 0))::BIGINT AS passed, sum(coalesce(n, 0))::BIGINT AS failed FROM documents LEFT JOIN counted USING (doc_id) GROUP BY 1",
    "run_statistics": "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd_sample, round(stddev_pop(value), 6) AS sd_population FROM events GROUP BY 1",
    "repository_lookup": f"WITH {KEYED}, r AS (SELECT repo, count(*)::INTEGER AS repo_stars, 'd' AS repo_description FROM keyed GROUP BY 1 HAVING count(*) > 2) SELECT doc_id, repo, repo_stars, repo_description FROM keyed LEFT JOIN r USING (repo)",
    "ordered_records": f"WITH {RECORDS} SELECT id, row_number() OVER (ORDER BY coalesce(source, ''), id) - 1 AS position FROM records",
    "head_sample": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
    "exact_sets": f"WITH {KEYED} SELECT lower(repo) AS repo, lang, min(doc_id) AS doc_id FROM keyed GROUP BY ALL",
    "token_bucket": "WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS arrival, (row_number() OVER w - 1) / 0.0001::DOUBLE AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(place + max(arrival - place) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS start FROM c",
    "breaker_pauses": "WITH r AS (SELECT *, (event_type = 'error')::INTEGER AS f, sum(1 - (event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events), o AS (SELECT *, sum(f) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM r), p AS (SELECT *, k > 0 AND k % 3 = 0 AS opens FROM o) SELECT event_id, opens, max(CASE WHEN opens THEN epoch_us(ts) + 600000000 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS paused_until_us FROM p",
    "backoff_delays": f"SELECT event_id, greatest(1, floor(least(300.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, event_id % 10)) * (0.75::DOUBLE + ({_HEX}) / 16777216.0::DOUBLE * 0.5::DOUBLE)))::BIGINT AS delay FROM events",
    "smells_sql_function": f"SELECT doc_id, type, md5(m) AS match_md5 FROM ({classify(whole=True)})",
    "validated_files": FIRST["validation_stats"],
    "load_order": "SELECT arg_min('D-' || doc_id, (doc_id % 37 <> 0, doc_id)) AS id, sha256(text) AS content_hash FROM documents GROUP BY 2",
    "read_planned": f"WITH {KEYED}, s AS (SELECT lang, ceil(count(*) / 100.0)::BIGINT AS n FROM documents GROUP BY 1), p AS (SELECT lang AS unit, (doc_id % n)::INTEGER AS page, sha FROM keyed JOIN s USING (lang)), w AS (SELECT * FROM p WHERE unit <> 'en' AND page >= 1) SELECT unit, page, sha, (SELECT count(DISTINCT (unit, page)) FROM w)::INTEGER AS pages_read, (SELECT count(DISTINCT (unit, page)) FROM p)::INTEGER AS pages FROM w",
    "planned_records": f"WITH {COMMITS} SELECT id, iac_tool, code_before_quality FROM commits WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING min(doc_id) % 2 <> 0)",
    "stream_recorded": f"WITH {KEYED}, s AS (SELECT lang, ceil(count(*) / 100.0)::BIGINT AS n FROM documents GROUP BY 1) SELECT lang AS unit, (doc_id % n)::INTEGER AS page, sha FROM keyed JOIN s USING (lang)",
    "resume_bucketed": FIRST["resume_anti_join"],
    "version_pairs_bucketed": FIRST["version_pairs"],
}
ORACLES["salvage_stats"] = f"SELECT count(*) AS total, count(*) FILTER (code_before_quality = 'exact') AS exact, count(*) FILTER (code_before_quality = 'partial') AS partial, count(*) FILTER (code_before_quality = 'unavailable') AS unrecoverable, sum(greatest(smells_added, 0))::BIGINT AS smells_added FROM ({ORACLES['salvaged']})"
