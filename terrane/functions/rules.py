"""Smell rules as data, compiled to native expressions.

A rule is (type, patterns in order); the first pattern that matches wins, and a type fires at most once per text. Patterns
are literals, so each is compiled once per task; a literal that a pattern can't match without guards it.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smell patterns in evaluation order. Types listed twice have a second list, tried only where the first misses.
RULES: list[tuple[str, list[str]]] = [
    ("hardcoded_password", [
        r'password\s*[=:]\s*["\'][^"\'$\{\}\s]{3,}["\']',
        r'passwd\s*[=:]\s*["\'][^"\'$\{\}\s]{3,}["\']',
        r'db_password\s*=\s*["\'][^"\'$]{3,}["\']',
        r'MYSQL_ROOT_PASSWORD\s*[:=]\s*["\'][^"\'$]{3,}["\']']),
    ("hardcoded_credential", [
        r'access_key\s*=\s*["\'][A-Z0-9]{16,}["\']',
        r'secret_key\s*=\s*["\'][^"\'$\{\}\s]{16,}["\']',
        r'aws_access_key_id\s*=\s*["\'][A-Z0-9]{20}["\']',
        r'aws_secret_access_key\s*=\s*["\'][^"\'$]{30,}["\']',
        r'api_key\s*=\s*["\'][^"\'$\{\}\s]{16,}["\']',
        r'token\s*=\s*["\'][^"\'$\{\}\s]{16,}["\']',
        r'private_key\s*=\s*["\'][^"\'$\{\}\s]{10,}["\']']),
    ("overly_permissive_cidr", [r'0\.0\.0\.0/0', r'::/0', r'cidr_blocks\s*=\s*\["0\.0\.0\.0/0"\]', r'ipv6_cidr_blocks\s*=\s*\["::/0"\]']),
    ("overly_permissive_acl", [r'acl\s*=\s*["\']public-read["\']', r'acl\s*=\s*["\']public-read-write["\']', r'acl\s*=\s*["\']authenticated-read["\']']),
    ("privileged_container", [r'privileged\s*:\s*true', r'"Privileged"\s*:\s*true', r'privileged\s*=\s*true']),
    ("root_user", [r'^\s*USER\s+root\s*$', r'runAsUser\s*:\s*0\b', r'runAsNonRoot\s*:\s*false']),
    ("allow_privilege_escalation", [r'allowPrivilegeEscalation\s*:\s*true']),
    ("missing_encryption", [r'encrypted\s*=\s*false', r'enable_encryption\s*=\s*false', r'storage_encrypted\s*=\s*false', r'kms_key_id\s*=\s*["\']["\']']),
    ("public_access_block_disabled", [r'block_public_acls\s*=\s*false', r'block_public_policy\s*=\s*false', r'ignore_public_acls\s*=\s*false', r'restrict_public_buckets\s*=\s*false']),
    ("versioning_disabled", [r'versioning\s*\{[^}]*enabled\s*=\s*false']),
    ("logging_disabled", [r'logging\s*=\s*false', r'enable_logging\s*=\s*false', r'access_log\s*\{\s*\}']),
    ("insecure_tls", [
        r'ssl_policy\s*=\s*["\']ELBSecurityPolicy-2015-05["\']',
        r'minimum_protocol_version\s*=\s*["\']TLSv1["\']',
        r'tls_version\s*=\s*["\']TLS1_0["\']',
        r'min_tls_version\s*=\s*["\']TLS_1_0["\']']),
    ("missing_resource_limits", [r'resources\s*:\s*\{\}', r'resources\s*:\s*$']),
    ("unpinned_base_image", [r'FROM\s+\S+:latest\b', r'FROM\s+(?!scratch)\S+\s*$']),
    ("secrets_in_env", [
        r'env\s*:\s*\n\s+-\s+name:\s+\w*(PASSWORD|SECRET|KEY|TOKEN)\w*\s*\n\s+value:\s*\S+',
        r'ENV\s+\w*(PASSWORD|SECRET|KEY|TOKEN)\w*\s*=\s*[^\$\{\}\n]+',
        r'SECRET\s*=\s*["\'][^"\'$\{\}]{6,}["\']']),
    ("overly_permissive_iam", [
        r'"Action"\s*:\s*"\*"',
        r'"Action"\s*:\s*\[\s*"\*"\s*\]',
        r'"Resource"\s*:\s*"\*"',
        r'"Resource"\s*:\s*\[\s*"\*"\s*\]',
        r'actions\s*=\s*\[\s*"\*"\s*\]',
        r'resources\s*=\s*\[\s*"\*"\s*\]',
        r'effect\s*=\s*["\']Allow["\'].*actions.*\*',
        r'apiGroups\s*:\s*\[\s*["\']?\*["\']?\s*\]',
        r'verbs\s*:\s*\[\s*["\']?\*["\']?\s*\]']),
    ("cors_wildcard", [
        r'allowed_origins\s*=\s*\[\s*["\']\*["\']\s*\]',
        r'"AllowedOrigins"\s*:\s*\[\s*"\*"\s*\]',
        r'allowedOrigins\s*:\s*\[\s*["\']?\*["\']?\s*\]',
        r'Access-Control-Allow-Origin[:=]\s*["\']?\*']),
    ("weak_hash", [r'\b(md5|sha1)\s*\(', r'["\'](md5|sha1)["\']', r'digest\s*[:=]\s*["\']?(md5|sha1)\b', r'signature_algorithm\s*=\s*["\']?(md5|sha1)\w*["\']?']),
    ("plaintext_protocol", [
        r'https?://[^/\s"\']*:[^/\s"\']+@',
        r'protocol\s*=\s*["\']HTTP["\']',
        r'"Protocol"\s*:\s*"HTTP"',
        r'use_https\s*=\s*false',
        r'enforce_ssl\s*=\s*false',
        r'force_ssl\s*=\s*false',
        r'insecure\s*[:=]\s*true']),
    ("deletion_protection_disabled", [r'deletion_protection\s*=\s*false', r'enable_deletion_protection\s*=\s*false', r'"DeletionProtection"\s*:\s*false']),
    ("backup_disabled", [
        r'backup_retention_period\s*=\s*0\b',
        r'backup_retention_days\s*=\s*0\b',
        r'"BackupRetentionPeriod"\s*:\s*0\b',
        r'point_in_time_recovery\s*\{[^}]*enabled\s*=\s*false',
        r'skip_final_snapshot\s*=\s*true']),
    ("no_mfa", [r'mfa_delete\s*=\s*false', r'"MFADelete"\s*:\s*"Disabled"', r'require_mfa\s*=\s*false']),
    ("image_pull_policy_not_always", [r'imagePullPolicy\s*:\s*(IfNotPresent|Never)\b']),
    ("read_only_fs_disabled", [r'readOnlyRootFilesystem\s*:\s*false']),
    ("service_account_token_auto_mount", [r'automountServiceAccountToken\s*:\s*true']),
    ("uri_credentials", [
        r'(postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^/\s"\']+:[^/\s"\']+@',
        r'smtp://[^/\s"\']+:[^/\s"\']+@',
        r'ftp://[^/\s"\']+:[^/\s"\']+@']),
    ("latest_image_tag", [r'image\s*:\s*\S+:latest\b', r'FROM\s+\S+:latest\b']),
    ("apt_no_install_recommends", [r'apt-get\s+install\s+(?!.*--no-install-recommends)']),
    ("host_namespace_shared", [r'hostNetwork\s*:\s*true', r'hostPID\s*:\s*true', r'hostIPC\s*:\s*true']),
    ("capabilities_added", [r'^\s+-\s+(ALL|SYS_ADMIN|NET_ADMIN|NET_RAW|SYS_PTRACE|SYS_MODULE)\s*$', r'"Capabilities"\s*:.*?"(ALL|SYS_ADMIN|NET_ADMIN|NET_RAW)"']),
    ("imds_v1", [r'http_tokens\s*=\s*["\']optional["\']', r'"HttpTokens"\s*:\s*"optional"']),
    ("ssh_port_open_world", [r'from_port\s*=\s*22\b[^}]*cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"', r'"FromPort"\s*:\s*22\b[\s\S]{0,400}"CidrIp"\s*:\s*"0\.0\.0\.0/0"']),
    ("rdp_port_open_world", [r'from_port\s*=\s*3389\b[^}]*cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"', r'"FromPort"\s*:\s*3389\b[\s\S]{0,400}"CidrIp"\s*:\s*"0\.0\.0\.0/0"']),
    ("validate_certs_disabled", [r'validate_certs\s*:\s*(no|false)', r'verify\s*=\s*False\b', r'ssl_verify\s*=\s*false', r'insecure_skip_verify\s*=\s*true']),
    ("become_root", [r'become\s*:\s*(yes|true)\b[\s\S]{0,200}become_user\s*:\s*root']),
    ("no_log_disabled", [r'no_log\s*:\s*(no|false)\b']),
    ("insecure_tls", [
        r'ssl_policy\s*=\s*["\']ELBSecurityPolicy-(2015|2016)',
        r'minimum_protocol_version\s*=\s*["\']TLSv1(\.1)?["\']',
        r'tls_version\s*=\s*["\']TLS1_[01]["\']',
        r'min_tls_version\s*=\s*["\']TLS_1_[01]["\']',
        r'minimumTlsVersion\s*[:=]\s*["\']?(1\.0|1\.1|TLS1_[01])',
        r'sslProtocols?\s*[:=].*(SSLv[23]|TLSv1\.0|TLSv1\.1)']),
    ("missing_encryption", [
        r'encrypted\s*=\s*false',
        r'enable_encryption\s*=\s*false',
        r'storage_encrypted\s*=\s*false',
        r'kms_key_id\s*=\s*["\']["\']',
        r'"Encrypted"\s*:\s*false',
        r'server_side_encryption_configuration\s*\{[^}]*rule[^}]*sse_algorithm\s*=\s*["\']AES256["\']\s*\}',
        r'at_rest_encryption_enabled\s*=\s*false',
        r'transit_encryption_enabled\s*=\s*false']),
    ("hardcoded_credential", [
        r'access_key\s*=\s*["\'][A-Z0-9]{16,}["\']',
        r'secret_key\s*=\s*["\'][^"\'$\{\}\s]{16,}["\']',
        r'aws_access_key_id\s*=\s*["\']AKIA[A-Z0-9]{16}["\']',
        r'aws_secret_access_key\s*=\s*["\'][^"\'$]{30,}["\']',
        r'api_key\s*=\s*["\'][^"\'$\{\}\s]{16,}["\']',
        r'token\s*=\s*["\'][A-Za-z0-9_\-]{20,}["\']',
        r'bearer\s+[A-Za-z0-9_\-\.]{20,}',
        r'ghp_[A-Za-z0-9]{30,}',
        r'xox[baprs]-[A-Za-z0-9\-]{10,}',
        r'-----BEGIN\s+(RSA|OPENSSH|EC|PGP|DSA|PRIVATE)\s+PRIVATE\s+KEY-----']),
    ("logging_disabled", [
        r'logging\s*=\s*false',
        r'enable_logging\s*=\s*false',
        r'"LoggingEnabled"\s*:\s*false',
        r'enable_cloudwatch_logs_exports\s*=\s*\[\s*\]',
        r'access_logs\s*\{[^}]*enabled\s*=\s*false',
        r'audit_logs\s*\{[^}]*enabled\s*=\s*false',
        r'flow_log_config\s*\{[^}]*enabled\s*=\s*false']),
    ("missing_resource_limits", [r'resources\s*:\s*\{\s*\}', r'^\s*resources\s*:\s*$']),
]
#: Type, CWE, severity, category, check ids.
TAXONOMY: list[tuple[str, str, str, str, list[str]]] = [
    ("hardcoded_password", "CWE-259", "HIGH", "Security", ["CKV_SECRET_*"]),
    ("hardcoded_credential", "CWE-798", "CRITICAL", "Security", ["CKV_AWS_41", "CKV_SECRET_*"]),
    ("overly_permissive_cidr", "CWE-732", "HIGH", "Security", ["CKV_AWS_25", "CKV_AWS_277"]),
    ("overly_permissive_acl", "CWE-732", "HIGH", "Security", ["CKV_AWS_20"]),
    ("privileged_container", "CWE-250", "HIGH", "Security", ["CKV_K8S_16", "CKV_DOCKER_5"]),
    ("root_user", "CWE-250", "MEDIUM", "Security", ["CKV_K8S_6", "CKV_DOCKER_8"]),
    ("missing_encryption", "CWE-312", "HIGH", "Security", ["CKV_AWS_19", "CKV_AWS_7"]),
    ("public_access_block_disabled", "CWE-732", "HIGH", "Security", ["CKV_AWS_53", "CKV_AWS_54"]),
    ("versioning_disabled", "CWE-693", "LOW", "Configuration Data", ["CKV_AWS_52"]),
    ("logging_disabled", "CWE-778", "MEDIUM", "Configuration Data", ["CKV_AWS_18", "CKV_AWS_86"]),
    ("unencrypted_database", "CWE-312", "HIGH", "Security", ["CKV_AWS_16", "CKV_AWS_17"]),
    ("insecure_tls", "CWE-326", "HIGH", "Security", ["CKV_AWS_84", "CKV_AWS_68"]),
    ("missing_resource_limits", "CWE-400", "MEDIUM", "Configuration Data", ["CKV_K8S_11", "CKV_K8S_13"]),
    ("allow_privilege_escalation", "CWE-250", "HIGH", "Security", ["CKV_K8S_20"]),
    ("unpinned_base_image", "CWE-1357", "MEDIUM", "Dependency", ["CKV_DOCKER_6"]),
    ("secrets_in_env", "CWE-798", "CRITICAL", "Security", ["CKV_K8S_35", "CKV_DOCKER_3"]),
    ("overly_permissive_iam", "CWE-732", "HIGH", "Security", ["CKV_AWS_40", "CKV_AWS_274"]),
    ("missing_network_policy", "CWE-923", "MEDIUM", "Security", ["CKV_K8S_7"]),
    ("cors_wildcard", "CWE-942", "MEDIUM", "Security", ["CKV_AWS_65"]),
    ("weak_hash", "CWE-327", "HIGH", "Security", ["CKV_AWS_145"]),
    ("plaintext_protocol", "CWE-319", "HIGH", "Security", ["CKV_AWS_103"]),
    ("deletion_protection_disabled", "CWE-693", "MEDIUM", "Configuration Data", ["CKV_AWS_28"]),
    ("backup_disabled", "CWE-693", "MEDIUM", "Configuration Data", ["CKV_AWS_118"]),
    ("no_mfa", "CWE-308", "HIGH", "Security", ["CKV_AWS_171"]),
    ("image_pull_policy_not_always", "CWE-1357", "LOW", "Dependency", ["CKV_K8S_15"]),
    ("readiness_probe_missing", "CWE-754", "LOW", "Configuration Data", ["CKV_K8S_9"]),
    ("liveness_probe_missing", "CWE-754", "LOW", "Configuration Data", ["CKV_K8S_8"]),
    ("read_only_fs_disabled", "CWE-732", "MEDIUM", "Security", ["CKV_K8S_22"]),
    ("service_account_token_auto_mount", "CWE-250", "MEDIUM", "Security", ["CKV_K8S_38"]),
    ("uri_credentials", "CWE-798", "HIGH", "Security", ["CKV_SECRET_*"]),
    ("latest_image_tag", "CWE-1357", "MEDIUM", "Dependency", ["CKV_DOCKER_7"]),
    ("missing_healthcheck", "CWE-754", "LOW", "Configuration Data", ["CKV_DOCKER_2"]),
    ("apt_no_install_recommends", "CWE-1357", "LOW", "Dependency", ["CKV_DOCKER_9"]),
    ("host_namespace_shared", "CWE-250", "HIGH", "Security", ["CKV_K8S_1", "CKV_K8S_2", "CKV_K8S_3"]),
    ("capabilities_added", "CWE-250", "HIGH", "Security", ["CKV_K8S_37"]),
    ("imds_v1", "CWE-862", "HIGH", "Security", ["CKV_AWS_79"]),
    ("ssh_port_open_world", "CWE-732", "CRITICAL", "Security", ["CKV_AWS_24"]),
    ("rdp_port_open_world", "CWE-732", "CRITICAL", "Security", ["CKV_AWS_25"]),
    ("validate_certs_disabled", "CWE-295", "HIGH", "Security", []),
    ("become_root", "CWE-250", "MEDIUM", "Security", []),
    ("no_log_disabled", "CWE-532", "MEDIUM", "Security", []),
]
#: Line heuristics (pattern, type, CWE); every hit counts.
HEURISTICS: list[tuple[str, str, str]] = [
    (r'password\s*=\s*"[^"]+"', "hardcoded_secret", "CWE-259"),
    (r'secret\s*=\s*"[^"]+"', "hardcoded_secret", "CWE-259"),
    (r'(api[_-]?key|token|secret|password)\s*[:=]\s*["\'][^"\']+["\']', "hardcoded_secret", "CWE-259"),
    (r'access_key\s*=\s*"[^"]+"', "hardcoded_credential", "CWE-798"),
    (r"0\.0\.0\.0/0", "overly_permissive_cidr", "CWE-732"),
    (r"privileged\s*:\s*true", "privileged_container", "CWE-250"),
    (r"allowPrivilegeEscalation\s*:\s*true", "privilege_escalation_allowed", "CWE-250"),
    (r"runAsRoot\s*:\s*true", "run_as_root", "CWE-250"),
    (r"runAsNonRoot\s*:\s*false", "run_as_root", "CWE-250"),
    (r"validate_certs\s*:\s*(no|false)", "tls_disabled", "CWE-295"),
    (r"mode\s*[=:]\s*['\"]?0?777", "world_writable", "CWE-732"),
    (r"PasswordAuthentication\s+yes", "ssh_password_auth_enabled", "CWE-287"),
    (r"NOPASSWD", "passwordless_sudo", "CWE-250"),
    (r"curl\b.*\|\s*(sh|bash)", "remote_script_without_integrity", "CWE-494"),
    (r"wget\b.*\|\s*(sh|bash)", "remote_script_without_integrity", "CWE-494"),
    (r"chmod\s+(u\+s|g\+s|[0-7]*[46][0-7]{3})", "setuid_setgid_binary", "CWE-269"),
    (r"^\s*FROM\s+\S+:latest\b", "unpinned_base_image", "CWE-829"),
    (r"readOnlyRootFilesystem\s*:\s*false", "writable_root_filesystem", "CWE-732"),
]
FLAGS = "(?imd)"


def _runs(pattern: str) -> list[str]:
    """Runs of plain characters that every match of a pattern holds."""
    runs, run, i = [""], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[i], 0) if pattern[i - 1] != "\\" else 0
                if depth == 0:
                    break
                i += 1
            c = None
        elif c == "[":
            i = pattern.index("]", i + 1)
            c = None
        elif c == "\\":
            i += 1
            c = None if pattern[i].isalnum() else pattern[i]
        elif c in "^$.":
            c = None
        elif c in "?*+{":
            run = run[:-1] if c in "?*" or (c == "{" and pattern[i + 1] == "0") else run
            i = pattern.index("}", i) if c == "{" else i
            c = None
        if c is None:
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [*runs, run]


def required_literal(pattern: str) -> str | None:
    """The longest run of plain characters that every match of a pattern holds, in lower case; None if shorter than three."""
    best = max(_runs(pattern), key=len)
    return best.lower() if len(best) >= 3 else None


def required_signs(pattern: str) -> list[str]:
    """Signs, neither letters nor digits nor white space, that every match of a pattern holds."""
    return sorted({c for run in _runs(pattern) for c in run if not c.isalnum() and not c.isspace()})


def guards(pattern: str) -> list[str]:
    """Literals in lower case of which every match of a pattern holds one: its longest run, else the alternatives of its first group; none if any is shorter than three."""
    if one := required_literal(pattern):
        return [one]
    group = re.search(r"\((\w+(?:\|\w+)+)\)(?![?*{])", pattern)
    words = group[1].lower().split("|") if group else []
    return words if all(len(w) >= 3 for w in words) else []


def first_match(text: Column, lowered: Column, patterns: list[str], signs: Column | None = None) -> Column:
    """The text that the first matching pattern matches, or null. ``signs`` holds, in fields named by their codes, which signs the text has; prose has few of them, so it is seldom searched for more."""
    found = []
    for pattern in patterns:
        hit = F.nullif(F.regexp_extract(text, FLAGS + pattern, 0), F.lit(""))
        held = [lowered.contains(guard) for guard in guards(pattern)]
        told = [signs[f"s{ord(c)}"] for c in required_signs(pattern)] if signs is not None else []
        every = [*told, *([functools.reduce(operator.or_, held)] if held else [])]
        found.append(F.when(functools.reduce(operator.and_, every), hit) if every else hit)
    return F.coalesce(*found)


def annotations(text: Column, lowered: Column, rules: list[tuple[str, list[str]]] = RULES, taxonomy: list = TAXONOMY) -> Column:
    """array<struct<type, cwe, checkov_id, severity, category, description, match>> of all smells of a text, in rule order.

    Every list is evaluated once; a type's second list only where its first one missed. So are the text and its lower case, which Spark
    would else compute anew for each guard, as it shares nothing inside of array functions.
    """
    once = F.struct(text.alias("text"), lowered.alias("lowered"))
    told = sorted({c for _, patterns in rules for p in patterns for c in required_signs(p)})
    signs = lambda x: F.struct(x["text"].alias("text"), x["lowered"].alias("lowered"), F.struct(F.lit(True).alias("any"), *[x["lowered"].contains(c).alias(f"s{ord(c)}") for c in told]).alias("signs"))
    return F.transform(F.transform(F.array(once), signs), lambda x: _annotations(x["text"], x["lowered"], x["signs"], rules, taxonomy))[0]


def _annotations(text: Column, lowered: Column, signs: Column, rules: list[tuple[str, list[str]]], taxonomy: list) -> Column:
    facts = {name: (cwe, ids[0] if ids else None, severity, category) for name, cwe, severity, category, ids in taxonomy}
    first: dict[str, list[str]] = {}
    second: list[tuple[str, list[str]]] = []
    for name, patterns in rules:
        if name in first:
            second.append((name, patterns))
        else:
            first[name] = patterns
    place = {name: i for i, name in enumerate(first)}
    names = [*first, *[name for name, _ in second]]
    told = lambda i: F.array(*[F.lit(facts.get(name, (None,) * 4)[i]).cast("string") for name in names])

    def both(found: Column) -> Column:
        later = [F.when(found[place[name]].isNull(), first_match(text, lowered, patterns, signs)) for name, patterns in second]
        return F.concat(found, F.array(*later)) if later else found

    def described(match: Column, i: Column) -> Column:
        at = lambda k: F.get(told(k), i)
        return F.struct(F.get(F.array(*[F.lit(n) for n in names]), i).alias("type"), at(0).alias("cwe"), at(1).alias("checkov_id"), at(2).alias("severity"), at(3).alias("category"), F.concat(F.lit("Pattern match: "), F.left(match, F.lit(80))).alias("description"), match.alias("match"))

    found = F.array(*[first_match(text, lowered, patterns, signs) for patterns in first.values()])
    every = F.transform(F.array(found), both)[0]
    return F.filter(F.transform(every, lambda m, i: F.when(m.isNotNull(), described(m, i))), lambda x: x.isNotNull())


def smells(text: Column, lowered: Column | None = None) -> Column:
    """array<struct<type, cwe, checkov_id, severity, category, description, line_number>>; the rules tell no line."""
    found = annotations(text, F.lower(text) if lowered is None else lowered)
    fields = ("type", "cwe", "checkov_id", "severity", "category", "description")
    return F.transform(found, lambda s: F.struct(*[s[f].alias(f) for f in fields], F.lit(None).cast("int").alias("line_number")))
