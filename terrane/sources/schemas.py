"""Explicit schemas: a fixed core with the known extensions, so reading never infers."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SMELL = struct(type=S, cwe=S, checkov_id=S, severity=S, category=S, description=S, line_number=I)
FINDING = struct(scanner=S, rule_id=S, severity=S, cwe=S, line=I, message=S, direction=S)
RECORD = struct(
    id=S, source=S, iac_tool=S, file_path=S, code_before=S, code_after=S, diff=S, has_fix=B, smells=T.ArrayType(SMELL), labels=T.ArrayType(S),
    repo=S, repo_stars=I, repo_description=S, commit_sha=S, parent_sha=S, commit_message=S, commit_date=S, commit_author=S,
    split=S, content_hash=S, scraped_at=S, notes=S, code_before_quality=S, tier=S, validated_smells=T.ArrayType(FINDING),
    validated_smells_before=T.ArrayType(FINDING), validated_smells_after=T.ArrayType(FINDING), validation_scanners=T.ArrayType(S), source_version=S,
)
REQUIRED = ("id", "source", "iac_tool", "file_path", "code_before", "code_after", "diff", "has_fix")
TRUTH = struct(files=T.ArrayType(struct(id=S, file=S, iac_tool=S, smells=T.ArrayType(struct(smell_id=S, type=S, line=I, cwe=S, checkov_id=S, description=S, category=S)))))
TAXONOMY = struct(id=S, name=S, category=S, description=S, cwe=S, iac_tools=T.ArrayType(S), fix_example=S)
PUSH = struct(type=S, repo=struct(name=S), payload=struct(head=S, commits=T.ArrayType(struct(sha=S))))
CVE = struct(cve=struct(id=S, descriptions=T.ArrayType(struct(lang=S, value=S)), references=T.ArrayType(struct(url=S))))
CHECK = struct(check_id=S, check_name=S, severity=S, resource=S, file_line_range=T.ArrayType(I), guideline=S)
SCAN = struct(check_type=S, results=struct(failed_checks=T.ArrayType(CHECK), passed_checks=T.ArrayType(CHECK)), summary=struct(passed=I, failed=I))
SEED = struct(cve_id=S, owner=S, repo=S, commit_sha=S, description=S)
TFSEC = struct(results=T.ArrayType(struct(rule_id=S, long_id=S, severity=S, description=S, location=struct(start_line=I))))
KICS = struct(queries=T.ArrayType(struct(query_id=S, query_name=S, severity=S, cwe=S, files=T.ArrayType(struct(line=I)))))
#: Answers of hosting services: a commit with its files, a code search hit, a commit of the other service with its changes, its project.
COMMIT = struct(
    repo=S, sha=S, parents=T.ArrayType(struct(sha=S)), commit=struct(message=S, author=struct(name=S, date=S)),
    files=T.ArrayType(struct(filename=S, status=S, patch=S, raw_url=S)),
)
CODE_ITEM = struct(path=S, repository=struct(full_name=S, default_branch=S, stargazers_count=I, description=S))
CHANGE = struct(new_path=S, old_path=S, deleted_file=B, new_file=B, diff=S)
PROJECT_COMMIT = struct(id=S, project_id=T.LongType(), parent_ids=T.ArrayType(S), message=S, title=S, author_name=S, committed_date=S, diffs=T.ArrayType(CHANGE))
PROJECT = struct(id=T.LongType(), path_with_namespace=S, star_count=I, description=S)
