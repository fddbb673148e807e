"""SQL surface: the rules as a table function that SQL itself defines, so that queries in SQL stay native and share the rules' one dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules


def smells_of(docs: DataFrame, text: str) -> DataFrame:
    """Row to smell rows, natively; the way to use in pipelines."""
    lowered = docs.withColumn("_low", F.lower(text))
    return lowered.select(*docs.columns, F.explode(rules.annotations(F.col(text), F.col("_low"))).alias("smell"))


def _literal(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def smells_sql(text: str = "t") -> str:
    """array<struct<type, match>> of a text as SQL: per type the first pattern that matches. Text and lower case are evaluated once, patterns only where a literal that they need is."""
    lists: dict[str, list[str]] = {}
    for name, patterns in rules.RULES:
        lists.setdefault(name, []).extend(patterns)

    def hit(pattern: str) -> str:
        match = f"nullif(regexp_extract(x.t, {_literal('(?im)' + pattern)}, 0), '')"
        held = " OR ".join(f"contains(x.low, {_literal(guard)})" for guard in rules.guards(pattern))
        every = " AND ".join([*(f"x.s{ord(c)}" for c in rules.required_signs(pattern)), *([f"({held})"] if held else [])])
        return f"CASE WHEN {every} THEN {match} END" if every else match

    told = sorted({c for patterns in lists.values() for p in patterns for c in rules.required_signs(p)})
    signs = ", ".join(f"'s{ord(c)}', contains(y.low, {_literal(c)})" for c in told)

    found = ", ".join(f"named_struct('type', {_literal(name)}, 'match', coalesce({', '.join(map(hit, patterns))}))" for name, patterns in lists.items())
    once = f"transform(array(named_struct('t', {text}, 'low', lower({text}))), y -> named_struct('t', y.t, 'low', y.low, {signs}))"
    return f"transform({once}, x -> filter(array({found}), y -> y.match IS NOT NULL))[0]"


def register(spark: SparkSession) -> None:
    """Registers, as functions that SQL itself defines, both without Python:

    * ``smell_list(text)``: array<struct<type, match>>, an expression of the scan: SELECT id, s.* FROM (SELECT id, smell_list(text) AS found FROM docs) LATERAL VIEW inline(found) s. For large tables.
    * ``smells(text)``: rows (type, match): SELECT id, s.* FROM docs, LATERAL smells(text) s. Spark joins its rows back by the text, each different text classified once.
    """
    found = "ARRAY<STRUCT<type: STRING, match: STRING>>"
    # A generator can't refer to the outer row itself; nullif has Spark evaluate the list in a projection before it.
    listed = f"nullif({smells_sql()}, CAST(array() AS {found}))"
    for name, body in (("smell_list", f"RETURNS {found} RETURN {smells_sql()}"), ("smells", f"RETURNS TABLE(type STRING, match STRING) RETURN SELECT type, match FROM inline({listed})")):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        spark.sql(f"CREATE TEMPORARY FUNCTION {name}(t STRING) {body}")
