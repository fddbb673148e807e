"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
a policy is a versioned mask over those bits, so verdicts and ablations never touch the text again.

Defined cases: a null or empty text has no words and fails FEW_WORDS; repeated rows each get their own
ledger row; extra columns of the input are ignored (only ``doc_id`` and ``text`` are read), so clashing
names do no harm; an empty table gives an empty ledger. Windows are compared by a 64-bit hash, inside one
document only (for 20,000 words the chance of one collision is about 1e-11).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, split_words, whole_text

#: Rule name -> test over the measurements. The position is the bit; append only, never reorder.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("many_symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 5 * m["n_lines"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("few_letters", lambda m: 10 * m["n_letter_words"] < 5 * m["n_words"]),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: The two rules that every policy holds.
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


BASE = Policy("base", 1, BASE_MASK)
PRODUCTION = Policy("production", 1, sum(BIT.values()))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more, the first one included."""

    def positions(hashes: Column, repeated: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(repeated, hashes[i]))
        # Many repeated windows: neighbours in sorted order instead of a search per window.
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = let(
            ranked,
            lambda s: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == s[j]["h"])) | (F.get(s, j + 1)["h"] == s[j]["h"]),
                ),
                lambda j: s[j]["i"],
            ),
        )
        return F.when(F.size(repeated) <= 48, few).otherwise(many)

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.array(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))))

    def repeated_hashes(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, j: (j > 0) & (F.get(s, j - 1) == h))))

    def count(hashes: Column) -> Column:
        some = let(repeated_hashes(hashes), lambda r: let(positions(hashes, r), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(some)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, count))


def measure(text: Column) -> Column:
    """struct of the measurements of a text; one expression, so a filter on it evaluates nothing twice."""

    def counted(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(x["text"], F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(words, lambda w: w.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))).cast("long").alias("n_letter_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(text.alias("text"), split_words(text).alias("words"), lines.alias("lines")), counted)


def fail_bits(m: Column) -> Column:
    """Bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(test(m), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measurements and ``fail_bits``. All of it stays in the JVM and needs no shuffle."""
    both = let(measure(whole_text(text_col)), lambda m: F.struct(m.alias("m"), fail_bits(m).alias("fail_bits")))
    return docs.select(F.col(id_col), both.alias("_q")).select(id_col, "_q.m.*", "_q.fail_bits")


def apply_policy(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Adds the verdict of one policy; the ledger isn't evaluated anew."""
    return rows.withColumns(
        {
            "policy": F.lit(f"{policy.name}-v{policy.version}"),
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0,
        }
    )


def ablation(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Rows are counted per distinct mask first, so at most 2^rules rows reach the second step.
    """
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("b")) for n, _ in RULES if BIT[n] & policy.mask]))
    hit = F.col("m").bitwiseAND(F.col("r.b"))
    return (
        masks.select("m", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when((hit != 0) & (F.col("m") == F.col("r.b")), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.b"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def with_ablation(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Adds ``only_rule``, the rule without which the policy would keep a document, and ``only_rule_n``, how many documents hang on that rule alone.

    ``rows`` is a ledger that was cut; the ablation is a table of as many rows as there are rules.
    """
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    alone = F.coalesce(*[F.when(failed == F.lit(BIT[n]), F.lit(n)) for n, _ in RULES if BIT[n] & policy.mask])
    only = F.broadcast(ablation(rows, policy).select(F.col("rule").alias("only_rule"), F.col("n_only").cast("long").alias("only_rule_n")))
    return rows.withColumn("only_rule", alone).join(only, "only_rule", "left")


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The document rows that a policy keeps, with their columns as they are: a filter, without a join."""
    return docs.filter(let(measure(whole_text(text_col)), fail_bits).bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0)
