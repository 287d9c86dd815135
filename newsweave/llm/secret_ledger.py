"""Secret scans over a ledger of blobs.

Every version of every path is addressed by its content. The ledger records which
rule versions a blob was scanned with and what they found, so that a later run scans
only pairs of blob and rule version it has not seen; findings are joined back to all
paths that ever held the blob.

Null and empty texts are the same blob, without findings. Rows that repeat are kept and get
the same findings. Columns of the input besides the text pass through untouched.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm.columns import joined_spans, matches

LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:bigint,end:bigint>>"
FOUND = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a new version makes every blob unseen for it."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns, their order and least lengths.
BASE = [
    Rule(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        at_least=8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", at_least=16),
    Rule("hex", "[0-9a-f]{32,}", at_least=32),
]
# What this scan adds: heads of private keys, and passwords inside addresses.
ADDED = [
    Rule("pem", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("login", "://[^\\s:/?#@]+:[^\\s:/?#@]+@"),
]
RULES = [*BASE, *ADDED]


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty where nothing was scanned yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def unseen_pairs(versions: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """Blobs with the rule versions still to run on them: blob, text, missing.

    Copies shrink to one row per task before the shuffle, so a text on a third of all
    rows is scanned once and moved a few times.
    """
    blobs = (
        versions.select(F.coalesce("text", F.lit("")).alias("text"))
        .groupBy(content_address(F.col("text")).alias("blob"))
        .agg(F.any_value("text").alias("text"))
    )
    seen = ledger.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
    )
    wanted = F.array(*[F.lit(rule.name) for rule in rules]).cast("array<string>")
    known = F.coalesce("seen", F.array().cast("array<string>"))
    return (
        blobs.join(seen, "blob", "left")
        .select("blob", "text", F.array_except(wanted, known).alias("missing"))
        .where(F.size("missing") > 0)
    )


def extend_ledger(versions: DataFrame, path: str, rules: list[Rule] = RULES) -> None:
    """Scan the unseen pairs of ``versions`` (a column ``text``) and append them to the ledger."""
    todo = unseen_pairs(versions, read_ledger(versions.sparkSession, path), rules)
    nothing = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    found = [
        F.when(F.array_contains("missing", rule.name), _scan(F.col("text"), rule)).otherwise(nothing)
        for rule in rules
    ]
    todo.select(
        "blob", F.col("missing").alias("rules"), F.flatten(F.array(*found)).alias("found")
    ).write.mode("append").parquet(path)


def _scan(text: Column, rule: Rule) -> Column:
    passing = F.filter(
        matches(text, rule.pattern, rule.group), lambda m: F.length(m["value"]) >= rule.at_least
    )
    return F.transform(
        passing, lambda m: F.struct(F.lit(rule.name).alias("rule"), m["start"], m["end"])
    )


def findings(versions: DataFrame, path: str, rules: list[Rule] = RULES) -> DataFrame:
    """``versions`` without its text, with ``found``: spans by start, then by order of ``rules``.

    Only blobs with findings take part in the join; copies of one blob are a skewed key of a
    plain join, which adaptive execution splits.
    """
    names = F.array(*[F.lit(rule.name) for rule in rules])
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])

    def place(x: Column) -> Column:
        at = F.array_position(names, x["rule"]).cast("int")
        kind = F.element_at(kinds, at)
        return F.struct(x["start"], at.alias("place"), x["end"], kind.alias("kind"))

    listed = (
        read_ledger(versions.sparkSession, path)
        .select("blob", F.filter("found", lambda x: F.array_contains(names, x["rule"])).alias("f"))
        .where(F.size("f") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("_f"))
        .select(F.col("blob").alias("_blob"), F.array_sort(F.transform("_f", place)).alias("_found"))
    )
    others = [name for name in versions.columns if name not in ("text", "found")]
    return (
        versions.select(*others, content_address(F.col("text")).alias("_blob"))
        .join(listed, "_blob", "left")
        .select(*others, F.coalesce("_found", F.array().cast(FOUND)).alias("found"))
    )


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def scan_digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, per row with ``found``."""
    base = [rule.kind for rule in BASE]
    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    counts = [
        F.size(F.filter("found", _of(kind))).cast("long").alias(f"n_{kind}")
        for kind in base
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(of_base), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )
