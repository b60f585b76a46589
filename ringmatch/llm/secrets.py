"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of a document is named by the SHA-256 of its text. The ledger remembers which blob
was scanned under which version of which rule, so a run scans only pairs it has not seen, however
many paths hold the blob, and findings are joined back to all paths. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringmatch.llm.common import scratch_path, texts_of, written

SCANS = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start long, stop long"


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must hold ``least`` characters, else the match is dropped."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: The kinds, in the order in which spans that start together are listed. The minimum
#: of the last two stands in the pattern: a run that is too short holds no longer run, so the spans
#: are those of ``+`` with short matches dropped.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def versions_of(docs: DataFrame) -> DataFrame:
    """Paths and their blobs: ``doc_id, blob``. A null text is the empty blob."""
    return texts_of(docs).select("doc_id", F.sha2("text", 256).alias("blob"))


def _spans(texts: DataFrame, rule: Rule) -> DataFrame:
    """``blob, start, stop`` of the rule's matches, leftmost first, none overlapping.

    The text between matches comes from ``split``, the matches from ``regexp_extract_all``; their
    running lengths are the positions, in code points.
    """
    pattern = F.lit(rule.pattern)
    parts = texts.where(F.col("text").rlike(rule.pattern)).select(
        "blob",
        F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.char_length).alias("gap"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length).alias("size"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.char_length).alias("held"),
        ).alias("parts"),
    )
    rows = parts.select("blob", F.posexplode("parts").alias("at", "part"))
    rows = rows.select("blob", "at", "part.gap", "part.size", "part.held")
    so_far = Window.partitionBy("blob").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    return (
        rows.withColumn("stop", before)
        .where(F.col("held") >= rule.least)
        .select("blob", (F.col("stop") - F.col("size")).alias("start"), "stop")
    )


def _ledger_table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger; empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_versions(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what ``ledger`` (a folder) has not seen and add it there.

    One text per unseen blob is scanned. Findings are written before the scan marks, so a run that
    dies between them is repeated, and readers take distinct findings. If no pair is unseen,
    nothing is scanned.
    """
    spark = docs.sparkSession
    seen = _ledger_table(spark, ledger, "scans", SCANS)
    # The smallest id that holds a blob names the row whose text is scanned; null ids count too.
    owners = versions_of(docs).groupBy("blob").agg(F.min("doc_id").alias("owner"))
    texts = texts_of(docs).withColumn("blob", F.sha2("text", 256))
    marks = None
    for rule in rules:
        done = seen.where((F.col("rule") == rule.name) & (F.col("version") == rule.version)).select("blob")
        mark = owners.join(done, "blob", "left_anti").select("blob", "owner", F.lit(rule.name).alias("rule"))
        mark = mark.withColumn("version", F.lit(rule.version))
        marks = mark if marks is None else marks.unionByName(mark)
    # One row per unseen blob with the rules it still needs; the text crosses the network once.
    needed = marks.groupBy("blob", "owner").agg(F.collect_set("rule").alias("rules"))
    due = texts.join(
        needed.withColumnRenamed("blob", "unseen"),
        (F.col("blob") == F.col("unseen")) & F.col("doc_id").eqNullSafe(F.col("owner")),
    ).select("blob", "text", "rules")
    # Keep only rows in which some due rule can match before the rules are taken one by one.
    flagged = due.select("blob", "text", *[_due(rule).alias(f"due_{rule.name}") for rule in rules])
    flagged = flagged.where(_any([F.col(f"due_{rule.name}") for rule in rules]))
    kept = written(flagged.dropDuplicates(["blob"]), "flagged")
    found = None
    for rule in rules:
        spans = _spans(kept.where(F.col(f"due_{rule.name}")).select("blob", "text"), rule)
        spans = spans.select("blob", F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), "start", "stop")
        found = spans if found is None else found.unionByName(spans)
    found.write.mode("append").parquet(f"{ledger}/findings")
    marks.select("blob", "rule", "version").write.mode("append").parquet(f"{ledger}/scans")


def _due(rule: Rule) -> Column:
    """Whether the rule is still due and matches; tested after the join, so only unseen blobs are scanned."""
    return F.when(F.array_contains("rules", rule.name), F.col("text").rlike(rule.pattern)).otherwise(F.lit(False))


def _any(conditions: list[Column]) -> Column:
    met = conditions[0]
    for condition in conditions[1:]:
        met = met | condition
    return met


def findings_by_path(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with its findings: ``doc_id, findings array<struct<start, place, rule, stop>>``.

    Findings are gathered per blob (bounded by the blob's own text) and joined to all its paths.
    Order in the array: by start, then by the rules' order.
    """
    spark = docs.sparkSession
    current = None
    for place, rule in enumerate(rules):
        hit = (F.col("rule") == rule.name) & (F.col("version") == rule.version)
        current = F.when(hit, place) if current is None else current.when(hit, place)
    per_blob = (
        _ledger_table(spark, ledger, "findings", FINDINGS)
        .withColumn("place", current)
        .where(F.col("place").isNotNull())
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "place", "rule", "stop"))).alias("findings"))
    )
    empty = F.expr("cast(array() as array<struct<start:bigint, place:int, rule:string, stop:bigint>>)")
    return (
        versions_of(docs)
        .join(per_blob, "blob", "left")
        .select("doc_id", "blob", F.coalesce("findings", empty).alias("findings"))
    )


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return :func:`findings_by_path`.

    Without ``ledger`` a fresh one is made in the shared folder. Null text: empty blob, no findings.
    Repeated rows and null ids each get their row; an empty table gives none; other columns of
    ``docs`` are ignored.
    """
    ledger = ledger or scratch_path(docs.sparkSession, "ledger")
    scan_versions(docs, ledger, rules)
    return findings_by_path(docs, ledger, rules)


def redacted(text: Column, findings: Column) -> Column:
    """The text with every span replaced by ``[rule]``; overlapping spans give one mark per span start outside."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        mark = F.when(span["start"] >= done["at"], F.concat(gap, F.lit("["), span["rule"], F.lit("]"))).otherwise("")
        return F.struct(
            F.greatest(done["at"], span["stop"]).alias("at"), F.concat(done["out"], mark).alias("out")
        )

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, start, step, finish))
