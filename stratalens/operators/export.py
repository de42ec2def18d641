"""Exports: SARIF, software bills of materials, JSON and Markdown reports, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SARIF_LEVEL, by_severity, clean_version


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding, in the shape of SARIF 2.1.0."""
    region = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"), (F.col("end_col") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), by_severity("severity", SARIF_LEVEL, "none").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("doc_id", "line", "rule_id", F.to_json(result).alias("result"))


#: Numbers that stand for severities in the rules of a report.
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "7.5", "MEDIUM": "5.0", "LOW": "2.5", "INFO": "0"}


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_index, rule_id, name, level, security_severity of the distinct rules, in the order of their first finding (by document, line, column)."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct("doc_id", "line", "col")).alias("at"), F.min("severity").alias("severity"))
    w = Window.orderBy("at", "rule_id")  # a row per rule
    name = F.initcap(F.regexp_replace("rule_id", r"[/_-]", " "))
    return first.select((F.row_number().over(w) - 1).cast("long").alias("rule_index"), "rule_id", name.alias("name"), by_severity("severity", SARIF_LEVEL, "none").alias("level"), by_severity("severity", SECURITY_SEVERITY, "0").alias("security_severity"))


def sarif_located(findings: DataFrame) -> DataFrame:
    """The results of a report with their rule's index: doc_id, line, col, rule_id, rule_index, level, uri, start_column, end_column."""
    rules = sarif_rules(findings).select("rule_id", "rule_index", "level")
    out = findings.join(F.broadcast(rules), "rule_id")  # a row per rule
    return out.select("doc_id", "line", "col", "rule_id", "rule_index", "level", F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri"), (F.col("col") + 1).alias("start_column"), (F.col("end_col") + 1).alias("end_column"))


def sarif_artifacts(findings: DataFrame) -> DataFrame:
    """uri of every document with findings, once."""
    return findings.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri")).distinct()


def gate_annotations(gates: DataFrame) -> DataFrame:
    """gate, annotation: a line for a CI log for each gate (gate, value, limit_value, passed) that failed."""
    text = F.concat(F.lit("::error title=Quality Gate Failed::"), "gate", F.lit(": "), F.col("value").cast("string"), F.lit(" (allowed: "), F.col("limit_value").cast("string"), F.lit(")"))
    return gates.where(~F.col("passed")).select("gate", text.alias("annotation"))


def cyclonedx(components: DataFrame) -> DataFrame:
    """bom_ref, component (JSON) of CycloneDX 1.5, in order of name and version; columns name, version, purl, scope, ecosystem."""
    w = Window.orderBy("name", "version")  # a row per package of one project
    ref = F.concat(F.lit("component-"), (F.row_number().over(w) - 1).cast("string"))
    body = F.to_json(F.struct(F.col("bom_ref").alias("bom-ref"), F.lit("library").alias("type"), "name", "version", "purl", "scope", F.array(F.struct(F.lit("ecosystem").alias("name"), F.col("ecosystem").alias("value"))).alias("properties")))
    return components.withColumn("bom_ref", ref).select("bom_ref", body.alias("component"))


def spdx_relationships(components: DataFrame) -> DataFrame:
    """element, related, relationship of SPDX 2.3: packages depend on the root as their scope says."""
    w = Window.orderBy("name", "version")  # a row per package of one project
    related = F.concat(F.lit("SPDXRef-Package-"), (F.row_number().over(w) - 1).cast("string"))
    kind = F.when(F.col("scope") == "required", "DEPENDS_ON").otherwise("DEV_DEPENDENCY_OF")
    return components.select(F.lit("SPDXRef-RootPackage").alias("element"), related.alias("related"), kind.alias("relationship"))


def sbom_components(packages: DataFrame) -> DataFrame:
    """name, version, purl of distinct npm packages."""
    p = packages.select("name", clean_version("version").alias("version")).distinct()
    return p.withColumn("purl", F.concat(F.lit("pkg:npm/"), F.regexp_replace("name", "^@", "%40"), F.lit("@"), F.col("version")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a small report as a Markdown table."""
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(str(v).replace('|', chr(92) + '|') for v in r)} |" for r in df.limit(limit).collect())])


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` put in place of those of equal key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)
