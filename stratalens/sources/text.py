"""Sources: documents as lines and chunks, ignore lists, manifests, coverage, Dockerfiles, incidents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import glob_regex

#: Fixed values of file discovery and of the oversize guard.
EXTENSIONS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "go", "java", "rs")
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "coverage", "vendor", ".next", "out", "target", "__pycache__")
MAX_CHARS, MAX_LINES = 500_000, 5_000


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of source files below ``root``; skipped folders and other extensions are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.col("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~F.col("path").rlike(rf"/({'|'.join(d.replace('.', chr(92) + '.') for d in SKIP_DIRS)})/")
    return files.where(wanted).select("path", F.col("content").cast("string").alias("content"))


def without_ignored(files: DataFrame, patterns: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose path no ignore pattern covers; negated patterns and comments are dropped."""
    for p in patterns:
        if p.strip() and p.strip()[0] not in "!#":
            files = files.where(~F.col(path).rlike(glob_regex(p)))
    return files


def changed_files(diff: DataFrame, untracked: DataFrame, path: str = "path") -> DataFrame:
    """Distinct normalised paths of changed and untracked script files."""
    norm = F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"^\./", "")
    return diff.select(path).unionByName(untracked.select(path)).select(norm.alias(path)).where(F.col(path).rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$")).distinct()


def lines(docs: DataFrame, text: str = "text", guard: bool = False) -> DataFrame:
    """One row per line: the other columns of ``docs``, ``line`` from 1 and ``txt``.  With ``guard`` oversize documents give none."""
    if guard:
        docs = docs.where(F.length(text) <= MAX_CHARS).where(F.regexp_count(text, F.lit("\n")) < MAX_LINES)
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("pos", "txt")).select(*keep, (F.col("pos") + 1).cast("long").alias("line"), "txt")


def chunks(docs: DataFrame, text: str = "text", size: int = 50, overlap: int = 5, least: int = 5) -> DataFrame:
    """Chunks of ``size`` lines that share ``overlap`` with the next; shorter ones than ``least`` are dropped."""
    parts = F.split(text, "\r?\n")
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(size - overlap))
    each = docs.withColumn("_l", parts).select("*", F.explode(starts).alias("_s"))
    out = each.select(*[c for c in docs.columns if c != text], (F.col("_s") + 1).cast("long").alias("start_line"), F.slice("_l", F.col("_s") + 1, size).alias("_c"))
    out = out.where(F.size("_c") >= least)
    return out.select("*", (F.col("start_line") + F.size("_c") - 1).cast("long").alias("end_line"), F.array_join("_c", "\n").alias("content")).drop("_c").withColumn("content_hash", F.sha2("content", 256))


def package_dependencies(manifests: DataFrame, content: str = "content") -> DataFrame:
    """name, version, type of the four sections of package.json texts; one range operator is stripped."""
    sections = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
    schema = ", ".join(f"{s} map<string,string>" for s in sections)
    j = manifests.withColumn("_j", F.from_json(content, schema))
    rows = [j.select(*[c for c in manifests.columns if c != content], F.explode(F.col("_j")[s]).alias("name", "version"), F.lit(kind).alias("type")) for s, kind in sections.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("version", F.regexp_replace("version", r"^[\^~>=<]+", ""))


def lockfile_packages(files: DataFrame, content: str = "content") -> DataFrame:
    """path, name, version, dev, is_direct and chain of version 2 and 3 lock files."""
    j = files.select(F.explode(F.from_json(content, "packages map<string,struct<version:string,dev:boolean>>")["packages"]).alias("key", "v")).where(F.col("key") != "")
    names = F.split(F.regexp_replace("key", "^node_modules/", ""), "/node_modules/")
    return j.select("key", F.element_at(names, -1).alias("name"), F.col("v.version").alias("version"), F.coalesce("v.dev", F.lit(False)).alias("dev"), (F.size(names) == 1).alias("is_direct"), F.array_join(names, " > ").alias("chain"))


def requirements(files: DataFrame, content: str = "content") -> DataFrame:
    """name, version of requirements.txt lines; comments and options are skipped."""
    rows = files.select(F.explode(F.split(content, "\r?\n")).alias("l")).select(F.trim(F.regexp_replace("l", r"#.*$", "")).alias("l")).where("l <> '' and not l like '-%'")
    return rows.select(F.regexp_extract("l", r"^([A-Za-z0-9_.\-]+)", 1).alias("name"), F.regexp_extract("l", r"(?:==|>=|~=|<=|>|<)\s*([0-9][^\s,;]*)", 1).alias("version")).where("name <> ''")


def lcov_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Per SF record: file, lines, covered, percentage, functions hit, branches of LCOV texts."""
    rows = files.withColumn("_f", F.monotonically_increasing_id()).select("_f", F.posexplode(F.split(content, "\r?\n")).alias("pos", "l"))
    w = Window.partitionBy("_f").orderBy("pos")
    rows = rows.withColumn("rec", F.sum(F.col("l").startswith("SF:").cast("int")).over(w)).where("rec > 0")
    hits = F.split(F.substr("l", F.lit(4)), ",")
    da, brda, fnda = F.col("l").startswith("DA:"), F.col("l").startswith("BRDA:"), F.col("l").startswith("FNDA:")
    hit = F.element_at(hits, 2).try_cast("long") > 0
    out = rows.groupBy("_f", "rec").agg(
        F.max(F.when(F.col("l").startswith("SF:"), F.substr("l", F.lit(4)))).alias("file"),
        F.count_if(da).alias("lines"),
        F.count_if(da & hit).alias("covered"),
        F.count_if(fnda & (F.regexp_extract("l", r"^FNDA:(\d+)", 1).try_cast("long") > 0)).alias("functions_hit"),
        F.count_if(brda).alias("branches"),
        F.count_if(brda & F.col("l").rlike(r",[1-9]\d*$")).alias("branches_hit"),
    )
    return out.drop("_f", "rec").withColumn("percentage", F.when(F.col("lines") > 0, F.round(100.0 * F.col("covered") / F.col("lines"), 2)).otherwise(F.lit(0.0)))


def lcov_totals(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """file, lines_found, lines_hit, branches_found, branches_hit and line_pct of LCOV texts, from their LF, LH, BRF and BRH records."""
    rows = files.select(file, F.explode(F.split(content, "\r?\n")).alias("l"))
    total = lambda k, name: F.coalesce(F.sum(F.regexp_extract("l", rf"^{k}:(\d+)$", 1).try_cast("long")), F.lit(0)).alias(name)
    out = rows.groupBy(file).agg(total("LF", "lines_found"), total("LH", "lines_hit"), total("BRF", "branches_found"), total("BRH", "branches_hit"))
    return out.withColumn("line_pct", F.when(F.col("lines_found") > 0, F.round(100.0 * F.col("lines_hit") / F.col("lines_found"), 2)).otherwise(F.lit(0.0)))


def cobertura(files: DataFrame, content: str = "content") -> DataFrame:
    """file, lines, covered, percentage (100 without lines) and uncovered of the classes of Cobertura texts."""
    classes = files.select(F.explode(F.regexp_extract_all(content, F.lit(r"(?s)<class [^>]*filename=\"[^\"]+\"[^>]*>.*?</class>"), F.lit(0))).alias("c"))
    hits = F.regexp_extract_all("c", F.lit(r"<line\s+number=\"\d+\"[^>]*hits=\"(\d+)\"[^>]*/>"), F.lit(1))
    numbers = F.regexp_extract_all("c", F.lit(r"<line\s+number=\"(\d+)\"[^>]*hits=\"\d+\"[^>]*/>"), F.lit(1))
    both = F.arrays_zip(numbers.alias("number"), hits.alias("hits"))
    missed = F.transform(F.filter(both, lambda x: x["hits"].cast("long") == 0), lambda x: x["number"])
    out = classes.select(F.regexp_extract("c", r"filename=\"([^\"]+)\"", 1).alias("file"), F.size(hits).cast("long").alias("lines"), F.size(F.filter(hits, lambda h: h.cast("long") > 0)).cast("long").alias("covered"), F.array_join(missed, ",").alias("uncovered"))
    return out.withColumn("percentage", F.when(F.col("lines") > 0, F.floor(100.0 * F.col("covered") / F.col("lines") + 0.5)).otherwise(F.lit(100)).cast("long"))


def maven_dependencies(files: DataFrame, content: str = "content") -> DataFrame:
    """name (group:artifact), version (latest, where none is given) of pom.xml texts."""
    pattern = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?"
    d = files.select(F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(0))).alias("d"))
    version = F.regexp_extract("d", pattern, 3)
    return d.select(F.concat_ws(":", F.regexp_extract("d", pattern, 1), F.regexp_extract("d", pattern, 2)).alias("name"), F.when(version == "", "latest").otherwise(version).alias("version"))


def gem_dependencies(files: DataFrame, content: str = "content") -> DataFrame:
    """name, version of the gems of Gemfile.lock texts (four blanks deep; what they depend on stands deeper)."""
    pattern = r"(?m)^\s{4}([a-zA-Z0-9_-]+) +\(([^)]+)\)"
    rows = files.select(F.explode(F.split(content, "\r?\n")).alias("l")).where(F.col("l").rlike(r"^ {4}[a-zA-Z0-9_-]+ +\([^)]+\)"))
    return rows.select(F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"))


def go_dependencies(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """name, version of go.mod texts: single require lines and those of require blocks."""
    rows = files.select(file, F.posexplode(F.split(content, "\r?\n")).alias("pos", "l")).withColumn("l", F.trim(F.regexp_replace("l", r"^\s+", "")))
    w = Window.partitionBy(file).orderBy("pos")
    opens, closes = F.col("l").startswith("require ("), F.col("l") == ")"
    inside = F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(w), F.lit(False))
    rows = rows.withColumn("inside", inside).where(~opens & ~closes & (F.col("inside") | F.col("l").startswith("require ")))
    rows = rows.withColumn("l", F.regexp_replace("l", r"^require\s+", "")).where(F.col("l").rlike(r"^\S+\s+\S+") & ~F.col("l").startswith("//"))
    return rows.select(F.regexp_extract("l", r"^(\S+)\s+v?(\S+)", 1).alias("name"), F.regexp_extract("l", r"^(\S+)\s+v?(\S+)", 2).alias("version"))


def build_errors(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """file, type, detail, at_file, at_line of the errors in build logs: modules that are missing, and syntax errors with their place."""
    module = lambda p: files.select(file, F.explode(F.regexp_extract_all(content, F.lit(p), F.lit(1))).alias("detail")).select(file, F.lit("MISSING_MODULE").alias("type"), "detail", F.lit("").alias("at_file"), F.lit(None).cast("long").alias("at_line"))
    pattern = r"(SyntaxError:[^\n]*)\n\s+at\s+([^\n]+):(\d+):(\d+)"
    s = files.select(file, F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(0))).alias("m"))
    syntax = s.select(file, F.lit("SYNTAX_ERROR").alias("type"), F.regexp_extract("m", pattern, 1).alias("detail"), F.regexp_extract("m", pattern, 2).alias("at_file"), F.regexp_extract("m", pattern, 3).cast("long").alias("at_line"))
    return module(r"Module not found:.*Can't resolve '([^']+)'").unionByName(module(r"Error: Cannot find module '([^']+)'")).unionByName(syntax)


def dockerfile_instructions(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """file, line, instruction, arguments; lines that end in a backslash go on in the next one."""
    rows = files.select(file, F.posexplode(F.split(content, "\r?\n")).alias("pos", "l")).where("trim(l) <> '' and not trim(l) like '#%'")
    w = Window.partitionBy(file).orderBy("pos")
    goes_on = F.coalesce(F.lag("l").over(w).rlike(r"\\\s*$"), F.lit(False))
    rows = rows.withColumn("g", F.sum((~goes_on).cast("int")).over(w))
    whole = rows.groupBy(file, "g").agg((F.min("pos") + 1).alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("l", r"\\\s*$", "")).alias("t")))), lambda x: x["t"]), " ").alias("t"))
    return whole.select(file, "line", F.upper(F.regexp_extract("t", r"^(\w+)", 1)).alias("instruction"), F.regexp_replace("t", r"^\w+\s*", "").alias("arguments"))


def commit_log(files: DataFrame, content: str = "content") -> DataFrame:
    """sha, authored_at, author_name, author_email, subject, body of a log cut by record and unit separators."""
    rows = files.select(F.explode(F.split(content, "\x1e")).alias("r")).select(F.split(F.trim("r"), "\x1f").alias("f")).where(F.size("f") >= 5)
    return rows.select(*[F.element_at("f", i + 1).alias(n) for i, n in enumerate(("sha", "authored_at", "author_name", "author_email", "subject"))], F.coalesce(F.try_element_at("f", F.lit(6)), F.lit("")).alias("body"))


def incidents(payloads: DataFrame) -> DataFrame:
    """source, message, severity of raw JSON bodies of four vendors and a generic shape."""
    b = F.col("body")
    get = lambda p: F.get_json_object(b, p)
    level = F.lower(F.coalesce(get("$.data.event.level"), get("$.event.data.urgency"), get("$.alert_type"), get("$.severity"), F.lit("medium")))
    severity = F.when(level.isin("fatal", "critical"), "CRITICAL").when(level.isin("error", "high"), "HIGH").when(level.isin("info", "low", "success", "debug"), "LOW").otherwise("MEDIUM")
    message = F.coalesce(get("$.data.event.title"), get("$.event.data.title"), get("$.title"), get("$.message"), get("$.error"), F.lit("Unknown error"))
    return payloads.select("source", message.alias("error_message"), severity.alias("severity"), F.coalesce(get("$.file"), get("$.data.event.culprit")).alias("file_path"))


def ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """test_name, category, expected (a real boolean) of a four-column truth file with a header."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]).select(F.col("c0").alias("test_name"), F.col("c2").alias("category"), (F.lower("c3") == "true").alias("expected"))
