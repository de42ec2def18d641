"""Registered queries over source trees: rule packs, manifests, coverage, builds, imports and taint, on trees derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, clones, custom, export, modules, packs
from ..sources import derived, text
from . import calls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_FILES = derived.tree_sql()


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(derived.files(spark, sf_dir))
        ORACLE[name] = sql
        return f

    return add


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("file").rlike(pattern))


for _name in packs.CONTENT_PACKS:
    query(f"{_name}_rules", packs.content_pack_sql(_name, _FILES))(lambda files, n=_name: packs.content_pack(files, n))
for _name in packs.LINE_PACKS | packs.TOKEN_PACKS:
    query(f"{_name}_rules", packs.line_pack_sql(_name, _FILES))(lambda files, n=_name: packs.line_pack(files, n))

query("file_classes", packs.file_classes_sql(_FILES))(packs.file_classes)


def _of(pattern: str) -> str:
    return f"(SELECT * FROM ({_FILES}) WHERE regexp_matches(file, '{pattern}'))"


_LINES = "SELECT file, CAST(i AS BIGINT) AS line, p[i] AS l FROM (SELECT file, regexp_split_to_array(content, '\\r?\\n') AS p FROM {}), unnest(range(1, len(p) + 1)) AS t(i)"


@query("requirement_versions", f"SELECT regexp_extract(l, '^([A-Za-z0-9_.\\-]+)', 1) AS name, regexp_extract(l, '(?:==|>=|~=|<=|>|<)\\s*([0-9][^\\s,;]*)', 1) AS version FROM ({_LINES.format(_of('requirements.txt$'))}) WHERE regexp_matches(l, '^[A-Za-z0-9]')")
def _requirements(files):
    return text.requirements(_named(files, "requirements.txt$"))


@query("maven_dependencies", f"SELECT regexp_extract(d, '<groupId>([^<]+)', 1) || ':' || regexp_extract(d, '<artifactId>([^<]+)', 1) AS name, coalesce(nullif(regexp_extract(d, '<version>([^<]+)', 1), ''), 'latest') AS version FROM (SELECT unnest(regexp_extract_all(content, '(?s)<dependency>.*?</dependency>')) AS d FROM {_of('pom.xml$')})")
def _maven(files):
    return text.maven_dependencies(_named(files, "pom.xml$"))


@query("gem_dependencies", f"SELECT regexp_extract(l, '^ +(\\S+)', 1) AS name, regexp_extract(l, '\\((.*)\\)', 1) AS version FROM ({_LINES.format(_of('Gemfile.lock$'))}) WHERE regexp_matches(l, '^ {{4}}\\S')")
def _gems(files):
    return text.gem_dependencies(_named(files, "Gemfile.lock$"))


@query("go_dependencies", f"SELECT split_part(d, ' ', 1) AS name, ltrim(split_part(d, ' ', 2), 'v') AS version FROM (SELECT regexp_replace(trim(l, chr(9) || ' '), '^require ', '') AS d FROM ({_LINES.format(_of('go.mod$'))}) WHERE regexp_matches(l, ' v[0-9]')) WHERE d NOT LIKE '//%'")
def _go(files):
    return text.go_dependencies(_named(files, "go.mod$"))


@query("npm_dependencies", f"SELECT s AS type, k AS name, regexp_replace(json_extract_string(content, '$.' || p || '.\"' || k || '\"'), '^[\\^~>=<]', '') AS version FROM {_of('package.json$')}, (VALUES ('dependencies', 'runtime'), ('devDependencies', 'dev')) AS v(p, s), unnest(json_keys(content, '$.' || p)) AS t(k)")
def _npm(files):
    return text.package_dependencies(_named(files, "package.json$")).select("type", "name", "version")


@query("coverage_totals", f"SELECT file, lf AS lines_found, lh AS lines_hit, bf AS branches_found, bh AS branches_hit, CASE WHEN lf > 0 THEN round(100.0 * lh / lf, 2) ELSE 0.0 END AS line_pct FROM (SELECT file, {', '.join(f'CAST(coalesce(sum(TRY_CAST(regexp_extract(l, {chr(39)}^{k}:([0-9]+)${chr(39)}, 1) AS BIGINT)), 0) AS BIGINT) AS {n}' for k, n in (('LF', 'lf'), ('LH', 'lh'), ('BRF', 'bf'), ('BRH', 'bh')))} FROM ({_LINES.format(_of('lcov.info$'))}) GROUP BY file)")
def _lcov_totals(files):
    return text.lcov_totals(_named(files, "lcov.info$"))


@query("coverage_records", f"SELECT max(CASE WHEN l LIKE 'SF:%' THEN l[4:] END) AS file, count(*) FILTER (l LIKE 'DA:%') AS lines, count(*) FILTER (regexp_matches(l, '^DA:[0-9]+,[1-9]')) AS covered, count(*) FILTER (l LIKE 'BRDA:%') AS branches FROM (SELECT *, file AS owner, sum(CASE WHEN l LIKE 'SF:%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS rec FROM ({_LINES.format(_of('lcov.info$'))})) WHERE rec > 0 GROUP BY owner, rec")
def _lcov_records(files):
    return text.lcov_records(_named(files, "lcov.info$")).select("file", "lines", "covered", "branches")


@query("coverage_classes", f"SELECT regexp_extract(c, 'filename=\"([^\"]+)\"', 1) AS file, CAST(len(h) AS BIGINT) AS lines, CAST(len(list_filter(h, lambda x: x <> '0')) AS BIGINT) AS covered, array_to_string(regexp_extract_all(c, '<line number=\"([0-9]+)\" hits=\"0\"', 1), ',') AS uncovered, CAST(CASE WHEN len(h) > 0 THEN floor(100.0 * len(list_filter(h, lambda x: x <> '0')) / len(h) + 0.5) ELSE 100 END AS BIGINT) AS percentage FROM (SELECT c, regexp_extract_all(c, 'hits=\"([0-9]+)\"', 1) AS h FROM (SELECT unnest(regexp_extract_all(content, '(?s)<class [^>]*filename=.*?</class>')) AS c FROM {_of('cobertura.xml$')}))")
def _cobertura(files):
    return text.cobertura(_named(files, "cobertura.xml$"))


@query("dockerfile_instructions", f"SELECT file, line, upper(regexp_extract(l, '^(\\w+)', 1)) AS instruction, regexp_replace(l, '^\\w+\\s*', '') AS arguments FROM ({_LINES.format(_of('(^|/)Dockerfile'))}) WHERE trim(l) <> ''")
def _docker(files):
    return text.dockerfile_instructions(_named(files, "(^|/)Dockerfile")).withColumn("line", F.col("line").cast("long"))


@query("build_errors", f"WITH f AS (SELECT * FROM {_of('build.log$')}) SELECT file, 'MISSING_MODULE' AS type, unnest(regexp_extract_all(content, '(?:resolve|module) ''([^'']+)''', 1)) AS detail, '' AS at_file, CAST(NULL AS BIGINT) AS at_line FROM f UNION ALL SELECT file, 'SYNTAX_ERROR', regexp_extract(m, '^([^\\n]*)', 1), regexp_extract(m, 'at ([^:]+):', 1), CAST(regexp_extract(m, ':([0-9]+):[0-9]+$', 1) AS BIGINT) FROM (SELECT file, unnest(regexp_extract_all(content, 'SyntaxError:[^\\n]*\\n +at [^:]+:[0-9]+:[0-9]+')) AS m FROM f)")
def _build(files):
    return text.build_errors(_named(files, "build.log$"))


@query("import_resolution", modules.IMPORTS_SQL.format(files=_FILES))
def _imports(files):
    return modules.resolved_imports(_named(files, r"\.js$"))


@query("exported_symbols", modules.EXPORTS_SQL.format(files=_FILES))
def _exports(files):
    return modules.exported_symbols(_named(files, r"\.js$"))


@query("cross_file_calls", modules.CROSS_SQL.format(files=_FILES))
def _cross(files):
    return modules.cross_file_sinks(_named(files, r"\.js$"))


@query("import_cycles", modules.CYCLES_SQL.format(files=_FILES))
def _cycles(files):
    return modules.two_cycles(modules.resolved_imports(_named(files, r"\.js$")))


@query("missing_tests", modules.MISSING_SQL.format(files=_FILES))
def _missing(files):
    return modules.missing_tests(_named(files, r"\.js$"))


@query("documentation_gaps", modules.DOCS_SQL.format(files=_FILES))
def _docs(files):
    return modules.documentation_gaps(_named(files, r"\.js$"))


@query("taint_flows", modules.TAINT_SQL.format(files=_FILES))
def _taint(files):
    return modules.tainted_sinks(_named(files, r"\.js$"))


_PARTS = "SELECT name, version, 'pkg:npm/' || name || '@' || version AS purl, CASE type WHEN 'runtime' THEN 'required' ELSE 'optional' END AS scope, row_number() OVER (ORDER BY name, version) - 1 AS n FROM (" + ORACLE["npm_dependencies"] + ")"


def _components(files):
    scope = F.when(F.col("type") == "runtime", "required").otherwise("optional")
    purl = F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version")
    return _npm(files).select("name", "version", purl.alias("purl"), scope.alias("scope"), F.lit("npm").alias("ecosystem"))


@query("sbom_cyclonedx", f"SELECT 'component-' || n AS bom_ref, '{{\"bom-ref\":\"component-' || n || '\",\"type\":\"library\",\"name\":\"' || name || '\",\"version\":\"' || version || '\",\"purl\":\"' || purl || '\",\"scope\":\"' || scope || '\",\"properties\":[{{\"name\":\"ecosystem\",\"value\":\"npm\"}}]}}' AS component FROM ({_PARTS})")
def _cyclonedx(files):
    return export.cyclonedx(_components(files))


@query("sbom_spdx", f"SELECT 'SPDXRef-RootPackage' AS element, 'SPDXRef-Package-' || n AS related, CASE scope WHEN 'required' THEN 'DEPENDS_ON' ELSE 'DEV_DEPENDENCY_OF' END AS relationship FROM ({_PARTS})")
def _spdx(files):
    return export.spdx_relationships(_components(files))


_MODULES = f"SELECT file, content FROM ({_FILES}) WHERE file LIKE 'src/%.js'"
_PROSE = "SELECT lpad(CAST(doc_id AS VARCHAR), 18, '0') AS file, text AS content FROM documents"


def _modules(files):
    return files.where("file like 'src/%.js'")


def _prose(spark, sf_dir):
    return calls.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("file"), F.col("text").alias("content"))


@query("token_clones", f"WITH {clones.blocks_sql(_MODULES)} {clones.REGIONS}")
def _token_clones(files):
    return clones.regions(clones.blocks(_modules(files)))


@query("token_clone_classes", f"WITH {clones.blocks_sql(_MODULES)} {clones.CLASSES}")
def _token_clone_classes(files):
    return clones.classes(clones.blocks(_modules(files)))


@query("token_clone_summary", f"WITH {clones.blocks_sql(_MODULES)} {clones.SUMMARY}")
def _token_clone_summary(files):
    return clones.summary(clones.regions(clones.blocks(_modules(files))))


@query("longest_clones", f"WITH {clones.blocks_sql(_MODULES)} {clones.LONGEST}")
def _longest_clones(files):
    return clones.longest(clones.regions(clones.blocks(_modules(files))))


def prose_clones(spark, sf_dir):
    """Runs of two lines that repeat in the documents, names kept."""
    return clones.regions(clones.blocks(_prose(spark, sf_dir), 2, keep_names=True), 2)


QUERIES["prose_clones"] = prose_clones
ORACLE["prose_clones"] = f"WITH {clones.blocks_sql(_PROSE, 2, keep_names=True)} {clones.REGIONS}"


_SOURCES = f"SELECT file, content FROM ({_FILES}) WHERE file LIKE '%.js'"


def _sources(files):
    return files.where("file like '%.js'")


@query("comment_lines", f"WITH RECURSIVE {blocks.states_sql(_SOURCES)} SELECT file, line FROM st WHERE state = 1")
def _comment_lines(files):
    return blocks.line_states(_sources(files)).where(F.col("state") == blocks.COMMENT).select("file", "line")


@query("long_functions", f"WITH RECURSIVE {blocks.pairs_sql(_SOURCES)} {blocks.long_functions_sql(20)}")
def _long_functions(files):
    """Over 20 lines; the derived modules have few functions of 80."""
    return blocks.long_functions(blocks.bracket_pairs(blocks.line_states(_sources(files))), 20)


@query("brace_blocks", f"WITH RECURSIVE {blocks.pairs_sql(_SOURCES)} SELECT DISTINCT file, level, start_line, end_line FROM pairs WHERE end_line - start_line + 1 >= 5")
def _brace_blocks(files):
    return blocks.brace_blocks(blocks.bracket_pairs(blocks.line_states(_sources(files))))


def long_texts(spark, sf_dir):
    """Documents of over 8 lines; none of the given ones has 400."""
    return blocks.long_files(_prose(spark, sf_dir), 8)


QUERIES["long_texts"] = long_texts
ORACLE["long_texts"] = f"SELECT file, CAST(n AS BIGINT) AS lines FROM (SELECT file, len(regexp_split_to_array(content, '\\r?\\n')) AS n FROM ({_PROSE})) WHERE n > 8"


#: Calls of a database in an exported function, but for those whose text is cleaned; and a rule of alternatives alone.
_QUERIES_IN_EXPORTS = custom.CustomRule(
    "CUSTOM_QUERY_IN_EXPORT", "HIGH", ("pool.execute('select ' + $X)", "show$X(req.body.id)"), inside=r"(?s)export function \w+\(a\) \{.*?return a;", excluded=("show$X(req.body.id) // ok",), message="{X} reaches a query", fix="bind({X})"
)
_RAW_TEXT = custom.CustomRule("CUSTOM_RAW_TEXT", "MEDIUM", ("db.query($X)", "fetch($X)"), excluded=("db.query(clean)",), message="{X} is sent as it is")


@query("custom_rule_regions", custom.rule_sql(_SOURCES, _QUERIES_IN_EXPORTS) + " UNION ALL SELECT * FROM (" + custom.rule_sql(_SOURCES, _RAW_TEXT) + ")")
def _custom_rule_regions(files):
    return custom.run_rules(_sources(files), (_QUERIES_IN_EXPORTS, _RAW_TEXT))
