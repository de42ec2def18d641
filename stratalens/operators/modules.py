"""Modules of a source tree: imports, exports, cycles, companions, documentation, and taint within and across files.

Files are rows (file, content).  Everything is a join or an aggregate over lines and words; taint spreads by
the names of each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import lines
from . import similarity
from .packs import FILE_CLASSES

two_cycles = similarity.two_cycles

_NAMED = r"import\s*\{[^}]+\}\s*from\s*['\"][^'\"]+['\"]"
_DEFAULT = r"import\s+\w+\s+from\s*['\"][^'\"]+['\"]"
_REQUIRED = r"(?:const|let|var)\s*\{[^}]+\}\s*=\s*require\s*\(\s*['\"][^'\"]+['\"]\s*\)"
_EXPORTS = (r"export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class)\s+(\w+)", r"export\s+default\s+(\w+)\s*;", r"exports\.(\w+)\s*=")
#: What taint comes from, where it must not go, and what clears it.
SOURCE = r"\b(?:req|request)\.(?:body|query|params|headers)\b|\bprocess\.argv\b|\binput\("
SINK = r"\b(?:eval|exec|query|execute|system)\s*\("
CLEAN = r"\b(?:escape|sanitize|validate|encodeURIComponent|parseInt)\w*\("
_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
_QUOTED = r"'[^']*'|\"[^\"]*\""
_ASSIGN = r"^\s*(?:const|let|var)?\s*(\{[^}]*\}|\[[^\]]*\]|[A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*([^=>].*)$"
_COMMENT = r"^\s*(//|#|/\*|\*)"


def _path(parts: Column) -> Column:
    """A path from its parts, without empty ones, points and what two points take back."""
    kept = F.filter(parts, lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/")


def imports(files: DataFrame) -> DataFrame:
    """file, specifier, imported, local of named, default and required imports."""

    def found(pattern: str) -> DataFrame:
        return files.select("file", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))

    spec = F.regexp_extract("m", r"['\"]([^'\"]+)['\"]", 1).alias("specifier")
    several = found(_NAMED).unionByName(found(_REQUIRED)).select("file", spec, F.explode(F.split(F.regexp_extract("m", r"\{([^}]*)\}", 1), ",")).alias("p"))
    several = several.select("file", "specifier", F.trim("p").alias("p")).where(F.col("p") != "")
    renamed = F.regexp_extract("p", r"(?:\s+as\s+|:\s*)(\w+)$", 1)
    first = F.regexp_extract("p", r"^(\w+)", 1)
    named = several.select("file", "specifier", first.alias("imported"), F.when(renamed == "", first).otherwise(renamed).alias("local"))
    return named.unionByName(found(_DEFAULT).select("file", spec, F.lit("default").alias("imported"), F.regexp_extract("m", r"import\s+(\w+)", 1).alias("local")))


def resolved_imports(files: DataFrame) -> DataFrame:
    """The imports with ``src`` and ``dst``, the file that a relative specifier stands for; null where it is none of ``files``."""
    relative = F.col("specifier").startswith(".")
    target = F.when(relative, _path(F.concat(F.split(F.regexp_extract("file", r"^(.*/)?[^/]*$", 1), "/"), F.split("specifier", "/"))))
    rows = imports(files).withColumn("target", target)
    known = files.select(F.col("file").alias("path"))
    found = similarity.resolve_imports(rows.where("target is not null"), known, "target", "path")
    out = found.unionByName(rows.where("target is null").withColumn("resolved", F.lit(None).cast("string")))
    return out.select(F.col("file").alias("src"), "specifier", "imported", "local", F.col("resolved").alias("dst"))


def exported_symbols(files: DataFrame) -> DataFrame:
    """file, symbol of everything that a file exports by name, once."""
    each = [files.select("file", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("symbol")) for p in _EXPORTS]
    return reduce(DataFrame.unionByName, each).distinct()


def cross_file_sinks(files: DataFrame) -> DataFrame:
    """file, line, function, sink_file: calls that pass a request's data to an imported function which hands it to a sink."""
    body = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)export\s+function\s+\w+\s*\([^)]*\)\s*\{.*?\n\}"), F.lit(0))).alias("f"))
    sinks = body.where(F.col("f").rlike(SINK)).select(F.col("file").alias("sink_file"), F.regexp_extract("f", r"function\s+(\w+)", 1).alias("function")).distinct()
    used = resolved_imports(files).join(sinks, (F.col("dst") == F.col("sink_file")) & (F.col("imported") == F.col("function")))
    rows = lines(files, "content").join(used.select(F.col("src").alias("file"), "local", "function", "sink_file"), "file")
    call = F.concat(F.lit(r"\b"), F.col("local"), F.lit(r"\s*\([^)]*\b(?:req|request)\.(?:body|query|params|headers)"))
    return rows.where(F.regexp_like("txt", call)).select("file", "line", "function", "sink_file").distinct()


def missing_tests(files: DataFrame, least_lines: int = 40) -> DataFrame:
    """file, symbol (the first exported one by name) of longer modules that export something and have no companion test.

    Companions are looked up by five names in the module's folder and in its ``__tests__``.
    """
    stem, end = F.regexp_extract("file", r"([^/]+?)\.([^./]+)$", 1), F.regexp_extract("file", r"\.([^./]+)$", 1)
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    names = [F.concat(stem, F.lit(f"{mark}."), end) for mark in (".test", ".spec", "-test", "_test")] + [F.concat(F.lit("test_"), stem, F.lit("."), end)]
    places = F.array(*[F.concat(folder, F.lit(d), n) for d in ("", "__tests__/") for n in names])
    long = files.where((F.size(F.split("content", "\r?\n")) > least_lines) & ~F.col("file").rlike(FILE_CLASSES["is_test"]))
    shown = long.join(exported_symbols(files).groupBy("file").agg(F.min("symbol").alias("symbol")), "file")
    tested = shown.select("file", F.explode(places).alias("place")).join(files.select(F.col("file").alias("place")), "place").select("file").distinct()
    return shown.join(tested, "file", "left_anti").select("file", "symbol")


def documentation_gaps(files: DataFrame) -> DataFrame:
    """file, category, line: exporting modules of over 50 filled lines with under 4 % comments, and code that begins below blank lines."""
    rows = lines(files, "content")
    filled, comment = F.trim("txt") != "", F.col("txt").rlike(_COMMENT)
    w = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("after_comment", F.coalesce(F.lag(comment).over(w), F.lit(True)))
    per = rows.groupBy("file").agg(F.count_if(filled).alias("filled"), F.count_if(filled & comment).alias("comments"), F.min(F.when(filled & ~comment, F.struct("line", "after_comment"))).alias("code"))
    shown = per.join(exported_symbols(files).select("file").distinct(), "file", "left_semi")
    poor = shown.where((F.col("filled") > 50) & (F.col("comments") < 0.04 * F.col("filled"))).select("file", F.lit("POOR_DOCUMENTATION").alias("category"), F.lit(1).cast("long").alias("line"))
    headless = per.where((F.col("code.line") > 1) & ~F.col("code.after_comment")).select("file", F.lit("MISSING_HEADER").alias("category"), F.col("code.line").alias("line"))
    return poor.unionByName(headless)


def _reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """file, name: all names that taint reaches from the seeds, over any number of edges (name, used).

    The names of a file meet in one row, which is no larger than the file, and are followed breadth first.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                uses: dict[str, list[str]] = {}
                for e in r["edges"] or []:
                    uses.setdefault(e["used"], []).append(e["name"])
                seen = set(r["seeds"])
                todo = list(seen)
                while todo:
                    new = [n for n in uses.pop(todo.pop(), ()) if n not in seen]
                    seen.update(new)
                    todo += new
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(seen), pa.string()), pa.array(sorted(seen), pa.string())], names=["file", "name"])

    of_file = edges.groupBy("file").agg(F.collect_set(F.struct("name", "used")).alias("edges"))
    started = seeds.groupBy("file").agg(F.collect_set("name").alias("seeds"))
    return started.join(of_file, "file", "left").select("file", "seeds", "edges").mapInArrow(follow, "file string, name string")


def tainted_sinks(files: DataFrame, back: int = 5) -> DataFrame:
    """file, line, variable: sink calls that a tainted name reaches, the least name of a line.

    A name that is assigned from a source is tainted; taint is carried over assignments until nothing changes, also of
    properties, templates and destructured names.  A cleaning call clears the value that it is in, and the
    sinks on its line and the ``back`` lines behind it.  Quoted words are not names.
    """
    rows = lines(files, "content").select("file", "line", "txt")
    made = rows.where(F.col("txt").rlike(_ASSIGN)).select("file", F.regexp_extract("txt", _ASSIGN, 1).alias("names"), F.regexp_extract("txt", _ASSIGN, 2).alias("value")).where(~F.col("value").rlike(CLEAN))
    words = lambda c: F.regexp_extract_all(F.regexp_replace(c, _QUOTED, ""), F.lit(_WORD), F.lit(0))
    named = made.select("file", F.explode(F.regexp_extract_all("names", F.lit(_WORD), F.lit(0))).alias("name"), "value")
    tainted = named.where(F.col("value").rlike(SOURCE)).select("file", "name").distinct()
    edges = named.select("file", "name", F.explode(words("value")).alias("used")).where("name <> used").distinct()
    tainted = _reached(edges, tainted)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-back, 0)
    calls = rows.withColumn("cleared", F.max(F.col("txt").rlike(CLEAN)).over(w)).where(F.col("txt").rlike(SINK) & ~F.col("cleared"))
    args = calls.select("file", "line", F.explode(words(F.regexp_extract("txt", rf"(?:{SINK})(.*)$", 1))).alias("name"))
    return args.join(tainted, ["file", "name"], "left_semi").groupBy("file", "line").agg(F.min("name").alias("variable"))


# ---- the same for DuckDB; {{files}} stands for the files


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


_F = "f AS (SELECT file, content FROM ({files}) WHERE regexp_matches(file, '\\.js$'))"
_L = "l AS (SELECT file, CAST(i AS BIGINT) AS line, p[i] AS txt FROM (SELECT file, regexp_split_to_array(content, '\\r?\\n') AS p FROM f), unnest(range(1, len(p) + 1)) AS t(i))"
_I = (
    f"several AS (SELECT file, regexp_extract(m, {_q(chr(91) + chr(39) + chr(34) + chr(93) + '([^' + chr(39) + chr(34) + ']+)')}, 1) AS specifier, trim(unnest(string_split(regexp_extract(m, {_q(r'{([^}]*)}')}, 1), ','))) AS p"
    f" FROM (SELECT file, unnest(regexp_extract_all(content, {_q(_NAMED)}) || regexp_extract_all(content, {_q(_REQUIRED)})) AS m FROM f)),"
    " named AS (SELECT file, specifier, regexp_extract(p, '^(\\w+)', 1) AS imported, coalesce(nullif(regexp_extract(p, '(?:\\s+as\\s+|:\\s*)(\\w+)$', 1), ''), regexp_extract(p, '^(\\w+)', 1)) AS local FROM several WHERE p <> ''"
    f" UNION ALL SELECT file, regexp_extract(m, {_q(chr(91) + chr(39) + chr(34) + chr(93) + '([^' + chr(39) + chr(34) + ']+)')}, 1), 'default', regexp_extract(m, 'import\\s+(\\w+)', 1) FROM (SELECT file, unnest(regexp_extract_all(content, {_q(_DEFAULT)})) AS m FROM f)),"
    " aimed AS (SELECT *, CASE WHEN specifier LIKE '.%' THEN array_to_string(list_reduce(list_transform(list_filter(string_split(regexp_replace(file, '[^/]*$', '') || '/' || specifier, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:len(a) - 1] ELSE a || x END), '/') END AS target FROM named),"
    " resolved AS (SELECT a.file AS src, specifier, imported, local, (SELECT arg_min(f.file, r.n) FROM f, (VALUES ('', 0), ('.js', 1), ('.ts', 2), ('.jsx', 3), ('.tsx', 4), ('/index.js', 5), ('/index.ts', 6)) AS r(e, n) WHERE f.file = a.target || r.e) AS dst FROM aimed a)"
)
_E = "exported AS (SELECT DISTINCT file, symbol FROM (SELECT file, unnest(" + " || ".join(f"regexp_extract_all(content, {_q(p)}, 1)" for p in _EXPORTS) + ") AS symbol FROM f))"
IMPORTS_SQL = f"WITH {_F}, {_I} SELECT * FROM resolved"
EXPORTS_SQL = f"WITH {_F}, {_E} SELECT * FROM exported"
CYCLES_SQL = f"WITH {_F}, {_I} SELECT DISTINCT a.src AS a, a.dst AS b FROM resolved a JOIN resolved b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"
CROSS_SQL = (
    f"WITH {_F}, {_L}, {_I}, sinks AS (SELECT DISTINCT file AS sink_file, regexp_extract(b, 'function\\s+(\\w+)', 1) AS function FROM (SELECT file, unnest(regexp_extract_all(content, {_q(r'(?s)export\s+function\s+\w+\s*\([^)]*\)\s*\{.*?\n\}')})) AS b FROM f) WHERE regexp_matches(b, {_q(SINK)}))"
    " SELECT DISTINCT l.file, line, function, sink_file FROM l JOIN resolved r ON r.src = l.file JOIN sinks s ON s.sink_file = r.dst AND s.function = r.imported WHERE regexp_matches(txt, '\\b' || local || '\\s*\\([^)]*\\b(?:req|request)\\.(?:body|query|params|headers)')"
)
MISSING_SQL = (
    f"WITH {_F}, {_E}, shown AS (SELECT file, min(symbol) AS symbol FROM exported GROUP BY file)"
    f" SELECT file, symbol FROM shown JOIN f USING (file) WHERE len(regexp_split_to_array(content, '\\r?\\n')) > 40 AND NOT regexp_matches(file, {_q(FILE_CLASSES['is_test'])})"
    " AND NOT EXISTS (SELECT 1 FROM f AS t WHERE regexp_replace(t.file, '[^/]*$', '') IN (regexp_replace(shown.file, '[^/]*$', ''), regexp_replace(shown.file, '[^/]*$', '') || '__tests__/')"
    " AND regexp_matches(regexp_extract(t.file, '[^/]*$'), '^(test_' || regexp_extract(shown.file, '([^/]+)\\.[^./]+$', 1) || '|' || regexp_extract(shown.file, '([^/]+)\\.[^./]+$', 1) || '(\\.test|\\.spec|-test|_test))\\.' || regexp_extract(shown.file, '[^.]+$') || '$'))"
)
DOCS_SQL = (
    f"WITH {_F}, {_L}, {_E}, c AS (SELECT *, trim(txt) <> '' AS filled, regexp_matches(txt, {_q(_COMMENT)}) AS comment FROM l), d AS (SELECT *, coalesce(lag(comment) OVER (PARTITION BY file ORDER BY line), true) AS after_comment FROM c)"
    " SELECT file, 'POOR_DOCUMENTATION' AS category, CAST(1 AS BIGINT) AS line FROM d WHERE file IN (SELECT file FROM exported) GROUP BY file HAVING count(*) FILTER (filled) > 50 AND count(*) FILTER (filled AND comment) < 0.04 * count(*) FILTER (filled)"
    " UNION ALL SELECT file, 'MISSING_HEADER', line FROM (SELECT * FROM d WHERE filled AND NOT comment QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) = 1) WHERE line > 1 AND NOT after_comment"
)
TAINT_SQL = (
    f"WITH RECURSIVE {_F}, {_L}, made AS (SELECT file, regexp_extract(txt, {_q(_ASSIGN)}, 1) AS names, regexp_extract(txt, {_q(_ASSIGN)}, 2) AS value FROM l WHERE regexp_matches(txt, {_q(_ASSIGN)})),"
    f" named AS (SELECT file, unnest(regexp_extract_all(names, {_q(_WORD)})) AS name, value FROM made WHERE NOT regexp_matches(value, {_q(CLEAN)})),"
    f" edges AS (SELECT DISTINCT file, name, unnest(regexp_extract_all(regexp_replace(value, {_q(_QUOTED)}, '', 'g'), {_q(_WORD)})) AS used FROM named),"
    f" tainted AS (SELECT file, name FROM named WHERE regexp_matches(value, {_q(SOURCE)}) UNION SELECT e.file, e.name FROM edges e JOIN tainted t ON t.file = e.file AND t.name = e.used WHERE e.name <> e.used),"
    f" calls AS (SELECT file, line, txt, max(CAST(regexp_matches(txt, {_q(CLEAN)}) AS INT)) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS cleared FROM l),"
    f" args AS (SELECT file, line, unnest(regexp_extract_all(regexp_replace(regexp_extract(txt, {_q(rf'(?:{SINK})(.*)$')}, 1), {_q(_QUOTED)}, '', 'g'), {_q(_WORD)})) AS name FROM calls WHERE cleared = 0 AND regexp_matches(txt, {_q(SINK)}))"
    " SELECT file, line, min(name) AS variable FROM args WHERE (file, name) IN (SELECT file, name FROM tainted) GROUP BY file, line"
)
