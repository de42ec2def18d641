"""Comment state, brackets and what they enclose, from an automaton whose transitions are composed.

A line is a map of the states code, comment and template to the state in which it ends: what it does depends on the
state in which it begins.  Maps compose, and composing is associative, so chunks of lines are composed where they
lie, the chunks of a file are folded, and each line then finds the state in which it begins from its chunk alone.
Brackets are matched by depth: after a running sum, the bracket that closes another is the next one of its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE, COMMENT, TEMPLATE = 0, 1, 2
_CHUNK = 128
#: What a line of code holds whole: strings, comments and templates that end on it; escaped characters go before, so that no group loops over long strings.
_WHOLE = r"""\"[^\"]*\"|'[^']*'|`[^`]*`|/\*.*?\*/|//.*$"""
_ESCAPED = r"\\."
_FUNCTION = r"\bfunction\b|=>\s*\{"


def _cut(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, _ESCAPED, ""), _WHOLE, "")


def _bare(code: Column) -> Column:
    """Code without what it holds whole, up to a comment or template that it leaves open."""
    return F.regexp_replace(_cut(code), r"(/\*|`).*$", "")


def _end(code: Column) -> Column:
    left = F.regexp_extract(_cut(code), r"(/\*|`)", 1)
    return F.when(left == "/*", COMMENT).when(left == "`", TEMPLATE).otherwise(CODE)


def _after(line: Column, mark: str) -> Column:
    """What follows the mark; null without one."""
    return F.when(F.instr(line, mark) > 0, F.substr(line, F.instr(line, mark) + len(mark)))


def line_states(files: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """file, line, state (in which the line begins), code (its code, without strings and comments).  Null texts give none."""
    src = files.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.split(text, "\r?\n").alias("rows"))
    rest = lambda x: (x, _after(x, "*/"), _after(x, "`"))

    def line(x: Column) -> Column:
        parts = rest(x)
        ends = [_end(parts[0])] + [F.coalesce(_end(p), F.lit(s)) if p is None else F.when(p.isNull(), s).otherwise(_end(p)) for s, p in ((COMMENT, parts[1]), (TEMPLATE, parts[2]))]
        return F.struct(F.array(*[e.cast("int") for e in ends]).alias("to"), F.array(*[F.coalesce(_bare(p), F.lit("")) for p in parts]).alias("code"))

    maps = src.select("file", F.transform("rows", line).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(_CHUNK))
    chunks = maps.select("file", F.transform(starts, lambda s: F.slice("lines", s, F.lit(_CHUNK))).alias("chunks"))
    same = F.array(F.lit(0), F.lit(1), F.lit(2))
    then = lambda f, g: F.transform(f, lambda s: F.element_at(g, s + 1))
    whole = chunks.select("file", "chunks", F.transform("chunks", lambda c: F.aggregate(c, same, lambda f, x: then(f, x["to"]))).alias("maps"))
    begin = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all"))
    folded = whole.select("file", "chunks", F.aggregate("maps", begin, lambda a, m: F.struct(F.element_at(m, a["s"] + 1).alias("s"), F.array_append(a["all"], a["s"]).alias("all")))["all"].alias("first"))
    each = folded.select("file", F.posexplode(F.arrays_zip("chunks", "first")).alias("c", "x"))
    inside = lambda s: F.struct(s.alias("s"), F.array().cast("array<int>").alias("all"))
    states = F.aggregate(F.col("x.chunks"), inside(F.col("x.first")), lambda a, x: F.struct(F.element_at(x["to"], a["s"] + 1).alias("s"), F.array_append(a["all"], a["s"]).alias("all")))["all"]
    lines = each.select("file", "c", F.col("x.chunks").alias("lines"), states.alias("states")).select("file", "c", F.posexplode(F.arrays_zip("lines", "states")).alias("k", "y"))
    state = F.col("y.states")
    return lines.select("file", (F.col("c") * _CHUNK + F.col("k") + 1).cast("long").alias("line"), state.alias("state"), F.element_at(F.col("y.lines.code"), state + 1).alias("code"))


def bracket_pairs(states: DataFrame, opens: str = "{", closes: str = "}") -> DataFrame:
    """file, level, start_line, end_line, head (the code of the line that opens): every bracket with the one that closes it."""
    marks = F.filter(F.split("code", ""), lambda c: c.isin(opens, closes))
    each = states.select("file", "line", "code", F.posexplode(marks).alias("k", "mark"))
    order = Window.partitionBy("file").orderBy("line", "k")
    depth = F.sum(F.when(F.col("mark") == opens, 1).otherwise(-1)).over(order)
    level = F.when(F.col("mark") == opens, depth).otherwise(depth + 1)
    placed = each.withColumn("level", level)
    of_level = Window.partitionBy("file", "level").orderBy("line", "k")
    paired = placed.withColumn("next_mark", F.lead("mark").over(of_level)).withColumn("end_line", F.lead("line").over(of_level))
    return paired.where((F.col("mark") == opens) & (F.col("next_mark") == closes)).select("file", F.col("level").cast("long").alias("level"), F.col("line").alias("start_line"), "end_line", F.col("code").alias("head"))


def long_functions(pairs: DataFrame, over: int = 80) -> DataFrame:
    """file, start_line, lines of functions of more than ``over`` lines; of several brackets of a line the widest counts."""
    found = pairs.where(F.col("head").rlike(_FUNCTION)).groupBy("file", "start_line").agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return found.where(F.col("lines") > over)


def brace_blocks(pairs: DataFrame, least: int = 5) -> DataFrame:
    """file, level, start_line, end_line of blocks of ``least`` lines or more, once for each place."""
    return pairs.where(F.col("end_line") - F.col("start_line") + 1 >= least).select("file", "level", "start_line", "end_line").distinct()


def long_files(files: DataFrame, over: int = 400, file: str = "file", text: str = "content") -> DataFrame:
    """file and its lines where they are more than ``over``."""
    return files.select(F.col(file).alias("file"), F.size(F.split(text, "\r?\n")).cast("long").alias("lines")).where(F.col("lines") > over)


# ---- the same for DuckDB


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def states_sql(files: str) -> str:
    """Common table expressions (recursive) up to ``st``: file, line, state, code."""
    cut = lambda x: f"regexp_replace(regexp_replace({x}, {_q(_ESCAPED)}, '', 'g'), {_q(_WHOLE)}, '', 'g')"
    bare = lambda x: f"regexp_replace({cut(x)}, '(/\\*|`).*$', '')"
    end = lambda x: f"CASE regexp_extract({cut(x)}, '(/\\*|`)', 1) WHEN '/*' THEN 1 WHEN '`' THEN 2 ELSE 0 END"
    after = lambda m: f"CASE WHEN instr(txt, '{m}') > 0 THEN substr(txt, instr(txt, '{m}') + {len(m)}) END"
    return (
        f"raw AS (SELECT file, CAST(i AS BIGINT) AS line, p[i] AS txt FROM (SELECT file, regexp_split_to_array(content, '\\r?\\n') AS p FROM ({files}) WHERE content IS NOT NULL), unnest(range(1, len(p) + 1)) AS t(i)),"
        f" parts AS (SELECT file, line, txt AS p0, {after('*/')} AS p1, {after('`')} AS p2 FROM raw),"
        f" maps AS MATERIALIZED (SELECT file, line, {end('p0')} AS e0, CASE WHEN p1 IS NULL THEN 1 ELSE {end('p1')} END AS e1, CASE WHEN p2 IS NULL THEN 2 ELSE {end('p2')} END AS e2,"
        f" {bare('p0')} AS c0, coalesce({bare('p1')}, '') AS c1, coalesce({bare('p2')}, '') AS c2 FROM parts),"
        " st AS (SELECT file, line, 0 AS state, c0 AS code, e0 AS ends FROM maps WHERE line = 1 UNION ALL"
        " SELECT m.file, m.line, s.ends, CASE s.ends WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END, CASE s.ends WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END FROM st s JOIN maps m ON m.file = s.file AND m.line = s.line + 1)"
    )


def pairs_sql(files: str) -> str:
    return (
        states_sql(files) + ", marks AS (SELECT file, line, code, k, code[k] AS mark FROM st, unnest(range(1, length(code) + 1)) AS t(k) WHERE code[k] IN ('{', '}')),"
        " deep AS (SELECT *, sum(CASE mark WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY file ORDER BY line, k) + CASE mark WHEN '{' THEN 0 ELSE 1 END AS level FROM marks),"
        " nexts AS (SELECT *, lead(mark) OVER w AS next_mark, lead(line) OVER w AS end_line FROM deep WINDOW w AS (PARTITION BY file, level ORDER BY line, k)),"
        " pairs AS (SELECT file, CAST(level AS BIGINT) AS level, line AS start_line, end_line, code AS head FROM nexts WHERE mark = '{' AND next_mark = '}')"
    )


def long_functions_sql(over: int) -> str:
    return f"SELECT file, start_line, max(end_line - start_line + 1) AS lines FROM pairs WHERE regexp_matches(head, {_q(_FUNCTION)}) GROUP BY file, start_line HAVING max(end_line - start_line + 1) > {over}"
