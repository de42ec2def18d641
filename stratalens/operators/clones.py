"""Clones of code by token blocks, merged to maximal regions.

A line is read into normalised tokens: strings, numbers and identifiers lose their spelling, keywords, operators
and punctuation keep theirs, comments go.  Every run of ``size`` lines of code with enough tokens is a block, and
equal blocks are a class.  A member of a class is linked with its first member alone, so that a class of n blocks
gives n - 1 links and never n * n pairs.  Links on one diagonal (the same two files, the same distance) that
follow each other are one region: gaps and islands over the number of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words of the language that keep their spelling.
KEYWORDS = (
    "async", "await", "break", "case", "catch", "class", "const", "continue", "default", "delete", "do", "else", "export", "extends", "false", "finally", "for", "from", "function", "if", "import", "in", "instanceof",
    "let", "new", "null", "of", "return", "static", "super", "switch", "this", "throw", "true", "try", "typeof", "undefined", "var", "void", "while", "with", "yield",
)
_MARKS = "{}()[];,."
TOKEN = r"""(?:"[^"]*"|'[^']*'|`[^`]*`)|[\p{L}_$][\p{L}\p{N}_$]*|\p{N}+(?:\.\p{N}+)?|[^\s\p{L}\p{N}_$]"""
_LINE_COMMENT = r"(^|\s)//.*$|^\s*#.*$"


def without_block_comments(text: Column) -> Column:
    """The text with the line feeds of its ``/* */`` comments only; an open comment reaches to the end."""
    closed = lambda p: F.concat(F.regexp_replace(F.split_part(p, F.lit("*/"), F.lit(1)), r"[^\n]", ""), F.substr(p, F.length(F.split_part(p, F.lit("*/"), F.lit(1))) + 3))
    return F.array_join(F.transform(F.split(text, r"/\*"), lambda p, i: F.when(i == 0, p).otherwise(closed(p))), "")


def normalised(line: Column, keep_names: bool = False) -> Column:
    """The tokens of a line: STR, NUM, ID, KW:word, P:mark, OP:sign.  With ``keep_names`` identifiers stay in small letters."""

    def kind(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        name = F.when(t.isin(*KEYWORDS), F.concat(F.lit("KW:"), t)).otherwise(F.lower(t) if keep_names else F.lit("ID"))
        return (
            F.when(first.isin('"', "'", "`") & (F.length(t) > 1), "STR").when(first.rlike(r"[\p{L}_$]"), name).when(first.rlike(r"\p{N}"), "NUM")
            .when(F.lit(_MARKS).contains(t), F.concat(F.lit("P:"), t)).otherwise(F.concat(F.lit("OP:"), t))
        )

    return F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), kind)


def code_lines(files: DataFrame, file: str = "file", text: str = "content", keep_names: bool = False) -> DataFrame:
    """file, i, line, body, tokens: the lines that hold code, numbered by i without the others.  Null texts give none."""
    rows = files.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.posexplode(F.split(without_block_comments(F.col(text)), "\r?\n")).alias("at", "txt"))
    rows = rows.select("file", (F.col("at") + 1).cast("long").alias("line"), normalised(F.regexp_replace("txt", _LINE_COMMENT, ""), keep_names).alias("t")).where(F.size("t") > 0)
    return rows.select("file", "line", F.array_join("t", " ").alias("body"), F.size("t").cast("long").alias("tokens"), (F.row_number().over(Window.partitionBy("file").orderBy("line"))).cast("long").alias("i"))


def blocks(files: DataFrame, size: int = 5, least_tokens: int = 10, file: str = "file", text: str = "content", keep_names: bool = False) -> DataFrame:
    """file, i, line, last_line, tokens, block_hash: every run of ``size`` lines of code with ``least_tokens`` tokens or more."""
    w = Window.partitionBy("file").orderBy("i")
    ahead = w.rowsBetween(0, size - 1)
    b = code_lines(files, file, text, keep_names).select("file", "i", "line", F.max("line").over(ahead).alias("last_line"), F.sum("tokens").over(ahead).alias("tokens"), F.count("*").over(ahead).alias("n"), F.array_join(F.collect_list("body").over(ahead), "\n").alias("body"))
    return b.where((F.col("n") == size) & (F.col("tokens") >= least_tokens)).select("file", "i", "line", "last_line", "tokens", F.sha2("body", 256).alias("block_hash"))


def classes(b: DataFrame) -> DataFrame:
    """block_hash, n, n_files, links (n - 1) and the first member of every class of two blocks or more."""
    c = b.groupBy("block_hash").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.min(F.struct("file", "i", "line")).alias("first")).where("n > 1")
    return c.select("block_hash", "n", "n_files", (F.col("n") - 1).alias("links"), F.col("first.file").alias("first_file"), F.col("first.i").alias("first_i"), F.col("first.line").alias("first_line"))


def regions(b: DataFrame, size: int = 5) -> DataFrame:
    """file, start_line, end_line, of_file, of_start, blocks, tokens: maximal regions that repeat what stands earlier.

    A block that overlaps its first member in the same file is no clone.  ``tokens`` counts those of the first
    block and of each line that a further block adds, at least.
    """
    first = classes(b).select("block_hash", "first_file", "first_i", "first_line")
    apart = (F.col("file") != F.col("first_file")) | (F.col("i") - F.col("first_i") >= size)
    links = b.join(first, "block_hash").where(apart).withColumn("diagonal", F.col("i") - F.col("first_i"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("file", "first_file", "diagonal").orderBy("i"))
    return links.withColumn("island", island).groupBy("file", F.col("first_file").alias("of_file"), "diagonal", "island").agg(
        F.min("line").alias("start_line"), F.max("last_line").alias("end_line"), F.min("first_line").alias("of_start"), F.count("*").alias("blocks"), F.max("tokens").alias("tokens")
    ).drop("diagonal", "island")


def summary(found: DataFrame) -> DataFrame:
    """One row: clones, duplicate_lines, cross_file and internal clones, and the files that hold one."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return found.agg(
        F.count("*").alias("clones"), F.coalesce(F.sum(lines), F.lit(0)).alias("duplicate_lines"), F.count_if(F.col("file") != F.col("of_file")).alias("cross_file"),
        F.count_if(F.col("file") == F.col("of_file")).alias("internal"), F.countDistinct("file").alias("files"),
    )


def longest(found: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` regions of most lines; equal ones by place."""
    return found.withColumn("lines", F.col("end_line") - F.col("start_line") + 1).orderBy(F.desc("lines"), "file", "start_line", "of_file", "of_start").limit(k)


# ---- the same for DuckDB


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blocks_sql(files: str, size: int = 5, least_tokens: int = 10, keep_names: bool = False) -> str:
    """Common table expressions up to ``b``, the blocks of a relation (file, content)."""
    name = "lower(x)" if keep_names else "'ID'"
    closed = "regexp_replace(split_part(p, '*/', 1), '[^\\n]', '', 'g') || substr(p, length(split_part(p, '*/', 1)) + 3)"
    kind = (
        f"CASE WHEN x[1] IN ('\"', '''', '`') AND length(x) > 1 THEN 'STR' WHEN regexp_matches(x, '^[\\p{{L}}_$]') THEN CASE WHEN x IN {KEYWORDS} THEN 'KW:' || x ELSE {name} END"
        f" WHEN regexp_matches(x, '^\\p{{N}}') THEN 'NUM' WHEN contains({_q(_MARKS)}, x) THEN 'P:' || x ELSE 'OP:' || x END"
    )
    return (
        f"src AS (SELECT file, array_to_string(list_transform(string_split(content, '/*'), lambda p, j: CASE WHEN j = 1 THEN p ELSE {closed} END), '') AS content FROM ({files}) WHERE content IS NOT NULL),"
        " split AS (SELECT file, regexp_split_to_array(content, '\\r?\\n') AS p FROM src),"
        f" toks AS (SELECT file, CAST(k AS BIGINT) AS line, list_transform(regexp_extract_all(regexp_replace(p[k], {_q(_LINE_COMMENT)}, '', 'g'), {_q(TOKEN)}), lambda x: {kind}) AS t FROM split, unnest(range(1, len(p) + 1)) AS r(k)),"
        " code AS (SELECT file, line, array_to_string(t, ' ') AS body, len(t) AS tokens, row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM toks WHERE len(t) > 0),"
        " wide AS (SELECT file, i, line, max(line) OVER w AS last_line, CAST(sum(tokens) OVER w AS BIGINT) AS tokens, count(*) OVER w AS n, string_agg(body, chr(10)) OVER w AS body FROM code"
        f" WINDOW w AS (PARTITION BY file ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),"
        f" b AS MATERIALIZED (SELECT file, i, line, last_line, tokens, sha256(body) AS block_hash FROM wide WHERE n = {size} AND tokens >= {least_tokens}),"
        " c AS (SELECT block_hash, count(*) AS n, count(DISTINCT file) AS n_files, min({'file': file, 'i': i, 'line': line}) AS first FROM b GROUP BY block_hash HAVING count(*) > 1),"
        f" links AS (SELECT b.*, first.file AS first_file, first.line AS first_line, i - first.i AS diagonal FROM b JOIN c USING (block_hash) WHERE b.file <> first.file OR i - first.i >= {size}),"
        " regions AS (SELECT file, first_file AS of_file, min(line) AS start_line, max(last_line) AS end_line, min(first_line) AS of_start, count(*) AS blocks, max(tokens) AS tokens FROM"
        " (SELECT *, i - row_number() OVER (PARTITION BY file, first_file, diagonal ORDER BY i) AS island FROM links) GROUP BY file, first_file, diagonal, island)"
    )


CLASSES = "SELECT block_hash, n, n_files, n - 1 AS links, first.file AS first_file, first.i AS first_i, first.line AS first_line FROM c"
REGIONS = "SELECT * FROM regions"
SUMMARY = "SELECT count(*) AS clones, CAST(coalesce(sum(end_line - start_line + 1), 0) AS BIGINT) AS duplicate_lines, count(*) FILTER (file <> of_file) AS cross_file, count(*) FILTER (file = of_file) AS internal, count(DISTINCT file) AS files FROM regions"
LONGEST = "SELECT *, end_line - start_line + 1 AS lines FROM regions ORDER BY lines DESC, file, start_line, of_file, of_start LIMIT 50"
