"""The token rules on code that differs by blanks, quotes, case and what else stands in the line, in Spark and in SQL."""

import duckdb
import pytest

from stratalens.operators import packs

from .oracle import same

CASES = {
    "performance": [
        ("SYNC_IO", "x = fs.readFileSync(p)", 4, "fs.readFileSync"),
        ("SYNC_FILE_PARSE", "a = JSON.parse (\tfs.readFileSync(p))", 4, "JSON.parse (\tfs.readFileSync"),
        ("AWAIT_IN_LOOP", "for (const u of urls) { await(get(u)); }", 0, "for (const u of urls) { await"),
        ("AWAIT_IN_LOOP", "for (const u of urls) await get(u);", 0, "for (const u of urls) await"),
        ("AWAIT_IN_LOOP", "for (const u of urls) { if (u) { a(); } await get(u); }", 0, "for (const u of urls) { if (u) { a(); } await"),
        ("AWAIT_IN_LOOP", "await open(); for (;;) step();", 0, "await open(); for ("),
        ("ASYNC_TIMEOUT", " setTimeout(async () => { x = await(save()); }, 10);", 1, "setTimeout(async"),
        (None, "setTimeout(asyncTask, await delay());", 0, ""),
        (None, "const waitFor = 1; before();", 0, ""),
    ],
    "ai_risk": [
        ("EMPTY_CATCH", "try { a(); } catch (_) {} try { b(); } catch (e) { }", 39, "catch (e) { }"),
        ("EMPTY_CATCH", "try { a(); } catch {}", 13, "catch {}"),
        (None, "try { a(); } catch (_e) {}", 0, ""),
        ("PERMISSIVE_CORS", "res.set('Access-Control-Allow-Origin', \"*\");", 9, "Access-Control-Allow-Origin', \"*\""),
        ("DEFAULT_CREDENTIALS", 'const user = { "Password" : `Admin` };', 16, 'Password" : `Admin`'),
        ("CONSOLE_SENSITIVE", "console.log( 'x', API_KEY);", 0, "console.log("),
        ("TODO_SECURITY", "x(); // FixMe later: Encrypt", 8, "FixMe later: Encrypt"),
        ("HARDCODED_IV", "const iv = '0000000000000000';", 6, "iv = '0000000000000000"),
        ("HARDCODED_IV", 'const IV="00112233445566778899aabb";', 6, 'IV="00112233445566778899aabb'),
        (None, "const div = '0000000000000000';", 0, ""),
        ("SKIP_SSL_VERIFY", "get({ verify : false })", 6, "verify : false"),
        ("SKIP_SSL_VERIFY", "get({ 'rejectUnauthorized': false })", 7, "rejectUnauthorized': false"),
    ],
    "testing": [
        ("TODO_TESTS", "// add tests (TODO - Add tests)", 14, "TODO - Add tests"),
        (None, "it.only('no test file', f);", 0, ""),
    ],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_token_rules_find_each_case_at_its_place(spark, name):
    files = [(f"src/c{k}.js", line) for k, (_, line, _, _) in enumerate(CASES[name])] + [("src/none.js", None)]
    df = spark.createDataFrame(files, "file string, content string")
    found = packs.line_pack(df, name)
    want = {(f"src/c{k}.js", rule, col, match) for k, (rule, _, col, match) in enumerate(CASES[name]) if rule}
    got = {(r.file, r.rule_id, r.col, r.match) for r in found.collect()}
    assert want <= got and {f for f, *_ in got} == {f for f, *_ in want}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE tree (file VARCHAR, content VARCHAR)")
    duck.executemany("INSERT INTO tree VALUES (?, ?)", files)
    assert same(found, duck.sql(packs.line_pack_sql(name, "SELECT * FROM tree"))) == ""


SPEC = """app.use('/api/*', mount);
const files = 'src/**/*.js';
it.only('after marks in quotes', f);
\t// it.only('comment')
\t/* one line */
describe . only ('blanks', f);
  /**
  it.only('inside', f);
  end */ test.only('behind the end', f);
submit.only(f);
"""


def test_focused_tests_are_found_behind_comment_marks_in_quotes(spark):
    files = [("src/__tests__/a.test.js", SPEC), ("src/a.js", SPEC)]
    found = packs.line_pack(spark.createDataFrame(files, "file string, content string"), "testing")
    got = sorted((r.file, r.line, r.col, r.match) for r in found.collect())
    assert got == [("src/__tests__/a.test.js", 3, 0, "it.only("), ("src/__tests__/a.test.js", 6, 0, "describe . only ("), ("src/__tests__/a.test.js", 9, 9, "test.only(")]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE tree (file VARCHAR, content VARCHAR)")
    duck.executemany("INSERT INTO tree VALUES (?, ?)", files)
    assert same(found, duck.sql(packs.line_pack_sql("testing", "SELECT * FROM tree"))) == ""
