"""Comment state, brackets, custom rules and predictions against plain loops."""

import random
import re
from collections import defaultdict

import pytest

from stratalens.operators import blocks, custom, prediction


def lexed(text):
    """(state, code) of each line, character by character."""
    out, state = [], blocks.CODE
    for line in re.split("\r?\n", text):
        begin, rest, code = state, line, []
        if state != blocks.CODE:
            mark = "*/" if state == blocks.COMMENT else "`"
            if mark not in rest:
                out.append((begin, ""))
                continue
            rest = rest[rest.index(mark) + len(mark) :]
        state, rest = blocks.CODE, re.sub(r"\\.", "", rest)
        while rest:
            c = rest[0]
            if c in "\"'`" and c in rest[1:]:
                rest = rest[rest.index(c, 1) + 1 :]
            elif rest.startswith("//"):
                rest = ""
            elif rest.startswith("/*") and "*/" in rest[2:]:
                rest = rest[rest.index("*/", 2) + 2 :]
            elif rest.startswith("/*") or c == "`":
                state, rest = (blocks.COMMENT if c == "/" else blocks.TEMPLATE), ""
            else:
                code.append(c)
                rest = rest[1:]
        out.append((begin, "".join(code)))
    return out


PIECES = ["{", "}", "/*", "*/", "//", "`", '"a { b"', "'}'", "x = 1;", "it's", "\\`", "\n", "\n", "\n", "function f() {", "}", "=> {"]


@pytest.mark.parametrize("chunk", [128, 3, 1])
def test_states_and_brackets_equal_a_plain_lexer(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "_CHUNK", chunk)
    rng = random.Random(chunk)
    files = [(f"f{k}", " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 120)))) for k in range(30)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(files, "file string, content string")
    states = blocks.line_states(df).cache()
    got = defaultdict(list)
    for r in sorted(states.collect(), key=lambda r: (r.file, r.line)):
        got[r.file].append((r.state, r.code))
    want = {f: lexed(t) for f, t in files if t is not None}
    assert dict(got) == want
    pairs = []
    for f, t in files:
        stack = []
        for n, (_, code) in enumerate(lexed(t or ""), 1):
            for c in code:
                if c == "{":
                    stack.append(n)
                elif c == "}" and stack:
                    pairs.append((f, stack.pop(), n))
    found = blocks.bracket_pairs(states)
    only_matched = [r for r in found.collect()]
    assert {(r.file, r.start_line, r.end_line) for r in only_matched if r.level > 0} >= {p for p in pairs if balanced(dict(files)[p[0]])}
    assert all(r.start_line <= r.end_line for r in only_matched)


def balanced(text):
    """No closing bracket comes before its opening one."""
    depth = 0
    for _, code in lexed(text or ""):
        for c in code:
            depth += (c == "{") - (c == "}")
            if depth < 0:
                return False
    return True


def test_a_long_file_and_long_functions(spark):
    text = "/* " + "\n".join(f"line {k}" for k in range(1000)) + " */ function g() {\n" + "x();\n" * 90 + "}\n" + 'const s = "' + "a" * 300_000 + '"; function h() { y(); }'
    df = spark.createDataFrame([("a.js", text)], "file string, content string")
    states = blocks.line_states(df)
    assert states.where("state = 1").count() == 999
    assert [tuple(r) for r in blocks.long_functions(blocks.bracket_pairs(states)).collect()] == [("a.js", 1000, 92)]
    assert [r.lines for r in blocks.long_files(df).collect()] == [1092]


def test_rules_with_regions_alternatives_and_exclusions(spark):
    text = "begin\n db.query(a);\n // db.query(b);\n run(c.d); db.query(safe);\nend\ndb.query(e);\nbegin db.query(f) end\n"
    df = spark.createDataFrame([("a.js", text, "js"), ("b.py", text, "py"), ("c.js", None, "js")], "file string, content string, lang string")
    rule = custom.CustomRule("R", "HIGH", ("db.query($X)", "run($X)"), inside=r"(?s)begin.*?end", excluded=("db.query(safe)",), langs=("js",), message="{X} goes out", fix="bind({X})")
    got = sorted((r.file, r.line, r.col, r.match, r.message, r.fix) for r in custom.run_rule(df, rule, lang="lang").collect())
    assert got == [("a.js", 2, 1, "db.query(a)", "a goes out", "bind(a)"), ("a.js", 4, 1, "run(c.d)", "c.d goes out", "bind(c.d)"), ("a.js", 7, 6, "db.query(f)", "f goes out", "bind(f)")]
    assert custom.run_rule(df, custom.CustomRule("S", "LOW", ("nothing at all",))).collect() == []
    with pytest.raises(ValueError):
        custom.run_rule(df, custom.CustomRule("", "odd", ()))


def test_containment_by_a_sweep_equals_all_pairs(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.choice("ab"), s := rng.randint(0, 60), s + rng.randint(1, 15)) for _ in range(n)]
    matches, regions = sorted(set(spans(80))), spans(12)
    m, r = (spark.createDataFrame(x, "file string, start long, stop long") for x in (matches, regions))
    want = [x for x in matches if any(f == x[0] and s <= x[1] and x[2] <= e for f, s, e in regions)]
    assert sorted(map(tuple, custom.contained(m, r).collect())) == want


def test_predictions_equal_a_loop_over_runs(spark):
    rng = random.Random(6)
    rows = [(p, n, rng.choice("wxyz")) for p in ("a", "b", None) for n in range(12) for _ in range(rng.randint(1, 3))] + [("one", 1, "w"), ("a", 3, None)]
    by = defaultdict(lambda: defaultdict(set))
    for p, n, c in rows:
        if p is not None and c is not None:
            by[p][n].add(c)
    want = []
    for p, runs in by.items():
        seen, order = defaultdict(lambda: defaultdict(int)), sorted(runs)
        for k, n in enumerate(order[:-1]):
            score = defaultdict(float)
            for was in runs[n]:
                total = sum(seen[was].values())
                for to, c in seen[was].items():
                    score[to] += c / total
            for to, s in score.items():
                if round(s, 6) >= 0.5:
                    want.append((p, n, to, round(s, 6), to in runs[order[k + 1]]))
            for was in runs[n]:
                for to in runs[order[k + 1]] - {was}:
                    seen[was][to] += 1
    df = spark.createDataFrame(rows, "project string, run long, category string")
    got = prediction.predictions(df)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    q = prediction.quality(got, df).first()
    assert (q.predicted, q.right) == (len(want), sum(w[-1] for w in want)) and q.came == sum(len(runs[n]) for runs in by.values() for n in sorted(runs)[1:])


def test_scores_meet_tests_by_name_part_keyword_or_suite(spark):
    tests = spark.createDataFrame([("login form", "auth"), ("cart-total", None), ("cart price", "shop"), ("a", "auth")], "test string, keyword string")
    scores = spark.createDataFrame([(1, "Total", None), (2, "cart", "shop"), (3, "cart", "auth"), (4, None, "none"), (5, "login", "shop")], "score_id long, base string, keyword string")
    got = sorted(map(tuple, prediction.matched_tests(scores, tests).collect()))
    assert got == [(1, "unique", "cart-total"), (2, "keyword", "cart price"), (3, "keyword", "a"), (4, "suite", None), (5, "unique", "login form")]
