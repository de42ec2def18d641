"""Source trees that Spark derives from the rows of the given tables, a file (or a few) for each row.

The given tables hold prose and no source code, so the operators over source trees are registered on trees
whose files are written from rows: services from parts, infrastructure from suppliers, manifests from
customers, coverage from orders, build logs from events, modules from pages.  Which lines a file has follows
from its row, and the trees grow with the tables.  The expressions are those that Spark and DuckDB share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def written(template: str) -> str:
    """An SQL expression of a text in which ``{expression}`` stands for a value and a line feed for itself."""
    parts: list[str] = []
    for k, piece in enumerate(template.replace("{", "\0{").replace("}", "\0").split("\0")):
        if piece.startswith("{"):
            parts.append(f"coalesce(CAST({piece[1:]} AS STRING), '')")
        elif piece:
            parts += [x for j, line in enumerate(piece.split("\n")) for x in (["chr(10)"] if j else []) + ([_q(line)] if line else [])]
    return " || ".join(parts) or "''"


def when(condition: str, then: str, otherwise: str = "") -> str:
    """A placeholder: one of two texts."""
    return "{CASE WHEN " + condition + " THEN " + (written(then)) + " ELSE " + (written(otherwise)) + " END}"


_OPEN, _SHUT = "{chr(123)}", "{chr(125)}"  # braces of the files themselves

_DOCKER = (
    f"FROM registry/{{replace(p_name, ' ', '-')}}{when('p_size % 3 = 0', ':latest', when('p_size % 3 = 1', ':1.{p_size}').strip())}\n"
    f"{when('p_partkey % 4 = 0', 'ENV DB_PASSWORD=pw{p_partkey}')}\n{when('p_partkey % 5 = 0', 'ADD https://example.org/{p_partkey}.tgz /opt/', 'COPY app{p_partkey}.py /app/')}\n"
    f"{when('p_partkey % 6 = 0', 'COPY . /app')}\nRUN {when('p_size % 2 = 0', 'apt-get update && apt-get install -y git', 'pip install requests==2.{p_size}')}\n"
    f"{when('p_partkey % 7 = 0', 'RUN curl -s https://example.org/i.sh | sh')}\n{when('p_partkey % 9 = 0', 'RUN chmod 777 /app')}\nEXPOSE {{p_size + 10}}\n"
    f"{when('p_partkey % 2 = 0', 'USER app', when('p_partkey % 3 = 0', 'USER root'))}\n{when('p_partkey % 3 = 0', 'HEALTHCHECK NONE')}\n{when('p_partkey % 8 = 0', 'CMD node server.js', 'CMD ["run"]')}\n"
)
_PACKAGE = (
    _OPEN + '\n  "name": "part-{p_partkey}",\n  "scripts": ' + _OPEN + '\n    "' + when("p_partkey % 11 = 0", "postinstall", "start") + '": "node run.js"\n  ' + _SHUT
    + ',\n  "dependencies": ' + _OPEN + '"lib-{p_size}": "^1.{p_partkey % 7}.0"' + _SHUT + ',\n  "devDependencies": ' + _OPEN + '"dev-{p_partkey % 13}": "~2.0.{p_size}"' + _SHUT + "\n" + _SHUT + "\n"
)
_REQUIREMENTS = "# part {p_partkey}\nrequests=={p_size}.31.0\nflask>={p_partkey % 3}.0\n\n-r more.txt\nsix\n"
_POM = "<dependencies><dependency>\n <groupId>org.p{p_partkey}</groupId>\n <artifactId>core</artifactId>\n <version>1.{p_size}</version></dependency>\n<dependency><groupId>org.b</groupId><artifactId>u{p_size}</artifactId></dependency></dependencies>\n"
_GEMS = "GEM\n  specs:\n    rack{p_partkey % 17} (2.2.{p_size})\n      depends (>= 1)\n    rails (7.1.{p_size})\n"
_GO = "module example.org/p{p_partkey}\n\ngo 1.22\n\nrequire (\n\texample.org/a{p_size} v1.2.{p_size}\n\t// example.org/not v0.0.0\n\texample.org/b v0.9.0 // indirect\n)\nrequire example.org/c v2.0.{p_partkey % 5}\n"
_TERRAFORM = (
    f'resource "{when("s_suppkey % 3 = 0", "aws_s3_bucket", when("s_suppkey % 3 = 1", "aws_db_instance", "aws_ebs_volume"))}" "s{{s_suppkey}}" {_OPEN}\n'
    f'  acl = "{when("s_nationkey % 2 = 0", "public-read", "private")}"\n  publicly_accessible = {when("s_suppkey % 4 = 0", "true", "false")}\n  encrypted = {when("s_suppkey % 5 = 0", "false", "true")}\n'
    f'  password = "{when("s_suppkey % 6 = 0", "word{s_suppkey}", "$var")}"\n{_SHUT}\n'
    f'resource "aws_security_group" "g" {_OPEN}\n  from_port = {when("s_suppkey % 7 = 0", "22", "443")}\n  cidr_blocks = ["{when("s_suppkey % 2 = 0", "0.0.0.0/0", "10.0.0.0/8")}"]\n{_SHUT}\n'
    f'actions = ["{when("s_suppkey % 8 = 0", "*", "s3:Get")}"]\n'
)
_MANIFEST = (
    f"apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: {when('c_custkey % 3 = 0', 'true', 'false')}\n  containers:\n  - image: shop/{{lower(c_mktsegment)}}{when('c_custkey % 4 = 0', ':latest', ':1.{c_nationkey}')}\n"
    f"    securityContext:\n      privileged: {when('c_custkey % 5 = 0', 'true', 'false')}\n      runAsUser: {{c_nationkey}}\n{when('c_custkey % 2 = 0', '    resources:')}\n{when('c_custkey % 2 = 0', '      limits:')}\n"
    f"    env:\n    - name: {when('c_custkey % 6 = 0', 'API_TOKEN', 'MODE')}\n      value: v{{c_custkey}}\n"
)
_LCOV = "SF:src/order{o_orderkey}.js\nFN:3,f{o_custkey}\nFNDA:{o_custkey % 4},f\nDA:3,{o_custkey % 3}\nDA:4,{o_orderkey % 2}\nDA:5,{o_orderkey % 5}\nBRDA:4,0,0,{o_orderkey % 2}\nLF:3\nLH:{o_orderkey % 4}\nBRF:1\nBRH:{o_orderkey % 2}\nend_of_record\n"
_COBERTURA = (
    '<coverage><packages><package name="p"><classes>\n<class name="A" filename="src/c{c_custkey}.py"><methods><method name="run" line="2"/></methods><lines>\n'
    '<line number="2" hits="{c_custkey % 3}"/><line number="3" hits="{c_nationkey % 2}"/><line number="4" hits="1"/></lines></class>\n<class name="B" filename="src/b{c_custkey}.py"><lines></lines></class></classes></package></packages></coverage>\n'
)
_BUILD = (
    f"{when('event_id % 2 = 0', 'ERROR in ./src/x{user_id}.js')}\n{when("event_type = 'error'", "Module not found: Error: Can't resolve 'left{user_id}'")}\n"
    f"{when('event_id % 5 = 0', 'SyntaxError: Unexpected token {user_id}')}\n{when('event_id % 10 = 0', '    at src/y{user_id}.js:{event_id % 90 + 1}:7')}\n"
)
_MODULE = (
    f"{when('page_id % 3 = 0', '// page {page_id}')}\nimport {_OPEN} show{{page_id + 1}} {_SHUT} from './p{{page_id + 1}}';\n{when('page_id % 5 = 1', "import " + _OPEN + " show{page_id - 1} " + _SHUT + " from './p{page_id - 1}';")}\nimport extra from 'left';\n"
    "const id = req.query.id;\nconst copy = id;\nlet text = `select $` + copy;\n" + when("page_id % 4 = 0", "db.query(text);", "const clean = escape(text); db.query(clean);")
    + "\nfetch('http://10.1.2.{page_id % 250}/collect');\n" + when("page_id % 6 = 0", "const all = Object.keys(process.env);") + "\n" + when("page_id % 7 = 0", f"try {_OPEN} go(); {_SHUT} catch (e) {_OPEN}{_SHUT}") + "\n"
    + when("page_id % 9 = 0", "// TODO: fix auth of page {page_id}", "// TODO: add tests") + "\n" + when("page_id % 8 = 0", "const data = JSON.parse(fs.readFileSync(name));") + "\nsetTimeout(async () => " + _OPEN + " await save(); " + _SHUT + ", {page_id});\n"
    + f"export function show{{page_id}}(a) {_OPEN}\n  pool.execute('select ' + a);\n  emit('{{replace(replace(html, '''', ' '), '</p>', ''');' || chr(10) || 'emit(''')}}');\n"
    + when("page_id % 2 = 0", "  show{page_id + 1}(req.body.id);") + f"\n  return a;\n{_SHUT}\n"
)
_SPEC = f"describe{when('page_id % 20 = 0', '.only')}('page {{page_id}}', () => {_OPEN}\n  it('shows', () => {_OPEN}{_SHUT});\n{_SHUT});\n/*\n * it.only('in a comment')\n */\n"

#: table, path and content of its files.
TREE: tuple[tuple[str, str, str], ...] = tuple(
    (table, written(path), written(content))
    for table, path, content in (
        ("part", "services/p{p_partkey}/Dockerfile", _DOCKER), ("part", "services/p{p_partkey}/package.json", _PACKAGE), ("part", "services/p{p_partkey}/requirements.txt", _REQUIREMENTS), ("part", "services/p{p_partkey}/pom.xml", _POM),
        ("part", "services/p{p_partkey}/Gemfile.lock", _GEMS), ("part", "services/p{p_partkey}/go.mod", _GO), ("supplier", "infra/s{s_suppkey}.tf", _TERRAFORM), ("customer", "deploy/c{c_custkey}.yaml", _MANIFEST),
        ("orders", "coverage/o{o_orderkey}/lcov.info", _LCOV), ("customer", "coverage/c{c_custkey}/cobertura.xml", _COBERTURA), ("events", "logs/e{event_id}/build.log", _BUILD),
        ("pages", "src/p{page_id}.js", _MODULE), ("pages", "src/__tests__/p{page_id * 3}.test.js", _SPEC),
    )
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and content of every derived file; a reader of some paths prunes the tables that have none of them."""
    each = [spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(f"{p} AS file", f"{c} AS content") for t, p, c in TREE]
    return reduce(DataFrame.unionByName, each)


def tree_sql() -> str:
    """The same files as a DuckDB relation."""
    return " UNION ALL ".join(f"SELECT {p} AS file, {c} AS content FROM {t}" for t, p, c in TREE)
