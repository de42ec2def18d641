"""Small made-up files on which the operators over source trees are registered and tested.

A real run reads its files with ``discover_files``; these stand in for them, because the given tables
hold prose and no source code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LONG = "\n".join(f"  total += weight[{i}] * sample({i});" for i in range(45))

#: file, content
FILES: tuple[tuple[str, str], ...] = (
    ("Dockerfile", "FROM node:latest\nENV DB_PASSWORD=hunter2abc\nARG BUILD_TOKEN=abc\nADD https://example.org/x.tgz /opt/\nCOPY . /app\nRUN curl -s https://example.org/i.sh | sh\nRUN apt-get update && apt-get install -y git\nRUN chmod 777 /app\nEXPOSE 22\nWORKDIR app\nCMD node server.js\n"),
    ("images/Dockerfile.good", "FROM python:3.12-slim\nWORKDIR /srv\nCOPY requirements.txt /srv/\nRUN pip install requests==2.31.0\nUSER app\nHEALTHCHECK CMD [\"true\"]\nEXPOSE 8080\nCMD [\"python\", \"run.py\"]\n"),
    ("images/Dockerfile.root", "FROM registry/base/root\nUSER root\nADD site.tar.gz /srv/\nCOPY server.pem /etc/ssl/\nCOPY .env /srv/\nRUN pip install flask\nRUN curl -u admin:admin1 https://example.org/a\nHEALTHCHECK NONE\nCMD [\"a\"]\nCMD [\"b\"]\nENTRYPOINT run\n"),
    ("infra/main.tf", "resource \"aws_s3_bucket\" \"logs\" {\n  acl = \"public-read\"\n}\nresource \"aws_db_instance\" \"db\" {\n  publicly_accessible = true\n  password = \"swordfish1\"\n}\nresource \"aws_security_group\" \"ssh\" {\n  from_port = 22\n  cidr_blocks = [\"0.0.0.0/0\"]\n}\nactions = [\"*\"]\n"),
    ("infra/safe.tf", "resource \"aws_ebs_volume\" \"v\" {\n  encrypted = true\n}\npassword = \"${var.password}\"\n"),
    ("deploy/web.yaml", "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n  containers:\n  - image: shop/web:latest\n    securityContext:\n      privileged: true\n      runAsUser: 0\n    env:\n    - name: API_TOKEN\n      value: abc\n"),
    ("deploy/role.yml", "apiVersion: rbac/v1\nkind: ClusterRole\nrules:\n- verbs: [\"*\"]\n  resources: [\"*\"]\nlimits:\n  cpu: 1\n  memory: 1Gi\nrequests:\n  cpu: 1\n"),
    ("notes/plain.yaml", "title: notes\nhostNetwork: true\n"),
    ("package.json", "{\n  \"name\": \"shop\",\n  \"scripts\": {\n    \"postinstall\": \"node setup.js\"\n  },\n  \"dependencies\": {\"left\": \"^1.2.0\"},\n  \"devDependencies\": {\"right\": \"~2.0.1\"}\n}\n"),
    ("src/load.js", "const fs = require('fs');\n// fs.readFileSync is named here\nexport function load(p) {\n  return JSON.parse(fs.readFileSync(p));\n}\nfor (const u of urls) { await get(u); }\nsetTimeout(async () => { await save(); }, 10);\nfor (let i = 0; i < n; i++) {\n  for (let j = 0; j < n; j++) { pair(i, j); }\n}\n"),
    ("src/odd.js", "const name = parts + '.js';\nconst m = require(parts + '.js');\nconst all = Object.keys(process.env);\nconst open = Object.keys(process.env)\n  .filter((k) => k.startsWith('VITE_'));\nfetch('http://10.1.2.3/collect');\nfetch('https://a1b2.ngrok.io/x');\nfetch('https://webhook.site/abc');\neval(atob(code));\nrequire('child_process').exec(cmd);\ndns.lookup(process.env.HOST + '.x');\n# fetch('http://10.1.2.3/comment');\nlet t = 'a\u202eb';\nconst every = Object.entries(process.env);\n"),
    ("src/risk.js", "try { go(); } catch (e) {}\nres.header({ origin: '*' });\nconsole.log('password', password);\n// TODO: fix auth bypass\nconst opts = { rejectUnauthorized: false };\nconst agent = { verify: false };\nconst iv = '0000000000000000';\nconst user = { username: 'admin', password: 'admin' };\n"),
    ("src/big.js", "export const total = (weight) => {\n" + _LONG + "\n};\n"),
    ("src/paid.js", "export function pay(order) {\n" + _LONG + "\n}\n"),
    ("src/__tests__/paid.test.js", "describe.only('pay', () => {\n  it('pays', () => {});\n});\n/*\n * it.only('in a comment')\n */\n// test.only('also not')\n"),
    ("src/store.js", "// TODO: add tests for store\nimport { load } from './load';\nimport { pay } from './paid.js';\nimport extra from 'left';\nconst { query } = require('./db/sql');\nexport const save = (req) => query(req.body.id);\n"),
    ("src/db/sql.js", "import { save } from '../store';\nexport function query(text) {\n  return pool.execute('select ' + text);\n}\nexport default query;\n"),
    ("src/taint.js", "const id = req.query.id;\nconst { name, age } = req.body;\nconst copy = id;\nlet text = `select ${copy}`;\ndb.query(text);\nconst clean = escape(name);\ndb.query(clean);\n\n\n\n\n\ndb.query('x' + age);\nconst fixed = 'a';\ndb.query(fixed);\n"),
    ("requirements.txt", "# pinned\nrequests==2.31.0\nflask>=2.0\n\n-r more.txt\nsix\n"),
    ("pom.xml", "<dependencies><dependency>\n <groupId>org.a</groupId>\n <artifactId>core</artifactId>\n <version>1.4</version></dependency>\n<dependency><groupId>org.b</groupId><artifactId>util</artifactId></dependency></dependencies>\n"),
    ("Gemfile.lock", "GEM\n  specs:\n    rack (2.2.8)\n      depends (>= 1)\n    rails (7.1.0)\n"),
    ("go.mod", "module example.org/shop\n\ngo 1.22\n\nrequire (\n\texample.org/a v1.2.3\n\t// example.org/not v0.0.0\n\texample.org/b v0.9.0 // indirect\n)\nrequire example.org/c v2.0.0\n"),
    ("coverage/lcov.info", "SF:src/load.js\nFN:3,load\nFNDA:2,load\nDA:3,2\nDA:4,0\nBRDA:4,0,0,1\nLF:2\nLH:1\nBRF:1\nBRH:1\nend_of_record\nSF:src/" + "deep/" * 30 + "far.js\nDA:1,1\nLF:1\nLH:1\nend_of_record\n"),
    ("coverage/cobertura.xml", "<coverage><packages><package name=\"p\"><classes>\n<class name=\"A\" filename=\"src/a.py\"><methods><method name=\"run\" line=\"2\"/></methods><lines>\n<line number=\"2\" hits=\"3\"/><line number=\"3\" hits=\"0\"/><line number=\"4\" hits=\"1\"/></lines></class>\n<class name=\"B\" filename=\"src/b.py\"><lines></lines></class></classes></package></packages></coverage>\n"),
    ("build.log", "ERROR in ./src/x.js\nModule not found: Error: Can't resolve 'left'\nError: Cannot find module 'right'\nSyntaxError: Unexpected token )\n    at src/y.js:12:7\nSyntaxError: no place\n"),
)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES), "file string, content string")


def values_sql() -> str:
    """The same rows as a DuckDB relation."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(f)}, {quoted(c)})" for f, c in FILES) + ") AS v(file, content)"
