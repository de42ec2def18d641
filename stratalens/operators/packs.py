"""Rule packs over source files: containers, infrastructure, supply chain, performance, tests, generated code.

Files are read into facts first, a row per line: the instruction of a Dockerfile and what it is given, attribute,
value and block of a Terraform line, key and value of a manifest, the address, quoted text and call of a line of
code.  A rule is a condition on facts, written in the SQL that Spark and DuckDB share, so that the same text
runs in both engines and no rule searches whole files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import lines


@dataclass(frozen=True)
class Rule:
    """``when`` holds for a line, or, with ``whole``, for the totals of a file (reported at line 1)."""

    rule_id: str
    severity: str
    group: str
    when: str
    whole: bool = False
    first: bool = False
    comments: bool = False


@dataclass(frozen=True)
class Pack:
    """``path``: expression of the file names read; ``layers``: columns computed one layer after the other; ``totals``: sums over a file."""

    path: str
    layers: tuple[tuple[tuple[str, str], ...], ...]
    rules: tuple[Rule, ...]
    totals: tuple[tuple[str, str], ...] = ()
    only_if: str = ""


def _any(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _has(column: str, *texts: str) -> str:
    """One of the texts stands in the column."""
    return _any(*[f"instr({column}, '{t.replace(chr(39), chr(39) * 2)}') > 0" for t in texts])


def _ends(column: str, *texts: str) -> str:
    return _any(*[f"{column} LIKE '%{t}'" for t in texts])


_SECRET_WORDS = ("password", "secret", "key", "token")
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
_OPS = ("from", "run", "cmd", "label", "expose", "env", "add", "copy", "entrypoint", "volume", "user", "workdir", "arg", "onbuild", "stopsignal", "healthcheck", "shell", "maintainer")
_OVER = "OVER (PARTITION BY file ORDER BY line)"

# ---- containers: the instruction in force on each line, and what it is given

_DOCKER = (
    (("low", "lower(trim(txt))"),),
    (("word", "split_part(low, ' ', 1)"),),
    (("op_here", f"CASE WHEN word IN {_OPS} THEN word END"),),
    (("step", f"sum(CASE WHEN op_here IS NOT NULL THEN 1 ELSE 0 END) {_OVER}"),),
    (("op", "coalesce(max(op_here) OVER (PARTITION BY file, step), '')"), ("arg", "CASE WHEN op_here IS NULL THEN low ELSE trim(substr(low, length(word) + 1)) END")),
    (("image", "split_part(arg, ' ', 1)"), ("given", "split_part(replace(arg, ' ', '='), '=', 1)"), ("spaced", "' ' || arg || ' '")),
    (("last_part", "split_part(image, '/', -1)"), ("host", "CASE WHEN instr(image, '/') > 0 THEN split_part(image, '/', 1) ELSE '' END"), ("port", "coalesce(TRY_CAST(split_part(image, '/', 1) AS INT), 0)")),
)
_COPIES, _RUNS = "op IN ('copy', 'add')", "op = 'run'"
_PACKED = (".tar", ".tar.gz", ".tgz", ".tar.bz2")
#: Fixed values of the packs below: identifiers, severities and groups.
CONTAINER = (
    Rule("container/root-user", "HIGH", "user_privileges", "op = 'user' AND arg IN ('root', '0')"),
    Rule("container/no-user", "MEDIUM", "user_privileges", "n_user = 0", whole=True),
    Rule("container/sudo-installed", "MEDIUM", "user_privileges", f"{_RUNS} AND {_has('arg', 'install')} AND {_has('spaced', ' sudo ')}"),
    Rule("container/latest-tag", "HIGH", "base_image", "op = 'from' AND image LIKE '%:latest'"),
    Rule("container/no-tag", "HIGH", "base_image", "op = 'from' AND image NOT IN ('', 'scratch') AND instr(last_part, ':') = 0 AND instr(image, '@') = 0 AND instr(image, '$') = 0"),
    Rule("container/untrusted-base", "MEDIUM", "base_image", "op = 'from' AND instr(host, '.') > 0 AND host NOT IN ('docker.io', 'gcr.io', 'ghcr.io', 'quay.io', 'mcr.microsoft.com', 'public.ecr.aws', 'registry.k8s.io')"),
    Rule("container/privileged-base", "HIGH", "base_image", "op = 'from' AND host <> '' AND (last_part LIKE 'root%' OR last_part LIKE 'admin%' OR last_part LIKE 'privileged%')"),
    Rule("container/env-password", "CRITICAL", "secrets", f"op = 'env' AND {_has('given', *_SECRET_WORDS)} AND length(arg) > length(given) + 1"),
    Rule("container/arg-secret", "HIGH", "secrets", f"op = 'arg' AND instr(arg, '=') > 0 AND {_has('given', *_SECRET_WORDS)}"),
    Rule("container/copy-private-key", "CRITICAL", "secrets", f"{_COPIES} AND {_has('spaced', '.pem ', '.key ', '.p12 ', '.pfx ', '.jks ')}"),
    Rule("container/copy-env-file", "HIGH", "secrets", f"{_COPIES} AND {_has('spaced', ' .env')}"),
    Rule("container/curl-with-auth", "HIGH", "secrets", f"{_has('spaced', ' curl ')} AND (spaced LIKE '% -u %:%' OR spaced LIKE '% --user %:%')"),
    Rule("container/expose-ssh", "MEDIUM", "network", f"op = 'expose' AND {_has('spaced', ' 22 ', ' 22/tcp ')}"),
    Rule("container/expose-many-ports", "LOW", "network", "n_expose > 5", whole=True),
    Rule("container/privileged-port", "LOW", "network", "op = 'expose' AND port BETWEEN 1 AND 1023 AND port NOT IN (22, 80, 443)"),
    Rule("container/apt-no-version", "LOW", "packages", f"{_has('arg', 'apt-get install', 'apt-get -y install')} AND instr(arg, '=') = 0"),
    Rule("container/no-cache-cleanup", "LOW", "packages", "n_apt > 0 AND n_clean = 0", whole=True),
    Rule("container/pip-no-version", "LOW", "packages", f"{_has('arg', 'pip install ', 'pip3 install ')} AND instr(arg, '==') = 0 AND instr(spaced, ' -r ') = 0"),
    Rule("container/npm-dev-deps", "LOW", "packages", f"{_has('spaced', ' npm install ', ' npm ci ')} AND NOT {_has('arg', '--production', '--omit=dev', '--only=prod')}"),
    Rule("container/add-remote", "HIGH", "instructions", "op = 'add' AND (arg LIKE 'http://%' OR arg LIKE 'https://%')"),
    Rule("container/add-tar", "MEDIUM", "instructions", f"op = 'add' AND {_ends('image', *_PACKED)}"),
    Rule("container/copy-all", "MEDIUM", "instructions", "op = 'copy' AND image = '.'"),
    Rule("container/chmod-777", "HIGH", "instructions", f"{_has('spaced', ' chmod 777 ', ' chmod -r 777 ', ' chmod 0777 ')}"),
    Rule("container/workdir-relative", "LOW", "instructions", "op = 'workdir' AND arg <> '' AND arg NOT LIKE '/%' AND arg NOT LIKE '$%'"),
    Rule("container/multiple-cmd", "LOW", "instructions", "n_cmd > 1", whole=True),
    Rule("container/multiple-entrypoint", "LOW", "instructions", "n_entrypoint > 1", whole=True),
    Rule("container/shell-form-cmd", "LOW", "instructions", "op_here IN ('cmd', 'entrypoint') AND arg NOT LIKE '[%'"),
    Rule("container/no-healthcheck", "LOW", "instructions", "n_healthcheck = 0", whole=True),
    Rule("container/healthcheck-disabled", "MEDIUM", "instructions", "op = 'healthcheck' AND arg = 'none'"),
    Rule("container/setuid-binary", "HIGH", "runtime", f"{_has('spaced', ' chmod u+s ', ' chmod +s ', ' chmod 4755 ')}"),
    Rule("container/curl-bash", "HIGH", "runtime", f"{_has('spaced', ' curl ', ' wget ')} AND {_has('replace(spaced, ' + chr(39) + '| ' + chr(39) + ', ' + chr(39) + '|' + chr(39) + ')', '|sh ', '|bash ')}"),
    Rule("container/apk-no-cache", "LOW", "runtime", "n_apk > 0 AND n_apk_clean = 0", whole=True),
)


def _count(name: str, condition: str) -> tuple[str, str]:
    return name, f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


_DOCKER_TOTALS = (
    *[_count(f"n_{op}", f"op_here = '{op}'") for op in ("user", "expose", "cmd", "entrypoint", "healthcheck")],
    _count("n_apt", _has("arg", "apt-get install")), _count("n_clean", _has("arg", "/var/lib/apt")), _count("n_apk", _has("arg", "apk add")), _count("n_apk_clean", _has("arg", "--no-cache")),
)

# ---- Terraform: attribute, value, the resource and the innermost block of each line

_TF = (
    (("low", "trim(txt)"),),
    (
        ("attr", "lower(regexp_extract(low, '^\"?([A-Za-z_]+)\"?[ ]*[=:]', 1))"), ("value", "trim(regexp_extract(low, '^\"?[A-Za-z_]+\"?[ ]*[=:][ ]*([^#]*)', 1))"),
        ("opened", "regexp_extract(low, '^resource[ ]+\"([a-z0-9_]+)\"', 1)"), ("edge", "CASE WHEN instr(low, '{') > 0 OR instr(low, '}') > 0 THEN 1 ELSE 0 END"),
    ),
    (("area", f"sum(edge) {_OVER}"), ("res_no", f"sum(CASE WHEN opened <> '' THEN 1 ELSE 0 END) {_OVER}"), ("bare", "replace(replace(replace(value, '[', ''), ']', ''), ' ', '')")),
    (
        ("res", "max(opened) OVER (PARTITION BY file, res_no)"), ("open_area", "max(CASE WHEN attr = 'cidr_blocks' AND instr(value, '\"0.0.0.0/0\"') > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, area)"),
    ),
)
TERRAFORM = (
    Rule("iac/s3-no-encryption", "HIGH", "encryption", "n_bucket > 0 AND n_bucket_crypt = 0", whole=True),
    Rule("iac/rds-no-encryption", "HIGH", "encryption", "n_db > 0 AND n_db_crypt = 0", whole=True),
    Rule("iac/ebs-no-encryption", "MEDIUM", "encryption", "res = 'aws_ebs_volume' AND attr = 'encrypted' AND value = 'false'"),
    Rule("iac/s3-public-acl", "CRITICAL", "access_control", "attr = 'acl' AND bare IN ('\"public-read\"', '\"public-read-write\"')"),
    Rule("iac/security-group-wide-open", "CRITICAL", "access_control", "attr = 'cidr_blocks' AND instr(bare, '\"0.0.0.0/0\"') > 0"),
    Rule("iac/iam-star-action", "HIGH", "access_control", "attr IN ('action', 'actions') AND replace(bare, ',', '') = '\"*\"'"),
    Rule("iac/iam-star-resource", "HIGH", "access_control", "attr IN ('resource', 'resources') AND replace(bare, ',', '') = '\"*\"'"),
    Rule("iac/s3-no-logging", "MEDIUM", "logging", "n_bucket > 0 AND n_logging = 0", whole=True),
    Rule("iac/cloudtrail-no-encryption", "MEDIUM", "logging", "res = 'aws_cloudtrail' AND attr = 'kms_key_id' AND value = '\"\"'"),
    Rule("iac/vpc-no-flow-logs", "MEDIUM", "logging", "n_vpc > 0 AND n_flow = 0", whole=True),
    Rule("iac/hardcoded-secret", "CRITICAL", "secrets", f"{_has('attr', 'password', 'secret', 'api_key', 'access_key')} AND value LIKE '\"%\"' AND length(value) > 3 AND value NOT LIKE '\"$%'"),
    Rule("iac/aws-access-key-hardcoded", "CRITICAL", "secrets", "attr = 'access_key' AND value LIKE '\"AKIA%' AND length(value) = 22"),
    Rule("iac/ssh-open-to-internet", "HIGH", "network", "attr = 'from_port' AND value = '22' AND open_area = 1"),
    Rule("iac/rdp-open-to-internet", "HIGH", "network", "attr = 'from_port' AND value = '3389' AND open_area = 1"),
    Rule("iac/database-public", "CRITICAL", "network", "attr = 'publicly_accessible' AND value = 'true'"),
)
_TF_TOTALS = (
    _count("n_bucket", "opened = 'aws_s3_bucket'"), _count("n_bucket_crypt", "instr(low, 'server_side_encryption') > 0"), _count("n_db", "opened = 'aws_db_instance'"),
    _count("n_db_crypt", "attr = 'storage_encrypted' AND value = 'true'"), _count("n_logging", "low LIKE 'logging%' OR opened = 'aws_s3_bucket_logging'"), _count("n_vpc", "opened = 'aws_vpc'"), _count("n_flow", "opened = 'aws_flow_log'"),
)

# ---- manifests: key and value, and the key of the next line

_K8S = (
    (("low", "trim(txt)"),),
    (("field", "CASE WHEN low LIKE '- %' THEN trim(substr(low, 3)) ELSE low END"),),
    (("name", "regexp_extract(field, '^([A-Za-z]+):', 1)"), ("value", "replace(replace(trim(regexp_extract(field, '^[A-Za-z]+:(.*)$', 1)), '\"', ''), '''', '')")),
    (("next_name", f"coalesce(lead(name) {_OVER}, '')"), ("bare", "replace(replace(replace(value, '[', ''), ']', ''), ' ', '')")),
)


def _switched(rule_id: str, severity: str, group: str, name: str, value: str) -> Rule:
    return Rule(rule_id, severity, group, f"name = '{name}' AND value = '{value}'")


def _absent(rule_id: str, severity: str, group: str, total: str) -> Rule:
    return Rule(rule_id, severity, group, f"n_containers > 0 AND {total} = 0", whole=True)


KUBERNETES = (
    _switched("k8s/privileged-container", "CRITICAL", "security_context", "privileged", "true"),
    _switched("k8s/run-as-root", "HIGH", "security_context", "runAsUser", "0"),
    _switched("k8s/allow-privilege-escalation", "HIGH", "security_context", "allowPrivilegeEscalation", "true"),
    _switched("k8s/host-pid", "HIGH", "security_context", "hostPID", "true"),
    _switched("k8s/host-network", "HIGH", "security_context", "hostNetwork", "true"),
    _switched("k8s/host-ipc", "HIGH", "security_context", "hostIPC", "true"),
    _switched("k8s/writable-root-fs", "MEDIUM", "security_context", "readOnlyRootFilesystem", "false"),
    _absent("k8s/no-resource-limits", "MEDIUM", "resources", "n_limits"),
    _absent("k8s/no-resource-requests", "LOW", "resources", "n_requests"),
    _absent("k8s/no-cpu-limit", "MEDIUM", "resources", "n_cpu"),
    _absent("k8s/no-memory-limit", "MEDIUM", "resources", "n_memory"),
    Rule("k8s/image-latest-tag", "HIGH", "images", "name = 'image' AND (value LIKE '%:latest' OR (value <> '' AND instr(split_part(value, '/', -1), ':') = 0 AND instr(value, '@') = 0))"),
    _switched("k8s/image-pull-always", "LOW", "images", "imagePullPolicy", "Always"),
    Rule("k8s/secret-in-env", "MEDIUM", "secrets", f"name = 'name' AND {_has('lower(value)', *_SECRET_WORDS)} AND next_name = 'value'"),
    Rule("k8s/hardcoded-secret", "CRITICAL", "secrets", f"name = 'value' AND length(value) >= 20 AND translate(value, '{_BASE64}', '') = ''"),
    Rule("k8s/cluster-admin-binding", "HIGH", "rbac", "name = 'name' AND value = 'cluster-admin'"),
    Rule("k8s/rbac-wildcard-verb", "HIGH", "rbac", "name = 'verbs' AND bare = '*'"),
    Rule("k8s/rbac-wildcard-resource", "HIGH", "rbac", "name = 'resources' AND bare = '*'"),
    _switched("k8s/default-namespace", "LOW", "network", "namespace", "default"),
    _absent("k8s/no-liveness-probe", "LOW", "probes", "n_live"),
    _absent("k8s/no-readiness-probe", "LOW", "probes", "n_ready"),
)
_K8S_TOTALS = tuple(
    _count(n, f"name = '{k}'")
    for n, k in (("n_api", "apiVersion"), ("n_kind", "kind"), ("n_containers", "containers"), ("n_limits", "limits"), ("n_requests", "requests"), ("n_cpu", "cpu"), ("n_memory", "memory"), ("n_live", "livenessProbe"), ("n_ready", "readinessProbe"))
)

# ---- code: the line without blanks, its quoted text and the host of its address

_TEST = "(^|/)(tests?|__tests__|__mocks__|fixtures?|e2e)/|[._-](test|spec)[.][^.]+$"
_CODE = (
    (("low", "lower(trim(txt))"), ("dense", "replace(replace(replace(replace(txt, ' ', ''), chr(9), ''), '\"', ''''), '`', '''')")),
    (
        ("comment", "low LIKE '//%' OR low LIKE '#%' OR low LIKE '*%' OR low LIKE '/*%'"), ("quoted", "regexp_extract(dense, '''([^'']{40,})''', 1)"), ("host", "split_part(regexp_extract(low, 'https?://([^/''\"` )]+)', 1), ':', 1)"),
        ("key", "regexp_extract(low, '^[\"'']([a-z]+)[\"''][ ]*:', 1)"), ("program", "regexp_extract(low, ':[ ]*[\"'']([a-z]+)', 1)"), ("required", "regexp_extract(dense, 'require[(]([^)]*)', 1)"), ("imported", "regexp_extract(dense, 'import[(]([^)]*)', 1)"),
        ("looked_up", "regexp_extract(low, 'dns[.](resolve|lookup)[a-z0-9]*[(]([^)]*)', 2)"), ("decoded", "max(CASE WHEN instr(txt, 'fromCharCode') > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file)"),
        ("is_test", f"regexp_extract(file, '{_TEST}', 0) <> ''"), ("soon", f"dense || coalesce(lead(dense, 1) {_OVER}, '') || coalesce(lead(dense, 2) {_OVER}, '')"),
    ),
    (("caught", "regexp_extract(dense, 'catch([(][^)]*[)])?[{][}]', 0)"), ("named", "regexp_extract(dense, 'catch[(]_', 0)"), ("opens", f"sum((length(low) - length(replace(low, '/*', ''))) / 2 - (length(low) - length(replace(low, '*/', ''))) / 2) {_OVER}")),
    (("in_block", f"coalesce(lag(opens) {_OVER}, 0) > 0"),),
)
#: Control characters that turn the direction of a text; hosts of tunnels and inspection services; public prefixes.
_TURNS = "‪‫‬‭‮⁦⁧⁨⁩‏؜"
_TUNNELS, _INSPECTORS = (".ngrok.io", ".ngrok.app", ".ngrokfree.app", ".ngrok-free.app"), ("requestbin", "hookbin", "beeceptor", "webhook.site")
_OAST = tuple(f".oast.{t}" for t in ("fun", "me", "online", "site", "pro", "live"))
_PUBLIC = tuple(f"startsWith('{p}" for p in ("NEXT_PUBLIC_", "PUBLIC_", "VITE_", "REACT_APP_", "NUXT_PUBLIC_"))
_ALL_ENV = (*[f"Object.{m}(process.env)" for m in ("keys", "entries", "values")], "inprocess.env)", "ofprocess.env)", "inprocess.env{", "ofprocess.env{")


def _computed(argument: str) -> str:
    return f"({argument} LIKE '[%' OR ({argument} LIKE '%+%' AND {argument} NOT LIKE '''%'))"


def _code(rule_id: str, severity: str, impact: int, when: str, **more: bool) -> Rule:
    return Rule(rule_id, severity, str(impact), when, **more)


SUPPLY_CHAIN = (
    _code("TROJAN_SOURCE", "CRITICAL", 10, f"translate(txt, '{_TURNS}', '') <> txt", first=True, comments=True),
    _code("OBFUSCATED_HEX", "HIGH", 8, "length(low) - length(replace(low, '0x', '')) >= 12 AND length(low) < 12 * (length(low) - length(replace(low, '0x', '')))", first=True, comments=True),
    _code("CHARCODE_OBFUSCATION", "MEDIUM", 7, "decoded = 1 AND length(low) - length(replace(low, ',', '')) >= 9 AND 2 * length(translate(low, '0123456789, ', '')) < length(low)", first=True, comments=True),
    _code("RUNTIME_BASE64_DECODE", "HIGH", 8, f"{_has('dense', 'Buffer.from(')} AND {_has('low', 'base64')} AND quoted <> '' AND translate(quoted, '{_BASE64}', '') = ''", first=True, comments=True),
    _code("POSTINSTALL_EXEC", "CRITICAL", 10, "key IN ('postinstall', 'preinstall', 'install', 'prepare') AND program IN ('node', 'sh', 'bash', 'python', 'curl', 'wget')", first=True, comments=True),
    _code("EVAL_DECODE_EXEC", "CRITICAL", 10, _has("dense", "eval(atob(", "eval(Buffer.from(", "eval(decodeURIComponent(")),
    _code("DYNAMIC_REQUIRE", "HIGH", 8, _computed("required")),
    _code("DYNAMIC_IMPORT", "HIGH", 8, _computed("imported")),
    _code("ENV_HARVEST", "CRITICAL", 10, f"{_has('dense', *_ALL_ENV)} AND NOT {_has('soon', *_PUBLIC)}"),
    _code("RAW_IP_REQUEST", "HIGH", 9, f"host <> '' AND translate(host, '0123456789', '') = '...' AND {_has('dense', 'fetch(', 'axios', 'http.get(', 'https.get(', '.request(', '.post(')}"),
    _code("NGROK_EXFIL", "CRITICAL", 10, _has("low", *_TUNNELS)),
    _code("BURP_COLLABORATOR", "CRITICAL", 10, _has("low", ".burpcollaborator.net")),
    _code("REQUESTBIN_EXFIL", "HIGH", 9, _has("low", *_INSPECTORS)),
    _code("OAST_EXFIL", "CRITICAL", 10, _has("low", *_OAST)),
    _code("DNS_EXFILTRATION", "HIGH", 9, _has("looked_up", "env", "process", *_SECRET_WORDS)),
    _code("INSTALL_TIME_EXEC", "HIGH", 9, _has("dense", "require('child_process').exec", "require('child_process').spawn")),
    _code("LARGE_BASE64_BLOB", "MEDIUM", 6, f"length(quoted) >= 80 AND translate(quoted, '{_BASE64}', '') = ''"),
)
# ---- code tokens: what a line holds, token after token, whatever blanks stand between them


@dataclass(frozen=True)
class TokenRule:
    """Finds ``at`` in a line that also holds ``also``.

    ``tests``: only in test files, or never there.  ``live``: what block comments hold is no code.  Lines that
    begin like comments count with ``comments`` alone.
    """

    rule_id: str
    severity: str
    impact: int
    at: str
    also: str = ""
    tests: bool | None = None
    live: bool = False
    comments: bool = False


_BLANKS, _Q, _REST = "[ \t\f\r]*", "['\"`]", "[^\n]*"
_COMMENT = f"^{_BLANKS}(//|#|[*]|/[*])"


def _tokens(*tokens: str) -> str:
    return _BLANKS.join(tokens)


def _one_of(*texts: str) -> str:
    return f"({'|'.join(texts)})"


def _caseless(*words: str) -> str:
    return _one_of(*["".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words])


def _either_order(a: str, b: str) -> str:
    return f"{a}{_REST}{b}|{b}{_REST}{a}"


_TODO, _TESTERS = _caseless("todo", "fixme"), _one_of("describe", "it", "test", "context", "suite", "each")
PERFORMANCE = (
    TokenRule("SYNC_IO", "MEDIUM", 4, _tokens("fs", "[.]", _one_of("readFileSync", "writeFileSync", "appendFileSync")), comments=True),
    TokenRule("SYNC_FILE_PARSE", "MEDIUM", 7, _tokens("JSON", "[.]", "parse", "[(]", "fs", "[.]", "readFileSync"), comments=True),
    TokenRule("AWAIT_IN_LOOP", "MEDIUM", 5, _either_order(_tokens("for", "[(]"), "await"), comments=True),
    TokenRule("ASYNC_TIMEOUT", "LOW", 2, _tokens("setTimeout", "[(]", "async\\b"), also="await", comments=True),
)
TESTING = (
    TokenRule("FOCUSED_TEST", "HIGH", 7, "\\b" + _tokens(_TESTERS, "[.]", "only", "[(]"), tests=True, live=True),
    TokenRule("TODO_TESTS", "MEDIUM", 4, _caseless("todo") + _REST + _caseless("add tests"), tests=False, comments=True),
)
AI_RISK = (
    TokenRule("EMPTY_CATCH", "LOW", 3, _tokens("catch", f"([(]{_BLANKS}([^_) \t\f\r][^)]*)?[)])?", "[{]", "[}]"), tests=False),
    TokenRule("PERMISSIVE_CORS", "HIGH", 8, _tokens(f"(origin|Access-Control-Allow-Origin){_Q}?", "[:=,]", _Q, "[*]", _Q), tests=False),
    TokenRule("DEFAULT_CREDENTIALS", "CRITICAL", 10, _tokens(f"{_caseless('password')}{_Q}?", "[:=]", _Q, _caseless("admin", "password", "root", "123456", "changeme"), _Q), tests=False),
    TokenRule("CONSOLE_SENSITIVE", "HIGH", 8, _tokens("console", "[.]", _one_of("log", "info", "debug"), "[(]"), also=_caseless("password", "secret", "token", "apikey", "api_key"), tests=False),
    TokenRule("TODO_SECURITY", "MEDIUM", 7, _either_order(_TODO, _caseless("auth", "security", "sanitize", "validate", "encrypt")), tests=False, comments=True),
    TokenRule("HARDCODED_IV", "HIGH", 9, "\\b" + _tokens(_caseless("iv") + f"{_Q}?", "[:=]", _Q, f"([0-9A-Fa-f]{{16,}}|([0-9A-Fa-f]{_BLANKS}){{16}})"), tests=False),
    TokenRule("SKIP_SSL_VERIFY", "HIGH", 9, _tokens(f"(verify|rejectUnauthorized){_Q}?", "[:=]", "false\\b"), tests=False),
)
_SCRIPTS = "[.](js|jsx|ts|tsx|mjs|cjs|json)$"
CONTENT_PACKS = {
    "container": Pack("(^|/)Dockerfile[^/]*$", _DOCKER, CONTAINER, _DOCKER_TOTALS),
    "terraform": Pack("[.](tf|tfvars)$", _TF, TERRAFORM, _TF_TOTALS),
    "kubernetes": Pack("[.]ya?ml$", _K8S, KUBERNETES, _K8S_TOTALS, "n_api > 0 AND n_kind > 0"),
}
LINE_PACKS = {"supply_chain": Pack(_SCRIPTS, _CODE, SUPPLY_CHAIN)}
TOKEN_PACKS = {"performance": PERFORMANCE, "testing": TESTING, "ai_risk": AI_RISK}

#: Path classes of files, tried on the whole path.
FILE_CLASSES = {
    "is_test": _TEST,
    "is_bench": r"(?i)(^|/)(benchmarks?|bench)/",
    "is_doc": r"(?i)\.mdx?$|(^|/)(examples|docs|blog|fixtures)/",
    "is_example_config": r"(?i)\.(example|sample|template)\.",
    "is_infra": r"(?i)(^|/)(scripts|codegen|tools)/|(^|/)(Makefile|Gruntfile|Gulpfile|Jakefile)",
    "is_minified": r"(?i)\.min\.[jt]s$|(^|/)(dist|build|out|\.next|min)/",
    "is_locale": r"(?i)(^|/)(locales?|i18n|translations?|messages)/",
    "is_vendored": r"(^|/)public/(workbox|sw|service-worker|precache-manifest)[A-Za-z0-9_.-]*\.[mc]?js$|(^|/)(node_modules|vendor)/",
    "is_seed": r"(^|/)(seeds?|fixtures?|sample[-_]data)(/|\.[mc]?[jt]sx?$)",
}


def facts(files: DataFrame, pack: Pack, path: str = "file", text: str = "content") -> DataFrame:
    """file, line, txt and the columns of the pack's layers, a row per line.  Null contents give no rows."""
    rows = lines(files.where(F.col(path).rlike(pack.path)).select(F.col(path).alias("file"), F.col(text).alias("content")), "content").select("file", "line", "txt")
    for layer in pack.layers:
        rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in layer])
    return rows


def _found(rows: DataFrame, rules: tuple[Rule, ...], line_packs: bool) -> DataFrame:
    def of(r: Rule):
        when = r.when if r.comments or not line_packs else f"({r.when}) AND NOT comment"
        place = F.lit(1).cast("long") if r.whole else F.col("line")
        shown = F.lit("file") if r.whole else F.substring(F.trim("txt"), 1, 100)
        return F.when(F.expr(when), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.group).alias("grp"), place.alias("line"), shown.alias("match")))

    return rows.select("file", F.explode(F.array_compact(F.array(*[of(r) for r in rules]))).alias("f")).select("file", "f.*")


def content_pack(files: DataFrame, name: str, path: str = "file", text: str = "content") -> DataFrame:
    """file, rule_id, severity, category, line, match: lines that a rule is true of (at most 100 characters shown), and judgements of whole files at line 1."""
    pack = CONTENT_PACKS[name]
    rows = facts(files, pack, path, text)
    totals = rows.groupBy("file").agg(*[F.expr(e).alias(n) for n, e in pack.totals])
    wanted = totals.where(pack.only_if) if pack.only_if else totals
    each = rows.join(wanted.select("file"), "file", "left_semi") if pack.only_if else rows
    out = _found(each, tuple(r for r in pack.rules if not r.whole), False).unionByName(_found(wanted, tuple(r for r in pack.rules if r.whole), False))
    return out.withColumnRenamed("grp", "category")


def line_pack(files: DataFrame, name: str, path: str = "file", text: str = "content") -> DataFrame:
    """file, line, rule_id, severity, impact, match: the findings in script and package files; token packs also give ``col``.

    Lines that begin like comments count only for rules with ``comments``; ``first`` rules give one finding for a file.
    """
    if name in TOKEN_PACKS:
        return token_scan(files, TOKEN_PACKS[name], path, text)
    pack = LINE_PACKS[name]
    out = _found(facts(files, pack, path, text).withColumn("line", F.col("line").cast("long")), pack.rules, True)
    once = [r.rule_id for r in pack.rules if r.first]
    if once:
        w = Window.partitionBy("file", "rule_id").orderBy("line")
        out = out.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("rule_id").isin(*once)).drop("_n")
    return out.select("file", "line", "rule_id", "severity", F.col("grp").cast("long").alias("impact"), "match")


#: The line without what a block comment holds; comments open where a line begins and end at their first mark.
_LIVE = "CASE WHEN NOT in_block THEN txt WHEN instr(txt, '*/') > 0 THEN substr(txt, instr(txt, '*/') + 2) ELSE '' END"
_OPENS, _ENDS = "max(CASE WHEN trim(translate(txt, chr(9), ' ')) LIKE '/*%' AND instr(txt, '*/') = 0 THEN line END)", "max(CASE WHEN instr(txt, '*/') > 0 THEN line END)"
_BEFORE = "OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_IN_BLOCK = f"coalesce({_OPENS} {_BEFORE}, 0) > coalesce({_ENDS} {_BEFORE}, 0)"


def token_scan(files: DataFrame, rules: tuple[TokenRule, ...], path: str = "file", text: str = "content") -> DataFrame:
    """file, line, rule_id, severity, impact, col (from 0) and match of the first match of each rule in each line."""
    rows = lines(files.where(F.col(path).rlike(_SCRIPTS)).select(F.col(path).alias("file"), F.col(text).alias("content")), "content").select("file", "line", "txt")
    if any(r.live for r in rules):
        rows = rows.selectExpr("*", f"{_IN_BLOCK} AS in_block").selectExpr("*", f"{_LIVE} AS live")

    def of(r: TokenRule):
        txt = F.col("live" if r.live else "txt")
        hit = txt.rlike(r.at)
        if r.also:
            hit = hit & txt.rlike(r.also)
        if not r.comments:
            hit = hit & ~txt.rlike(_COMMENT)
        if r.tests is not None:
            hit = hit & (F.col("file").rlike(_TEST) == F.lit(r.tests))
        col = F.length("txt") - F.length(txt) + F.length(F.regexp_extract(txt, f"(?s)^(.*?)(?:{r.at})", 1))
        return F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.impact).cast("long").alias("impact"), col.cast("long").alias("col"), F.regexp_extract(txt, r.at, 0).alias("match")))

    return rows.select("file", "line", F.explode(F.array_compact(F.array(*[of(r) for r in rules]))).alias("f")).select("file", "line", "f.*")


def file_classes(files: DataFrame, path: str = "file") -> DataFrame:
    """file and a flag for each class of paths."""
    return files.select(path, *[F.col(path).rlike(p).alias(name) for name, p in FILE_CLASSES.items()])


# ---- the same for DuckDB


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _facts_sql(pack: Pack, files: str) -> str:
    rows = f"SELECT file, CAST(i AS BIGINT) AS line, p[i] AS txt FROM (SELECT file, regexp_split_to_array(content, '\\r?\\n') AS p FROM ({files}) WHERE regexp_matches(file, {_q(pack.path)})), unnest(range(1, len(p) + 1)) AS t(i)"
    for layer in pack.layers:
        rows = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer)} FROM ({rows})"
    return rows


def content_pack_sql(name: str, files: str) -> str:
    pack = CONTENT_PACKS[name]
    parts = []
    for r in pack.rules:
        head = f"SELECT file, {_q(r.rule_id)} AS rule_id, {_q(r.severity)} AS severity, {_q(r.group)} AS category"
        if r.whole:
            parts.append(f"{head}, CAST(1 AS BIGINT) AS line, 'file' AS match FROM wanted WHERE {r.when}")
        else:
            parts.append(f"{head}, line, trim(txt)[1:100] AS match FROM l WHERE ({r.when}) AND file IN (SELECT file FROM wanted)")
    totals = f"SELECT file, {', '.join(f'{e} AS {n}' for n, e in pack.totals)} FROM l GROUP BY file" + (f" HAVING {pack.only_if}" if pack.only_if else "")
    return f"WITH l AS MATERIALIZED ({_facts_sql(pack, files)}), wanted AS ({totals}) " + " UNION ALL ".join(parts)


def line_pack_sql(name: str, files: str) -> str:
    if name in TOKEN_PACKS:
        return token_scan_sql(TOKEN_PACKS[name], files)
    pack = LINE_PACKS[name]
    parts = []
    for r in pack.rules:
        one = f"SELECT file, line, {_q(r.rule_id)} AS rule_id, {_q(r.severity)} AS severity, CAST({r.group} AS BIGINT) AS impact, trim(txt)[1:100] AS match FROM l WHERE ({r.when})" + ("" if r.comments else " AND NOT comment")
        parts.append(f"(SELECT * FROM ({one}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) = 1)" if r.first else one)
    return f"WITH l AS MATERIALIZED ({_facts_sql(pack, files)}) " + " UNION ALL ".join(parts)


def token_scan_sql(rules: tuple[TokenRule, ...], files: str) -> str:
    rows, parts = _facts_sql(Pack(_SCRIPTS, (), ()), files), []
    if any(r.live for r in rules):
        rows = f"SELECT *, {_LIVE} AS live FROM (SELECT *, {_IN_BLOCK} AS in_block FROM ({rows}))"
    for r in rules:
        txt = "live" if r.live else "txt"
        tests = [f"regexp_matches({txt}, {_q(r.at)})"] + [f"regexp_matches({txt}, {_q(r.also)})"] * bool(r.also) + [f"NOT regexp_matches({txt}, {_q(_COMMENT)})"] * (not r.comments)
        tests += [f"regexp_matches(file, {_q(_TEST)}) = {r.tests}"] * (r.tests is not None)
        col = f"CAST(length(txt) - length({txt}) + length(regexp_extract({txt}, {_q(f'(?s)^(.*?)(?:{r.at})')}, 1)) AS BIGINT)"
        parts.append(f"SELECT file, line, {_q(r.rule_id)} AS rule_id, {_q(r.severity)} AS severity, CAST({r.impact} AS BIGINT) AS impact, {col} AS col, regexp_extract({txt}, {_q(r.at)}) AS match FROM l WHERE {' AND '.join(tests)}")
    return f"WITH l AS MATERIALIZED ({rows}) " + " UNION ALL ".join(parts)


def file_classes_sql(files: str) -> str:
    return f"SELECT file, {', '.join(f'regexp_matches(file, {_q(p)}) AS {n}' for n, p in FILE_CLASSES.items())} FROM ({files})"
