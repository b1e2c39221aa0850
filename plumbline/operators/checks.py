"""The checks of packages: what each claims, and the findings, with evidence, of all packages at once.

Checks of declared permissions are columns of one projection over packages. Checks of file
text are unrolled into one projection over files; only hits leave it, are compared with the
package's allowlist where a check needs that, and are reduced to the first by path.
"""

from __future__ import annotations

import importlib.util
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from plumbline.functions import digests, hosts, paths
from plumbline.functions import text as t
from plumbline.sources.arrow import sieve
from plumbline.sources.manifests import frontmatter
from plumbline.sources.packages import SURFACE, regular

# --- fixed values: what each check claims, and the words, paths and patterns that it looks for ---
COVERS = {
    "AST01-content-hash-missing": "category-precondition",
    "AST01-content-hash-mismatch": "category-precondition",
    "AST01-social-engineering-prerequisites": "full",
    "AST01-soul-md-persistence": "full",
    "AST01-memory-poisoning": "full",
    "AST01-identity-clone-exfiltration": "full",
    "AST01-websocket-c2": "full",
    "AST01-undeclared-egress": "full",
    "AST01-hidden-output-injection": "full",
    "AST01-obfuscated-payload-exec": "full",
    "AST02-config-file-hijacking": "full",
    "AST03-identity-file-write-grant": "full",
    "AST03-unbounded-write-scope": "category-precondition",
    "AST03-shell-network-privilege-combo": "artifact-signal-only",
    "AST03-wildcard-network-egress": "artifact-signal-only",
    "AST04-permission-understating": "full",
    "AST04-risk-tier-spoofing": "full",
    "AST04-yaml-injection": "full",
    "AST04-json-injection": "full",
    "AST04-toml-injection": "full",
    "AST04-invisible-unicode-smuggling": "category-precondition",
    "AST05-fetched-content-instruction-sink": "artifact-signal-only",
    "AST05-remote-response-executed": "artifact-signal-only",
    "AST05-absent-instruction-boundary": "artifact-signal-only",
    "AST05-unrestricted-network-fetch": "artifact-signal-only",
    "AST05-wildcard-domain-allowlist": "artifact-signal-only",
    "AST06-host-persistence-write": "full",
    "AST06-root-write-scope": "full",
    "AST06-unrestricted-shell-exec": "category-precondition",
    "AST06-unscoped-shared-state-write": "artifact-signal-only",
    "AST06-missing-sandbox-declaration": "artifact-signal-only",
    "AST08-S02": "full",
    "AST08-S04": "full",
    "AST08-S07": "full",
    "AST08-S08": "full",
    "AST10-S06": "full",
}
OPEN_POLICIES = ["allow-all", "allow_all", "allowall", "all", "any", "*", "unrestricted", "open"]
CLOSED_POLICIES = ["deny-all", "deny_all", "denyall", "none", "off", "allow-list", "allow_list"]
FETCH_TOOLS = ["web_fetch", "web_search", "fetch", "http_request", "http", "browser", "curl"]
ROOT_SCOPES = ["/", "//", "/*", "/**", "/**/*", "*", "**", "~", "~/", "~/*", "~/**", "$HOME", "${HOME}"]
PERSISTENCE = [
    (r"\bcrontab\b", "cron table"),
    (r"/etc/cron(?:tab|\.d|\.daily|\.hourly|\.weekly|\.monthly)\b", "system cron directory"),
    (r"/var/spool/cron\b", "user cron spool"),
    (r"/etc/systemd/system\b", "systemd system unit"),
    (r"/usr/lib/systemd/system\b", "systemd vendor unit"),
    (r"\.config/systemd/user\b", "systemd user unit"),
    (r"\bsystemctl\s+(?:--user\s+)?enable\b", "systemd unit enablement"),
    (r"/Library/LaunchAgents\b", "launch agent"),
    (r"/Library/LaunchDaemons\b", "launch daemon"),
    (r"\blaunchctl\s+(?:load|bootstrap|enable)\b", "launchd registration"),
    (r"(?:^|[/~])\.(?:bashrc|zshrc|profile|bash_profile|zprofile|zshenv|kshrc)\b", "shell rc file"),
    (r"/etc/profile\.d\b", "system shell profile"),
    (r"/etc/rc\.local\b", "init script"),
    (r"\.ssh/authorized_keys\b", "ssh authorized_keys"),
    (r"CurrentVersion\\+Run\b", "Windows Run key"),
    (r"(?i)shell:startup\b", "Windows startup folder"),
]
HOST_COMMANDS = r"\bcrontab\b|\bsystemctl\s+(?:--user\s+)?enable\b|\blaunchctl\s+(?:load|bootstrap|enable)\b"
OUTSIDE = r"(^|[\s\"'=:])(/|~/|~$|\$HOME|\$\{HOME\}|%USERPROFILE%|%APPDATA%|\.\./)"
SHARED_STATE = [
    (r"(?:^|/)(?:SOUL|MEMORY|AGENTS)\.md$", "agent identity/memory file"),
    (r"\.aws/credentials\b", "cloud credential store"),
    (r"\.netrc\b", "netrc credential store"),
    (r"\.docker/config\.json\b", "container registry credential store"),
    (r"\.config/gh/hosts\.ya?ml\b", "forge credential store"),
    (r"(?:^|/)\.env$", "environment secret file"),
    (r"(?:^|/)(?:workspace|shared|scratch)(?:/|$)", "shared workspace root"),
    (r"\.(?:agent|claude|openclaw)/(?:memory|state|context)\b", "shared agent memory"),
]
AGENT_SCOPED = r"(?:^|/)(?:agent|agents|session|sessions|tenant|tenants|instance)/[^/]+/"
SCRIPTS = r"(?i)\.(?:py|sh|bash|zsh|js|mjs|ts|ps1|rb|pl)$"
CODE = r"(?i)\.(?:py|sh|bash|zsh|js|mjs|cjs|ts|rb|ps1|pl)$"
PIPE_TO_SHELL = [
    (r"(?i)(?:curl|wget)\b[^\n|]{0,400}\|\s{0,8}(?:sudo\s{1,8})?(?:/bin/)?(?:ba|z|k|a)?sh\b", "remote fetch piped to a shell"),
    (r"(?i)(?:iwr|irm|invoke-webrequest|invoke-restmethod)\b[^\n|]{0,400}\|\s{0,8}(?:iex|invoke-expression)\b", "remote fetch piped to Invoke-Expression"),
    (r"(?i)\b(?:ba|z|k)?sh\b\s{0,8}<\(\s{0,8}(?:curl|wget)\b[^)\n]{0,400}\)", "shell reading a remote script through process substitution"),
]
URL_HOST = r"(?i)https?://([A-Za-z0-9._~-]+(?::\d{1,5})?)"
WEBSOCKET = r"(?i)['\"]\s{0,4}wss?://([A-Za-z0-9._~-]+(?::\d{1,5})?)[^'\"\n]{0,300}['\"]"
WRITES_TO = [
    (r"open\s{0,4}\([^)\n]{0,160}?['\"][^'\"\n]{0,200}NAME['\"]\s{0,4},\s{0,4}['\"][wax]", "opened for write"),
    (r"['\"][^'\"\n]{0,200}NAME['\"][^\n]{0,160}\.\s{0,4}(?:write_text|write_bytes|writelines)\s{0,4}\(", "written through a pathlib write"),
    (r"(?:appendFileSync|writeFileSync|createWriteStream|writeFile)\s{0,4}\(\s{0,4}['\"][^'\"\n]{0,200}NAME", "written through a filesystem write call"),
    (r"(?:>>?|\btee\b(?:\s{1,4}-a)?|Add-Content|Set-Content|Out-File)\s{0,4}['\"]?[^\s;|&'\"\n]{0,200}NAME", "written through a shell redirect or append"),
]
SENDS = (
    r"(?i)\b(?:requests\.(?:post|put|patch|get|request)|httpx\.(?:post|put|patch|get|stream)|urllib\.request\.urlopen|urlopen|http\.client\.HTTPS?Connection"
    r"|aiohttp\.ClientSession|socket\.create_connection|websockets?\.(?:connect|create_connection)|WebSocketApp|axios\.(?:post|put|get)|XMLHttpRequest"
    r"|Invoke-RestMethod|Invoke-WebRequest)\s{0,4}\("
)
SHELL_SENDS = r"(?i)\b(?:curl|wget|nc|ncat|netcat)\b\s{1,8}[^\n]{0,200}"
IDENTITY_LITERAL = r"(?i)['\"][^'\"\n]{0,200}(?:SOUL|MEMORY|AGENTS|PERSONA|IDENTITY)\.(?:md|json|ya?ml)['\"]"
READS = r"(?i)(?:\bopen\s{0,4}\(|read_text\s{0,4}\(|read_bytes\s{0,4}\(|readlines\s{0,4}\(|\.read\s{0,4}\(|readFileSync\s{0,4}\(|Get-Content\b|\bcat\b)"
WRITE_MODE = r"['\"][wax]\+?b?['\"]"
YAML_TAG = r"!!(?:python|ruby)/[A-Za-z_][A-Za-z0-9_.]*(?:/[A-Za-z_][A-Za-z0-9_.]*)*"
#: The loader has to be named within 200 characters of the call.
YAML_LOADS = [
    (r"yaml\.unsafe_load\s*\(", "yaml.unsafe_load() call"),
    (r"Loader\s*=\s*yaml\.UnsafeLoader", "Loader=yaml.UnsafeLoader"),
    (r"(?s)(?=yaml\.load\s*\()(?!.{0,190}SafeLoader)", "yaml.load() without a safe loader"),
]
JSON_KEYS = r"(?<!\\)\"(__proto__|constructor|prototype)\"\s*:"
TOML_TABLE = r"(?m)^[ \t]*\[([^\[\]\n]+)\][ \t]*$"
TOML_KEYS = ["name", "description", "version", "settings", "permissions", "metadata"]
FOREIGN_TOML = ["pyproject.toml", "cargo.toml", "ruff.toml", "poetry.toml", "rustfmt.toml", "netlify.toml"]
EGRESS = (
    r"\b(?:curl|wget|Invoke-WebRequest|iwr|requests\.(?:get|post|put|patch|delete|request)"
    r"|urlopen|httpx\.(?:get|post|put|request)|axios(?:\.\w+)?|fetch|Net::HTTP|HTTPSConnection|HTTPConnection)\b"
)
EGRESS_URL = r"https?://([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)(?::\d+)?"
#: For RE2: what the patterns of the checks of text cannot match without, by what they look for.
SIGNS = {
    "fetch": r"(?i:curl|wget|iwr|irm|invoke-)",
    "pipe": r"\||<\(",
    "identity": r"(?i:(?:SOUL|MEMORY|AGENTS|PERSONA|IDENTITY)\.(?:md|json|ya?ml))",
    "socket": r"(?i:wss?://)",
    "egress": r"curl|wget|Invoke-WebRequest|iwr|requests\.|urlopen|httpx\.|axios|fetch|Net::HTTP|HTTPS?Connection",
    "url": r"https?://",
    "yaml": r"!!(?:python|ruby)/|yaml\.",
    "key": r"__proto__|constructor|prototype",
    "invisible": t.INVISIBLE,
}
# --- end of fixed values ---

LINE_END = r"\R|[\x1c-\x1e]"


def first_label(entry: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(entry.rlike(p), F.lit(label)) for p, label in table))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def declared_findings(packages: DataFrame) -> DataFrame:
    """Findings of the checks that read only what manifests.declared gives: one row for each package and check."""
    write, deny, allow = F.col("write"), F.col("deny"), F.col("allow")
    policy = F.lower(F.trim("policy"))
    live = F.transform(F.filter(paths.effective_writes(write, deny), lambda e: F.trim(e) != ""), lambda e: F.regexp_replace(F.trim(e), r"(?s)^\./(?=.)", ""))
    unbounded = F.col("net_any") | (F.col("net_map") & hosts.unbounded(allow, F.col("policy")))
    reached = F.filter(
        F.array(*map(F.lit, paths.IDENTITY_FILES)),
        lambda f: F.exists(write, lambda e: paths.reaches(e, f)) & ~F.exists(deny, lambda e: paths.shadows(e, f)),
    )

    def root(entry: Column) -> Column:
        outside = F.when(entry.rlike(HOST_COMMANDS) | entry.rlike(OUTSIDE), first_label(entry, PERSISTENCE))
        return F.when(entry.isin(ROOT_SCOPES), F.concat(entry, F.lit(" reaches the root"))).otherwise(F.concat(entry, F.lit(" is a "), outside))

    def shared(entry: Column) -> Column:
        return F.when(~entry.rlike(AGENT_SCOPED), F.concat(entry, F.lit(" is a "), first_label(entry, SHARED_STATE)))

    broad = F.filter(allow, lambda e: (e == "*") | (e.startswith("*.") & ~F.substring(e, 3, 1 << 20).contains(".")))
    tools = F.array_sort(F.array_intersect("tools", F.array(*map(F.lit, FETCH_TOOLS))))
    no_list = F.col("net_map") & ~F.col("has_allow") & ~F.coalesce(policy.isin(CLOSED_POLICIES), F.lit(False)) & (F.size(tools) > 0)
    fetch = F.col("net_any") | (F.col("net_map") & F.coalesce(policy.isin(OPEN_POLICIES), F.lit(False))) | no_list
    derived = paths.risk_tier(write, deny, F.col("shell"), allow)
    spoofed = F.col("has_perms") & F.coalesce(paths.tier_rank(F.col("risk_tier")) < paths.tier_rank(derived), F.lit(False))
    roots, states = (F.array_compact(F.transform(live, f)) for f in (root, shared))
    floor = F.when(F.col("has_perms"), "permissions without deny_write").otherwise("no permissions")
    checks = [
        ("AST01-content-hash-missing", F.col("content_hash").isNull(), F.lit("no content hash is declared")),
        ("AST03-identity-file-write-grant", F.size(reached) > 0, F.concat(F.lit("write reaches "), listed(reached))),
        ("AST03-unbounded-write-scope", ~F.col("declares_deny"), floor),
        ("AST03-shell-network-privilege-combo", F.col("shell") & unbounded, F.concat(F.lit("shell, and egress to "), listed(allow))),
        ("AST03-wildcard-network-egress", unbounded, F.concat(F.lit("egress to "), listed(allow), F.lit(", policy "), F.coalesce("policy", F.lit("none")))),
        ("AST04-risk-tier-spoofing", spoofed, F.concat(F.lit("declared "), F.col("risk_tier"), F.lit(", derived "), derived)),
        ("AST05-unrestricted-network-fetch", fetch, F.concat(F.lit("no host bounds egress; policy "), F.coalesce("policy", F.lit("none")), F.lit(", tools "), listed(tools))),
        ("AST05-wildcard-domain-allowlist", F.col("net_map") & (F.size(broad) > 0), F.concat(F.lit("broad entries "), listed(broad))),
        ("AST06-root-write-scope", F.size(roots) > 0, F.get(roots, F.lit(0))),
        ("AST06-unrestricted-shell-exec", F.col("shell_open"), F.lit("no literal command bounds the shell")),
        ("AST06-unscoped-shared-state-write", F.size(states) > 0, F.get(states, F.lit(0))),
        ("AST06-missing-sandbox-declaration", ~F.col("has_perms"), F.lit("no permissions")),
    ]
    one = F.array(*(F.struct(F.lit(c).alias("check_id"), d.alias("detected"), F.when(d, e).alias("evidence")) for c, d, e in checks))
    return packages.select("pkg_id", F.explode(one).alias("x")).select("pkg_id", "x.*")


@F.pandas_udf(ArrayType(StringType()))
def toml_keys(texts: pd.Series) -> pd.Series:
    """Sorted top-level keys of TOML texts; null for what is no TOML."""
    import tomllib

    def one(text: str | None) -> list[str] | None:
        try:
            return None if text is None else sorted(tomllib.loads(text))
        except (tomllib.TOMLDecodeError, RecursionError):
            return None

    return texts.map(one)


def _writes(name: str) -> Column:
    """How a script writes to a file, if it does."""
    quoted = name.replace(".", r"\.")
    forms = ((p.replace("NAME", quoted), label) for p, label in WRITES_TO)
    return F.coalesce(*(F.when(F.col("text").rlike(p), F.concat(F.lit(f"{name} {label}: "), t.snippet(F.regexp_extract("text", p, 0)))) for p, label in forms))


def file_hits(files: DataFrame) -> DataFrame:
    """Hits in files(pkg_id, path, text) that need no manifest, and sites to be held against an allowlist.

    One row for each file and check: pkg_id, check_id, path, detail, and hosts (null where
    the allowlist does not matter). Files are scanned where they lie; a check's patterns are
    tried on those that show its signs.
    """
    text, path = F.col("text"), F.col("path")
    shown = lambda detail, *signs: F.when(reduce(Column.__and__, (F.col(f"shown.{s}") for s in signs)), detail)
    script = path.rlike(SCRIPTS)
    low = F.lower(path)
    sends = F.when(text.rlike(SENDS), F.regexp_extract(text, SENDS, 0)).when(low.rlike(r"\.(?:sh|bash|zsh)$") & text.rlike(SHELL_SENDS), F.regexp_extract(text, SHELL_SENDS, 0))
    cloned = F.exists(F.split(text, LINE_END), lambda s: s.rlike(IDENTITY_LITERAL) & s.rlike(READS) & ~s.rlike(WRITE_MODE))
    yaml_text = F.when(low.rlike(r"\.ya?ml$"), text).when(low.endswith(".md"), frontmatter(text))
    tagged = F.when(yaml_text.rlike(YAML_TAG), F.concat(F.lit("code-executing tag "), F.regexp_extract(yaml_text, YAML_TAG, 0)))
    loads = F.when(low.endswith(".py"), F.coalesce(*(F.when(text.rlike(p), F.lit(label)) for p, label in YAML_LOADS)))
    polluted = F.when(low.endswith(".json") & text.rlike(JSON_KEYS) & F.get_json_object("text", "$").isNotNull(), F.concat(F.lit("key "), F.regexp_extract(text, JSON_KEYS, 1)))
    tables = F.transform(F.regexp_extract_all(text, F.lit(TOML_TABLE), 1), F.trim)
    twice = F.filter(F.array_distinct(tables), lambda n: F.size(F.filter(tables, lambda m: m == n)) > 1)
    extra = F.array_except("toml_keys", F.array(*map(F.lit, TOML_KEYS)))
    toml = F.when(
        low.endswith(".toml"),
        F.when(F.size(twice) > 0, F.concat(F.lit("tables defined again "), listed(twice))).when(F.size(extra) > 0, F.concat(F.lit("unexpected keys "), listed(extra))),
    )
    points = t.invisible_points(text)
    piped = F.flatten(F.array(*(F.when(low.rlike(r"\.(?:md|markdown)$"), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(F.array().cast("array<string>")) for p, _ in PIPE_TO_SHELL)))
    piped_hosts = F.flatten(F.transform(piped, lambda c: F.regexp_extract_all(c, F.lit(URL_HOST), 1)))
    lines = F.filter(F.split(text, LINE_END), lambda s: s.rlike(EGRESS))
    reached = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(EGRESS_URL), 1)))
    none = F.lit(None).cast("array<string>")
    checks = [
        ("AST01-social-engineering-prerequisites", shown(F.when(F.size(piped_hosts) > 0, "remote fetch piped to a shell"), "fetch", "pipe"), piped_hosts),
        ("AST01-soul-md-persistence", shown(F.when(script, _writes("SOUL.md")), "identity"), none),
        ("AST01-memory-poisoning", shown(F.when(script, _writes("MEMORY.md")), "identity"), none),
        ("AST01-identity-clone-exfiltration", shown(F.when(script & sends.isNotNull() & cloned, F.concat(F.lit("reads an identity file and sends: "), t.snippet(sends))), "identity"), none),
        ("AST01-websocket-c2", shown(F.when(script & text.rlike(WEBSOCKET), "WebSocket client"), "socket"), F.regexp_extract_all(text, F.lit(WEBSOCKET), 1)),
        ("AST04-permission-understating", shown(F.when(path.rlike(CODE) & text.rlike(EGRESS) & (F.size(reached) > 0), "egress call"), "egress", "url"), F.transform(reached, F.lower)),
        ("AST04-yaml-injection", shown(F.coalesce(tagged, loads), "yaml"), none),
        ("AST04-json-injection", shown(polluted, "key"), none),
        ("AST04-toml-injection", toml, none),
        ("AST04-invisible-unicode-smuggling", shown(F.when(text.rlike(t.INVISIBLE), listed(points)), "invisible"), none),
    ]
    own = ~path.contains("/") & low.endswith(".toml") & ~low.isin(FOREIGN_TOML)
    one = lambda c, d, h: F.when(d.isNotNull(), F.struct(F.lit(c).alias("check_id"), d.alias("detail"), h.alias("hosts")))
    hits = F.array_compact(F.array(*(one(*c) for c in checks)))
    out = files.where(text.isNotNull()).select("pkg_id", "path", "text", sieve(SIGNS)(text).alias("shown")).where(F.col("shown").isNotNull() | low.endswith(".toml"))
    out = out.withColumn("toml_keys", toml_keys(F.when(own, text)))
    return out.select("pkg_id", "path", F.explode(hits).alias("x")).select("pkg_id", "x.check_id", "path", "x.detail", "x.hosts")


def undeclared(hits: DataFrame, packages: DataFrame) -> DataFrame:
    """hits without those whose hosts the package's allowlist names: a host is compared exactly, lower-cased.

    Egress to anything contradicts nothing. Loopback and dotless names count only where the
    check is of the declaration itself (AST04).
    """
    bound = packages.select("pkg_id", "allow", (F.col("net_any") | (F.col("net_map") & hosts.unbounded(F.col("allow"), F.col("policy")))).alias("_open"))
    bare = F.col("check_id") == "AST04-permission-understating"
    named = F.transform(F.coalesce("allow", F.array().cast("array<string>")), F.lower)
    routable = F.filter(F.transform("hosts", hosts.normalize), lambda h: (h != "") & (hosts.host_class(h) == "routable"))
    away = F.when(bare, F.when(~F.array_contains(named, "*"), F.array_except("hosts", named))).when(~F.coalesce("_open", F.lit(False)), F.array_except(routable, named))
    held = hits.join(bound, "pkg_id", "left").withColumn("_away", F.when(F.col("hosts").isNotNull(), away))  # hits once: files are scanned for them
    told = F.when(F.col("hosts").isNull(), F.col("detail")).otherwise(F.concat("detail", F.lit(" to undeclared host(s) "), listed(F.col("_away"))))
    return held.where(F.col("hosts").isNull() | (F.size("_away") > 0)).select("pkg_id", "check_id", "path", told.alias("detail"))


def _granted(packages: DataFrame) -> DataFrame:
    """Write grants of identity files, and invisible characters of descriptions, as hits before any file."""
    grant = lambda name, check: F.when(paths.write_allowed(F.col("write"), F.col("deny"), name), F.struct(F.lit(check).alias("check_id"), F.lit("").alias("path"), F.lit(f"manifest grants write to {name}").alias("detail")))
    seen = F.when(
        F.col("description").rlike(t.INVISIBLE),
        F.struct(F.lit("AST04-invisible-unicode-smuggling").alias("check_id"), F.lit("\U0010ffff").alias("path"), F.concat(F.lit("description "), listed(t.invisible_points(F.col("description")))).alias("detail")),
    )
    rows = F.array_compact(F.array(grant("SOUL.md", "AST01-soul-md-persistence"), grant("MEMORY.md", "AST01-memory-poisoning"), seen))
    return packages.select("pkg_id", F.explode(rows).alias("x")).select("pkg_id", "x.*")


def text_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the checks of file text, one row for each package and check; evidence is of the first hit by path.

    Checks of the first category look at the shipped surface alone, the others at all files.
    """
    seen = file_hits(files).where(~F.col("check_id").startswith("AST01") | F.col("path").rlike(SURFACE))
    hits = undeclared(seen, packages).unionByName(_granted(packages))
    first = hits.groupBy("pkg_id", "check_id").agg(F.min(F.struct("path", "detail")).alias("x"))
    place = F.when(F.col("x.path").isin("", "\U0010ffff"), F.col("x.detail")).otherwise(F.concat("x.path", F.lit(": "), "x.detail"))
    ids = F.array(*(F.lit(c) for c in TEXT_CHECKS))
    roster = packages.select("pkg_id", F.explode(ids).alias("check_id"))
    return roster.join(first, ["pkg_id", "check_id"], "left").select("pkg_id", "check_id", F.col("x").isNotNull().alias("detected"), place.alias("evidence"))


TEXT_CHECKS = [
    "AST01-social-engineering-prerequisites", "AST01-soul-md-persistence", "AST01-memory-poisoning", "AST01-identity-clone-exfiltration", "AST01-websocket-c2",
    "AST04-permission-understating", "AST04-yaml-injection", "AST04-json-injection", "AST04-toml-injection", "AST04-invisible-unicode-smuggling",
]


def hash_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Is the declared content hash that of the files? Packages that declare none are clear here."""
    check = "AST01-content-hash-mismatch"
    stated = packages.where(F.col("content_hash").isNotNull()).select("pkg_id", "content_hash")
    digest = digests.package_digest(files.join(stated.select("pkg_id"), "pkg_id", "left_semi"))
    actual = F.coalesce("digest", F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"))  # of no bytes
    out = packages.select("pkg_id", "content_hash").join(digest, "pkg_id", "left")
    differs = F.col("content_hash").isNotNull() & (actual != F.col("content_hash"))
    return out.select("pkg_id", F.lit(check).alias("check_id"), differs.alias("detected"), F.when(differs, F.concat(F.lit("declared "), F.col("content_hash"), F.lit(", actual "), actual)).alias("evidence"))


@F.pandas_udf(BinaryType())
def _source_hash(sources: pd.Series) -> pd.Series:
    """The hash of a source file as this interpreter writes it into bytecode."""
    return sources.map(lambda b: None if b is None else importlib.util.source_hash(bytes(b)))


def bytecode_findings(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """Does the bytecode of packages belong to the source beside it? Only its 16-byte header is read.

    entries has pkg_id, path, n_bytes and content of all entries, cache folders included.
    Detected are bytecode without source, with a header too short or not read (content null),
    with a hash that nothing checks, with another source's hash (told only for this
    interpreter's magic number), and with another source's size.
    """
    check, path = "AST08-S08", F.col("path")
    entries = regular(entries)
    cached = F.regexp_replace(path, r"(^|/)__pycache__/([^/.]*)[^/]*$", "$1$2.py")
    source = F.when(path.rlike(r"(^|/)__pycache__/[^/]+$"), cached).otherwise(F.regexp_replace(path, r"\.[^./]*$", ".py"))
    head = F.hex(F.substring("content", 1, 16))
    compiled = entries.where(path.endswith(".pyc")).select("pkg_id", "path", source.alias("source"), head.alias("head"))
    text = entries.where(path.endswith(".py")).select("pkg_id", path.alias("source"), F.col("n_bytes").alias("size"), F.col("content").alias("body"))
    number = lambda *at: F.conv(F.concat(*(F.substring("head", i, 2) for i in at)), 16, 10).cast("long")
    flags, ours = number(9), F.substring("head", 1, 8) == importlib.util.MAGIC_NUMBER.hex().upper()
    both = compiled.join(text, ["pkg_id", "source"], "left").withColumns({"flags": flags, "stated": number(31, 29, 27, 25)})
    hashed, checked = F.col("flags").bitwiseAND(1) == 1, F.col("flags").bitwiseAND(2) == 2
    both = both.withColumn("of", F.hex(_source_hash(F.when(hashed & checked & ours, F.col("body")))))
    detail = (
        F.when(F.coalesce(F.length("head"), F.lit(0)) < 32, "INCOMPLETE: no whole header")
        .when(F.col("size").isNull(), F.concat(F.lit("bytecode without "), F.col("source")))
        .when(hashed & ~checked, F.concat(F.lit("nothing checks its hash against "), F.col("source")))
        .when(hashed & (F.col("of") != F.substring("head", 17, 16)), F.concat(F.lit("hash of another source than "), F.col("source")))
        .when(~hashed & (F.col("stated") != F.col("size")), F.concat(F.lit("size of another source than "), F.col("source")))
    )
    first = both.withColumn("detail", detail).where("detail IS NOT NULL").groupBy("pkg_id").agg(F.min(F.struct("path", "detail")).alias("x"))
    out = packages.select("pkg_id").join(first, "pkg_id", "left")
    return out.select("pkg_id", F.lit(check).alias("check_id"), F.col("x").isNotNull().alias("detected"), F.concat("x.path", F.lit(": "), "x.detail").alias("evidence"))
