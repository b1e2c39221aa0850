"""Queries of the audit operators over documents (one source a package) and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import digests, hosts, paths
from plumbline.functions import text as t
from plumbline.operators import findings, studies
from plumbline.plans.bindings import PACKAGES_SQL, Registry, files, permission_rows, table

R = Registry()

#: Rules of the document audit: what a hit is, and the pattern, within the common regular language of both engines.
RULES = [
    ("encoded-blob", r"[A-Za-z0-9+/]{24,}={0,2}"),
    ("secret-assignment", r"(?:api_key|secret|token|password)\s*[=:]\s*\S+"),
    ("network-address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("license-line", r"(?:GNU General Public License|Apache License|MIT License)"),
    ("shouting", r"[A-Z]{4,}!!"),
]
COVERS = {"encoded-blob": "full", "secret-assignment": "full", "network-address": "artifact-signal-only", "license-line": "category-precondition", "shouting": "artifact-signal-only"}


def hits(spark, d):
    return findings.rule_hits(files(spark, d), RULES)


_HITS_SQL = "WITH f AS (" + PACKAGES_SQL + "), h AS (" + " UNION ALL ".join(
    f"SELECT pkg_id, path, {i} AS rule_ix, '{n}' AS rule, strpos(text, regexp_extract(text, '{p}', 0)) AS \"offset\", len(string_split(left(text, strpos(text, regexp_extract(text, '{p}', 0)) - 1), chr(10))) AS line, regexp_extract(text, '{p}', 0) AS excerpt FROM f WHERE regexp_matches(text, '{p}')" for i, (n, p) in enumerate(RULES)
) + ")"


@R.query(f"{_HITS_SQL} SELECT pkg_id, path, rule, \"offset\", excerpt FROM h")
def rules_by_files_matrix(spark, d):
    """Every rule hit of every file, from one unrolled scan."""
    return hits(spark, d).select("pkg_id", "path", "rule", "offset", "excerpt")


@R.query(f"{_HITS_SQL} SELECT pkg_id, rule, path, \"offset\", excerpt FROM (SELECT *, row_number() OVER (PARTITION BY pkg_id, rule ORDER BY path, \"offset\") AS rn FROM h) WHERE rn = 1")
def first_match_per_package(spark, d):
    return findings.first_match(hits(spark, d).withColumn("check", F.col("rule")), "pkg_id", "check").select("pkg_id", "rule", "path", "offset", "excerpt")


_MODES = [("full",), ("artifact-signal-only",), ("category-precondition",), ("undeclared",)]


@R.query(
    f"{_HITS_SQL}, k AS (SELECT DISTINCT pkg_id, rule FROM h), m(rule, covers) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in COVERS.items())}), "
    f"modes(covers) AS (VALUES {', '.join(f'({m[0]!r})' for m in _MODES)}) "
    "SELECT modes.covers, count(k.rule) AS detected FROM modes LEFT JOIN m USING (covers) LEFT JOIN k USING (rule) GROUP BY 1"
)
def detected_by_coverage(spark, d):
    covers = spark.createDataFrame(list(COVERS.items()), "rule string, covers string")
    found = hits(spark, d).select("pkg_id", "rule").distinct().join(F.broadcast(covers), "rule", "left").withColumn("detected", F.lit(True))
    return findings.detected_by_coverage(found, spark.createDataFrame(_MODES, "covers string"))


@R.query(
    f"{_HITS_SQL}, k AS (SELECT DISTINCT pkg_id, rule FROM h), p AS (SELECT DISTINCT pkg_id FROM f), r(rule) AS (VALUES {', '.join(f'({n!r})' for n, _ in RULES)}) "
    "SELECT p.pkg_id, r.rule AS check_id, CASE WHEN k.rule IS NULL THEN 'clear' ELSE 'fired' END AS status FROM p, r LEFT JOIN k ON k.pkg_id = p.pkg_id AND k.rule = r.rule"
)
def coverage_ledger(spark, d):
    """Every check of every package, fired or clear."""
    f = files(spark, d)
    fired = hits(spark, d).select("pkg_id", F.col("rule").alias("check_id"), F.lit(True).alias("detected"), F.col("excerpt").alias("evidence"))
    checks = spark.createDataFrame([(n,) for n, _ in RULES], "check_id string")
    roster = f.select("pkg_id").distinct().crossJoin(F.broadcast(checks)).withColumns({"detected": F.lit(False), "evidence": F.lit(None).cast("string")})
    return findings.ledger(fired.unionByName(roster), checks).select("pkg_id", "check_id", "status")


@R.query(
    f"{_HITS_SQL} SELECT CASE WHEN grouping(rule) = 1 THEN 'TOTAL' ELSE rule END AS rule, CASE WHEN grouping(pkg_id) = 1 THEN 'TOTAL' ELSE pkg_id END AS pkg_id, count(*) AS n FROM h GROUP BY ROLLUP (rule, pkg_id)"
)
def coverage_rollup(spark, d):
    return findings.rollup_counts(hits(spark, d), "rule", "pkg_id")


@R.query(
    f"{_HITS_SQL}, e AS (SELECT pkg_id, rule AS scenario, min(path || ': ' || excerpt) AS evidence FROM h GROUP BY ALL), "
    "w(skill, scenario, evidence_contains, reason, ordinal) AS (VALUES ('src0', 'encoded-blob', 'docs/', 'fixture', 0), ('src1', 'license-line', 'License', 'upstream text', 1), ('src2', 'shouting', 'no such text', 'never', 2)) "
    "SELECT e.pkg_id, e.scenario, w.reason IS NOT NULL AS waived, w.reason AS waiver_reason FROM e LEFT JOIN w ON w.skill = e.pkg_id AND w.scenario = e.scenario AND contains(e.evidence, w.evidence_contains)"
)
def waiver_apply(spark, d):
    return findings.apply_waivers(_evidence(spark, d), _waivers(spark)).select("pkg_id", "scenario", "waived", "waiver_reason")


@R.query(
    f"{_HITS_SQL}, e AS (SELECT pkg_id, rule AS scenario, min(path || ': ' || excerpt) AS evidence FROM h GROUP BY ALL), "
    "w(skill, scenario, evidence_contains, ordinal) AS (VALUES ('src0', 'encoded-blob', 'docs/', 0), ('src1', 'license-line', 'License', 1), ('src2', 'shouting', 'no such text', 2), ('srcX', 'shouting', '', 3)) "
    "SELECT skill, scenario, ordinal FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pkg_id = w.skill AND e.scenario = w.scenario AND contains(e.evidence, w.evidence_contains))"
)
def stale_waivers(spark, d):
    more = spark.createDataFrame([("srcX", "shouting", "", "", 3)], _waivers(spark).schema)
    return findings.stale_waivers(_evidence(spark, d), _waivers(spark).unionByName(more)).select("skill", "scenario", "ordinal")


def _waivers(spark):
    rows = [("src0", "encoded-blob", "docs/", "fixture", 0), ("src1", "license-line", "License", "upstream text", 1), ("src2", "shouting", "no such text", "never", 2)]
    return spark.createDataFrame(rows, "skill string, scenario string, evidence_contains string, reason string, ordinal int")


def _evidence(spark, d):
    h = hits(spark, d).groupBy("pkg_id", F.col("rule").alias("scenario"))
    return h.agg(F.min(F.concat("path", F.lit(": "), "excerpt")).alias("evidence"))


_DECLARED = [("X1-S01", "agent-judgable"), ("X1-S02", "out-of-artifact"), ("X1-S03", "static-detectable")]


@R.query(
    f"{_HITS_SQL}, m(rule, covers) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in COVERS.items())}), p AS (SELECT DISTINCT pkg_id FROM f), "
    "u(id, kind, why) AS (VALUES ('X1-S01', 'open', 'agent-judgable: decidable from this package, but not by a static check'), ('X1-S02', 'notApplicable', 'out-of-artifact: the defining condition is not in this package at any depth')) "
    "SELECT pkg_id, rule AS rule_id, 'fail' AS kind, CASE WHEN covers = 'full' THEN 'error' ELSE 'warning' END AS level, "
    "CASE WHEN length(path || excerpt || line) + 3 <= 1000 THEN path || ':' || line || ': ' || excerpt ELSE left(path || ':' || line || ': ' || excerpt, 1000) || '… [truncated]' END AS message, path AS uri, line::INTEGER AS start_line FROM h JOIN m USING (rule) "
    "UNION ALL SELECT pkg_id, rule, 'pass', 'none', rule || ': ran and cleared', NULL, NULL FROM p, m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pkg_id = p.pkg_id AND h.rule = m.rule) "
    "UNION ALL SELECT pkg_id, id || '-undecided', kind, 'none', id || ': declared ' || why || '. This run makes no claim about it.', NULL, NULL FROM p, u"
)
def sarif_results(spark, d):
    """A row for every hit, every check of a package that cleared, and every declared scenario that no check decides."""
    covers = spark.createDataFrame(list(COVERS.items()), "check_id string, covers string")
    evidence = F.concat(F.concat_ws(":", "path", "line"), F.lit(": "), F.col("excerpt"))
    fired = hits(spark, d).select("pkg_id", F.col("rule").alias("check_id"), F.lit(True).alias("detected"), evidence.alias("evidence"))
    packages = files(spark, d).select("pkg_id").distinct()
    cleared = packages.crossJoin(covers.select("check_id")).join(fired.select("pkg_id", "check_id").distinct(), ["pkg_id", "check_id"], "left_anti")
    ran = fired.unionByName(cleared.withColumns({"detected": F.lit(False), "evidence": F.lit(None).cast("string")})).join(covers, "check_id")
    declared = spark.createDataFrame(_DECLARED, "scenario_id string, tier string")
    return findings.sarif_results(ran).unionByName(findings.sarif_undecided(packages, declared))


@R.query("SELECT source AS pkg_id, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, max(strlen(text))::BIGINT AS largest, count(*) FILTER (WHERE strlen(text) > 8192) AS oversize FROM documents GROUP BY 1")
def scan_inventory(spark, d):
    n = F.octet_length("text").cast("long")
    return files(spark, d).groupBy("pkg_id").agg(F.count(F.lit(1)).alias("files"), F.sum(n).alias("bytes"), F.max(n).alias("largest"), F.count_if(n > 8192).alias("oversize"))


@R.query("SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'size' WHEN text = '' THEN 'empty' END AS skipped FROM documents")
def size_limit(spark, d):
    n = F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", F.when(n > 8192, "size").when(n == 0, "empty").alias("skipped"))


@R.query("SELECT lang, doc_id % 3 = 0 AS in_surface, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def lang_surface_split(spark, d):
    return table(spark, d, "documents").groupBy("lang", (F.col("doc_id") % 3 == 0).alias("in_surface")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_BLOB = r"[A-Za-z0-9+/]{24,}={0,2}"


@R.query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_BLOB}')) AS blob FROM documents WHERE regexp_matches(text, '{_BLOB}')")
def blob_extract(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(_BLOB)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_BLOB), 0)).alias("blob"))


@R.query(f"SELECT doc_id, i AS encoded, CASE WHEN len(i) % 4 = 0 AND NOT contains(rtrim(i, '='), '=') THEN octet_length(from_base64(i))::INTEGER END AS n_bytes FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_BLOB}')) AS i FROM documents)")
def blob_decode_size(spark, d):
    b = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_BLOB), 0)).alias("encoded"))
    ok = (F.length("encoded") % 4 == 0) & ~F.rtrim("encoded", F.lit("=")).contains("=")
    return b.select("doc_id", "encoded", F.when(ok, F.octet_length(F.try_to_binary("encoded", F.lit("base64")))).alias("n_bytes"))


@R.query("SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{32,}')) AS digits FROM documents")
def hex_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{32,}"), 0)).alias("digits"))


def _redact_sql(x: str) -> str:
    for p, to in t.SECRETS:
        x = f"regexp_replace({x}, '{p}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return x


@R.query(f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def secret_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", t.redact(F.col("text")).alias("redacted"))


@R.query(
    f"SELECT doc_id, CASE WHEN length(r) <= 800 THEN r ELSE left(r, 800) || '… [truncated ' || (length(r) - 800) || ' more characters]' END AS excerpt, chars FROM (SELECT doc_id, {_redact_sql('text')} AS r, length(text)::INTEGER AS chars FROM documents)"
)
def excerpt_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", t.excerpt(F.col("text")).alias("x")).select("doc_id", "x.*")


@R.query("SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE left(s, 119) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s FROM documents)")
def snippet_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", t.snippet(F.col("text")).alias("snippet"))


_PROBES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || chr(8203) || text WHEN 1 THEN text || chr(8238) || chr(8203) || chr(65279) ELSE text END AS text FROM documents"


@R.query(f"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{t.INVISIBLE}'), lambda c: 'U+' || upper(lpad(to_hex(unicode(c)), 4, '0'))))) AS points FROM ({_PROBES})")
def invisible_codepoints(spark, d):
    docs = table(spark, d, "documents")
    probe = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a\u200b"), F.col("text"))).when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit("\u202e\u200b\ufeff"))).otherwise(F.col("text"))
    return docs.select("doc_id", t.invisible_points(probe).alias("points"))


@R.query("SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, coalesce(list_max(list_transform(regexp_extract_all(text, '[ \\t]{2,}'), lambda x: length(x))), 0)::INTEGER AS longest_padding FROM documents")
def line_count_and_padding(spark, d):
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"[ \t]{2,}"), 0), lambda x: F.length(x))
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.coalesce(F.array_max(runs), F.lit(0)).alias("longest_padding"))


@R.query(f"WITH f AS ({PACKAGES_SQL}) SELECT pkg_id, sha256(string_agg(path || chr(0) || text, '' ORDER BY path)) AS digest FROM f GROUP BY 1")
def package_digest(spark, d):
    return digests.package_digest(files(spark, d))


@R.query("SELECT lang AS category, sha256(string_agg(doc_id || ':' || source, '|' ORDER BY doc_id || ':' || source)) AS \"lock\" FROM documents GROUP BY 1")
def tier_lock_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(digests.lock(F.col("doc_id").cast("string"), F.col("source")).alias("lock"))


@R.query("SELECT conv_id, 'run-' || left(sha256(conv_id || '|' || role), 10) AS token FROM conversations")
def blind_token(spark, d):
    return table(spark, d, "conversations").select("conv_id", digests.blind_token(F.col("conv_id").cast("string"), F.col("role")).alias("token"))


_URL_HOST = r"^[a-z]+://([^/?#]+)"
_HOST_SQL = f"SELECT page_id, regexp_extract(url, '{_URL_HOST}', 1) AS raw FROM pages"
_VARIANT_SQL = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN upper(raw) || ':8080' WHEN 1 THEN raw || '.' WHEN 2 THEN '[::1]:443' WHEN 3 THEN '127.0.0.' || page_id % 256 WHEN 4 THEN split_part(raw, '.', 1) WHEN 5 THEN '300.1.2.3' WHEN 6 THEN 'api.localhost' ELSE raw END AS raw FROM (" + _HOST_SQL + ")"
_NORM_SQL = f"SELECT page_id, raw, rtrim(CASE WHEN starts_with(h, '[') THEN regexp_extract(h, '^\\[([^\\]]*)', 1) WHEN len(h) - len(replace(h, ':', '')) > 1 THEN h ELSE split_part(h, ':', 1) END, '.') AS host FROM (SELECT page_id, raw, lower(trim(raw)) AS h FROM ({_VARIANT_SQL}))"
_OCT = [f"coalesce(try_cast(nullif(regexp_extract(host, '{hosts.IPV4}', {i}), '') AS INTEGER), 999)" for i in range(1, 5)]
_CLASS_SQL = f"CASE WHEN host IN ('::1', '0:0:0:0:0:0:0:1', 'localhost', 'localhost.localdomain') OR suffix(host, '.localhost') THEN 'loopback' WHEN regexp_matches(host, '{hosts.IPV4}') THEN CASE WHEN greatest({', '.join(_OCT)}) <= 255 AND ({_OCT[0]} = 127 OR {' + '.join(_OCT)} = 0) THEN 'loopback' ELSE 'routable' END WHEN NOT contains(host, '.') AND NOT contains(host, ':') THEN 'unqualified' ELSE 'routable' END"


def _page_hosts(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", _URL_HOST, 1).alias("raw"))
    k, raw = F.col("page_id") % 8, F.col("raw")
    variant = (
        F.when(k == 0, F.concat(F.upper(raw), F.lit(":8080"))).when(k == 1, F.concat(raw, F.lit("."))).when(k == 2, "[::1]:443")
        .when(k == 3, F.concat(F.lit("127.0.0."), F.col("page_id") % 256)).when(k == 4, F.substring_index(raw, ".", 1)).when(k == 5, "300.1.2.3")
        .when(k == 6, "api.localhost").otherwise(raw)
    )
    return p.select("page_id", variant.alias("raw")).withColumn("host", hosts.normalize(F.col("raw")))


@R.query(f"SELECT page_id, raw, host FROM ({_NORM_SQL})")
def host_normalize(spark, d):
    return _page_hosts(spark, d)


@R.query(f"SELECT page_id, host, {_CLASS_SQL} AS host_class FROM ({_NORM_SQL})")
def host_class(spark, d):
    return _page_hosts(spark, d).select("page_id", "host", hosts.host_class(F.col("host")).alias("host_class"))


@R.query(
    f"SELECT host, count(*) AS pages FROM ({_NORM_SQL}) WHERE {_CLASS_SQL} = 'routable' AND host NOT IN (SELECT lower(regexp_extract(url, '{_URL_HOST}', 1)) FROM pages WHERE page_id % 3 = 0) GROUP BY 1"
)
def undeclared_hosts(spark, d):
    """Routable hosts that an allowlist leaves out, by anti-join."""
    allow = table(spark, d, "pages").where("page_id % 3 = 0").select(F.lower(F.regexp_extract("url", _URL_HOST, 1)).alias("host")).distinct()
    found = _page_hosts(spark, d).where(hosts.host_class(F.col("host")) == "routable").join(allow, "host", "left_anti")
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


_LINT_SQL = "CASE WHEN contains(e, '*') THEN 'wildcard' WHEN contains(e, '://') THEN 'scheme' WHEN contains(e, '/') THEN 'path' WHEN contains(e, ':') THEN 'port' WHEN e <> lower(e) THEN 'case' WHEN NOT regexp_matches(e, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$') THEN 'form' END"


@R.query(f"SELECT page_id, e AS entry, {_LINT_SQL} AS fault FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '*.' || raw WHEN 1 THEN 'https://' || raw WHEN 2 THEN raw || '/v1' WHEN 3 THEN raw || ':443' WHEN 4 THEN upper(raw) ELSE raw END AS e FROM ({_HOST_SQL}))")
def host_lint(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", _URL_HOST, 1).alias("raw"))
    k, raw = F.col("page_id") % 6, F.col("raw")
    e = (
        F.when(k == 0, F.concat(F.lit("*."), raw)).when(k == 1, F.concat(F.lit("https://"), raw)).when(k == 2, F.concat(raw, F.lit("/v1")))
        .when(k == 3, F.concat(raw, F.lit(":443"))).when(k == 4, F.upper(raw)).otherwise(raw)
    )
    return p.select("page_id", e.alias("entry")).withColumn("fault", hosts.lint(F.col("entry")))


@R.query("SELECT entry, regexp_matches(entry, '[*?\\[\\]{}]') AS wildcard FROM (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN '*.' || split_part(url, '/', 3) ELSE split_part(url, '/', 3) END AS entry FROM pages)")
def wildcard_allow(spark, d):
    h = F.get(F.split("url", "/"), F.lit(2))
    e = table(spark, d, "pages").select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("*."), h)).otherwise(h).alias("entry")).distinct()
    return e.select("entry", hosts.unbounded(F.array("entry")).alias("wildcard"))


_GRANTS = ", ".join(f"({i}, '{n}', {w}::VARCHAR[], {x}::VARCHAR[], {s}, {a}::VARCHAR[])" for i, (n, w, x, s, a) in enumerate(permission_rows()))
_PERM = (
    f"WITH p AS (SELECT v.name || '-' || s_suppkey AS name, w, d, shell, allow FROM supplier JOIN (VALUES {_GRANTS}) v(ix, name, w, d, shell, allow) "
    f"ON s_suppkey % {len(permission_rows())} = ix)"
)
_ALLOWED = "NOT list_bool_or(list_transform(list_concat(d, ['~none~']), lambda e: regexp_replace(e, '^\\./', '') = '{f}')) AND list_bool_or(list_transform(list_concat(w, ['~none~']), lambda e: regexp_replace(e, '^\\./', '') = '{f}'))"


@R.query(_PERM + " SELECT name, " + ", ".join(f"({_ALLOWED.format(f=f)}) AS \"{f[:-3].lower()}\"" for f in paths.IDENTITY_FILES) + " FROM p")
def write_allowed(spark, d):
    p = _permissions(spark, d)
    return p.select("name", *(paths.write_allowed(F.col("w"), F.col("d"), f).alias(f[:-3].lower()) for f in paths.IDENTITY_FILES))


def _permissions(spark, d):
    """Suppliers as packages, each with one of the sets of permissions."""
    rows = permission_rows()
    sets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ix long, name string, w array<string>, d array<string>, shell boolean, allow array<string>")
    named = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(rows)).alias("ix")).join(F.broadcast(sets), "ix")  # a row for each set
    return named.select(F.concat_ws("-", "name", "s_suppkey").alias("name"), "w", "d", "shell", "allow")


_NAMED = "SELECT name, regexp_replace(e, '^\\./', '') AS path, regexp_replace(regexp_replace(e, '^\\./', ''), '.*/', '') AS base FROM (SELECT name, unnest({0}) AS e FROM p)"
_TIERS = (
    f"{_PERM}, wr AS ({_NAMED.format('w')}), dn AS ({_NAMED.format('d')}), "
    "eff AS (SELECT name FROM wr WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.name = wr.name AND (dn.path = wr.path OR (NOT contains(dn.path, '/') AND dn.path = wr.base)))), "
    "own AS (SELECT name FROM wr WHERE base IN ('SOUL.md', 'MEMORY.md', 'AGENTS.md') AND NOT EXISTS (SELECT 1 FROM dn WHERE dn.name = wr.name AND dn.base = wr.base)), "
    "t AS (SELECT name, CASE WHEN name IN (FROM own) OR (shell AND name IN (FROM eff)) THEN 3 WHEN shell THEN 2 WHEN name IN (FROM eff) OR len(allow) > 0 THEN 1 ELSE 0 END AS derived FROM p)"
)


@R.query(f"{_TIERS} SELECT name, 'L' || derived AS tier FROM t")
def risk_tier_derive(spark, d):
    return _permissions(spark, d).select("name", paths.risk_tier(F.col("w"), F.col("d"), F.col("shell"), F.col("allow")).alias("tier"))


@R.query(
    f"{_TIERS}, c AS (SELECT name, derived, x AS declared FROM t, (VALUES ('L0'), ('L1'), ('L9')) v(x)) "
    "SELECT name, declared, CASE WHEN regexp_matches(declared, '^L[0-3]$') THEN right(declared, 1)::INTEGER < derived ELSE false END AS spoofed FROM c"
)
def tier_spoof(spark, d):
    t_ = _permissions(spark, d).select("name", paths.tier_rank(paths.risk_tier(F.col("w"), F.col("d"), F.col("shell"), F.col("allow"))).alias("derived"))
    c = t_.crossJoin(F.broadcast(spark.createDataFrame([("L0",), ("L1",), ("L9",)], "declared string")))
    return c.select("name", "declared", F.coalesce(paths.tier_rank(F.col("declared")) < F.col("derived"), F.lit(False)).alias("spoofed"))


_BASE_SQL = "regexp_replace(regexp_replace(e, '^\\./', ''), '.*/', '')"


@R.query(f"{_PERM}, e AS (SELECT name, unnest(d) AS e FROM p) SELECT name, bool_or({_BASE_SQL} = 'SOUL.md' OR e IN ('**', './**', '~/**', '/**')) AS shadowed FROM e GROUP BY 1")
def deny_shadow(spark, d):
    e = _permissions(spark, d).select("name", F.explode("d").alias("e"))
    return e.groupBy("name").agg(F.bool_or(paths.shadows(F.col("e"), "SOUL.md")).alias("shadowed"))


@R.query(f"{_PERM}, e AS (SELECT name, unnest(w) AS e FROM p) SELECT name, bool_or({_BASE_SQL} = 'SOUL.md' OR e IN ('**', './**', '~/**', '/**', '*.md', 'SOUL.*', '*')) AS reached FROM e GROUP BY 1")
def glob_reach(spark, d):
    e = _permissions(spark, d).select("name", F.explode("w").alias("e"))
    return e.groupBy("name").agg(F.bool_or(paths.reaches(F.col("e"), "SOUL.md")).alias("reached"))


@R.query(f"WITH f AS ({PACKAGES_SQL}) SELECT sha256(text) AS digest, count(*) AS copies, min(path) AS first_path FROM f GROUP BY 1 HAVING count(*) > 1")
def dup_documents(spark, d):
    return studies.duplicate_files(files(spark, d))


@R.query(f"WITH f AS ({PACKAGES_SQL}) SELECT left(text, 80) AS header, count(DISTINCT pkg_id) AS packages FROM f GROUP BY 1 HAVING count(DISTINCT pkg_id) > 1")
def near_headers_dup(spark, d):
    return files(spark, d).groupBy(F.left("text", F.lit(80)).alias("header")).agg(F.countDistinct("pkg_id").alias("packages")).where("packages > 1")
