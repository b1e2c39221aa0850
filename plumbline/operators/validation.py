"""Validation of package manifests: structural violations first, the meaning only of manifests that have the right shape.

Manifests are VARIANT; every rule is a column of one projection that gives nothing or a list
of violations, so a table of manifests is read once and only violations leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hosts, paths
from plumbline.sources.manifests import at, has, is_map, kind, strings

# --- fixed values: the shape of a manifest, and the words of its fields ---
SHAPE = [
    ("name", "STRING", True), ("version", "STRING", True), ("platforms", "ARRAY", True), ("description", "STRING", True), ("author", "OBJECT", True),
    ("author.name", "STRING", True), ("author.identity", "STRING", False), ("author.signing_key", "STRING", False), ("permissions", "OBJECT", True),
    ("permissions.files", "OBJECT", True), ("permissions.files.read", "ARRAY", True), ("permissions.files.write", "ARRAY", True),
    ("permissions.files.deny_write", "ARRAY", True), ("permissions.network", "OBJECT", True), ("permissions.network.allow", "ARRAY", True),
    ("permissions.shell", "BOOLEAN", True), ("permissions.tools", "ARRAY", False), ("requires", "OBJECT", False), ("risk_tier", "STRING", True),
    ("scan_status", "OBJECT", False), ("signature", "STRING", True), ("content_hash", "STRING", True), ("changelog", "ARRAY", False),
]
HASH, SIGNATURE, UNSIGNED = r"^sha256:[0-9a-f]{64}$", r"^ed25519:[0-9a-f]{128}$", "unsigned"
NETWORK_TOOLS = ["web_fetch", "web_search", "fetch", "http_request", "http", "browser", "curl"]
# --- end of fixed values ---

VIOLATION = "array<struct<severity:string,rule:string,path:string,message:string>>"


def _one(severity: str, rule: str, path: str, when: Column, *message: Column | str) -> Column:
    """A list of one violation, or of none."""
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))
    row = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(path).alias("path"), text.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(row)).otherwise(F.array().cast(VIOLATION)).cast(VIOLATION)


def _each(severity: str, rule: str, path: str, entries: Column, wrong) -> Column:
    """A violation for each entry for which wrong gives a message."""

    def told(entry: Column, i: Column) -> Column:
        why = wrong(entry)
        where = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        row = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), where.alias("path"), why.alias("message"))
        return F.when(why.isNotNull(), row)

    return F.array_compact(F.transform(entries, told)).cast(VIOLATION)


def _entries(path: str) -> Column:
    """All entries of a list as text, those that are no strings as null."""
    items = F.coalesce(at(path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def _text(path: str) -> Column:
    return F.when(kind(at(path)) == "STRING", at(path, "string"))


def structural() -> Column:
    """Violations of the shape: fields that are absent or of another type, list entries that are no text, misshapen hashes.

    A field below one that is itself absent or misshapen is not told again.
    """
    rules = [_one("error", "shape", "$", ~kind(F.col("manifest")).startswith("OBJECT"), "the manifest is no mapping")]
    for name, wanted, required in SHAPE:
        path, parent = f"$.{name}", f"$.{name}".rpartition(".")[0]
        k = kind(at(path))
        above = is_map(parent) if parent != "$" else kind(F.col("manifest")).startswith("OBJECT")
        absent = (k == "") if required else F.lit(False)
        rules.append(_one("error", "required", path, above & absent, f"{name} is required"))
        rules.append(_one("error", "type", path, above & (k != "") & ~k.startswith(wanted), f"{name} is no {wanted.lower()} but ", F.lower(F.regexp_extract(k, "^[A-Z]+", 0))))
    for name in ("platforms", "permissions.files.read", "permissions.files.write", "permissions.files.deny_write", "permissions.network.allow", "permissions.tools"):
        rules.append(_each("error", "type", f"$.{name}", _entries(f"$.{name}"), lambda e: F.when(F.coalesce(F.trim(e), F.lit("")) == "", "no text")))
    rules.append(_one("error", "pattern", "$.content_hash", ~_text("$.content_hash").rlike(HASH), "content_hash is no sha256: and 64 hex digits"))
    return F.concat(*rules)


def signature_state() -> Column:
    """signed, unsigned (the word itself), or malformed: anything else, absent too."""
    value = _text("$.signature")
    return F.when(value == UNSIGNED, "unsigned").when(value.rlike(SIGNATURE), "signed").otherwise("malformed")


def _globbed(entry: Column) -> Column:
    return F.when(entry.rlike(r"[*?\[\]{}]"), F.concat(entry, F.lit(" has a wildcard, and only explicit paths can be reviewed")))


def _parent(entry: Column) -> Column:
    return F.when(F.array_contains(F.split(F.regexp_replace(entry, r"^\./", ""), "/"), ".."), F.concat(entry, F.lit(" has a '..' segment, which leads out of its root")))


def _host_wrong(entry: Column) -> Column:
    """The first thing wrong with an allowlist entry: only a star is a wildcard of a host."""
    return (
        F.when(entry.contains("*"), F.concat(entry, F.lit(" has a wildcard, and hosts match exactly")))
        .when(entry.contains("://"), F.concat(entry, F.lit(" has a scheme")))
        .when(entry.contains("/"), F.concat(entry, F.lit(" has a path")))
        .when(entry.contains(":"), F.concat(entry, F.lit(" has a port")))
        .when(entry != F.lower(entry), F.concat(entry, F.lit(" is not lower-case")))
        .when(~entry.rlike(hosts.HOSTNAME), F.concat(entry, F.lit(" is no host name")))
    )


def semantic() -> Column:
    """Violations of the meaning of a manifest that has the right shape, errors and warnings."""
    read, write, deny, allow = (strings(f"$.permissions.{p}") for p in ("files.read", "files.write", "files.deny_write", "network.allow"))
    tools = F.array_sort(F.array_intersect(strings("$.permissions.tools"), F.array(*map(F.lit, NETWORK_TOOLS))))
    scopes = (("read", read), ("write", write), ("deny_write", deny))
    rules = [_each("error", rule, f"$.permissions.files.{n}", e, wrong) for n, e in scopes for rule, wrong in (("explicit-path", _globbed), ("parent-path", _parent))]
    for name in paths.IDENTITY_FILES:
        named = lambda e: paths.basename(e) == name  # noqa: B023, E731
        denied, granted = F.exists(deny, named), F.exists(write, named)
        rules.append(_one("warning", "inert-grant", "$.permissions.files", denied & granted, f"{name} is granted and denied; the denial wins"))
        rules.append(_one("error", "identity-default", "$.permissions.files.deny_write", ~denied & ~granted, f"{name} is neither denied nor granted by name"))
    rules.append(_each("error", "host", "$.permissions.network.allow", allow, _host_wrong))
    denial = "$.permissions.network.deny"
    rules.append(_one("error", "network-deny", denial, has(denial) & ~F.coalesce(_text(denial) == "*", F.lit(False)), 'egress is denied by default; deny can only be "*"'))
    rules.append(_one("warning", "network-deny", denial, ~has(denial), "the default denial of egress is not written down"))
    rules.append(_one("warning", "idle-tools", "$.permissions.tools", (F.size(tools) > 0) & (F.size(allow) == 0), "tools that reach no host: ", F.array_join(tools, ", ")))
    tier = _text("$.risk_tier")
    derived = paths.risk_tier(write, deny, F.coalesce(at("$.permissions.shell", "boolean"), F.lit(False)), allow)
    rank, floor = paths.tier_rank(tier), paths.tier_rank(derived)
    rules.append(_one("error", "risk-tier", "$.risk_tier", rank < floor, tier, " is below ", derived, ", which the permissions ask for"))
    rules.append(_one("warning", "risk-tier", "$.risk_tier", rank > floor, tier, " is above ", derived, ", which the permissions ask for"))
    rules.append(_one("error", "risk-tier", "$.risk_tier", tier.isNotNull() & rank.isNull(), tier, " is no tier"))
    state = signature_state()
    rules.append(_one("error", "signature", "$.signature", state == "malformed", "neither a signature nor the word unsigned"))
    rules.append(_one("error", "signing-key", "$.author.signing_key", (state == "signed") & (F.coalesce(_text("$.author.signing_key"), F.lit("")) == ""), "signed, and no key to verify it with"))
    rules.append(_one("warning", "identity", "$.author.identity", F.coalesce(_text("$.author.identity"), F.lit("")) == "", "no identity to bind the package to"))
    scan, result, scanner = "$.scan_status", _text("$.scan_status.result"), _text("$.scan_status.scanner")
    unscanned = F.coalesce(result == "unscanned", F.lit(False))
    rules.append(_one("warning", "scan-status", scan, ~has(scan), "absent: never scanned, or lost in a port"))
    rules.append(_one("error", "scan-status", scan, has(scan) & unscanned & (scanner != "none"), "unscanned, by ", scanner))
    rules.append(_one("error", "scan-status", scan, has(scan) & ~unscanned & (scanner == "none"), "a result of no scanner: ", F.coalesce(result, F.lit("none"))))
    version = _text("$.version")
    log = F.coalesce(at("$.changelog", "array<variant>"), F.array().cast("array<variant>"))
    logged = F.array_compact(F.transform(log, lambda v: F.try_variant_get(v, "$.version", "string")))
    rules.append(_one("error", "changelog", "$.changelog", (version != "") & (F.size(log) > 0) & ~F.array_contains(logged, version), "no entry for version ", version, " among ", F.array_join(F.array_sort(logged), ", ")))
    return F.concat(*rules)


def validate(manifests: DataFrame) -> DataFrame:
    """One row for each of manifests(pkg_id, manifest VARIANT): pkg_id, ok, signature_state, derived_risk_tier, violations.

    A manifest that has not the right shape is told what is wrong with the shape and nothing
    else; its tier is null. ok is false if there is an error among the violations. manifests
    may also have actual_hash (of the package's surface, as sha256:hex) and native_name (of
    SKILL.md), against which the manifest's are held where they are not null.
    """
    bound = []
    if "actual_hash" in manifests.columns:
        bound.append(_one("error", "content-hash", "$.content_hash", _text("$.content_hash") != F.col("actual_hash"), "declared ", _text("$.content_hash"), ", actual ", F.col("actual_hash")))
    if "native_name" in manifests.columns:
        bound.append(_one("error", "name", "$.name", _text("$.name") != F.col("native_name"), "declared ", _text("$.name"), ", in SKILL.md ", F.col("native_name")))
    shaped = manifests.select("*", structural().alias("_shape"))
    sound = F.size("_shape") == 0
    write, deny, allow = (strings(f"$.permissions.{p}") for p in ("files.write", "files.deny_write", "network.allow"))
    tier = paths.risk_tier(write, deny, F.coalesce(at("$.permissions.shell", "boolean"), F.lit(False)), allow)
    found = F.when(sound, F.concat(semantic(), *bound)).otherwise(F.col("_shape"))
    out = shaped.select("pkg_id", signature_state().alias("signature_state"), F.when(sound, tier).alias("derived_risk_tier"), found.alias("violations"))
    return out.select("pkg_id", (~F.exists("violations", lambda v: v["severity"] == "error")).alias("ok"), "signature_state", "derived_risk_tier", "violations")


def violations(validated: DataFrame) -> DataFrame:
    """A row for each violation: pkg_id, severity, rule, path, message."""
    return validated.select("pkg_id", F.explode("violations").alias("v")).select("pkg_id", "v.*")


def egress_allowed(allow: Column, host: Column) -> Column:
    """Egress by default denied: only a host on the list, exactly, in any case."""
    return hosts.declared(allow, F.lower(F.trim(host)))
