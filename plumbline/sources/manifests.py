"""Manifests: YAML and frontmatter to VARIANT, and declared permissions in one shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What frontmatter is: all between a first line of dashes and the next line that begins with three.
FRONTMATTER = r"(?s)^---[^\n]*\n(.*?)(?<=\n)---"


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """JSON of YAML mappings, read by the safe loader; null for anything else."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            data = yaml.load(text, loader)  # a safe loader in both cases
            return json.dumps(data, default=str) if isinstance(data, dict) else None
        except (yaml.YAMLError, TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def frontmatter(text: Column) -> Column:
    """The YAML block at the head of a Markdown text, null without one."""
    return F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 1))


def read_manifests(scanned: DataFrame) -> DataFrame:
    """One row for each package of scanned(pkg_id, path, text): pkg_id, manifest (VARIANT), source, problem.

    A skill.usf.yaml goes before the frontmatter of SKILL.md. If it is no mapping the
    frontmatter is read; problem tells of one that is no YAML mapping.
    """
    usf, md = F.col("path") == "skill.usf.yaml", F.col("path") == "SKILL.md"
    block = F.when(usf, F.col("text")).when(md, frontmatter(F.col("text")))
    read = scanned.where(usf | md).select("pkg_id", usf.alias("usf"), yaml_to_json(block).alias("json"))
    both = read.groupBy("pkg_id").agg(
        F.max(F.when(F.col("usf"), F.col("json"))).alias("u"), F.max(F.when(~F.col("usf"), F.col("json"))).alias("m"),
        F.bool_or("usf").alias("has_u"), F.bool_or(~F.col("usf")).alias("has_m"),
    )
    out = scanned.select("pkg_id").distinct().join(both, "pkg_id", "left")
    source = (
        F.when(F.col("u").isNotNull(), "skill.usf.yaml").when(F.col("m").isNotNull(), "SKILL.md frontmatter")
        .when(F.col("has_m"), "SKILL.md (no parseable frontmatter)").otherwise("none")
    )
    problem = F.when(F.col("has_u") & F.col("u").isNull(), "skill.usf.yaml is no YAML mapping")
    return out.select("pkg_id", F.try_parse_json(F.coalesce("u", "m")).alias("manifest"), source.alias("source"), problem.alias("problem"))


def at(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("manifest", path, kind)


def kind(value: Column) -> Column:
    """BOOLEAN, STRING, OBJECT<..>, ARRAY<..>, a number type, VOID; an empty string where nothing is."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def is_map(path: str) -> Column:
    return kind(at(path)).startswith("OBJECT")


def has(path: str) -> Column:
    return kind(at(path)) != ""


def strings(path: str) -> Column:
    """The strings of a list; an empty array where there is no list."""
    items = F.coalesce(at(path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def _text(path: str) -> Column:
    return F.when(kind(at(path)) == "STRING", at(path, "string"))


def _truthy(path: str) -> Column:
    """Is a value anything but absent, null, false, zero and empty?"""
    k = kind(at(path))
    return (
        F.when(k.isin("", "VOID", "OBJECT<>", "ARRAY<VOID>"), F.coalesce(F.size(at(path, "array<variant>")) > 0, F.lit(False)))
        .when(k == "BOOLEAN", at(path, "boolean"))
        .when(k == "STRING", at(path, "string") != "")
        .when(k.startswith("OBJECT") | k.startswith("ARRAY"), True)
        .otherwise(at(path, "double") != 0)
    )


def declared(packages: DataFrame) -> DataFrame:
    """Permissions, risk tier, hash and description of packages(pkg_id, manifest VARIANT) in flat columns.

    A block with a top-level deny_write, a shell mapping or a network policy is taken as it
    is; any other is read in the nested spelling: scopes below files, shell as a flag, an
    allowlist evaluated default-deny, a bare network flag as everything or nothing. Columns
    beside pkg_id and manifest: has_perms, native, read, write, deny, declares_deny, shell (granted in any spelling),
    shell_open (granted, and no literal command bounds it), net_any (a bare true), net_map,
    has_network, policy, has_allow, allow, tools, risk_tier, content_hash, description.
    A null manifest declares nothing.
    """
    p, files, shell, net = "$.permissions", "$.permissions.files", "$.permissions.shell", "$.permissions.network"
    native = has(f"{p}.deny_write") | is_map(shell) | (is_map(net) & has(f"{net}.policy"))
    out = packages.select(
        "pkg_id", "manifest", (is_map(p) & (kind(at(p)) != "OBJECT<>")).alias("has_perms"), native.alias("native"), is_map(files).alias("nested"),
        kind(at(shell)).alias("sk"), kind(at(net)).alias("nk"),
    )
    nat, nk, sk = F.col("native"), F.col("nk"), F.col("sk")
    empty = F.array().cast("array<string>")

    def scope(key: str) -> Column:
        return F.when(F.col("nested"), strings(f"{files}.{key}")).when(nat, strings(f"{p}.{key}")).otherwise(empty)

    flag = nk == "BOOLEAN"
    on = F.coalesce(at(net, "boolean"), F.lit(False))
    allow = F.when(flag, F.when(on, F.array(F.lit("*"))).otherwise(empty)).otherwise(strings(f"{net}.allow"))
    said = F.lower(F.trim(at(shell, "string")))
    # fixed values: words for a closed shell; the second reader knows fewer of them
    granted = F.when(sk == "STRING", ~said.isin("", "none", "false", "no", "off", "denied"))
    opened = F.when(sk == "STRING", ~said.isin("", "none", "false", "no", "off") & F.trim(at(shell, "string")).isin("*", "all"))
    commands = F.filter(strings(f"{shell}.commands"), lambda c: (F.trim(c) != "") & ~c.contains("*"))
    globbed = F.when(sk == "STRING", ~said.isin("", "none", "false", "no", "off") & at(shell, "string").contains("*"))
    any_shell = _truthy(shell)
    hash_text = F.when(is_map("$.content_hash"), _text("$.content_hash.value")).otherwise(F.regexp_extract(_text("$.content_hash"), r"(?s)^[^:]+:(.+)$", 1))
    return out.select(
        "pkg_id", "manifest", "has_perms", "native",
        scope("read").alias("read"), scope("write").alias("write"), scope("deny_write").alias("deny"),
        (F.col("has_perms") & (~nat | F.when(F.col("nested"), has(f"{files}.deny_write")).otherwise(has(f"{p}.deny_write")))).alias("declares_deny"),
        F.when(nat, F.when(sk.startswith("OBJECT"), _truthy(f"{shell}.allowed")).otherwise(F.coalesce(granted, any_shell))).otherwise(any_shell).alias("shell"),
        F.when(~nat, any_shell).when(sk.startswith("OBJECT"), _truthy(f"{shell}.allowed") & (F.size(commands) == 0))
        .when(sk == "BOOLEAN", at(shell, "boolean")).otherwise(F.coalesce(opened | globbed, F.lit(False))).alias("shell_open"),
        (nat & flag & on).alias("net_any"),
        (F.col("has_perms") & (~nat | nk.startswith("OBJECT"))).alias("net_map"),
        (F.col("has_perms") & (~nat | (nk != ""))).alias("has_network"),
        F.when(nat, _text(f"{net}.policy")).when(F.size(allow) > 0, "allow-list").otherwise("deny-all").alias("policy"),
        (~nat | has(f"{net}.allow")).alias("has_allow"), allow.alias("allow"), strings(f"{p}.tools").alias("tools"),
        _text("$.risk_tier").alias("risk_tier"), F.when(F.trim(hash_text) != "", hash_text).alias("content_hash"), at("$.description", "string").alias("description"),
    )
