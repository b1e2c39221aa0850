"""The check of configuration that a host reads when a project is opened: what it starts, and what it redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.trees import nodes

# --- fixed values: files that hosts read by themselves, and what in them starts a process ---
CONFIGS = [
    ".claude/settings.json", ".claude/settings.local.json", ".claude/hooks.json", ".mcp.json", ".cursor/mcp.json", ".cursor/settings.json", ".vscode/tasks.json",
    ".vscode/settings.json", ".codex/config.toml",
]
SERVER_KEYS = ["mcpServers", "servers", "mcp_servers"]
COMMAND_KEYS = ["command", "cmd", "script", "exec", "run", "shellcmd"]
CONTROL_PLANE = (
    r"(?i)^(?:ANTHROPIC_(?:BASE_URL|AUTH_TOKEN|API_KEY|MODEL)|OPENAI_(?:BASE_URL|API_KEY)|AWS_(?:ACCESS_KEY_ID|SECRET_ACCESS_KEY|ENDPOINT_URL)|NODE_OPTIONS"
    r"|LD_PRELOAD|LD_LIBRARY_PATH|DYLD_INSERT_LIBRARIES|PYTHONSTARTUP|PYTHONPATH|BASH_ENV|ENV|GIT_SSH_COMMAND|GIT_PROXY_COMMAND|npm_config_[A-Za-z0-9_]+"
    r"|HTTPS?_PROXY|ALL_PROXY)$"
)
# --- end of fixed values ---

CHECK = "AST02-config-file-hijacking"


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def command(entries: Column) -> Column:
    """The command among the entries of a mapping, with its arguments, or null: the first command key in order that has one."""

    def under(key: str) -> Column:
        held = F.filter(entries, lambda e: (F.lower(e["key"]) == key) & (~_blank(e["text"]) | e["items"].isNotNull()))
        return F.get(held, F.lit(0))

    given = F.get(F.filter(entries, lambda e: (F.lower(e["key"]) == "args") & (e["items"].isNotNull() | ~_blank(e["text"]))), F.lit(0))
    args = F.coalesce(F.concat(F.lit(" "), F.trim(F.coalesce(F.array_join(given["items"], " "), given["text"]))), F.lit(""))
    return F.coalesce(*(F.coalesce(F.trim(F.concat(F.trim(under(k)["text"]), args)), F.trim(F.array_join(under(k)["items"], " "))) for k in COMMAND_KEYS))


def _place(trail: Column) -> Column:
    return F.when(F.size(trail) == 0, "<root>").otherwise(F.array_join(trail, "."))


def _first(nodes: Column, f) -> Column:
    return F.get(F.array_compact(F.transform(nodes, f)), F.lit(0))


def hijacks(nodes: Column) -> Column:
    """The first thing in a document that a host would run or redirect: a hook, a server, an environment override, a task of an opened folder."""

    def hook(n: Column) -> Column:
        inside = F.exists(n["trail"], lambda k: F.lower(k).isin("hook", "hooks"))
        return F.when(inside, F.concat(F.lit("hook at "), _place(n["trail"]), F.lit(" runs "), command(n["entries"])))

    def server(n: Column) -> Column:
        inside = F.exists(n["trail"], lambda k: k.isin(SERVER_KEYS)) & ~F.coalesce(F.element_at(n["trail"], -1).isin(SERVER_KEYS), F.lit(False))
        return F.when((F.size(n["trail"]) > 0) & inside, F.concat(F.lit("server "), _place(n["trail"]), F.lit(" starts "), command(n["entries"])))

    def override(n: Column) -> Column:
        of = F.get(F.filter(n["entries"], lambda e: e["key"].rlike(CONTROL_PLANE)), F.lit(0))
        here = (F.size(n["trail"]) > 0) & F.lower(F.try_element_at(n["trail"], F.lit(-1))).isin("env", "environment", "envvars")
        return F.when(here & of.isNotNull(), F.concat(F.lit("override "), _place(n["trail"]), F.lit("."), of["key"], F.lit(" = "), of["shown"]))

    def task(n: Column) -> Column:
        options = F.filter(nodes, lambda m: m["trail"] == F.concat(n["trail"], F.array(F.lit("runOptions"))))
        opened = F.exists(options, lambda m: F.exists(m["entries"], lambda e: (e["key"] == "runOn") & (F.lower(e["text"]) == "folderopen")))
        return F.when(opened, F.concat(F.lit("task at "), _place(n["trail"]), F.lit(" runs as the folder opens: "), command(n["entries"])))

    return F.coalesce(*(_first(nodes, rule) for rule in (hook, server, override, task)))


def config_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Does a configuration file that hosts read by themselves run or redirect anything? pkg_id, check_id, detected, evidence, note.

    Files are told by the end of their paths, in any case. Evidence is of the first file by
    path, with the trail of keys. Files behind one that cannot be read are not decided: the
    first such file ends the check of its package, and the note says so.
    """
    flat = F.lower(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", ""))
    known = F.exists(F.array(*map(F.lit, CONFIGS)), lambda c: F.endswith(flat, c))
    read = files.where(F.col("text").isNotNull() & known).select("pkg_id", "path", nodes(F.col("text"), F.endswith(flat, F.lit(".toml"))).alias("x"))
    hits = read.select("pkg_id", "path", hijacks(F.col("x.nodes")).alias("detail"), "x.broken")
    first = hits.groupBy("pkg_id").agg(F.min(F.when(F.col("detail").isNotNull(), F.struct("path", "detail"))).alias("hit"), F.min(F.when(F.col("broken").isNotNull(), F.struct("path", "broken"))).alias("stop"))
    out = packages.select("pkg_id").join(first, "pkg_id", "left")
    detected = F.col("hit").isNotNull() & (F.col("stop").isNull() | (F.col("hit.path") < F.col("stop.path")))
    evidence = F.when(detected, F.concat("hit.path", F.lit(": "), "hit.detail"))
    note = F.when(~detected, F.concat(F.lit("INCOMPLETE, "), "stop.path", F.lit(": "), "stop.broken"))
    return out.select("pkg_id", F.lit(CHECK).alias("check_id"), detected.alias("detected"), evidence.alias("evidence"), note.alias("note"))
