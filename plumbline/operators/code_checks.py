"""Checks of what Python files call: relational over the facts of sources.pycode, one parse for each file.

Fetched content is followed through the statements of each function by an ordered fold whose
state is the set of names that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hosts
from plumbline.functions import text as t
from plumbline.operators.checks import HOST_COMMANDS, OUTSIDE, PERSISTENCE, SCRIPTS, SENDS, SHELL_SENDS, URL_HOST, first_label, listed
from plumbline.sources.packages import SURFACE
from plumbline.sources.pycode import facts

# --- fixed values: the names that each check looks for ---
HTTP_ROOTS = ["requests", "httpx", "urllib", "urllib3", "aiohttp", "http", "session", "client"]
HTTP_VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "request", "send", "urlopen"]
FETCHERS = ["urlopen", "fetch", "web_fetch", "http_get", "urlretrieve", "get_url", "download_url"]
INSTRUCTIONS = [
    "prompt", "prompts", "system_prompt", "systemprompt", "instruction", "instructions", "messages", "message_list", "directives", "preamble",
]
APPENDS = ["append", "extend", "insert", "add", "update", "push"]
INSTRUCTION_ARGUMENTS = ["prompt", "system", "system_prompt", "instructions", "messages", "preamble"]
BOUNDARIES = [
    "quarantine", "tag", "tag_untrusted", "mark_untrusted", "as_data", "as_reference_data", "wrap_untrusted", "delimit", "fence", "sanitize", "sanitise",
    "escape", "provenance", "untrusted", "to_reference_data",
]
BOUNDARY_TEXT = (
    r"(?iU)(untrusted|reference[ _-]?data\b|do not follow (?:any )?instructions|must not override|never as instructions?|treat(?:ed)? as data\b"
    r"|provenance|<\s*/?\s*(?:external|retrieved|fetched)[-_ ]?\w*\s*>)"
)
EXECUTES = ["eval", "exec", "compile", "__import__"]
LOADS = ["os.system", "os.popen", "pickle.loads", "pickle.load", "marshal.loads", "yaml.unsafe_load", "dill.loads", "jsonpickle.decode"]
SPAWN_ROOTS = ["subprocess", "os"]
SPAWNS = ["run", "call", "check_call", "check_output", "Popen", "system", "popen"]
SHELL_ROOTS = ["os", "subprocess", "commands", "pty", "asyncio"]
SHELL_CALLS = [
    "system", "popen", "run", "call", "check_call", "check_output", "Popen", "getoutput", "getstatusoutput", "spawn", "spawnl", "spawnv", "execl", "execv",
    "execvp", "create_subprocess_shell", "create_subprocess_exec",
]
WRITE_CALLS = ["write_text", "write_bytes", "copy", "copyfile", "copy2", "move", "symlink", "link"]
ENVIRONMENT = [
    "os.getenv", "os.environ.get", "socket.gethostname", "socket.getfqdn", "platform.node", "platform.uname", "os.uname", "getpass.getuser", "os.getlogin",
    "os.getuid", "pwd.getpwuid", "datetime.now", "datetime.utcnow", "datetime.today", "date.today", "time.time", "os.path.exists", "os.path.isfile",
    "os.path.isdir", "path.exists", "path.is_file", "path.is_dir", "sys.gettrace",
]
PORTABILITY = ["platform.system", "platform.machine", "sys.platform", "os.name"]
DANGEROUS = [
    "eval", "exec", "compile", "__import__", "os.system", "os.popen", "os.execv", "os.execve", "os.remove", "os.unlink", "os.rmdir", "shutil.rmtree",
    "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_call", "subprocess.check_output", "socket.create_connection",
    "urllib.request.urlopen", "request.urlopen", "requests.get", "requests.post", "requests.put", "httpx.post", "smtplib.SMTP", "ftplib.FTP",
]
QUOTED_URL = r"(?i)['\"]\s{0,4}https?://([A-Za-z0-9._~-]+(?::\d{1,5})?)[^'\"\n]{0,300}['\"]"
# --- end of fixed values ---

CODE_CHECKS = ["AST05-fetched-content-instruction-sink", "AST05-remote-response-executed", "AST05-absent-instruction-boundary", "AST06-host-persistence-write", "AST08-S04"]
EGRESS_CHECK = "AST01-undeclared-egress"
FETCHED = "(<fetched content>"


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _root(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def fetches(name: Column) -> Column:
    """Does a callee fetch from elsewhere?"""
    dotted = name.endswith(".urlopen") | name.endswith("request.urlopen") | (_root(name).isin(HTTP_ROOTS) & _last(name).isin(HTTP_VERBS))
    return F.when(name.contains("."), dotted).otherwise(name.isin(FETCHERS))


def _fetched(value: Column, held: Column) -> Column:
    """Does an expression fetch, or use one of the names held?"""
    return F.coalesce(F.exists(value["calls"], fetches) | F.arrays_overlap(value["names"], held), F.lit(False))


def _bounded(value: Column) -> Column:
    """Does an expression pass through a boundary between instructions and data?"""
    return F.exists(value["calls"], lambda c: _last(c).isin(BOUNDARIES)) | F.exists(value["texts"], lambda s: s.rlike(BOUNDARY_TEXT))


def _loose(value: Column, held: Column) -> Column:
    return _fetched(value, held) & ~_bounded(value)


def _instructed(step: Column, held: Column) -> Column:
    """How a statement puts fetched content into instructions, or null."""
    to = F.get(F.filter(step["targets"], lambda n: n.isin(INSTRUCTIONS)), F.lit(0))
    assigned = F.when(to.isNotNull() & step["kind"].isin("assign", "add") & _loose(step["value"], held), F.concat(to, F.when(step["kind"] == "add", " += ").otherwise(" = "), F.lit("<fetched content>")))

    def called(call: Column) -> Column:
        appended = call["receiver"].isin(INSTRUCTIONS) & _last(call["name"]).isin(APPENDS) & F.exists(call["args"], lambda a: a["name"].isNull() & _loose(a["value"], held))
        given = F.get(F.filter(call["args"], lambda a: a["name"].isin(INSTRUCTION_ARGUMENTS) & _loose(a["value"], held)), F.lit(0))["name"]
        return F.when(appended, F.concat(call["receiver"], F.lit("."), _last(call["name"]), F.lit(f"{FETCHED})"))).when(
            given.isNotNull(), F.concat(F.when(call["name"] == "", "call").otherwise(call["name"]), F.lit("("), given, F.lit("=<fetched content>)"))
        )

    return F.coalesce(assigned, F.get(F.array_compact(F.transform(step["calls"], called)), F.lit(0)))


def _executed(step: Column, held: Column) -> Column:
    """How a statement runs fetched content, or null."""

    def called(call: Column) -> Column:
        name = call["name"]
        shell = _root(name).isin(SPAWN_ROOTS) & _last(name).isin(SPAWNS) & (call["shell"] | _last(name).isin("system", "popen"))
        sink = (
            F.when(name.isin(*EXECUTES, *LOADS), F.concat(name, F.lit(f"{FETCHED})")))
            .when((name == "yaml.load") & ~F.exists(call["args"], lambda a: F.coalesce(a["name"], F.lit("")) == "Loader"), f"yaml.load{FETCHED}) with no Loader")
            .when(shell, F.concat(name, F.lit(f"{FETCHED}, shell)")))
        )
        return F.when(sink.isNotNull() & F.exists(call["args"], lambda a: a["name"].isNull() & _fetched(a["value"], held)), sink)

    return F.get(F.array_compact(F.transform(step["calls"], called)), F.lit(0))


def follow(steps: Column) -> Column:
    """Fold the ordered steps of one scope: struct(held, instructed, executed).

    held are the names that hold fetched content: an assignment of it adds its targets, any
    other assignment takes them away, an addition or a with-statement only adds. The first
    sink of each kind is kept; a statement's sinks see the names held before it.
    """
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(None).cast("string").alias("instructed"), F.lit(None).cast("string").alias("executed"))

    def move(state: Column, step: Column) -> Column:
        held, kind, targets = state["held"], step["kind"], step["targets"]
        adds = F.when(kind == "with", _fetched(step["value"], held)).otherwise(_loose(step["value"], held))
        now = F.when(step["value"].isNull(), held).when(adds, F.array_union(held, targets)).when(kind.isin("assign", "declare"), F.array_except(held, targets)).otherwise(held)
        return F.struct(
            now.alias("held"),
            F.coalesce(state["instructed"], _instructed(step, held)).alias("instructed"),
            F.coalesce(state["executed"], _executed(step, held)).alias("executed"),
        )

    return F.aggregate(steps, start, move)


def _persisted(call: Column) -> Column:
    """Where a call that runs commands or writes files persists on the host, or null."""
    name = call["name"]
    runs = (_root(name).isin(SHELL_ROOTS) & _last(name).isin(SHELL_CALLS)) | name.isin("system", "popen")
    writes = _last(name).isin(WRITE_CALLS) | (name.isin("open", "io.open", "codecs.open") & F.exists(call["modes"], lambda m: m.rlike("^[wax]")))
    label = lambda s: F.when(s.rlike(HOST_COMMANDS) | s.rlike(OUTSIDE), F.concat(name, F.lit("() targets a "), first_label(s, PERSISTENCE), F.lit(" outside the package: "), t.snippet(s)))
    return F.when(runs | writes, F.get(F.array_compact(F.transform(call["texts"], label)), F.lit(0)))


def _guarded(branch: Column) -> Column:
    """How a branch on the environment guards a dangerous call, or null."""
    probe = lambda n: F.when(n.isin(PORTABILITY), None).when(n.isin(ENVIRONMENT), n).when(F.substring_index(n, ".", -2).isin(ENVIRONMENT), F.substring_index(n, ".", -2))
    looked_up = F.when(F.exists(branch["subscripts"], lambda n: n.isin("os.environ", "environ")), "os.environ[...]")
    guard = F.coalesce(looked_up, F.get(F.array_compact(F.transform(branch["test"], probe)), F.lit(0)))
    does = F.get(F.filter(branch["body"], lambda n: n.isin(DANGEROUS)), F.lit(0))
    return F.when(guard.isNotNull() & does.isNotNull(), F.concat(F.lit("line "), branch["line"].cast("string"), F.lit(": "), branch["kind"], F.lit(" on "), guard, F.lit(" guards "), does, F.lit("()")))


def code_hits(files: DataFrame) -> DataFrame:
    """What the Python files of files(pkg_id, path, text) do: pkg_id, path, key, detail.

    key is a check that the file hits, `fetches` or `broken` (it cannot be parsed; detail is
    the line). Each file is parsed once, and of each key there is one row for a file.
    """
    gate = F.col("text").rlike("|".join([*HTTP_ROOTS, *FETCHERS]))  # nothing is followed in files that cannot fetch
    read = files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).select("pkg_id", "path", facts(F.col("text"), gate).alias("facts"))
    first = lambda items, f: F.get(F.array_compact(F.transform(items, f)), F.lit(0))
    read = read.withColumn("states", F.transform("facts.scopes", follow))
    details = {
        "AST05-fetched-content-instruction-sink": F.concat(first(F.col("states"), lambda s: s["instructed"]), F.lit(" with no boundary")),
        "AST05-remote-response-executed": first(F.col("states"), lambda s: s["executed"]),
        "AST06-host-persistence-write": first(F.col("facts.calls"), _persisted),
        "AST08-S04": first(F.col("facts.branches"), _guarded),
        "fetches": F.when(F.exists("facts.calls", lambda c: fetches(c["name"])), ""),
        "broken": F.col("facts.broken").cast("string"),
    }
    rows = F.array(*(F.struct(F.lit(c).alias("key"), d.alias("detail")) for c, d in details.items()))
    return read.select("pkg_id", "path", F.explode(rows).alias("x")).select("pkg_id", "path", "x.*").where("detail IS NOT NULL")


def code_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of CODE_CHECKS, one row for each package and check: pkg_id, check_id, detected, evidence, note.

    Evidence is of the first file by path. A package that fetches and has no Markdown text that
    tells instructions from data lacks the boundary. Files that cannot be parsed are counted in
    the note: what they hold was not decided.
    """
    firsts = code_hits(files).groupBy("pkg_id", "key").agg(F.min(F.struct("path", "detail")).alias("first"), F.count(F.lit(1)).alias("n"))
    by_key = firsts.groupBy("pkg_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("first", "n")))).alias("hits"))  # a handful of keys
    said = files.where(F.col("path").endswith(".md") & F.col("text").rlike(BOUNDARY_TEXT)).select("pkg_id").distinct().withColumn("said", F.lit(True))
    out = packages.select("pkg_id").join(by_key, "pkg_id", "left").join(said, "pkg_id", "left")
    hit = lambda key: F.try_element_at("hits", F.lit(key))
    absent = F.when(hit("fetches").isNotNull() & F.col("said").isNull(), F.concat(hit("fetches")["first"]["path"], F.lit(": fetches, and no prose tells instructions from data")))
    evidence = {c: F.concat(hit(c)["first"]["path"], F.lit(": "), hit(c)["first"]["detail"]) for c in CODE_CHECKS} | {"AST05-absent-instruction-boundary": absent}
    more = F.when(hit("broken")["n"] > 1, F.concat(F.lit(" and "), hit("broken")["n"] - 1, F.lit(" more"))).otherwise("")
    note = F.concat(F.lit("INCOMPLETE, not parsed: "), hit("broken")["first"]["path"], F.lit(":"), hit("broken")["first"]["detail"], more)
    rows = F.array(*(F.struct(F.lit(c).alias("check_id"), evidence[c].isNotNull().alias("detected"), evidence[c].alias("evidence")) for c in CODE_CHECKS))
    return out.select("pkg_id", F.explode(rows).alias("x"), note.alias("note")).select("pkg_id", "x.*", "note")


def egress_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Do shipped scripts send to literal hosts that the declared network policy does not name?

    Without a declared policy nothing is contradicted, unqualified names are not decided, and
    loopback is no egress; note says which of these, in this order, cleared a package.
    """
    path, text = F.col("path"), F.col("text")
    shell = F.lower(path).rlike(r"\.(?:sh|bash|zsh)$")
    site = F.when(text.rlike(SENDS), F.regexp_extract(text, SENDS, 0)).when(shell & text.rlike(SHELL_SENDS), F.regexp_extract(text, SHELL_SENDS, 0))
    urls = F.concat(F.regexp_extract_all(text, F.lit(QUOTED_URL), 1), F.when(shell, F.regexp_extract_all(text, F.lit(URL_HOST), 1)).otherwise(F.array().cast("array<string>")))
    sites = files.where(path.rlike(SCRIPTS) & path.rlike(SURFACE)).select("pkg_id", "path", t.snippet(site).alias("site"), F.array_distinct(F.filter(F.transform(urls, hosts.normalize), lambda h: h != "")).alias("hosts"))
    bound = packages.select("pkg_id", "has_network", "allow", (F.col("net_any") | (F.col("net_map") & hosts.unbounded(F.col("allow"), F.col("policy")))).alias("open"))
    sites = sites.where("site IS NOT NULL").join(bound, "pkg_id")
    of = lambda kind: F.filter("hosts", lambda h: hosts.host_class(h) == kind)
    named = F.transform(F.coalesce("allow", F.array().cast("array<string>")), lambda h: F.lower(F.trim(h)))
    away = F.when(~F.coalesce("open", F.lit(False)), F.array_except(of("routable"), named)).otherwise(F.array().cast("array<string>"))
    sites = sites.select("pkg_id", "path", "site", "hosts", "has_network", away.alias("away"), of("unqualified").alias("bare"), of("loopback").alias("local"))
    told = lambda these: F.struct("path", F.concat("path", F.lit(": "), "site", F.lit(" to "), listed(F.col(these))).alias("text"))
    declared, kept = F.col("has_network"), F.size("away") == 0
    by_package = sites.groupBy("pkg_id").agg(
        F.min(F.when(declared & ~kept, told("away"))).alias("found"),
        F.min(F.when(~declared, told("hosts"))).alias("undeclared"),
        F.min(F.when(declared & kept & (F.size("bare") > 0), told("bare"))).alias("bare"),
        F.min(F.when(declared & kept & (F.size("bare") == 0) & (F.size("local") > 0), told("local"))).alias("local"),
    )
    out = packages.select("pkg_id", "has_network").join(by_package, "pkg_id", "left")
    detected = F.col("found").isNotNull()
    note = F.when(~detected, F.coalesce(
        F.concat(F.lit("no network policy is declared, so none is contradicted: "), "undeclared.text"), F.concat(F.lit("undecided, an unqualified host: "), "bare.text"),
        F.concat(F.lit("no egress, loopback only: "), "local.text"), F.when(F.col("has_network"), "every literal destination is declared").otherwise("no call that sends, and no network policy"),
    ))
    evidence = F.concat("found.text", F.lit(", which the network policy does not name"))
    return out.select("pkg_id", F.lit(EGRESS_CHECK).alias("check_id"), detected.alias("detected"), evidence.alias("evidence"), note.alias("note"))
