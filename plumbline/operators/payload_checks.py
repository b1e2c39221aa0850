"""Checks of what text conceals: encoded payloads, hidden output, folded spellings. The rows come from sources.decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.checks import LINE_END, SCRIPTS, listed
from plumbline.sources import decoding
from plumbline.sources.arrow import nested_udf, sieve
from plumbline.sources.packages import SURFACE
from plumbline.sources.trees import strings

# --- fixed values: how payloads read once they are in the clear, and what decodes and runs them ---
PAYLOADS = [
    (
        "interpreter-invocation",
        r"(?i)/bin/(?:ba|z|k)?sh\b|\b(?:ba|z)?sh\s+-c\b|\bpython[0-9.]*\s+-c\b|\bnode\s+-e\b|\bperl\s+-e\b|\bpowershell(?:\.exe)?\s+-",
    ),
    (
        "destructive-filesystem",
        r"(?i)\brm\s+-[a-zA-Z]*[rf][a-zA-Z]*\b|\bshutil\.rmtree\b|\bos\.removedirs\b|\bmkfs(?:\.[a-z0-9]+)?\b|\bdd\s+if=|\bdel\s+/[fs]\b|\bformat\s+[a-z]:",
    ),
    (
        "credential-harvest",
        r"(?im)(?:~|\$HOME|/home/[^\s'\"]+|/root)/\.(?:ssh|aws|kube|docker|npmrc|netrc|gnupg)\b|\.aws/credentials\b|\bid_(?:rsa|ed25519)\b|\.netrc\b"
        r"|(?:^|[/\s'\"])\.env\b|\bAWS_SECRET_ACCESS_KEY\b|\bGITHUB_TOKEN\b|\b(?:OPENAI|ANTHROPIC)_API_KEY\b",
    ),
    ("identity-file-write", r"\b(?:SOUL|MEMORY|AGENTS)\.md\b"),
    ("remote-fetch-execute", r"(?i)\b(?:curl|wget)\b[^\n|]{0,200}\|\s*(?:sudo\s+)?(?:ba|z)?sh\b|\bInvoke-WebRequest\b[^\n]{0,200}\biex\b|\biex\s*\(\s*New-Object\b"),
    ("outbound-exfiltration", r"(?i)\b(?:curl|wget|requests\.(?:post|put|patch)|urllib\.request\.urlopen|http\.client\.HTTPS?Connection|fetch)\b[^\n]{0,200}https?://"),
    ("reverse-shell", r"(?i)\bsocket\.socket\b|/dev/tcp/|\bnc\s+-[a-z]*e[a-z]*\s|\b(?:ba)?sh\s+-i\s*>&"),
    (
        "dynamic-execution",
        r"(?i)\b(?:eval|exec|execfile|os\.system|os\.popen|subprocess\.(?:run|Popen|call|check_call|check_output)|child_process\.(?:exec|execSync|spawn|spawnSync))\s*\(",
    ),
]
DECODES = (
    r"(?i)\b(?:atob|b64decode|standard_b64decode|urlsafe_b64decode|b32decode|b16decode|a85decode|unhexlify|fromhex|codecs\.decode|zlib\.decompress|gzip\.decompress"
    r"|lzma\.decompress|Buffer\.from)\s*\(|\bbase64\s+(?:-d|-D|--decode)\b|\bopenssl\s+(?:base64|enc)\b[^\n]{0,40}\s-d\b|\bxxd\s+-r\b|\bbase64\s+--decode\b"
)
#: For RE2: what DECODES, RUN_OF_DECODE and SHELL_OF_DECODE cannot match without.
DECODER = r"(?i:atob|b64decode|b32decode|b16decode|a85decode|unhexlify|decodebytes|fromhex|codecs\.decode|decompress|Buffer\.from|base64|openssl|xxd)"
RUNS = (
    r"(?i)\b(?:eval|exec|execfile|os\.system|os\.popen|subprocess\.(?:run|Popen|call|check_call|check_output)|child_process\.(?:exec|execSync|spawn|spawnSync)"
    r"|vm\.runInNewContext|pickle\.loads|marshal\.loads)\s*\(|\bnew\s+Function\s*\(|\|\s*(?:sudo\s+)?(?:ba|z)?sh\b|\|\s*python[0-9.]*\b|\b(?:ba|z)?sh\s+-c\b|\bIEX\s*\("
)
ASSIGNS = r"^[ \t]*(?:const\s+|let\s+|var\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=\s*(.+)$"
OUTPUT_FENCE = r"(?dms)^```[ \t]*(output|template|response|skill-output|agent-output)[^\n]*\n(.*?)^```"
TEMPLATES = r"(?i)\.(?:tmpl|template|j2|mustache)$"
BASE64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
RUN_OF_DECODE = (
    r"(?i)\b(?:eval|exec|os\.system|subprocess\.(?:run|call|Popen|check_output)|Function)\s{0,4}\([^)\n]{0,120}?"
    r"(?:b64decode|b32decode|a85decode|atob|unhexlify|decodebytes|fromhex)\s{0,4}\("
)
LITERAL = r"['\"]([A-Za-z0-9+/]{16,}={0,2})['\"]"
SHELL_OF_DECODE = r"(?i)base64\s{1,8}(?:--decode|-d)\b[^\n]{0,200}\|\s{0,8}(?:ba|z|k)?sh\b"
DANGEROUS_TEXT = r"(?i)(?:\brm\s{1,4}-[rf]{1,2}\b|\bcurl\b|\bwget\b|/bin/(?:ba)?sh\b|\bnc\s{1,4}-e\b|\bchmod\s{1,4}\+x\b|\bos\.system\b|\bsubprocess\b|\bimport\s{1,4}socket\b)"
RULES = [
    ("agent-directed-override", r"(?iU)(ignore\s+(all\s+)?(previous|prior|above)\s+instructions|do\s+not\s+(tell|inform|mention|report)\s+(the\s+)?(user|operator)|without\s+(telling|informing|notifying)\s+the\s+user)"),
    ("credential-material-path", r"(?iU)(\.aws/credentials|\.ssh/id_[a-z0-9]+|/\.env\b|\.npmrc|\.docker/config\.json|\.kube/config)"),
    ("egress-of-local-data", r"(?iU)\b(post|upload|send|exfiltrat\w*|beacon)\b[^\n]{0,80}https?://"),
    ("remote-fetch-piped-to-shell", r"(?iU)\b(curl|wget)\b[^\n|]{0,200}\|\s*(ba|z|k)?sh\b"),
    ("shell-or-eval-execution", r"(?iU)\b(os\.system|os\.popen|subprocess\.(run|call|Popen|check_output)|(ba|z|k)?sh\s+-c|eval\s*\(|exec\s*\()"),
]
EVIDENCE = 6
# --- end of fixed values ---

ENCODED, OUTPUT, OBFUSCATED, FOLDED = "AST10-S06", "AST01-hidden-output-injection", "AST01-obfuscated-payload-exec", "AST08-S02"


def _finding(packages: DataFrame, found: DataFrame, check: str, note: Column | None = None) -> DataFrame:
    """One row for each package: found has pkg_id and evidence (null: not detected), and what note reads."""
    out = packages.select("pkg_id").join(found, "pkg_id", "left")
    return out.select("pkg_id", F.lit(check).alias("check_id"), F.col("evidence").isNotNull().alias("detected"), "evidence", (F.lit(None).cast("string") if note is None else note).alias("note"))


def _first(items: Column) -> Column:
    return F.get(F.array_compact(items), F.lit(0))


def surfaces(packages: DataFrame, files: DataFrame) -> DataFrame:
    """pkg_id, path, text of all text of packages(pkg_id, manifest): files, and the strings of manifests by their trails."""
    held = packages.select("pkg_id", F.explode(strings(F.to_json("manifest"))).alias("x"))
    said = held.select("pkg_id", F.concat(F.lit("<manifest."), "x.trail", F.lit(">")).alias("path"), "x.text")
    return files.where(F.col("text").isNotNull()).select("pkg_id", "path", "text").unionByName(said)


def run_after_decoding(text: Column) -> Column:
    """Places (line, told) where a decoded literal is run, in the line or through a variable that holds it, in this order."""
    lines = F.transform(F.split(text, LINE_END), lambda s, i: F.struct((i + 1).alias("at"), s.alias("s")))
    here = F.filter(lines, lambda x: x["s"].rlike(DECODES) & x["s"].rlike(RUNS))
    holds = F.filter(lines, lambda x: x["s"].rlike(DECODES) & ~x["s"].rlike(RUNS) & F.regexp_extract(x["s"], ASSIGNS, 2).rlike(DECODES))
    names = F.transform(holds, lambda x: F.struct(x["at"].alias("at"), F.regexp_extract(x["s"], ASSIGNS, 1).alias("name")))
    names = F.filter(names, lambda x: ~F.exists(names, lambda y: (y["name"] == x["name"]) & (y["at"] < x["at"])))  # the first assignment of a name
    sinks = F.transform(F.filter(lines, lambda x: x["s"].rlike(RUNS)), lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s"), F.regexp_extract(x["s"], f"(?:{RUNS}).*", 0).alias("rest")))
    told = lambda x, how: F.struct(x["at"].alias("line"), F.concat(how, F.left(F.trim(x["s"]), F.lit(120))).alias("told"))
    reached = F.flatten(
        F.transform(
            sinks,
            lambda x: F.transform(
                F.filter(names, lambda n: (n["at"] != x["at"]) & F.rlike(x["rest"], F.concat(F.lit(r"(?U)\b"), n["name"], F.lit(r"\b")))),
                lambda n: told(x, F.concat(F.lit("decoded value "), n["name"], F.lit(" of line "), n["at"].cast("string"), F.lit(" is run: "))),
            ),
        )
    )
    return F.concat(F.transform(here, lambda x: told(x, F.lit("decoded and run: "))), reached)


def encoded_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """AST10-S06: does encoded text of files or manifests decode to a payload, or reach something that runs it?

    Evidence is of the first EVIDENCE places: decoded payloads by path, then runs of decoded
    values. What a decoding bound left out is in the note.
    """
    rows = surfaces(packages, files)
    opened = rows.select("pkg_id", "path", "text", decoding.blobs(F.col("text"), F.col("path")).alias("x"), sieve({"decoder": DECODER})(F.col("text")).alias("shown"))
    opened = opened.where("x IS NOT NULL OR shown IS NOT NULL")
    label = lambda b: F.array_join(F.array_compact(F.array(*(F.when(b["text"].rlike(p), name) for name, p in PAYLOADS))), "+")
    blobs = F.transform("x.blobs", lambda b: F.struct(b["layers"].alias("layers"), b["excerpt"].alias("excerpt"), label(b).alias("label")))
    payloads = F.transform(F.filter(blobs, lambda b: b["label"] != ""), lambda b: F.concat(F.array_join(b["layers"], "+"), F.lit(" blob '"), b["excerpt"], F.lit("' decodes to "), b["label"]))
    runs = F.when(F.col("shown").isNotNull() & F.col("text").rlike(DECODES) & F.col("text").rlike(RUNS), F.transform(run_after_decoding(F.col("text")), lambda r: F.concat(F.lit("line "), r["line"].cast("string"), F.lit(": "), r["told"])))
    few = lambda kind, items: F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, EVIDENCE), lambda d, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), d.alias("detail")))
    hits = opened.select("pkg_id", "path", F.explode(F.concat(few(0, payloads), few(1, runs), few(2, F.col("x.spent")))).alias("h")).select("pkg_id", "path", "h.*")
    ranked = hits.withColumn("n", F.row_number().over(W.partitionBy("pkg_id", "kind").orderBy("path", "place", "detail"))).where(F.col("n") <= EVIDENCE)
    told = F.concat("path", F.lit(": "), "detail")
    held = ranked.groupBy("pkg_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 2, F.struct("kind", "n", told.alias("told"))))).alias("hits"),  # a dozen at most
        F.min(F.when(F.col("kind") == 2, told)).alias("spent"),
    )
    evidence = F.when(F.size("hits") > 0, F.array_join(F.slice(F.transform("hits", lambda h: h["told"]), 1, EVIDENCE), "; "))
    return _finding(packages, held.select("pkg_id", evidence.alias("evidence"), "spent"), ENCODED, F.concat(F.lit("INCOMPLETE, "), "spent"))


def hidden_output_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """AST01: do the output blocks and templates that a package ships hold invisible characters or text in base64?"""
    path, text = F.col("path"), F.col("text")
    templates = path.rlike(TEMPLATES) | F.lower(path).rlike("^(?:templates|output)/")
    shipped = files.where(text.isNotNull() & path.rlike(SURFACE) & (text.contains("```") | templates))
    kinds = F.regexp_extract_all(text, F.lit(OUTPUT_FENCE), 1)
    fences = F.transform(F.regexp_extract_all(text, F.lit(OUTPUT_FENCE), 2), lambda r, i: F.struct(F.lit(0).alias("kind"), i.alias("place"), F.concat(F.lit(" ("), F.get(kinds, i), F.lit(" block)")).alias("label"), r.alias("region")))
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("place"), F.lit("").alias("label"), text.alias("region")))
    none = F.array().cast("array<struct<kind:int,place:int,label:string,region:string>>")
    regions = F.concat(
        F.when(F.lower(path).rlike(r"\.(?:md|markdown)$"), fences).otherwise(none), F.when(path.rlike(TEMPLATES), whole(1)).otherwise(none),
        F.when(F.lower(path).rlike("^(?:templates|output)/"), whole(2)).otherwise(none),
    )
    rows = shipped.select("pkg_id", "path", F.explode(regions).alias("r")).select("pkg_id", "path", "r.*")
    said = nested_udf(decoding.first_base64_text, "string", once=True)(F.regexp_extract_all("region", F.lit(BASE64_RUN), 0))
    seen = F.when(F.col("region").rlike(t.INVISIBLE), F.concat(F.lit(": invisible characters "), listed(t.invisible_points(F.col("region")))))
    detail = F.coalesce(seen, F.concat(F.lit(": base64 that reads: "), t.snippet(said)))
    found = rows.select("pkg_id", "kind", "path", "place", F.concat("path", "label", detail).alias("detail")).where("detail IS NOT NULL")
    first = found.groupBy("pkg_id").agg(F.min(F.struct("kind", "path", "place", "detail")).alias("x"))
    return _finding(packages, first.select("pkg_id", F.col("x.detail").alias("evidence")), OUTPUT)


def obfuscated_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """AST01: does a shipped script decode a literal into something that runs it, or pipe decoded base64 into a shell?"""
    text = F.col("text")
    rows = files.where(text.isNotNull() & F.col("path").rlike(SURFACE) & F.col("path").rlike(SCRIPTS))
    rows = rows.select("pkg_id", "path", "text", sieve({"decoder": DECODER})(text).alias("shown")).where("shown IS NOT NULL")
    window = F.left(F.regexp_extract(text, rf"(?:{RUN_OF_DECODE})(?s:.{{0,400}})", 0), F.lit(400))
    rows = rows.select("pkg_id", "path", F.regexp_extract(text, RUN_OF_DECODE, 0).alias("run"), F.regexp_extract(window, LITERAL, 1).alias("literal"), F.regexp_extract(text, SHELL_OF_DECODE, 0).alias("shell"))
    said = nested_udf(decoding.base64_text, "string")(F.when(F.col("literal") != "", F.col("literal")))
    rows = rows.where("run <> '' OR shell <> ''").withColumn("said", said)
    verdict = F.when(F.col("said").rlike(DANGEROUS_TEXT), "dangerous").otherwise("opaque")
    decoded = F.concat(F.lit("a literal is decoded and run, and reads ("), verdict, F.lit("): "), t.snippet(F.col("said")))
    detail = F.when(F.col("run") != "", F.coalesce(decoded, F.concat(F.lit("a literal is decoded and run: "), t.snippet(F.col("run"))))).otherwise(F.concat(F.lit("decoded base64 is piped into a shell: "), t.snippet(F.col("shell"))))
    first = rows.groupBy("pkg_id").agg(F.min(F.struct("path", F.concat("path", F.lit(": "), detail).alias("detail"))).alias("x"))
    return _finding(packages, first.select("pkg_id", F.col("x.detail").alias("evidence")), OBFUSCATED)


def raw_place(edges: Column, at: Column) -> Column:
    """The place (from 0) in the raw text of the character at a place of the folded view."""
    edge = F.element_at(F.filter(edges, lambda e: e["at"] <= at), -1)
    return edge["raw"] + F.when(edge["kept"], at - edge["at"]).otherwise(0)


def folded_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """AST08-S02: is something in the folded view, in a zero-width run or below encodings that the raw text does not show?

    In the order of the paths: a rule that matches the view more often than the raw text, text
    spelled in zero-width bits, a rule that matches a decoded layer. The description of the
    manifest counts as a file. Where nothing is found but a decoding bound was met, the
    package is not clean: it is reported as INCOMPLETE.
    """
    described = packages.select("pkg_id", F.lit("<manifest.description>").alias("path"), F.col("description").alias("text")).where("text <> ''")
    rows = files.where(F.col("text").isNotNull()).select("pkg_id", "path", "text").unionByName(described)
    rows = rows.select("pkg_id", "path", "text", decoding.unfolded(F.col("text")).alias("x")).where("x IS NOT NULL")
    view, text = F.col("x.view"), F.col("text")

    def shown(name: str, p: str) -> Column:
        more = view.isNotNull() & (view != text) & (F.regexp_count(view, F.lit(p)) > F.regexp_count(text, F.lit(p)))
        places = F.transform(F.array(F.regexp_instr(view, F.lit(p)) - 1), lambda at: raw_place(F.col("x.edges"), at))  # looked for once, not at every edge
        return F.when(more, F.concat(F.lit(f"{name} is split or folded from character "), F.get(places, F.lit(0)).cast("string"), F.lit(" on: "), F.left(F.regexp_extract(view, p, 0), F.lit(120))))

    spelled = F.concat(F.lit("zero-width characters from character "), F.col("x.zero_width.at").cast("string"), F.lit(" on read: "), F.left(F.col("x.zero_width.text"), F.lit(80)))

    def layered(x: Column) -> Column:
        rule = F.coalesce(*(F.when(x["text"].rlike(p), F.concat(F.lit(f"{n}: "), F.left(F.regexp_extract(x["text"], p, 0), F.lit(120)))) for n, p in RULES))
        return F.concat(x["form"], F.lit(" at depth "), x["depth"].cast("string"), F.lit(" decodes to "), rule)

    detail = F.coalesce(*(shown(*r) for r in RULES), spelled, _first(F.transform("x.layers", layered)))
    by_file = rows.select("pkg_id", "path", detail.alias("detail"), F.when(F.size("x.spent") > 0, F.array_join("x.spent", ", ")).alias("spent"))
    first = by_file.groupBy("pkg_id").agg(F.min(F.when(F.col("detail").isNotNull(), F.struct("path", "detail"))).alias("hit"), F.min(F.when(F.col("spent").isNotNull(), F.struct("path", "spent"))).alias("bound"))
    bound = F.concat(F.lit("INCOMPLETE, a decoding bound was met: "), "bound.path", F.lit(": "), "bound.spent")
    evidence = F.coalesce(F.concat("hit.path", F.lit(": "), "hit.detail"), bound)
    return _finding(packages, first.select("pkg_id", evidence.alias("evidence")), FOLDED)


def payload_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """All of these checks: pkg_id, check_id, detected, evidence, note. packages needs manifest and description."""
    found = [f(packages, files) for f in (encoded_findings, hidden_output_findings, obfuscated_findings, folded_findings)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
