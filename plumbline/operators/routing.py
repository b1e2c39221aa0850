"""Ordered phrase routing: the first rule with a phrase in the text decides, later ones contribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the rules in order of priority, and the phrases of each ---
RULES = [
    ("AST01", ["hidden payload", "credential theft", "credential stealer", "malicious skill", "malicious at publish", "reverse shell", "c2 server", "trojan"]),
    (
        "AST02",
        [
            "typosquat", "registry", "publisher account", "maintainer account", "missing signature", "no code signature", "unsigned", "weak vetting",
            "dependency confusion", "supply chain", "compromised publisher",
        ],
    ),
    (
        "AST04",
        [
            "manifest metadata", "deceptive description", "understated permission", "spoofed risk_tier", "risk tier spoofing", "unsafe deserialization",
            "yaml injection", "json injection", "toml injection", "frontmatter", "brand impersonation",
        ],
    ),
    (
        "AST08",
        [
            "scanner", "scanning", "reviewer control", "evaded scan", "obfuscated instruction", "natural-language bypass", "scanner impersonation",
            "bypassed the scanner",
        ],
    ),
    (
        "AST03",
        [
            "overprivileged", "over-privileged", "over privileged", "excessive permission", "excessive access", "broader permission", "broader access",
            "write access", "admin credential", "least privilege", "blast radius", "scoped credential",
        ],
    ),
    (
        "AST05",
        [
            "external url", "external document", "external instructions", "rug-pull", "rug pull", "fetched content", "remote file", "external reference",
            "bait-and-switch", "referenced documentation",
        ],
    ),
    ("AST06", ["sandbox", "isolation", "host access", "full file system access", "shell access", "host escape", "network pivot", "co-located service"]),
    (
        "AST07",
        [
            "rollback attack", "hot-reload", "hot reload", "auto-update", "auto-updating", "stale version", "outdated skill", "never patched",
            "drifted from the pinned version", "update drift",
        ],
    ),
    (
        "AST09",
        [
            "no inventory", "approval workflow", "shadow ai", "audit trail", "orphaned skill", "deprovision", "no soc visibility", "regulatory exposure",
            "compliance reporting",
        ],
    ),
    (
        "AST10",
        [
            "cross-platform", "ported to another platform", "porting", "platform translation", "manifest was stripped", "manifest stripping",
            "cross registry", "multi-platform",
        ],
    ),
]
# --- end of fixed values ---


def route(findings: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Add ast_id (null: escalate), contributing (later rules that match too) and escalate to findings(text)."""
    text = F.lower(F.coalesce("text", F.lit("")))

    def hit(phrases: list[str]):
        out = F.lit(False)
        for p in phrases:
            out = out | text.contains(p)
        return out

    matched = F.array_compact(F.array(*(F.when(hit(p), F.lit(i)) for i, p in rules or RULES)))
    out = findings.withColumn("_matched", matched)
    return out.withColumns(
        {"ast_id": F.get("_matched", F.lit(0)), "contributing": F.slice("_matched", 2, 100), "escalate": F.size("_matched") == 0}
    ).drop("_matched")
