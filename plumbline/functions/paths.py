"""Paths and permission scopes: reach, shadowing, write decisions and the derived risk tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
IDENTITY_FILES = ["SOUL.md", "MEMORY.md", "AGENTS.md"]
TIERS = ["L0", "L1", "L2", "L3"]
# --- end of fixed values ---


def normalize(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(normalize(path), r"/+$", ""), "/", -1)


def rooted_everywhere(path: Column) -> Column:
    """A recursive grant from the package or home directory."""
    p = normalize(path)
    return p.endswith("**") & F.regexp_replace(F.regexp_replace(p, r"\*\*$", ""), r"/+$", "").isin("", ".", "~")


def glob_regex(glob: Column) -> Column:
    """The anchored regular expression of a shell glob (*, ?, [..] and [!..])."""
    quoted = F.regexp_replace(glob, r"([.+^${}()|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("[!"), F.lit("[^")), F.lit("$"))


def reaches(entry: Column, identity: Column | str) -> Column:
    """Does a write entry put an identity file in reach: by name, by a glob at a root, or recursively?"""
    name = F.lit(identity) if isinstance(identity, str) else identity
    p = normalize(entry)
    globbed = p.rlike(r"[*?\[\]{}]")
    spots = [name, F.concat(F.lit("~/"), name), F.concat(F.lit("/"), name)]
    hit = F.lit(False)
    for s in spots:
        hit = hit | F.regexp_like(s, F.when(p.rlike(r"\[[^\]]*$|^[^\[]*\]"), F.lit("$.")).otherwise(glob_regex(p)))
    return (p != "") & ((basename(entry) == name) | (globbed & (hit | rooted_everywhere(entry))))


def shadows(entry: Column, identity: Column | str) -> Column:
    """Does a deny_write entry take an identity file out of reach?"""
    name = F.lit(identity) if isinstance(identity, str) else identity
    return (basename(entry) == name) | rooted_everywhere(entry)


def write_allowed(write: Column, deny: Column, path: str) -> Column:
    """Deny first (a bare name denies everywhere), then an exact grant."""
    p = path.removeprefix("./")
    same = lambda e: normalize(e) == p
    denied = F.exists(deny, lambda e: same(e) | (~normalize(e).contains("/") & (normalize(e) == p.rsplit("/", 1)[-1])))
    return ~denied & F.exists(write, same)


def lint(path: Column) -> Column:
    """All that is wrong with a declared path."""
    return F.array_compact(
        F.array(F.when(path.rlike(r"[*?\[\]{}]"), F.lit("wildcard")), F.when(F.array_contains(F.split(normalize(path), "/"), ".."), F.lit("parent")))
    )


def effective_writes(write: Column, deny: Column) -> Column:
    """The write entries that no deny_write entry takes back: the same path, or a bare name anywhere."""

    def denied(entry: Column) -> Column:
        return F.exists(deny, lambda e: (normalize(e) == normalize(entry)) | (~normalize(e).contains("/") & (normalize(e) == basename(entry))))

    return F.filter(write, lambda e: ~denied(e))


def risk_tier(write: Column, deny: Column, shell: Column, allow: Column) -> Column:
    """The least tier that a package's permissions ask for.

    An identity file counts by base name, wherever it lies; other writes count only if they
    are effective.
    """
    identity = F.lit(False)
    for f in IDENTITY_FILES:
        named = lambda e: basename(e) == f  # noqa: B023, E731
        identity = identity | (F.exists(write, named) & ~F.exists(deny, named))
    writes, sends = F.size(effective_writes(write, deny)) > 0, F.size(allow) > 0
    return F.when(identity | (shell & writes), "L3").when(shell, "L2").when(writes | sends, "L1").otherwise("L0")


def tier_rank(tier: Column) -> Column:
    """0 to 3, null for anything else."""
    return F.when(tier.isin(*TIERS), F.right(tier, F.lit(1)).cast("int"))
