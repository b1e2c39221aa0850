"""Host names: normal form, class, allowlists and their lint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import let

# --- fixed values ---
HOSTNAME = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$"
# --- end of fixed values ---
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
MAPPED = "::ffff:"


def normalize(host: Column) -> Column:
    """Lower-case name without port and root dot; brackets of IPv6 are taken off."""
    return let(F.lower(F.trim(host)), _bare)


def _bare(h: Column) -> Column:
    bare = (
        F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)", 1))
        .when(F.regexp_count(h, F.lit(":")) > 1, h)
        .otherwise(F.substring_index(h, ":", 1))
    )
    return F.regexp_replace(bare, r"\.+$", "")


def host_class(host: Column) -> Column:
    """loopback, unqualified or routable, of a normalised host."""
    return let(F.when(host.startswith(MAPPED), F.regexp_replace(host, "^" + MAPPED, "")).otherwise(host), _class)


def _class(plain: Column) -> Column:
    octets = F.array(*(F.try_to_number(F.regexp_extract(plain, IPV4, i), F.lit("999")).cast("int") for i in range(1, 5)))
    valid, local = F.array_max(octets) <= 255, (F.get(octets, F.lit(0)) == 127) | (F.array_max(octets) == 0)
    return (
        F.when(plain.isin("::1", "0:0:0:0:0:0:0:1", "localhost", "localhost.localdomain") | plain.endswith(".localhost"), "loopback")
        .when(plain.rlike(IPV4), F.when(valid & local, "loopback").otherwise("routable"))
        .when(~plain.contains(".") & ~plain.contains(":"), "unqualified")
        .otherwise("routable")
    )


def unbounded(allow: Column, policy: Column | None = None) -> Column:
    """Egress that is not a finite list of hosts: an open policy, or a pattern among the hosts."""
    globbed = F.exists(F.coalesce(allow, F.array().cast("array<string>")), lambda h: h.rlike(r"[*?\[\]{}]"))
    if policy is None:
        return globbed
    # fixed values: words for an open policy
    return globbed | F.coalesce(F.lower(F.trim(policy)).isin("allow-all", "allow_all", "any", "all", "*", "unrestricted"), F.lit(False))


def declared(allow: Column, host: Column) -> Column:
    """Is the host on the list, exactly, but for case and blanks around it?"""
    return F.array_contains(F.transform(F.coalesce(allow, F.array().cast("array<string>")), lambda h: F.lower(F.trim(h))), host)


def lint(entry: Column) -> Column:
    """The first thing wrong with an allowlist entry, or null."""
    return (
        F.when(entry.contains("*"), "wildcard")
        .when(entry.contains("://"), "scheme")
        .when(entry.contains("/"), "path")
        .when(entry.contains(":"), "port")
        .when(entry != F.lower(entry), "case")
        .when(~entry.rlike(HOSTNAME), "form")
    )
