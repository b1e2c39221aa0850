"""The check of packages that attack what scans them: too much, too large, padded, leading out, or archives that blow up."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.arrow import nested_udf
from plumbline.sources.packages import regular

# --- fixed values: bounds of a package, and what an archive is ---
MOST_ENTRIES, MOST_BYTES, MOST_PADDING, MOST_MEMBERS, MOST_RATIO = 500, 2 << 20, 1000, 1000, 100
ARCHIVES = r"(?i)\.(?:zip|docx|xlsx|pptx|jar|whl|egg|odt|epub)$"
SIGNATURES = ["504B0304", "504B0506", "504B0708"]
# --- end of fixed values ---

CHECK = "AST08-S07"
LISTED = "struct<broken:string,members:array<struct<name:string,size:long,packed:long>>>"


def listed_of(content: bytes) -> dict:
    """The members that an archive's central directory lists; nothing is decompressed."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return {"broken": None, "members": [{"name": m.filename, "size": m.file_size, "packed": m.compress_size} for m in z.infolist()]}
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError) as e:
        return {"broken": type(e).__name__, "members": []}


def hazards(entries: DataFrame) -> DataFrame:
    """All hazards of entries (of sources.packages.read_packages): pkg_id, kind, path, place, detail.

    kind orders them: 0 entries, 1 size, 2 padding, 3 links and special files, 4 archives.
    """
    path = F.col("path")
    many = entries.groupBy("pkg_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ENTRIES)
    many = many.select("pkg_id", F.lit(0).alias("kind"), F.lit("").alias("path"), F.lit(0).alias("place"), F.concat("n", F.lit(f" entries, more than {MOST_ENTRIES}")).alias("detail"))

    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    padding = rf"(?U)\s{{{MOST_PADDING},}}"
    run = F.regexp_extract(text, padding, 0)
    large = F.when(F.col("n_bytes") > MOST_BYTES, F.concat("n_bytes", F.lit(f" bytes, more than {MOST_BYTES}")))
    padded = F.when(text.rlike(padding), F.concat(F.char_length(run), F.lit(" blanks from character "), F.regexp_instr(text, F.lit(padding)) - 1, F.lit(f" on, {MOST_PADDING} or more")))
    leads = F.when(F.col("type") == "symlink", F.when(F.col("escapes"), F.concat(F.lit("a link that leads out of the package, to "), "target")))
    special = F.when(~F.col("type").isin("file", "dir", "symlink"), F.concat(F.lit("no regular file but a "), "type"))
    own = F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("detail")) for k, d in ((1, large), (2, padded), (3, F.coalesce(leads, special)))))
    own = entries.select("pkg_id", "path", F.explode(own).alias("x")).select("pkg_id", "x.kind", "path", F.lit(0).alias("place"), "x.detail").where("detail IS NOT NULL")

    archive = path.rlike(ARCHIVES) | F.hex(F.substring("content", 1, 4)).isin(SIGNATURES)
    found = regular(entries).where(archive & F.col("content").isNotNull()).select("pkg_id", "path", nested_udf(listed_of, LISTED)(F.col("content")).alias("z"))
    count = F.size("z.members")
    whole = F.when(F.col("z.broken").isNotNull(), F.concat(F.lit("INCOMPLETE: the archive's directory cannot be read ("), "z.broken", F.lit(")"))).when(
        count > MOST_MEMBERS, F.concat(count, F.lit(f" members, more than {MOST_MEMBERS}"))
    )
    flat = lambda m: F.replace(m["name"], F.lit("\\"), F.lit("/"))
    ratio = lambda m: m["size"] / F.nullif(m["packed"], F.lit(0))

    def told(m):
        named = F.concat(F.lit("member "), m["name"])
        return F.array_compact(
            F.array(
                F.when(flat(m).startswith("/") | F.array_contains(F.split(flat(m), "/"), ".."), F.concat(named, F.lit(" leads out of the archive"))),
                F.when(ratio(m) > MOST_RATIO, F.concat(named, F.lit(" unpacks to "), m["size"], F.lit(" bytes from "), m["packed"])),
                F.when(flat(m).rlike(ARCHIVES), F.concat(named, F.lit(" is an archive itself"))),
            )
        )

    each = F.concat(F.array_compact(F.array(whole)), F.flatten(F.transform("z.members", told)))
    inside = found.select("pkg_id", F.lit(4).alias("kind"), "path", F.posexplode(each).alias("place", "detail"))
    return many.unionByName(own).unionByName(inside)


def hazard_findings(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """Is a package within every bound of a scan? pkg_id, check_id, detected, evidence.

    Evidence counts the hazards and tells the first. Archives are listed from their central
    directories, never unpacked; one whose directory cannot be read is INCOMPLETE and not
    clean. Files beyond what the source reads are over a bound by their size alone.
    """
    first = hazards(entries).groupBy("pkg_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kind", "path", "place", "detail")).alias("x"))
    out = packages.select("pkg_id").join(first, "pkg_id", "left")
    where = F.when(F.col("x.path") == "", F.col("x.detail")).otherwise(F.concat("x.path", F.lit(": "), "x.detail"))
    return out.select("pkg_id", F.lit(CHECK).alias("check_id"), F.col("x").isNotNull().alias("detected"), F.concat("n", F.lit(" hazard(s), first: "), where).alias("evidence"))
