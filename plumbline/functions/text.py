"""String expressions over file text, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: credential shapes and what replaces them, applied in this order ---
SECRETS = [
    (r"sk-[A-Za-z0-9_\-]{12,}", "<redacted:api-key>"),
    (r"AKIA[0-9A-Z]{16}", "<redacted:aws-access-key-id>"),
    (r"ASIA[0-9A-Z]{16}", "<redacted:aws-session-key-id>"),
    (r"AIza[0-9A-Za-z_\-]{20,}", "<redacted:google-api-key>"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "<redacted:github-token>"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]{12,}", "<redacted:bearer-token>"),
    (r"(?i)\b([A-Z0-9_]*(?:API_KEY|SECRET|TOKEN|PASSWORD))\b\s*[=:]\s*\S+", "$1=<redacted>"),
]
#: Zero-width and bidirectional control characters.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
# --- end of fixed values ---

EXCERPT, SNIPPET, MESSAGE = 800, 120, 1000


def collapse(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """One clipped line of evidence."""
    return clip(collapse(text), limit)


def redact(text: Column) -> Column:
    """Name what was removed instead of each credential-shaped string."""
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """Redacted, then clipped with a note of how much is gone; the full length of the original goes beside it."""

    def cut(clean: Column) -> Column:
        gone = F.char_length(clean) - limit
        return F.when(gone <= 0, clean).otherwise(F.concat(F.left(clean, F.lit(limit)), F.lit("… [truncated "), gone.cast("string"), F.lit(" more characters]")))

    return F.struct(F.transform(F.array(redact(text)), cut)[0].alias("excerpt"), F.char_length(text).alias("chars"))


def fold(text: Column) -> Column:
    """Key under which two texts count as the same wording."""
    return F.lower(collapse(text))


def invisible_points(text: Column) -> Column:
    """Distinct invisible code points as U+XXXX, sorted."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(INVISIBLE), 0))
    return F.array_sort(F.transform(found, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))))


def sarif_text(text: Column, limit: int = MESSAGE) -> Column:
    """Blanks for control characters but tab and line feed, no bidirectional overrides, at most limit code points and a note."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", " "), r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")
    return F.when(F.char_length(clean) <= limit, clean).otherwise(F.concat(F.left(clean, F.lit(limit)), F.lit("… [truncated]")))


def uri_path(path: Column) -> Column:
    """Percent-encode every segment of a path; empty segments go."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(segments, lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


# --- fixed values: how the arm of an evaluation is spelled, and what stands for it and for the workspace ---
ARM_MARK = r"(?i)with(?:out)?[\s_\-]{0,2}skills?\b"
ARM_GONE, PATH_GONE = "<arm-redacted>", "<workspace-path-redacted>"
# --- end of fixed values ---


def blinded(text: Column, workspace: str | None = None) -> Column:
    """text without the workspace's path and without any spelling of the arm that a run belongs to."""
    if workspace:
        text = F.replace(text, F.lit(workspace), F.lit(PATH_GONE))
    return F.regexp_replace(text, ARM_MARK, ARM_GONE)


def arm_leak(text: Column) -> Column:
    """The first spelling of an arm in a text that should be blind, or null."""
    return F.nullif(F.regexp_extract(text, ARM_MARK, 0), F.lit(""))


def badge_field(text: Column) -> Column:
    """A field of a badge's path: dashes and underscores doubled, then percent-encoded."""
    doubled = F.replace(F.replace(text, F.lit("_"), F.lit("__")), F.lit("-"), F.lit("--"))
    return F.replace(F.replace(F.url_encode(doubled), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def printable_share(text: Column) -> Column:
    """Share of characters that are tab, line ends, printable ASCII or above U+00A0; null for an empty text."""
    odd = F.char_length(F.regexp_replace(text, r"[\t\r\n\x20-\x7E\x{A1}-\x{10FFFF}]", ""))
    return F.try_divide((F.char_length(text) - odd).cast("double"), F.char_length(text).cast("double"))
