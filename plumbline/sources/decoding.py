"""What text conceals: layers of encodings, invisible characters and folded spellings, unfolded in Arrow stages.

The rows that come out are plain text with where it was found; what it means is for the
checks to say. All decoding is bounded, and a bound that is met is reported. Nothing is run.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from plumbline.functions.text import INVISIBLE
from plumbline.sources.arrow import nested_udf, shows

# --- fixed values: forms of encoded text, and the bounds of decoding ---
BLOB_FORMS = [
    ("base64", r"(?<![A-Za-z0-9+/=])((?:[A-Za-z0-9+/]{4}){6,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)(?![A-Za-z0-9+/=])"),
    ("hex", r"(?<![0-9A-Za-z])((?:[0-9a-fA-F]{2}){12,})(?![0-9A-Za-z])"),
    ("hex-escape", r"((?:\\x[0-9a-fA-F]{2}){8,})"),
    ("percent", r"((?:%[0-9A-Fa-f]{2}){8,})"),
]
HASH_FIELDS = (
    r"(?i)\b(?:content_hash|signature|signing_key|public_key|fingerprint|integrity|checksum"
    r"|digest|sha1|sha256|sha384|sha512|md5|blake2b|commit|revision|etag|uuid)\b"
)
GZIP, ZLIB = b"\x1f\x8b", (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
BLOB_CANDIDATES, BLOB_BYTES, BLOB_DEPTH = 400, 256 * 1024, 2
LAYER_FORMS = [("base64", r"[A-Za-z0-9+/]{24,}={0,2}"), ("base64url", r"[A-Za-z0-9_-]{24,}={0,2}"), ("hex", r"(?:[0-9a-fA-F]{2}){16,}")]
LAYER_BYTES, LAYER_DEPTH = 1 << 20, 4
MARKS = "\ufe00-\ufe0f\U000e0000-\U000e01ef"
ZERO_WIDTH_RUN = "[\u200b-\u200d\ufeff]{16,}"
ZERO_WIDTH_BITS = {"\u200b": "0", "\u200c": "1"}
#: For RE2: what every literal of BLOB_FORMS and LAYER_FORMS holds, and what is gone from, or read in, a folded text.
ENCODED = r"[A-Za-z0-9+/_-]{24}|(?:\\x[0-9a-fA-F]{2}){8}|(?:%[0-9A-Fa-f]{2}){8}"
HIDDEN = f"[{MARKS}]|{INVISIBLE}"
# --- end of fixed values ---

_DECODERS: dict[str, Callable[[str], bytes]] = {
    "base64": lambda s: base64.b64decode(s, validate=True),
    "base64url": base64.urlsafe_b64decode,
    "hex": bytes.fromhex,
    "hex-escape": lambda s: bytes.fromhex(s.replace("\\x", "")),
    "percent": unquote_to_bytes,
}


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _mostly(text: str | None, good: Callable[[str], bool]) -> str | None:
    """text, if it is not empty and nine tenths of its characters are good."""
    return text if text and sum(map(good, text)) >= 0.9 * len(text) else None


def _visible(c: str) -> bool:
    return c.isprintable() or c in "\n\r\t"


def _plain(c: str) -> bool:
    return c in "\t\r\n" or " " <= c < "\x7f" or c > "\xa0"


def base64_text(blob: str) -> str | None:
    """The text that one base64 literal, padded if it has to be, holds: at least 8 characters, nine tenths printable."""
    try:
        text = _utf8(base64.b64decode(blob + "=" * (-len(blob) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None
    return _mostly(text, _visible) if text and len(text) >= 8 else None


def first_base64_text(blobs: list[str]) -> str | None:
    return next((t for b in blobs if (t := base64_text(b)) is not None), None)


def _inflated(raw: bytes) -> tuple[bytes, str, bool] | None:
    """Bytes below gzip or zlib, the name of the layer, and whether more than the bound was there."""
    gz = raw.startswith(GZIP)
    if not gz and not raw.startswith(ZLIB):
        return None
    try:
        z = zlib.decompressobj(31 if gz else 15)
        out = z.decompress(raw, BLOB_BYTES)
        if not z.eof and len(out) < BLOB_BYTES:
            return None  # cut short
        return out, "gzip" if gz else "zlib", not z.eof
    except zlib.error:
        return None


def _line_around(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)]


def _candidates(where: str, text: str, spent: list[str]) -> Iterator[tuple[str, str, bytes]]:
    """Form, literal and bytes of the encoded literals of a text, form by form; hex in a field that is there to hold a hash does not count."""
    left = BLOB_CANDIDATES
    of_hash = re.search(HASH_FIELDS, where) is not None
    for form, pattern in BLOB_FORMS:
        for m in re.finditer(pattern, text):
            if not left:
                spent.append(f"more than {BLOB_CANDIDATES} encoded literals")
                return
            if form == "hex" and (of_hash or re.search(HASH_FIELDS, _line_around(text, m.start()))):
                continue
            try:
                raw = _DECODERS[form](m[1])
            except (binascii.Error, ValueError):
                continue
            left -= 1
            if len(raw) > BLOB_BYTES:
                spent.append(f"more than {BLOB_BYTES} decoded bytes")
            yield form, m[1], raw[:BLOB_BYTES]


def _blobs(where: str, text: str, depth: int, above: list[str], spent: list[str]) -> Iterator[dict]:
    for form, literal, raw in _candidates(where, text, spent):
        layers = [form]
        if (below := _inflated(raw)) is not None:
            raw, name, more = below
            layers.append(name)
            if more:
                spent.append(f"more than {BLOB_BYTES} bytes below {name}")
        decoded = _mostly(_utf8(raw), _plain)
        if decoded is None:
            continue
        yield {"layers": [*above, *layers], "text": decoded, "excerpt": literal[:40] + ("..." if len(literal) > 40 else "")}
        if depth < BLOB_DEPTH:
            yield from _blobs(where, decoded, depth + 1, [*above, *layers], spent)


BLOBS = "struct<blobs:array<struct<layers:array<string>,text:string,excerpt:string>>,spent:array<string>>"


def blobs_of(text: str, where: str) -> dict:
    """Readable text below encodings and compression, layer by layer to BLOB_DEPTH, and the bounds that were met."""
    spent: list[str] = []
    found = list(_blobs(where, text, 1, [], spent))
    return {"blobs": found, "spent": sorted(set(spent))}


def blobs(text: Column, where: Column) -> Column:
    """BLOBS of a text; null where it holds nothing that could be encoded."""
    return nested_udf(blobs_of, BLOBS, needs=lambda texts: shows(texts, ENCODED))(text, where)


def _layer(text: str, spent: list[str], depth: int) -> list[tuple[str, str]]:
    """(form, text) of all literals of a text that decode to text, each literal once."""
    out, seen = [], set()
    for form, pattern in LAYER_FORMS:
        for m in re.finditer(pattern, text):
            literal = m[0]
            if form != "hex" and (len(literal) % 4 or (form == "base64url" and not re.search("[-_]", literal))) or literal in seen:
                continue
            seen.add(literal)
            try:
                raw = _DECODERS[form](literal) if len(literal) <= LAYER_BYTES else None
            except (binascii.Error, ValueError):
                continue
            if raw is None or len(raw) > LAYER_BYTES:
                spent.append(f"size at depth {depth}")
            elif (decoded := _mostly(_utf8(raw), _visible)) is not None:
                out.append((form, decoded))
    return out


def _layers(text: str) -> tuple[list[dict], list[str]]:
    out, spent, texts = [], [], [text]
    for depth in range(1, LAYER_DEPTH + 1):
        below = [x for t in texts for x in _layer(t, spent, depth)]
        out += [{"depth": depth, "form": form, "text": t} for form, t in below]
        texts = [t for _, t in below]
        if not texts:
            break
    else:
        spent.append(f"depth {LAYER_DEPTH}")
    return out, spent


_HIDDEN = re.compile(f"[{MARKS}]|" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE))
#: A character outside ASCII may combine with the one before it and with its like behind it, with nothing else.
_FOLDS = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


def folded(text: str) -> tuple[str, list[dict]]:
    """text without invisible characters and marks, in NFKC, and where its parts come from: edges (at, raw, kept).

    From the place `at` on, characters stand for those of the text from `raw` on, one by one
    where kept is true, all together otherwise.
    """
    parts, edges, size, done = [], [{"at": 0, "raw": 0, "kept": True}], 0, 0

    def put(part: str, raw: int, kept: bool) -> None:
        nonlocal size
        if part:
            edges.append({"at": size, "raw": raw, "kept": kept})
            parts.append(part)
            size += len(part)

    for m in _FOLDS.finditer(text):
        put(text[done : m.start()], done, True)
        put(unicodedata.normalize("NFKC", _HIDDEN.sub("", m[0])), m.start(), False)
        done = m.end()
    put(text[done:], done, True)
    return "".join(parts), edges


def zero_width(text: str) -> dict | None:
    """The first run of zero-width characters that spells out text in bits, and where it stands."""
    for m in re.finditer(ZERO_WIDTH_RUN, text):
        bits = "".join(ZERO_WIDTH_BITS.get(c, "") for c in m[0])
        if len(bits) >= 16 and len(bits) % 8 == 0:
            said = _mostly(_utf8(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))), _visible)
            if said and said.strip():
                return {"at": m.start(), "text": said}
    return None


UNFOLDED = (
    "struct<view:string,edges:array<struct<at:int,raw:int,kept:boolean>>,zero_width:struct<at:int,text:string>,"
    "layers:array<struct<depth:int,form:string,text:string>>,spent:array<string>>"
)


def _own_view(text: str) -> bool:
    """Is the folded view the text itself? Any part of a text in NFKC is in NFKC."""
    return text.isascii() or unicodedata.is_normalized("NFKC", text) and _HIDDEN.search(text) is None


def unfolded_of(text: str) -> dict:
    layers, spent = _layers(text)
    view, edges = (None, None) if _own_view(text) else folded(text)
    return {"view": view, "edges": edges, "zero_width": zero_width(text), "layers": layers, "spent": sorted(set(spent))}


def _conceals(texts: pa.Array) -> pa.Array:
    """Which texts could hold a layer, or are not their own view; zero-width runs are of hidden characters."""
    signs = shows(texts, f"{ENCODED}|{HIDDEN}")
    rest = pc.and_not(pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False), signs)
    folds = [not unicodedata.is_normalized("NFKC", t) for t in texts.filter(rest).to_pylist()]
    return pc.replace_with_mask(signs, rest, pa.array(folds, pa.bool_()))


def unfolded(text: Column) -> Column:
    """UNFOLDED of a text: its folded view (null where that is the text itself), what zero-width runs spell, and decoded layers.

    Null where there is nothing of all this.
    """
    return nested_udf(unfolded_of, UNFOLDED, needs=_conceals)(text)
