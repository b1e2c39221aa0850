"""Canonical JSON (RFC 8785), what a manifest's signature covers, and the keys that did:web documents publish."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.arrow import nested_udf

# --- fixed values: the exact integers of a double, and how keys and identifiers are written ---
EXACT = 2**53
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ED25519_PREFIX, KEY_BYTES = b"\xed\x01", 32
KEY_TYPES = ["Ed25519VerificationKey2020", "Multikey"]
DID_WEB = r"^did:web:((?:[a-z0-9._-]|%[0-9A-Fa-f]{2}|:)+)$"
DOMAIN = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*(:[0-9]{1,5})?$"
CONTEXT = ["https://www.w3.org/ns/did/v1", "https://w3id.org/security/suites/ed25519-2020/v1"]
# --- end of fixed values ---


def _number(value: float) -> str:
    """A double as ECMAScript prints it: the shortest digits, plain between 1e-7 and 1e21."""
    if value != value or abs(value) == float("inf"):
        raise ValueError("no number of JSON")
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent  # 0.text times 10 to the point
    if not value:
        return "0"
    if 0 < point <= 21:
        text = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{text}"
    else:
        text = f"{text[0]}{'.' if len(text) > 1 else ''}{text[1:]}e{point - 1:+d}"
    return "-" * sign + text


def _canonical(value: object) -> str:
    match value:
        case bool() | None:
            return json.dumps(value)
        case int():
            if abs(value) > EXACT:
                raise ValueError("an integer beyond the exact doubles")
            return str(value)
        case float():
            return _number(value)
        case str():
            value.encode("utf-8")  # a lone surrogate ends here
            return json.dumps(value, ensure_ascii=False)
        case list():
            return f"[{','.join(map(_canonical, value))}]"
    members = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))  # by UTF-16 code units
    return "{" + ",".join(f"{_canonical(k)}:{_canonical(v)}" for k, v in members) + "}"


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a name occurs twice")
    return dict(pairs)


CANONICAL = "struct<text:string,problem:string>"


def canonical_of(text: str) -> dict:
    """The canonical form of a JSON text, or why it has none."""
    try:
        return {"text": _canonical(json.loads(text, object_pairs_hook=_unique)), "problem": None}
    except RecursionError:
        return {"text": None, "problem": "too deep"}
    except ValueError as e:
        return {"text": None, "problem": "no JSON" if isinstance(e, json.JSONDecodeError) else "a lone surrogate" if isinstance(e, UnicodeError) else str(e)}


def payload_of(text: str) -> dict:
    """What a signature over a manifest covers: its canonical form without the signature; the content hash has to be there."""
    whole = canonical_of(text)
    if whole["problem"]:
        return whole
    manifest = json.loads(text)
    if not isinstance(manifest, dict) or "content_hash" not in manifest:
        return {"text": None, "problem": "no content_hash to cover"}
    return {"text": _canonical({k: v for k, v in manifest.items() if k != "signature"}), "problem": None}


def canonical(text: Column) -> Column:
    return nested_udf(canonical_of, CANONICAL)(text)


def signing_payload(text: Column) -> Column:
    return nested_udf(payload_of, CANONICAL)(text)


def base58_encode(data: bytes) -> str:
    """Each leading zero byte is a digit of its own; the rest is one number."""
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, digit = divmod(n, 58)
        out = BASE58[digit] + out
    return BASE58[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def base58_decode(text: str) -> bytes:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    return bytes(len(text) - len(text.lstrip(BASE58[0]))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def multibase_of(hex_key: str) -> str | None:
    """How a did document writes an ed25519 key of 64 hex digits."""
    try:
        key = bytes.fromhex(hex_key)
    except ValueError:
        return None
    return "z" + base58_encode(ED25519_PREFIX + key) if len(key) == KEY_BYTES else None


def key_of(multibase: str) -> dict:
    """The key (64 hex digits) of a multibase text, or why it is none."""
    if not multibase.startswith("z"):
        return {"text": None, "problem": "not in base58btc"}
    if len(multibase) > 4 * KEY_BYTES:
        return {"text": None, "problem": "too long"}
    try:
        raw = base58_decode(multibase[1:])
    except ValueError:
        return {"text": None, "problem": "a foreign character"}
    if raw[:2] != ED25519_PREFIX:
        return {"text": None, "problem": "no ed25519 key"}
    key = raw[2:]
    return {"text": key.hex(), "problem": None} if len(key) == KEY_BYTES else {"text": None, "problem": f"{len(key)} bytes, not {KEY_BYTES}"}


def multibase(hex_key: Column) -> Column:
    return nested_udf(multibase_of, "string")(hex_key)


def did_web(identity: Column) -> Column:
    """struct(did, domain, segments, url, problem) of a did:web identifier; problem is null where it is one.

    Without segments the document lies below .well-known, with them below their path.
    """
    did = F.trim(identity)
    parts = F.split(F.regexp_extract(did, DID_WEB, 1), ":")
    domain = F.try_url_decode(F.replace(F.get(parts, F.lit(0)), F.lit("+"), F.lit("%2B")))
    segments = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    problem = (
        F.when(F.coalesce(did, F.lit("")) == "", "no identifier").when(~did.startswith("did:web:"), "not did:web").when(~did.rlike(DID_WEB), "not well-formed")
        .when(~F.coalesce(domain.rlike(DOMAIN), F.lit(False)), "no host name").when(F.exists(segments, lambda s: s == ""), "an empty segment")
    )
    path = F.array_join(F.transform(segments, F.try_url_decode), "/")
    url = F.when(F.size(segments) == 0, F.concat(F.lit("https://"), domain, F.lit("/.well-known/did.json"))).otherwise(F.concat(F.lit("https://"), domain, F.lit("/"), path, F.lit("/did.json")))
    ok = problem.isNull()
    return F.struct(did.alias("did"), F.when(ok, domain).alias("domain"), F.when(ok, segments).alias("segments"), F.when(ok, url).alias("url"), problem.alias("problem"))


def did_document(did: Column, multibase: Column) -> Column:
    """The document (JSON) that publishes one key for an identifier; the key's own text names its method."""
    method = F.concat(did, F.lit("#"), multibase)
    one = F.struct(method.alias("id"), F.lit(KEY_TYPES[0]).alias("type"), did.alias("controller"), multibase.alias("publicKeyMultibase"))
    return F.to_json(
        F.struct(
            F.array(*map(F.lit, CONTEXT)).alias("@context"), did.alias("id"), F.array(one).alias("verificationMethod"), F.array(method).alias("authentication"), F.array(method).alias("assertionMethod")
        )
    )


def assertion_keys(documents: DataFrame) -> DataFrame:
    """What documents(did, document as JSON) publish for assertions: did, method_id, public_key, problem, a row for each entry.

    An entry is a method itself or the id of one under verificationMethod. A key under any
    other relationship does not count; a document of another identifier, or one without any
    entry, has one row with the problem.
    """
    parsed = documents.select("did", F.try_parse_json("document").alias("d"))
    items = lambda path: F.coalesce(F.try_variant_get("d", path, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, path="$": F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    claimed = text(F.col("d"), "$.id")
    whole = F.when(F.col("d").isNull() | ~F.schema_of_variant("d").startswith("OBJECT"), "no JSON object").when(~claimed.eqNullSafe(F.col("did")), "of another identifier").when(F.size(items("$.assertionMethod")) == 0, "no assertion method")
    parsed = parsed.withColumn("whole", whole)
    methods = parsed.select("did", F.explode(items("$.verificationMethod")).alias("m")).select("did", text(F.col("m"), "$.id").alias("ref"), "m").where("ref IS NOT NULL")
    methods = methods.groupBy("did", "ref").agg(F.last("m").alias("method"))
    entries = parsed.where("whole IS NULL").select("did", F.posexplode(items("$.assertionMethod")).alias("at", "e")).withColumn("ref", text(F.col("e")))
    found = entries.join(methods, ["did", "ref"], "left").withColumn("method", F.when(F.col("ref").isNotNull(), F.col("method")).otherwise(F.col("e")))
    kind, base = text(F.col("method"), "$.type"), text(F.col("method"), "$.publicKeyMultibase")
    found = found.select("did", "at", F.coalesce(text(F.col("method"), "$.id"), "ref").alias("method_id"), F.col("method").isNotNull() & F.schema_of_variant("method").startswith("OBJECT"), kind.alias("kind"), nested_udf(key_of, CANONICAL)(base).alias("key"))
    found = found.toDF("did", "at", "method_id", "is_method", "kind", "key")
    problem = (
        F.when(~F.coalesce("is_method", F.lit(False)), "no such verification method").when(~F.coalesce(F.col("kind").isin(KEY_TYPES), F.lit(False)), "another type of key")
        .when(F.col("key").isNull(), "no key").otherwise(F.col("key.problem"))
    )
    keys = found.select("did", "method_id", F.when(problem.isNull(), F.concat(F.lit("ed25519:"), "key.text")).alias("public_key"), problem.alias("problem"))
    none = F.lit(None).cast("string")
    return keys.unionByName(parsed.where("whole IS NOT NULL").select("did", none.alias("method_id"), none.alias("public_key"), F.col("whole").alias("problem")))
