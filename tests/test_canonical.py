"""Canonical JSON, key documents and identifiers against results that are written down."""

import json
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.sources import canonical

#: Doubles by their bits, and what ECMAScript prints.
NUMBERS = {
    "0000000000000000": "0", "8000000000000000": "0", "0000000000000001": "5e-324", "7fefffffffffffff": "1.7976931348623157e+308", "4340000000000000": "9007199254740992",
    "444b1ae4d6e2ef4e": "999999999999999700000", "444b1ae4d6e2ef50": "1e+21", "3eb0c6f7a0b5ed8c": "9.999999999999997e-7", "3eb0c6f7a0b5ed8d": "0.000001", "41b3de4355555553": "333333333.3333332", "becbf647612f3696": "-0.0000033333333333333333",
}


def test_numbers_and_order():
    for bits, text in NUMBERS.items():
        assert canonical._number(struct.unpack(">d", bytes.fromhex(bits))[0]) == text
    odd = '{"\\u20ac": 1, "\\r": 2, "\\ufb33": 3, "1": 4, "\\ud83d\\ude00": 5, "\\u0080": 6, "\\u00f6": 7}'
    assert [v for v in json.loads(canonical.canonical_of(odd)["text"]).values()] == [2, 4, 6, 7, 1, 5, 3]
    assert canonical.canonical_of('{"b": [1.50, true, null, "\\u000f\\n\\"\\\\/\\u007f"], "a": {}}')["text"] == '{"a":{},"b":[1.5,true,null,"\\u000f\\n\\"\\\\/\x7f"]}'
    problems = {"{": "no JSON", "9007199254740993": "an integer beyond the exact doubles", "NaN": "no number of JSON", '"\\ud800"': "a lone surrogate", '{"a": 1, "a": 2}': "a name occurs twice"}
    assert {t: canonical.canonical_of(t)["problem"] for t in problems} == problems


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(-(2.0**53), 2.0**53) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values)
def test_canonical_text_keeps_the_value_and_is_a_fixed_point(value):
    text = canonical.canonical_of(json.dumps(value))["text"]
    assert json.loads(text) == value and canonical.canonical_of(text)["text"] == text


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40))
def test_base58_is_its_inverse(data):
    assert canonical.base58_decode(canonical.base58_encode(data)) == data


def test_base58_examples():
    assert canonical.base58_encode(b"Hello World!") == "2NEpo7TZRRrLZSi2U" and canonical.base58_encode(bytes.fromhex("0000287fb4cd")) == "11233QC4"


def test_signing_payload(spark):
    rows = [("a", '{"signature": "x", "b": 1, "content_hash": "h"}'), ("b", '{"b": 1}'), ("c", "[1]"), ("d", "{"), ("e", None)]
    got = {r.n: r.p and tuple(r.p) for r in spark.createDataFrame(rows, "n string, t string").select("n", canonical.signing_payload(F.col("t")).alias("p")).collect()}
    assert got == {"a": ('{"b":1,"content_hash":"h"}', None), "b": (None, "no content_hash to cover"), "c": (None, "no content_hash to cover"), "d": (None, "no JSON"), "e": None}


def test_identifiers(spark):
    cases = {
        "did:web:example.com": ("example.com", [], "https://example.com/.well-known/did.json", None),
        " did:web:example.com%3A3000:user:a%20b ": ("example.com:3000", ["user", "a%20b"], "https://example.com:3000/user/a b/did.json", None),
        "did:key:z6": (None, None, None, "not did:web"), "did:web:Example.com": (None, None, None, "not well-formed"), "did:web:-a.com": (None, None, None, "no host name"),
        "did:web:a.com::b": (None, None, None, "an empty segment"), "did:web:": (None, None, None, "not well-formed"), "": (None, None, None, "no identifier"), None: (None, None, None, "no identifier"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", canonical.did_web(F.col("c")).alias("d"))
    assert {r.c: (r.d.domain, r.d.segments, r.d.url, r.d.problem) for r in df.collect()} == cases


KEY = "ab" * 32


def test_keys_of_documents(spark):
    base = canonical.multibase_of(KEY)
    did = "did:web:example.com"
    made = spark.createDataFrame([(did, KEY)], "did string, k string").select(canonical.did_document(F.col("did"), canonical.multibase(F.col("k"))).alias("d")).first().d
    method = lambda i, **more: {"id": i, "type": "Multikey", "publicKeyMultibase": base} | more
    other = canonical.base58_encode(b"\x12\x00" + bytes(32))
    entries = ["#a", "#gone", method("#in"), 5, "#type", "#short", "#other", "#bare", "#alien"]
    methods = [method("#a"), method("#type", type="X"), method("#short", publicKeyMultibase="z" + canonical.base58_encode(b"\xed\x01abc")), method("#other", publicKeyMultibase="z" + other), {"id": "#bare", "type": "Multikey"}, method("#alien", publicKeyMultibase="z0")]
    rows = [(did, made), ("did:b", json.dumps({"id": "did:b", "verificationMethod": methods, "assertionMethod": entries})), ("did:c", made), ("did:d", '{"id": "did:d"}'), ("did:e", "[]"), ("did:f", None)]
    got = {(r.did, r.method_id, r.public_key, r.problem) for r in canonical.assertion_keys(spark.createDataFrame(rows, "did string, document string")).collect()}
    key = f"ed25519:{KEY}"
    assert got == {
        (did, f"{did}#{base}", key, None), ("did:b", "#a", key, None), ("did:b", "#in", key, None), ("did:b", "#gone", None, "no such verification method"), ("did:b", None, None, "no such verification method"),
        ("did:b", "#type", None, "another type of key"), ("did:b", "#short", None, "3 bytes, not 32"), ("did:b", "#other", None, "no ed25519 key"), ("did:b", "#bare", None, "no key"),
        ("did:b", "#alien", None, "a foreign character"), ("did:c", None, None, "of another identifier"), ("did:d", None, None, "no assertion method"), ("did:e", None, None, "no JSON object"), ("did:f", None, None, "no JSON object"),
    }
