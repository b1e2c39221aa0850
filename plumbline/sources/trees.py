"""JSON and TOML documents as rows of nodes, each with its trail of keys, read in one Arrow stage."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

from pyspark.sql import Column

from plumbline.sources.arrow import nested_udf

#: A mapping of a document: the keys that lead to it ([i] for places of lists), and its entries.
#: Of an entry, text is a string value, items a list of strings and shown any value as JSON.
NODES = "struct<broken:string,nodes:array<struct<trail:array<string>,entries:array<struct<key:string,text:string,items:array<string>,shown:string>>>>>"
STRINGS = "array<struct<trail:string,text:string>>"


def _children(node: object) -> list[tuple[str, object]]:
    if isinstance(node, dict):
        return [(str(k), v) for k, v in node.items()]
    return [(f"[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []


def _walk(node: object) -> Iterator[tuple[list[str], object]]:
    """Every node with its trail, a parent before its children, in the order of the document."""
    waiting: list[tuple[list[str], object]] = [([], node)]
    while waiting:
        trail, here = waiting.pop()
        yield trail, here
        waiting += [([*trail, key], child) for key, child in reversed(_children(here))]


def _entry(key: str, value: object) -> dict:
    items = value if isinstance(value, list) and value and all(isinstance(v, str) for v in value) else None
    return {"key": key, "text": value if isinstance(value, str) else None, "items": items, "shown": json.dumps(value, default=str, ensure_ascii=False)}


def nodes_of(text: str, toml: bool) -> dict:
    """The mappings of a document; broken says why there are none."""
    try:
        document = tomllib.loads(text) if toml else json.loads(text)
        found = [(trail, node) for trail, node in _walk(document) if isinstance(node, dict)]
        return {"broken": None, "nodes": [{"trail": trail, "entries": [_entry(str(k), v) for k, v in node.items()]} for trail, node in found]}
    except (ValueError, RecursionError) as e:
        return {"broken": f"{'TOML' if toml else 'JSON'} cannot be read ({type(e).__name__})", "nodes": []}


def nodes(text: Column, toml: Column) -> Column:
    return nested_udf(nodes_of, NODES)(text, toml)


def strings_of(text: str) -> list[dict]:
    """Every string of a JSON document, with its trail as a.b[0]."""
    return [{"trail": ".".join(trail).replace(".[", "["), "text": node} for trail, node in _walk(json.loads(text)) if isinstance(node, str)]


def strings(text: Column) -> Column:
    return nested_udf(strings_of, STRINGS)(text)
