"""Python files as facts: each file is parsed once, in an Arrow stage, into nested rows of calls, steps and branches.

The rows say what is written, not what it means: names of callees, literal text that reaches
them, the order of assignments. Checks are expressions over them. Nothing is ever executed.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column

from plumbline.sources.arrow import nested_udf

#: What an expression is made of: plain names, callees, and string constants.
VALUE = "struct<names:array<string>,calls:array<string>,texts:array<string>>"
#: A call below a statement, its receiver and its arguments; a keyword argument has a name.
INNER = f"struct<name:string,receiver:string,shell:boolean,args:array<struct<name:string,value:{VALUE}>>>"
#: A statement that assigns (assign, add, with) or calls something (other).
STEP = f"struct<kind:string,targets:array<string>,value:{VALUE},calls:array<{INNER}>>"
FACTS = (
    "struct<broken:int,"
    "calls:array<struct<line:int,name:string,modes:array<string>,texts:array<string>>>,"
    f"scopes:array<array<{STEP}>>,"
    "branches:array<struct<line:int,kind:string,test:array<string>,subscripts:array<string>,body:array<string>>>>"
)


def _dotted(node: ast.AST) -> str:
    """`a.b.c` of a chain of names, `().c` where it hangs on a call, nothing for other expressions."""
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    head = node.id if isinstance(node, ast.Name) else "()" if isinstance(node, ast.Call) else None
    return "" if head is None else ".".join([head, *reversed(tail)])


def _callee_below(node: ast.AST) -> str:
    """Like _dotted, but a call in the chain gives its own last name, in lower case: `path.exists` for Path(p).exists."""
    if isinstance(node, ast.Attribute):
        head = _callee_below(node.value)
        return head and f"{head}.{node.attr}"
    if isinstance(node, ast.Call):
        return _callee_below(node.func).rpartition(".")[2].lower()
    return node.id if isinstance(node, ast.Name) else ""


def _rendered(node: ast.AST, known: dict[str, str]) -> str | None:
    """The text that an expression spells out, unknown parts as {}; None where nothing is literal."""
    match node:
        case ast.Constant(value=str() as text):
            return text
        case ast.Name(id=name):
            return known.get(name)
        case ast.JoinedStr(values=parts):
            return "".join(p.value if isinstance(p, ast.Constant) and isinstance(p.value, str) else "{}" for p in parts)
        case ast.BinOp(op=ast.Add(), left=a, right=b):
            sides = [_rendered(a, known), _rendered(b, known)]
            return None if sides == [None, None] else "".join(s or "{}" for s in sides)
        case ast.Call(func=func, args=args):
            name = _dotted(func)
            if name.endswith(("path.join", ".joinpath")):
                return "/".join(_rendered(a, known) or "{}" for a in args)
            if name.endswith(".join") and args and isinstance(args[0], ast.List | ast.Tuple):
                return (_rendered(func.value, known) or "").join(_rendered(x, known) or "{}" for x in args[0].elts)
            return next((x for a in args if (x := _rendered(a, known)) is not None), None)
    return None


def _constants(nodes: list[ast.AST]) -> dict[str, str]:
    """Names that literal text is assigned to anywhere in a file; the last assignment wins."""
    known: dict[str, str] = {}
    for node in nodes:
        if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None and (text := _rendered(node.value, known)) is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    known[target.id] = text
    return known


def _arguments(call: ast.Call) -> list[ast.AST]:
    return [*call.args, *(k.value for k in call.keywords)]


def _spelled(call: ast.Call, known: dict[str, str]) -> list[str]:
    """Text that reaches a call: each argument rendered as a whole, then its constants and named constants."""
    found: dict[str, None] = {}
    for arg in _arguments(call):
        texts = [_rendered(arg, known)]
        for node in ast.walk(arg):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                texts.append(node.value)
            elif isinstance(node, ast.Name):
                texts.append(known.get(node.id))
        found.update((t, None) for t in texts if t)
    return list(found)


def _modes(call: ast.Call) -> list[str]:
    """Literal modes that a call to open may be given, by keyword or in the second place."""
    given = [k.value for k in call.keywords if k.arg == "mode"] + call.args[1:2]
    return [n.value for n in given if isinstance(n, ast.Constant) and isinstance(n.value, str)]


def _value(node: ast.AST | None) -> dict | None:
    if node is None:
        return None
    below = list(ast.walk(node))
    return {
        "names": [n.id for n in below if isinstance(n, ast.Name)],
        "calls": [_dotted(n.func) for n in below if isinstance(n, ast.Call)],
        "texts": [n.value for n in below if isinstance(n, ast.Constant) and isinstance(n.value, str)],
    }


def _targets(node: ast.AST | None) -> list[str]:
    """Names that an assignment binds; of an attribute its last name, of an item its container's."""
    match node:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return [name]
        case ast.Subscript(value=inner):
            return _targets(inner)
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            return [n for p in parts for n in _targets(p)]
    return []


def _calls_below(node: ast.AST) -> list[dict]:
    out = []
    for call in ast.walk(node):
        if isinstance(call, ast.Call):
            held = _targets(call.func.value) if isinstance(call.func, ast.Attribute) else []
            args = [{"name": None, "value": _value(a)} for a in call.args] + [{"name": k.arg or "**", "value": _value(k.value)} for k in call.keywords]
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords)
            out.append({"name": _dotted(call.func), "receiver": held[0] if held else None, "shell": shell, "args": args})
    return out


def _statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Statements in the order of the source, those inside compound ones after them; functions and classes stay closed."""
    for statement in body:
        yield statement
        if not isinstance(statement, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            for block in ("body", "orelse", "finalbody"):
                yield from _statements(getattr(statement, block, None) or [])
            for handler in getattr(statement, "handlers", []):
                yield from _statements(handler.body)


def _steps(body: list[ast.stmt]) -> list[dict]:
    out = []
    for s in _statements(body):
        calls = _calls_below(s)
        first = len(out)
        if isinstance(s, ast.Assign | ast.AnnAssign) and s.value is not None:
            targets = [n for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in _targets(t)]
            out.append({"kind": "assign" if isinstance(s, ast.Assign) else "declare", "targets": targets, "value": _value(s.value), "calls": calls})
        elif isinstance(s, ast.AugAssign):
            kind = "add" if isinstance(s.op, ast.Add) else "change"
            out.append({"kind": kind, "targets": _targets(s.target), "value": _value(s.value), "calls": calls})
        elif isinstance(s, ast.With):
            for item in s.items:
                if item.optional_vars is not None:
                    out.append({"kind": "with", "targets": _targets(item.optional_vars), "value": _value(item.context_expr), "calls": [] if len(out) > first else calls})
        if len(out) == first and calls:
            out.append({"kind": "other", "targets": [], "value": None, "calls": calls})
    return out


def _names_called(node: ast.AST) -> list[str]:
    """Callees below a node and their last names, sorted."""
    names = {n for c in ast.walk(node) if isinstance(c, ast.Call) and (n := _callee_below(c.func))}
    return sorted(names | {n.rpartition(".")[2] for n in names})


def _branches(nodes: list[ast.AST]) -> list[dict]:
    """Branches whose test calls or looks up something: what the test and, part by part, the branches call."""
    out = []
    for node in nodes:
        if isinstance(node, ast.If | ast.While | ast.IfExp):
            looked_up = [_callee_below(n.value) for n in ast.walk(node.test) if isinstance(n, ast.Subscript)]
            test = _names_called(node.test)
            if test or looked_up:
                parts = [node.body, node.orelse] if isinstance(node, ast.IfExp) else [*node.body, *node.orelse]
                kind = "expression" if isinstance(node, ast.IfExp) else "branch"
                out.append({"line": node.lineno, "kind": kind, "test": test, "subscripts": looked_up, "body": [n for p in parts for n in _names_called(p)]})
    return out


def facts_of(source: str, steps: bool = True) -> dict:
    """The facts of one file; broken is the line at which it cannot be parsed, else null."""
    try:
        tree = ast.parse(source)
        nodes = list(ast.walk(tree))
        known = _constants(nodes)
        calls = [
            {"line": n.lineno, "name": _dotted(n.func), "modes": _modes(n), "texts": _spelled(n, known)} for n in nodes if isinstance(n, ast.Call)
        ]
        bodies = [tree.body, *(n.body for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))] if steps else []
        return {"broken": None, "calls": calls, "scopes": [_steps(b) for b in bodies], "branches": _branches(nodes)}
    except SyntaxError as e:
        return {"broken": e.lineno or 0, "calls": [], "scopes": [], "branches": []}
    except (ValueError, RecursionError, MemoryError):
        return {"broken": 0, "calls": [], "scopes": [], "branches": []}


def facts(text: Column, steps: Column) -> Column:
    """FACTS of Python source; scopes, the ordered steps of the module and of each function, only where steps is true."""
    return nested_udf(facts_of, FACTS)(text, steps)
