"""Extraction from source texts: one Arrow pass gives symbols, units, nodes and facts as nested rows.

Languages are registered as functions from (path, text) to a dict of lists; two for one name is an error.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import ship, spread

SYMBOL = "name string, qualified_name string, kind string, start_line int, end_line int, source_snippet string"
UNIT = "kind string, start_line int, end_line int, text string, symbol string, ordinal int"
NODE = "kind string, qualified_name string, name string, start_line int, end_line int, symbol string"
FACT = (
    "ordinal int, kind string, source_reference string, target_reference string, source_scope string, start_line int, end_line int, confidence double, "
    "target_kind string, hint string, hint_method string, evidence string"
)
DIAGNOSTIC = "stage string, message string, line int"
SCHEMA = f"relative_path string, language string, symbols array<struct<{SYMBOL}>>, units array<struct<{UNIT}>>, nodes array<struct<{NODE}>>, facts array<struct<{FACT}>>, diagnostics array<struct<{DIAGNOSTIC}>>"
GROUPS = ("symbols", "units", "nodes", "facts", "diagnostics")
_languages: dict[str, Callable[[str, str], dict]] = {}

#: How a language splits identifiers into terms; one without an entry adds none.
_terms: dict[str, Callable[[str], list[str]]] = {}


def fragments(value: str) -> list[str]:
    """The whole, and the parts of each run of letters and digits, in lower case."""
    parts = [x for run in re.findall(r"[A-Za-z0-9]+", value) for x in (run, *re.findall(r"[0-9]+|[A-Z]+(?=[0-9]|$|[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+", run))]
    return [x.lower() for x in (value, *parts) if x]


def registry_terms(value: str) -> list[str]:
    """Terms of all registered languages, each once, in order of registration."""
    return list(dict.fromkeys(t for own in dict.fromkeys(_terms.values()) for t in own(value)))


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def register(language: str, analyse: Callable[[str, str], dict]) -> None:
    if language in _languages:
        raise ValueError(f"{language} is registered twice")
    _languages[language] = analyse


def module_of(path: str) -> str:
    stem = re.sub(r"(^|/)__init__$", "", path.removesuffix(".py"))
    return stem.replace("/", ".") or "__root__"


def is_test(path: str) -> bool:
    return bool(re.search(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$", path.casefold()))


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of names and attributes alone."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def imported_from(package: str, module: str | None, level: int) -> str:
    if not level:
        return module or ""
    parts = [p for p in package.split(".") if p]
    parts = parts[: len(parts) - (level - 1)] if level > 1 else parts
    return ".".join(parts + (module.split(".") if module else []))


def declarations(body: list, scope: tuple[str, ...] = (), in_class: bool = False) -> Iterator[tuple[ast.AST, dict]]:
    """Classes and functions at any depth, in source order, each with its symbol."""
    for node in body:
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            kind = "class" if isinstance(node, ast.ClassDef) else ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if in_class else "function")
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield node, {"name": node.name, "qualified_name": ".".join((*scope, node.name)), "kind": kind, "start_line": start, "end_line": node.end_lineno}
            yield from declarations(node.body, (*scope, node.name), isinstance(node, ast.ClassDef))
        else:
            for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                inner = getattr(node, field, None)
                if isinstance(inner, list):
                    for x in inner:
                        yield from declarations(x.body if hasattr(x, "body") and not isinstance(x, ast.stmt) else [x], scope, in_class) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case)) else ()


def first_string(node: ast.AST) -> ast.AST | None:
    head = node.body[0] if getattr(node, "body", None) else None
    return head if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str) else None


def comment_runs(text: str) -> list[tuple[int, int, str]]:
    try:
        every = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, IndentationError):
        return []
    found = {t.start[0]: t.string + "\n" for t in every if t.type == tokenize.COMMENT}
    runs: list[list[int]] = []
    for line in sorted(found):
        if runs and line == runs[-1][1] + 1:
            runs[-1][1] = line
        else:
            runs.append([line, line])
    return [(a, b, "".join(found[i] for i in range(a, b + 1))) for a, b in runs]


def python_units(text: str, tree: ast.Module, found: list[tuple[ast.AST, dict]]) -> list[dict]:
    lines = text.splitlines(keepends=True)
    piece = lambda a, b: "".join(lines[a - 1 : b])
    units: list[tuple] = []
    for node, symbol in found:
        units.append(("symbol", symbol["start_line"], symbol["end_line"], symbol["source_snippet"], symbol["qualified_name"]))
        if (doc := first_string(node)) is not None:
            units.append(("symbol_docstring", doc.lineno, doc.end_lineno, piece(doc.lineno, doc.end_lineno), symbol["qualified_name"]))
    module_doc = first_string(tree)
    if module_doc is not None:
        units.append(("module_docstring", module_doc.lineno, module_doc.end_lineno, piece(module_doc.lineno, module_doc.end_lineno), None))
    islands: list[list] = []
    for node in tree.body:
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)) or node is module_doc:
            continue
        kind = "imports" if isinstance(node, (ast.Import, ast.ImportFrom)) else "assignment" if isinstance(node, (ast.AugAssign, ast.Assign, ast.AnnAssign)) else "module_code"
        if islands and islands[-1][0] == kind and node.lineno - islands[-1][2] <= 2:
            islands[-1][2] = node.end_lineno
        else:
            islands.append([kind, node.lineno, node.end_lineno])
    units += [(kind, a, b, piece(a, b), None) for kind, a, b in islands]
    symbols = sorted((s for _, s in found), key=lambda s: s["start_line"])
    for a, b, body in comment_runs(text):
        after = [s for s in symbols if 1 <= s["start_line"] - b <= 2 and not "".join(lines[b : s["start_line"] - 1]).strip()]
        around = sorted((s for _, s in found if s["start_line"] <= a <= s["end_line"]), key=lambda s: s["end_line"] - s["start_line"])
        owner = (after or around or [None])[0]
        units.append(("symbol_comment" if owner else "module_comment", a, b, body, owner and owner["qualified_name"]))
    once = {(k, a, b, t): (k, a, b, t, s) for k, a, b, t, s in reversed(units) if t.strip()}
    ordered = sorted(once.values(), key=lambda u: (u[1], u[2], u[0]))
    return [{"kind": k, "start_line": a, "end_line": b, "text": t, "symbol": s, "ordinal": i} for i, (k, a, b, t, s) in enumerate(ordered)]


class Facts:
    """Relationships of one file, before they are resolved: a walk with a stack of (reference, kind, names imported there)."""

    def __init__(self, path: str, text: str, references: dict[int, str]):
        self.module, self.text, self.references = module_of(path), text, references
        self.package = self.module if path.rsplit("/", 1)[-1] == "__init__.py" else self.module.rpartition(".")[0]
        self.testing, self.stack, self.out = is_test(path), [(self.module, "module", {})], []

    def hint(self, reference: str) -> tuple:
        head, *rest = reference.split(".")
        if head in ("self", "cls") and rest:
            owner = next((r for r, kind, _ in reversed(self.stack) if kind == "class"), None)
            if owner:
                return ".".join([owner, *rest]), "same_scope_qualified", "symbol"
        bound = next((names[head] for _, _, names in reversed(self.stack) if head in names), None)
        if not bound:
            return None, None, None
        name, kind, method = bound
        if kind == "module" and rest:
            kind, method = "symbol", "explicitly_imported_module_member"
        return ".".join([name, *rest]), method, kind

    def add(self, kind: str, reference: str, node: ast.AST, confidence: float, wanted: str, source: str | None = None, hint: tuple[str, str] | None = None, evidence: str | None = None) -> None:
        name, method, inferred = self.hint(reference)
        if hint:
            name, method = hint
        shown = evidence or ast.get_source_segment(self.text, node)
        self.out.append({
            "ordinal": len(self.out), "kind": kind, "source_reference": source or self.stack[-1][0], "target_reference": reference, "source_scope": source or self.stack[-1][0], "start_line": getattr(node, "lineno", 1),
            "end_line": getattr(node, "end_lineno", None) or getattr(node, "lineno", 1), "confidence": confidence, "target_kind": inferred if wanted == "any" and inferred else wanted, "hint": name, "hint_method": method,
            "evidence": " ".join(shown.split())[:256] if shown is not None else None,
        })

    def tested(self, reference: str, node: ast.AST, wanted: str, confidence: float) -> None:
        if self.testing:
            self.add("tests", reference, node, confidence, wanted)

    def inside(self, node: ast.AST, kind: str, body: list, before: Callable[[], None] = lambda: None) -> None:
        self.stack.append((self.references[id(node)], kind, {}))
        before()
        for x in body:
            self.visit(x)
        self.stack.pop()

    def visit(self, node: ast.AST) -> None:
        match node:
            case ast.ClassDef():
                own = self.references[id(node)]
                for base in node.bases:
                    if (r := dotted(base)) is not None:
                        self.add("inherits", r, base, 0.95, "symbol", source=own)
                self.inside(node, "class", node.body)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.inside(node, "function", node.body, lambda: self.test_function(node))
            case ast.Import():
                for a in node.names:
                    way = "explicitly_imported_module"
                    self.add("imports", a.name, node, 1.0, "module", hint=(a.name, way))
                    local = a.asname or a.name.split(".")[0]
                    self.stack[-1][2][local] = (a.name if a.asname else local, "module", way)
                    self.tested(a.name, node, "module", 0.7)
            case ast.ImportFrom():
                origin = imported_from(self.package, node.module, node.level)
                if origin:
                    self.add("imports", origin, node, 1.0, "module", hint=(origin, "explicitly_imported_module"))
                    self.tested(origin, node, "module", 0.7)
                for a in node.names if origin else ():
                    if a.name != "*":
                        full, way = f"{origin}.{a.name}", "explicitly_imported_symbol"
                        self.add("imports", a.name, node, 1.0, "any", hint=(full, way))
                        self.stack[-1][2][a.asname or a.name] = (full, "any", way)
                        self.tested(a.name, node, "any", 0.75)
            case ast.Call():
                if (r := dotted(node.func)) is not None:
                    self.add("calls", r, node.func, 0.9, "symbol")
                    self.tested(r, node.func, "symbol", 0.85)
                self.children(node)
            case ast.Attribute():  # names below it add nothing
                if isinstance(node.ctx, ast.Load) and (r := dotted(node)) is not None:
                    self.add("references", r, node, 0.7, "any")
            case ast.Name():
                if isinstance(node.ctx, ast.Load):
                    self.add("references", node.id, node, 0.6, "any")
            case _:
                self.children(node)

    def children(self, node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            self.visit(x)

    def test_function(self, node: ast.AST) -> None:
        if not (self.testing and node.name.startswith("test_")):
            return
        if subject := node.name[5:].strip("_"):
            self.add("tests", subject, node, 0.65, "symbol", evidence=node.name)
        for a in (*node.args.posonlyargs, *node.args.args):
            if a.arg not in ("self", "cls"):
                self.add("tests", a.arg, a, 0.55, "symbol", evidence=a.arg)


def python(path: str, text: str) -> dict:
    try:
        tree = ast.parse(text)
    except SyntaxError as error:
        return {"diagnostics": [{"stage": "parse", "message": str(error), "line": error.lineno}]}
    found = list(declarations(tree.body))
    rows = text.splitlines(keepends=True)
    for _, s in found:
        s["source_snippet"] = "".join(rows[s["start_line"] - 1 : s["end_line"]])
    module, testing, last = module_of(path), is_test(path), max(1, len(rows))
    nodes = [
        {"kind": "test_file" if testing else "file", "qualified_name": path, "name": path.rsplit("/", 1)[-1], "start_line": 1, "end_line": last},
        {"kind": "module", "qualified_name": module, "name": module.rsplit(".", 1)[-1], "start_line": 1, "end_line": last},
    ] + [{"kind": "test_symbol" if testing else "symbol", "qualified_name": f"{module}.{s['qualified_name']}", "name": s["name"], "start_line": s["start_line"], "end_line": s["end_line"], "symbol": s["qualified_name"]} for _, s in found]
    facts = Facts(path, text, {id(n): f"{module}.{s['qualified_name']}" for n, s in found})
    facts.children(tree)
    return {"symbols": [s for _, s in found], "units": python_units(text, tree, found), "nodes": nodes, "facts": facts.out}


def documentation(path: str, text: str) -> dict:
    """Sections as units; no symbols and no graph."""
    lines = text.splitlines()
    starts = [i for i, x in enumerate(lines) if i == 0 or re.match(r"#{1,6}\s+", x) or (i + 1 < len(lines) and re.match(r"[^\w\s]{3,}\s*$", lines[i + 1]))]
    spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(lines)]) if "".join(lines[a:b]).strip()]
    return {"units": [{"kind": "documentation", "start_line": a + 1, "end_line": b, "text": "\n".join(lines[a:b]), "ordinal": i} for i, (a, b) in enumerate(spans)]}


register("python", python)
register("documentation", documentation)
_terms["python"] = _terms["documentation"] = fragments


def parsed(sources: DataFrame) -> DataFrame:
    """One nested row per source (relative_path, language, text). A failure is a diagnostic and gives no other rows."""
    ship(sources.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "language", "text"))):
                try:
                    got = _languages[language](path, text or "")
                except Exception as error:  # one bad file doesn't end the run; what failed is in its row
                    got = {"diagnostics": [{"stage": "analyse", "message": repr(error), "line": None}]}
                out.append({"relative_path": path, "language": language, **{g: got.get(g, []) for g in GROUPS}})
            yield pa.RecordBatch.from_pylist(out, schema)

    return spread(sources.select("relative_path", "language", "text")).mapInArrow(run, SCHEMA)


def exploded(rows: DataFrame, group: str) -> DataFrame:
    """(path, language, the fields of the group) of parsed rows."""
    return rows.select(F.col("relative_path").alias("path"), "language", F.explode(group).alias("x")).select("path", "language", "x.*")
