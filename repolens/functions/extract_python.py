"""Facts of one Python source, from its syntax tree: symbols, imports, calls, tests, fixtures and patches."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Facts:
    """What one file says; lists of plain dictionaries, ready to be rows."""

    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    tests: list[dict] = field(default_factory=list)
    fixtures: list[dict] = field(default_factory=list)
    patches: list[dict] = field(default_factory=list)
    error: str | None = None


def module_of(path: str) -> str:
    return path.rsplit(".", 1)[0].replace("/", ".")


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names; None for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Reader(ast.NodeVisitor):
    """One walk; ``scope`` is the stack of (kind, name) that the node stands in."""

    def __init__(self, path: str, facts: Facts) -> None:
        self.module, self.facts, self.scope = module_of(path), facts, []
        name = path.rsplit("/", 1)[-1]
        self.in_tests = name.startswith("test_") or name.endswith("_test.py")

    def name_of(self, name: str) -> str:
        return ".".join([self.module, *(n for _, n in self.scope), name])

    def add(self, node: ast.stmt, name: str, kind: str, bases: list[str] | None = None) -> None:
        self.facts.symbols.append({
            "name": name, "qualified_name": self.name_of(name), "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno,
            "visibility": "private" if name.startswith("_") else "public", "bases": bases or [],
        })

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add(node, node.name, "class", [_dotted(b) or f"dynamic:{ast.unparse(b)}" for b in node.bases])
        self.nest("class", node)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = self.scope[-1][0] if self.scope else None
        self.add(node, node.name, "method" if inside == "class" else "function")
        holder = self.scope[-1][1] if inside == "class" and len(self.scope) == 1 else ""
        if self.in_tests and node.name.startswith("test") and (not self.scope or holder.startswith("Test")):
            self.facts.tests.append({"name": self.name_of(node.name), "line": node.lineno, "parameters": [a.arg for a in node.args.args if a.arg != "self"]})
        for mark in node.decorator_list:
            self.decorator(node, mark)
        self.nest("function", node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def decorator(self, node: ast.FunctionDef | ast.AsyncFunctionDef, mark: ast.expr) -> None:
        call = mark if isinstance(mark, ast.Call) else None
        name = _dotted(call.func if call else mark) or ""
        if name.split(".")[-1] == "fixture":
            given = {k.arg: k.value.value for k in call.keywords if isinstance(k.value, ast.Constant)} if call else {}
            self.facts.fixtures.append({"name": given.get("name") or node.name, "function": self.name_of(node.name), "autouse": given.get("autouse") is True, "parameters": [a.arg for a in node.args.args if a.arg != "self"]})

    def nest(self, kind: str, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for mark in node.decorator_list:
            self.visit(mark)
        self.scope.append((kind, node.name))
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.scope.pop()

    def assigned(self, node: ast.Assign | ast.AnnAssign) -> None:
        kind = self.scope[-1][0] if self.scope else "module"
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(target, ast.Name):
                if kind == "class":
                    self.add(node, target.id, "field")
                elif kind == "module" and target.id.strip("_").isupper():
                    self.add(node, target.id, "constant")
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = assigned

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.imports.append({"module": a.name, "name": None, "local": a.asname or a.name.split(".")[0], "level": 0, "line": node.lineno, "dynamic": False})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            star = a.name == "*"
            self.facts.imports.append({"module": node.module, "name": None if star else a.name, "local": None if star else a.asname or a.name, "level": node.level, "line": node.lineno, "dynamic": star})

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name:
            self.facts.calls.append({"caller": ".".join([self.module, *(n for _, n in self.scope)]), "callee": name, "line": node.lineno})
            last = name.split(".")[-1]
            if last == "patch" and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                self.facts.patches.append({"test": ".".join([self.module, *(n for _, n in self.scope)]), "target": node.args[0].value, "line": node.lineno})
            elif name.endswith("patch.object") and len(node.args) > 1 and isinstance(node.args[1], ast.Constant):
                self.facts.patches.append({"test": ".".join([self.module, *(n for _, n in self.scope)]), "target": f"{_dotted(node.args[0])}.{node.args[1].value}", "line": node.lineno})
        self.generic_visit(node)


def read_python(path: str, source: str) -> Facts:
    """All facts of a source. One that can't be parsed has none, and the error."""
    facts = Facts()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        facts.error = str(e)
        return facts
    module = module_of(path)
    facts.symbols.append({"name": module, "qualified_name": module, "kind": "module", "start_line": 1, "end_line": None, "visibility": "public", "bases": []})
    _Reader(path, facts).visit(tree)
    return facts


def candidates(importer: str, record: dict, roots: tuple[str, ...] = ("",)) -> Iterator[str]:
    """Paths that an import may mean, best first: a submodule before its package, a package before a module,
    for each source root."""
    module = record["module"] or ""
    if record["level"]:
        folders = importer.split("/")[: -record["level"]] if record["level"] <= importer.count("/") + 1 else None
        if folders is None:
            return
        module = ".".join([*folders, *([module] if module else [])])
    names = [f"{module}.{record['name']}".strip(".")] if record["name"] else []
    for root in roots if not record["level"] else ("",):
        for name in [*names, module]:
            if name:
                base = root + name.replace(".", "/")
                yield f"{base}/__init__.py"
                yield f"{base}.py"
