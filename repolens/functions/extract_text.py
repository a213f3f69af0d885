"""Facts of JavaScript, TypeScript, Rust, Astro and Django sources, read off their tokens."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .extract_python import _dotted, module_of
from .lexing import Lines, Token, js_tokens, partners, rust_tokens


def _symbol(name: str, holder: str, kind: str, line: int, visibility: str = "public", end: int | None = None) -> dict:
    return {"name": name, "qualified_name": f"{holder}.{name}" if holder else name, "kind": kind, "start_line": line, "end_line": end, "visibility": visibility, "bases": []}


class _Script:
    """A JavaScript or TypeScript source as tokens, with what each bracket closes with."""

    def __init__(self, source: str) -> None:
        self.tokens = js_tokens(source)
        self.close = partners(self.tokens)
        self.line = Lines(source)

    def text(self, i: int) -> str:
        """The text of a sign or name; nothing for strings and beyond the end."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind in ("sign", "name") else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def after(self, i: int) -> int:
        """The token behind token ``i``, or behind the bracket that it opens."""
        return self.close.get(i, i) + 1

    def top(self) -> Iterator[int]:
        """Tokens outside all brackets."""
        i = 0
        while i < len(self.tokens):
            yield i
            i = self.after(i)

    def line_of(self, i: int) -> int:
        return self.line(self.tokens[i].at)

    def arrow(self, i: int) -> int | None:
        """Where the body of an arrow function whose value starts at ``i`` begins; None for other values."""
        i += self.text(i) == "async"
        if self.named(i):
            return i + 2 if self.text(i + 1) == "=>" else None
        if self.text(i) == "<":  # type parameters
            while i < len(self.tokens) and self.text(i) != "(":
                i += 1
        if self.text(i) != "(":
            return None
        i = self.after(i)
        if self.text(i) == ":":  # a type of the result
            while i < len(self.tokens) and self.text(i) not in ("=>", ";", "="):
                i = self.after(i)
        return i + 1 if self.text(i) == "=>" else None

    def body_end(self, i: int) -> int:
        """Behind the body at ``i``: its block, or an expression up to the next statement outside brackets."""
        if self.text(i) == "{":
            return self.after(i)
        while i < len(self.tokens) and self.text(i) != ";" and not (self.text(i) in _STARTS and self.line_of(i) > self.line_of(i - 1)):
            i = self.after(i)
        return i

    def markup(self, start: int, end: int) -> bool:
        """Whether something between gives markup back: ``return <`` or ``=> <``, perhaps in brackets."""
        for i in range(start, min(end, len(self.tokens))):
            if self.text(i) in ("return", "=>") or i == start and self.text(i - 1) == "=>":
                k = i + (self.text(i) in ("return", "=>"))
                k += self.text(k) == "("
                if self.text(k) == "<" and (self.named(k + 1) or self.text(k + 1) == ">"):
                    return True
        return False


_STARTS = frozenset("import export const let var function class async".split())
_NOT_METHODS = frozenset("if for while switch catch with function return".split())


def js_symbols(path: str, source: str) -> list[dict]:
    """The module, its classes and their methods, functions and components (a name in capitals that returns
    markup)."""
    s, module = _Script(source), module_of(path)
    found = [_symbol(module, "", "module", 1, end=max(1, len(source.splitlines())))]

    def function(name: int, body: int) -> None:
        text = s.text(name)
        component = text[0].isupper() and s.markup(body, s.body_end(body))
        found.append(_symbol(text, module, "component" if component else "function", s.line_of(name)))

    for i in s.top():
        word = s.text(i)
        if word == "class" and s.named(i + 1):
            found.append(_symbol(s.text(i + 1), module, "class", s.line_of(i + 1)))
            body = i + 2
            while body < len(s.tokens) and s.text(body) != "{":
                body = s.after(body)
            found.extend(_methods(s, body, f"{module}.{s.text(i + 1)}"))
        elif word == "function":
            name = i + 1 + (s.text(i + 1) == "*")
            if s.named(name):
                body = name + 1
                while body < len(s.tokens) and s.text(body) not in ("{", ";"):
                    body = s.after(body)
                function(name, body)
        elif word in ("const", "let", "var") and s.named(i + 1):
            value = i + 2
            if s.text(value) == ":":  # its type
                while value < len(s.tokens) and s.text(value) not in ("=", ";"):
                    value = s.after(value)
            body = s.arrow(value + 1) if s.text(value) == "=" else None
            if body is not None:
                function(i + 1, body)
    return found


def _methods(s: _Script, body: int, holder: str) -> Iterator[dict]:
    """Names in a class body that brackets and then a block follow."""
    i, end = body + 1, s.close.get(body, len(s.tokens))
    while i < end:
        if s.named(i) and s.text(i + 1) == "(" and s.text(i) not in _NOT_METHODS:
            block = s.after(i + 1)
            if s.text(block) == ":":
                while block < end and s.text(block) not in ("{", ";"):
                    block += 1
            if s.text(block) == "{":
                yield _symbol(s.text(i), holder, "method", s.line_of(i))
                i = block
        i = s.after(i)


def _listed(s: _Script, i: int) -> list[str]:
    """The names of a list in braces at ``i``, as they are called where they come from."""
    names, fresh = [], True
    for k in range(i + 1, s.close.get(i, len(s.tokens))):
        if s.text(k) == ",":
            fresh = True
        elif fresh and s.named(k) and not (s.text(k) == "type" and s.named(k + 1) and s.text(k + 1) != "as"):
            names.append(s.text(k))
            fresh = False
    return names


def js_imports(source: str) -> list[dict]:
    """Static and dynamic imports: module, names, default, line."""
    s, found = _Script(source), []
    for i, t in enumerate(s.tokens):
        if t.kind != "name" or s.text(i - 1) == ".":
            continue
        row = {"names": [], "default": None, "line": s.line_of(i)}
        if t.text in ("import", "require") and s.text(i + 1) == "(":
            if i + 2 < len(s.tokens) and s.tokens[i + 2].kind == "string":
                found.append({"module": s.tokens[i + 2].text, **row, "dynamic": True})
        elif t.text == "import":
            k = i + 1
            k += s.text(k) == "type" and (s.text(k + 1) in ("{", "*") or s.named(k + 1) and s.text(k + 1) != "from")
            while k < len(s.tokens) and s.tokens[k].kind != "string" and s.text(k) not in (";", "=", "("):
                if s.text(k) == "{":
                    row["names"] = _listed(s, k)
                elif s.text(k) == "*":
                    row["default"], k = row["default"] or s.text(k + 2), k + 2
                elif s.named(k) and s.text(k) != "from":
                    row["default"] = s.text(k)
                k = s.after(k)
            if k < len(s.tokens) and s.tokens[k].kind == "string":
                found.append({"module": s.tokens[k].text, **row, "dynamic": False})
    return sorted(found, key=lambda r: r["line"])


def js_exports(source: str) -> list[dict]:
    """Name, kind (named or default) and line of each export."""
    s, found = _Script(source), []
    for i in s.top():
        if s.text(i) != "export":
            continue
        kind, k = ("default", i + 2) if s.text(i + 1) == "default" else ("named", i + 1)
        if s.text(k) == "{":
            names = _listed(s, k)
        else:
            declared = s.text(k) in ("async", "function", "class", "const", "let", "var")
            while s.text(k) in ("async", "function", "class", "const", "let", "var", "*"):
                k += 1
            alone = kind == "default" and s.text(k + 1) not in ("(", ".", "=>", "[")
            names = [s.text(k)] if s.named(k) and (declared or alone) else []
        found += [{"name": n, "kind": kind, "line": s.line_of(i)} for n in names]
    return found


_TAG = re.compile(r"<([A-Z][\w$]*)[\s/>]")
_ROUTE = re.compile(r"<Route\b[^>]*?\bpath\s*=\s*[{]?['\"]([^'\"]*)['\"][^>]*?\belement\s*=\s*\{\s*<\s*([A-Z][\w$]*)", re.S)
_ROUTE_OBJECT = re.compile(r"\bpath\s*:\s*['\"]([^'\"]*)['\"]\s*,\s*(?:element\s*:\s*<\s*|Component\s*:\s*)([A-Z][\w$]*)", re.S)


def react_usages(source: str) -> dict[str, list]:
    """Tags of components with their lines, and routes with the component they lead to."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), source, flags=re.S)
    line = Lines(bare)
    routes = _ROUTE.findall(bare) + (_ROUTE_OBJECT.findall(bare) if re.search(r"\bcreate\w*Router\b", bare) else [])
    return {"tags": [(m[1], line(m.start())) for m in _TAG.finditer(bare)], "routes": routes}


#: Item words of Rust and the kinds of symbol they make; fixed values.
RUST_ITEMS = {"struct": "struct", "enum": "enum", "trait": "trait", "fn": "function", "mod": "module"}
_RUST_MARKS = frozenset("pub async unsafe const extern default".split())


def rust_symbols(path: str, source: str) -> list[dict]:
    """The module and every item with a name, at any depth; an item is public where ``pub`` stands before it."""
    tokens, module, line = rust_tokens(source), module_of(path), Lines(source)
    found = [_symbol(module, "", "module", 1, end=max(1, len(source.splitlines())))]
    for i, t in enumerate(tokens[:-1]):
        if t.kind != "name" or t.text not in RUST_ITEMS or tokens[i + 1].kind != "name":
            continue
        k = i - 1
        marks = set()
        while k >= 0 and (tokens[k].text in _RUST_MARKS or tokens[k].kind == "string" or tokens[k].text in ("(", ")", "crate", "super", "self", "in", "::")):
            marks.add(tokens[k].text)
            k -= 1
        if k < 0 or tokens[k].text in ("{", "}", ";", "]") or "pub" in marks:
            found.append(_symbol(tokens[i + 1].text, module, RUST_ITEMS[t.text], line(t.at), "public" if "pub" in marks else "private"))
    return found


def _skip_angles(tokens: list[Token], i: int) -> int:
    """Behind the generic list at ``i``, if one opens there."""
    depth = 0
    while i < len(tokens):
        depth += (tokens[i].text == "<") - (tokens[i].text == ">")
        if not depth:
            return i + (tokens[i].text == ">")
        i += 1
    return i


def _type_name(tokens: list[Token], i: int) -> tuple[str, int]:
    """The last part of the path at ``i``, and the token behind its type."""
    name = ""
    while i < len(tokens) and tokens[i].text not in ("for", "where", "{", ";"):
        if tokens[i].text == "<":
            i = _skip_angles(tokens, i)
            continue
        if tokens[i].kind == "name" and tokens[i].text not in ("dyn", "mut", "const"):
            name = tokens[i].text
        i += 1
    return name, i


def rust_implements(source: str) -> list[tuple[str, str]]:
    """(type, trait) of each ``impl Trait for Type``, last path parts only."""
    tokens, found = rust_tokens(source), []
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text == "impl" and (i == 0 or tokens[i - 1].text in ("{", "}", ";", "]", "unsafe", "default")):
            trait, k = _type_name(tokens, _skip_angles(tokens, i + 1))
            if k < len(tokens) and tokens[k].text == "for":
                own, _ = _type_name(tokens, k + 1)
                if trait and own:
                    found.append((own, trait))
    return found


def rust_uses(source: str) -> list[dict]:
    """Each name that a ``use`` brings in: its path, its local name and the line. Braces nest, ``as`` renames,
    ``self`` is the path around it. One walk over the tokens."""
    tokens, line, found = rust_tokens(source), Lines(source), []
    i = 0
    while i < len(tokens):
        if tokens[i].text != "use" or tokens[i].kind != "name":
            i += 1
            continue
        at, around, path, local = line(tokens[i].at), [], [], None

        def give() -> None:
            if path:
                full = path[:-1] if path[-1] == "self" and len(path) > 1 else path
                found.append({"path": "::".join(full), "local": local or full[-1], "line": at})  # noqa: B023

        i += 1
        while i < len(tokens) and tokens[i].text != ";":
            text = tokens[i].text
            if text == "{":
                around.append(list(path))
                path = list(path)
            elif text in (",", "}"):
                if len(path) > (len(around[-1]) if around else 0):
                    give()
                path, local = list(around[-1]) if around else [], None
                if text == "}" and around:
                    around.pop()
                    # what follows the brace belongs to the list around it
                    path = list(around[-1]) if around else []
            elif text == "as" and i + 1 < len(tokens):
                i += 1
                local = tokens[i].text
            elif text != "::":
                path = [*path, text]
            i += 1
        if len(path) > (len(around[-1]) if around else 0):
            give()
    return found


def astro_parts(source: str) -> tuple[str, str]:
    """Frontmatter and template of an Astro file."""
    m = re.match(r"\s*---\n(.*?)\n---\n?(.*)", source, re.S)
    return (m[1], m[2]) if m else ("", source)


def django_urls(source: str) -> list[dict]:
    """Route, view and name of each URL pattern, from the syntax tree; none of a source that can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found = []
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call) or (_dotted(node.func) or "").split(".")[-1] not in ("path", "re_path") or len(node.args) < 2:
            continue
        route, view = node.args[:2]
        if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view":
            view = view.func.value
        name = next((k.value.value for k in node.keywords if k.arg == "name" and isinstance(k.value, ast.Constant)), None)
        if isinstance(route, ast.Constant) and isinstance(route.value, str) and _dotted(view):
            found.append((node.lineno, node.col_offset, {"route": route.value, "view": _dotted(view), "name": name}))
    return [row for *_, row in sorted(found, key=lambda f: f[:2])]
