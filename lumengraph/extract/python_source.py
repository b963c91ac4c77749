"""Python files by the standard parser: symbols, inheritance, type references, imports, calls, rationale."""

from __future__ import annotations

import ast

from ..functions.ids import make_id, normpath
from .emitter import Emitter
from .names import ANNOTATION_NOISE, GLOBALS, TYPE_CONTAINERS

#: Comments that give reasons.
REASONS = ("# NOTE:", "# IMPORTANT:", "# HACK:", "# WHY:", "# RATIONALE:", "# TODO:", "# FIXME:")
Function = (ast.FunctionDef, ast.AsyncFunctionDef)


def _generated(text: str) -> bool:
    head = text[:2048]
    marks = ("DO NOT EDIT", "@generated", "Generated by the protocol buffer")
    revision = any(x.lstrip().startswith("revision") and (":" in x or "=" in x) for x in head.splitlines())
    return any(m in head for m in marks) or (revision and "def upgrade(" in head and "down_revision" in head) or ("class Migration(migrations.Migration)" in head and "operations" in head)


def _type_names(node: ast.AST | None, generic: bool = False):
    """(name, whether inside brackets) of the types in an annotation, outer ones first."""
    if isinstance(node, ast.Name):
        yield node.id, generic
    elif isinstance(node, ast.Attribute):
        yield node.attr, generic
    elif isinstance(node, ast.Subscript):
        yield from _type_names(node.value, generic)
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        for part in inner:
            yield from _type_names(part, True)
    elif node is not None and not isinstance(node, ast.Constant):
        for part in ast.iter_child_nodes(node):
            yield from _type_names(part, generic)


class _Walk:
    def __init__(self, path: str, text: str):
        self.out, self.text = Emitter(path), text
        self.root = self.out.file_node()
        self.bodies: list[tuple[str, ast.AST]] = []

    def run(self) -> Emitter:
        try:
            tree = ast.parse(self.text)
        except (SyntaxError, ValueError, RecursionError):
            return self.out
        self.block(tree.body, None)
        self.calls()
        if not _generated(self.text):
            self.docstring(tree, self.root)
        self.docstrings(tree.body, self.root)
        for number, line in enumerate(self.text.splitlines(), 1):
            if line.strip().startswith(REASONS):
                self.rationale(line.strip(), number, self.root)
        self.bindings(tree)
        return self.out

    def block(self, body: list[ast.stmt], owner: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                self.klass(node)
            elif isinstance(node, Function):
                self.function(node, owner)
            elif isinstance(node, ast.Import):
                for alias in node.names:
                    self.out.link(self.root, make_id(alias.name), "imports", node.lineno, context="import")
            elif isinstance(node, ast.ImportFrom):
                self.out.link(self.root, self.module(node), "imports_from", node.lineno, context="import")
            else:  # what stands under a condition belongs to the file
                inner = [x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case))]
                self.block(inner, None)

    def module(self, node: ast.ImportFrom) -> str:
        if not node.level:
            return make_id(node.module or "")
        folder = self.out.path.rpartition("/")[0]
        for _ in range(node.level - 1):
            folder = folder.rpartition("/")[0]
        inside = f"{node.module.replace('.', '/')}.py" if node.module else "__init__.py"
        return make_id(normpath(f"{folder}/{inside}" if folder else inside))

    def klass(self, node: ast.ClassDef) -> None:
        out = self.out
        me = out.node(make_id(out.stem, node.name), node.name, node.lineno)
        out.link(self.root, me, "contains", node.lineno)
        for base in node.bases:
            if isinstance(base, ast.Name):
                out.link(me, out.stub(base.id), "inherits", node.lineno)
        self.block(node.body, me)

    def function(self, node, owner: str | None) -> None:
        out = self.out
        if owner:
            me = out.node(make_id(owner, node.name), f".{node.name}()", node.lineno)
            out.link(owner, me, "method", node.lineno)
        else:
            me = out.node(make_id(out.stem, node.name), f"{node.name}()", node.lineno)
            out.link(self.root, me, "contains", node.lineno)
        a = node.args
        places = [(p.lineno, p.col_offset, p.annotation) for p in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else ()), *a.kwonlyargs, *([a.kwarg] if a.kwarg else ())) if p.annotation]
        for _, _, annotation in sorted(places, key=lambda p: p[:2]):
            self.types(me, annotation, "parameter_type", node.lineno)
        self.types(me, node.returns, "return_type", node.lineno)
        self.bodies.append((me, node))

    def types(self, me: str, annotation: ast.AST | None, context: str, line: int) -> None:
        for name, generic in _type_names(annotation):
            if name in TYPE_CONTAINERS or name in ANNOTATION_NOISE:
                continue
            target = self.out.stub(name)
            if target != me:
                self.out.link(me, target, "references", line, context="generic_arg" if generic else context)

    def calls(self) -> None:
        named = {n["label"].strip("()").lstrip("."): n["id"] for n in self.out.nodes}
        made: set[tuple[str, str]] = set()
        for caller, node in self.bodies:
            for call in self.within(node):
                f = call.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                foreign = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id[:1].isupper()
                target = named.get(name)
                if name and name not in GLOBALS and not foreign and target and target != caller and (caller, target) not in made:
                    made.add((caller, target))
                    self.out.link(caller, target, "calls", call.lineno, context="call")

    @staticmethod
    def within(function: ast.AST):
        """Calls of a body in order of the text, those of inner functions left out."""
        found, waiting = [], list(function.body)
        while waiting:
            node = waiting.pop()
            if isinstance(node, Function):
                continue
            if isinstance(node, ast.Call):
                found.append(node)
            waiting += ast.iter_child_nodes(node)
        return sorted(found, key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset))

    def docstring(self, node: ast.AST, about: str) -> None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            raw = (ast.get_source_segment(self.text, first.value) or "").strip("\"'").strip()
            if len(raw) > 20:
                self.rationale(raw, first.lineno, about)

    def docstrings(self, body: list, about: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                me = make_id(self.out.stem, node.name)
                self.docstring(node, me)
                self.docstrings(node.body, me)
            elif isinstance(node, Function):
                self.docstring(node, make_id(about if about != self.root else self.out.stem, node.name))
            elif not isinstance(node, ast.expr):
                self.docstrings([x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler))], about)

    def rationale(self, text: str, line: int, about: str) -> None:
        label = text[:80].replace("\r\n", " ").replace("\r", " ").replace("\n", " ").strip()
        me = self.out.node(make_id(self.out.stem, "rationale", str(line)), label, line, "rationale")
        self.out.link(me, about, "rationale_for", line)

    def bindings(self, tree: ast.Module) -> None:
        """Names that imports bind and bare calls by scope, for the resolution across files."""
        out = self.out

        def visit(node: ast.AST, scope: tuple[str, ...]) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.ImportFrom):
                    for alias in child.names:
                        if alias.name != "*":
                            out.imports.append({"module": (child.module or "").rsplit(".", 1)[-1], "name": alias.name.rsplit(".", 1)[-1], "alias": alias.asname or alias.name, "line": child.lineno})
                if isinstance(child, ast.Call) and isinstance(child.func, ast.Name):
                    out.calls.append({"caller": make_id(out.stem, *scope) if scope else self.root, "callee": child.func.id, "line": child.lineno})
                visit(child, (*scope, child.name) if isinstance(child, (ast.ClassDef, *Function)) else scope)

        visit(tree, ())


def extract_python(path: str, text: str) -> Emitter:
    return _Walk(path, text).run()
