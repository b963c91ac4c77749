"""Languages with braces, by tables of declaration patterns over text without comments and strings.

A scan finds declarations and the stretches of their bodies; what stands inside a
type belongs to it, what stands inside a function is not a symbol of its own.
References come from the types in headers and fields, calls from the bodies.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.ids import make_id
from .emitter import Emitter
from .names import GLOBALS

WORD = re.compile(r"[A-Za-z_$][\w$]*")


def masked(text: str, line: tuple[str, ...] = ("//",), block: tuple[tuple[str, str], ...] = (("/*", "*/"),), quotes: str = "\"'`", keep_strings: bool = False) -> str:
    """The text with comments and the insides of strings blanked; places and lines stay."""
    marks = [re.escape(x) for x in (*line, *(b[0] for b in block))] + [re.escape(q) for q in quotes]
    opener, out, at = re.compile("|".join(sorted(marks, key=len, reverse=True))), [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    ends = dict(block)
    while m := opener.search(text, at):
        out.append(text[at : m.start()])
        mark = m[0]
        if mark in line:
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
            out.append(blank(text[m.start() : end]))
        elif mark in ends:
            end = text.find(ends[mark], m.end())
            end = len(text) if end < 0 else end + len(ends[mark])
            out.append(blank(text[m.start() : end]))
        else:
            end = m.end()
            while end < len(text) and text[end] != mark and (mark == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, len(text))
            out.append(text[m.start() : end] if keep_strings else mark + blank(text[m.start() + 1 : end - 1]) + (text[end - 1 : end] if end - 1 > m.start() else ""))
        at = end
    return "".join([*out, text[at:]])


def closing(text: str, start: int, pair: str = "{}") -> int:
    """Place behind the bracket that closes the one at ``start``; the end of the text if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, start):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("-", "=")):
            depth -= 1
        elif c == mark and depth <= 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in (*parts, text[at:]) if p.strip()]


def type_names(text: str, noise: frozenset[str], deep: str = "<") -> list[tuple[str, bool]]:
    """(last part of each type's name, whether it stands in angle brackets)."""
    found, depth = [], 0
    for m in re.finditer(r"(?:[A-Za-z_][\w]*(?:\s*(?:::|\.|\\)\s*)?)+|[<>\[\]]", text):
        if m[0] in "<[":
            depth += m[0] in deep
        elif m[0] in ">]":
            depth -= (m[0] == ">" and "<" in deep) or (m[0] == "]" and "[" in deep)
        else:
            name = re.split(r"::|\.|\\", m[0].replace(" ", "").strip(":.\\"))[-1]
            if name and name not in noise:
                found.append((name, depth > 0))
    return found


@dataclass
class Spec:
    types: re.Pattern  # groups: name, head (up to the body)
    functions: re.Pattern  # groups: name, params, result (optional)
    imports: Callable = lambda scan, m: None
    import_pattern: re.Pattern | None = None
    bases: Callable[[str, str], list[tuple[str, str, bool]]] = lambda kind, head: []  # (name, relation, generic)
    typed: str = "after"  # "after": name: Type; "before": Type name; "": no types
    noise: frozenset[str] = frozenset()
    fields: Callable | None = None
    keywords: frozenset[str] = frozenset("if for while switch return catch match when function new sizeof else do throw typeof await using lock foreach guard elseif".split())
    bodiless: bool = True  # whether functions without body are symbols
    constructors: bool = True
    references: bool = True
    deep: str = "<"
    line: tuple[str, ...] = ("//",)
    quotes: str = "\"'`"
    member_calls: str = "upper"  # calls on a receiver that are left out: upper (type names), all, named
    extend: re.Pattern | None = None  # groups: name, head; adds to a type that stands elsewhere
    cases: Callable | None = None
    type_id: Callable | None = None
    pre: Callable | None = None
    new_calls: bool = True
    contexts: dict = field(default_factory=dict)


class Scan:
    def __init__(self, spec: Spec, path: str, text: str):
        self.spec, self.out, self.text = spec, Emitter(path), text
        self.plain = masked(text, spec.line, quotes=spec.quotes)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.root = self.out.file_node()
        self.owners: list[tuple[int, int, str]] = []
        self.bodies: list[tuple[int, int, str]] = []

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def owner(self, at: int) -> str | None:
        inside = [(a, b, o) for a, b, o in self.owners if a <= at < b]
        return max(inside)[2] if inside else None

    def in_body(self, at: int) -> bool:
        return any(a < at < b for a, b, _ in self.bodies)

    def refs(self, source: str, text: str, context: str, line: int) -> None:
        for name, generic in type_names(text, self.spec.noise, self.spec.deep):
            target = self.out.stub(name)
            if target != source:
                self.out.link(source, target, "references", line, context="generic_arg" if generic else context)

    def body(self, at: int) -> tuple[int, int] | None:
        """The braces that follow, before the statement ends."""
        m = re.compile(r"[{;]").search(self.plain, at)
        return (m.start(), closing(self.plain, m.start())) if m and m[0] == "{" else None

    def events(self):
        spec = self.spec
        found = [("type", m) for m in spec.types.finditer(self.plain)] + [("function", m) for m in spec.functions.finditer(self.plain)]
        if spec.import_pattern:
            # import paths may be strings
            found += [("import", m) for m in spec.import_pattern.finditer(masked(self.text, spec.line, quotes=spec.quotes, keep_strings=True))]
        if spec.extend:
            found += [("extend", m) for m in spec.extend.finditer(self.plain)]
        return sorted(found, key=lambda e: (e[1].start(), e[0] == "function"))

    def run(self) -> Emitter:
        events = self.events()
        if self.spec.pre:
            self.spec.pre(self)
        for kind, m in events:
            at = m.start("name") if "name" in m.groupdict() and m["name"] else m.start()
            if kind == "import":
                self.spec.imports(self, m)
            elif self.in_body(at):
                continue
            elif kind == "function":
                self.function(m, at)
            else:
                self.type(kind, m, at)
        self.calls()
        return self.out

    def type(self, kind: str, m: re.Match, at: int) -> None:
        spec, out, name = self.spec, self.out, m["name"]
        if name in spec.keywords:
            return
        line = self.line(m.start("name") if kind == "extend" else at)
        start = self.line(m.start() + len(m[0]) - len(m[0].lstrip()))
        head = (m["head"] if "head" in m.groupdict() else "") or ""
        end = m.end()
        body = (end - 1, closing(self.plain, end - 1)) if self.plain[end - 1 : end] == "{" else None
        outer = self.owner(at)
        me = spec.type_id(self, name) if spec.type_id else make_id(out.stem, name)
        word = (m["kind"] if "kind" in m.groupdict() else "") or ""
        if kind == "type" or me not in out.known:
            out.node(me, name, start)
            out.link(outer if outer and spec.contexts.get("nest") else self.root, me, "contains", start)
        for base, relation, generic in spec.bases(word, head):
            target = spec.type_id(self, base) if spec.type_id and spec.type_id(self, base) in out.known else out.stub(base)
            out.link(me, target, "references" if generic else relation, line, context="generic_arg" if generic else None)
        if body:
            self.owners.append((*body, me))
            if spec.cases:
                spec.cases(self, me, word, *body)
        if spec.fields:
            spec.fields(self, me, word, head, body, start)

    def function(self, m: re.Match, at: int) -> None:
        spec, out, name = self.spec, self.out, m["name"]
        if name in spec.keywords:
            return
        body = self.body(m.end() - 1) if self.plain[m.end() - 1 : m.end()] == "{" else None
        if not body and not spec.bodiless:
            return
        line, owner = self.line(m.start() + len(m[0]) - len(m[0].lstrip())), self.owner(at)
        if "receiver" in m.groupdict() and m["receiver"]:
            owner = spec.type_id(self, m["receiver"]) if spec.type_id else make_id(out.stem, m["receiver"])
            if owner not in out.known:
                owner = None
        if owner:
            if not spec.constructors and out.known[owner]["label"] == name:
                if body:
                    self.bodies.append((*body, owner))
                return
            me = out.node(make_id(owner, name), f".{name}()", line)
            out.link(owner, me, "method", line)
        else:
            me = out.node(make_id(out.stem, name), f"{name}()", line)
            out.link(self.root, me, "contains", line)
        if spec.references:
            self.signature(me, m, line)
        if body:
            self.bodies.append((*body, me))

    def signature(self, me: str, m: re.Match, line: int) -> None:
        groups, spec = m.groupdict(), self.spec
        params = []
        for p in split_top(groups.get("params") or ""):
            p = re.sub(r"\s*=[^>].*$", "", re.sub(r"@\w+(\([^)]*\))?\s*", "", p), flags=re.S)
            if spec.typed == "after" and ":" in p:
                params.append(p.split(":", 1)[1])
            elif spec.typed == "before" and re.search(r"\s|\*|&", p):
                params.append(re.sub(r"[$\w]+\s*(\[\s*\])*$", "", p))
        result = groups.get("result") or ""
        order = [(result, "return_type")] if spec.contexts.get("result_first") else []
        order += [(p, "parameter_type") for p in params] + ([] if order else [(result, "return_type")])
        for text, context in order:
            self.refs(me, text, context, line)

    def calls(self) -> None:
        spec, out = self.spec, self.out
        named = {n["label"].strip("()").lstrip("."): n["id"] for n in out.nodes if not n["id"].startswith("csharp_namespace")}
        pattern = re.compile(r"(?:(?P<on>[\w$\])]+)\s*(?P<how>\.|->|\?\.|::)\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w:, ]+>\s*)?\(")
        made, functions = set(), sorted(self.bodies)
        hits = sorted((m.start("name"), me, m) for a, b, me in functions for m in pattern.finditer(self.plain, a, b))
        for at, me, m in hits:
            name, on = m["name"], m["on"]
            if name in GLOBALS or name in spec.keywords:
                continue
            created = re.search(r"\bnew\s+$", self.plain[: m.start()]) is not None
            if on and not created and (spec.member_calls == "all" or (spec.member_calls == "named" and on not in ("]", ")")) or (spec.member_calls == "upper" and on[:1].isupper() and m["how"] != "::")):
                continue
            target = named.get(name)
            if target and target != me and (me, target) not in made and (not created or spec.new_calls):
                made.add((me, target))
                out.link(me, target, "calls", self.line(at), context="call")


def extractor(spec: Spec) -> Callable[[str, str], Emitter]:
    return lambda path, text: Scan(spec, path, text).run()
