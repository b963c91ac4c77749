"""Languages whose blocks end with a word, and declarative ones: a pass over the lines with a stack of open blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.ids import file_stem, make_id, normpath
from .emitter import Emitter
from .scanner import closing, masked, split_top, type_names


def _number(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _call_links(out: Emitter, bodies: list[tuple[str, int, list[str]]], named: dict[str, str], pattern: re.Pattern, context: str | None = "call", fold: Callable[[str], str] = str) -> None:
    """One link for each (caller, target) from bodies given as (caller, first line, lines)."""
    made = set()
    for caller, first, lines in bodies:
        for k, line in enumerate(lines):
            for name in pattern.findall(line):
                target = named.get(fold(name))
                if target and target != caller and (caller, target) not in made:
                    made.add((caller, target))
                    out.link(caller, target, "calls", first + k, context=context)


def _labels(out: Emitter) -> dict[str, str]:
    return {n["label"].strip("()").lstrip(".-"): n["id"] for n in out.nodes}


def extract_ruby(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("#",), (("=begin", "=end"),), "\"'")
    open_: list[tuple[str, str]] = []
    bodies: list[tuple[str, int, list[str]]] = []
    for number, line in enumerate(plain.splitlines(), 1):
        code = line.strip()
        inside_def = any(k == "def" for k, _ in open_)
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", code):
            name = m[2].rsplit("::", 1)[-1]
            me = out.node(make_id(out.stem, name), name, number)
            out.link(root, me, "contains", number)
            if m[3]:
                out.link(me, out.stub(m[3].rsplit("::", 1)[-1]), "inherits", number)
            open_.append(("class", me))
        elif m := re.match(r"def\s+(?:self\.)?([\w]+[?!=]?)", code):
            owner = next((o for k, o in reversed(open_) if k == "class"), None)
            if owner:
                me = out.node(make_id(owner, m[1]), f".{m[1]}()", number)
                out.link(owner, me, "method", number)
            else:
                me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
                out.link(root, me, "contains", number)
            if not re.search(r"\)\s*=\s|\bend\s*$", code):
                open_.append(("def", me))
                bodies.append((me, number + 1, []))
            continue
        elif re.match(r"(?:if|unless|while|until|for|case|begin)\b", code) or re.search(r"\bdo\b\s*(?:\|[^|]*\|)?$", code):
            open_.append(("", ""))
        elif re.match(r"end\b", code) and open_:
            open_.pop()
        if inside_def and bodies:
            bodies[-1][2].append(line)
    _call_links(out, bodies, _labels(out), re.compile(r"(?<![.\w@:])([a-z_]\w*[?!]?)\s*\("))
    return out


def extract_lua(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("--",), (("--[[", "]]"),), "\"'")
    for m in re.finditer(r"\brequire\s*\(?\s*[\"']([^\"']+)[\"']", text):
        # the module's file is looked for in this folder and the five above it
        rest, folder, paths = m[1].replace(".", "/"), path.rpartition("/")[0], []
        for _ in range(6):
            paths += [f"{folder}/{rest}{tail}".lstrip("/") for tail in (".lua", ".luau", "/init.lua", "/init.luau")]
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out.choose(make_id(m[1]), paths)
        out.link(root, make_id(m[1]), "imports", _number(text, m.start()), context="import")
    heads = list(re.finditer(r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)\s*\(", plain, re.M))
    bodies = []
    for m in heads:
        number = _number(plain, m.start(1))
        me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
        out.link(root, me, "contains", number)
        end = re.compile(r"^(?:end\b|\S)", re.M).search(plain, plain.find("\n", m.end()) + 1)
        bodies.append((me, number, plain[m.end() : end.start() if end else len(plain)].split("\n")))
    _call_links(out, bodies, {n["label"].removesuffix("()"): n["id"] for n in out.nodes}, re.compile(r"([\w.:]+)\s*\("))
    return out


def extract_bash(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    ending = out.name.rpartition(".")[2]
    entry = out.node(f"{root}_{make_id(ending)}__entry", f"{out.name} script", 1)
    out.link(root, entry, "contains", 1)
    folder = path.rpartition("/")[0]
    plain = masked(text, (), (), "'")
    lines = [re.sub(r"(^|\s)#.*$", "", x) for x in plain.split("\n")]
    functions: dict[str, str] = {}
    bodies: list[tuple[str, int, list[str]]] = [(entry, 1, [])]
    at = 0
    while at < len(lines):
        line, number = lines[at], at + 1
        if m := re.match(r"\s*(?:function\s+([\w:-]+)\s*(?:\(\))?|([\w:-]+)\s*\(\))\s*\{?", line):
            name = m[1] or m[2]
            me = functions[name] = out.node(make_id(out.stem, name), f"{name}()", number)
            out.link(root, me, "defines", number)
            depth, body = line.count("{") - line.count("}"), []
            while at + 1 < len(lines) and (depth > 0 or not body):
                at += 1
                depth += lines[at].count("{") - lines[at].count("}")
                body.append(lines[at])
            bodies.append((me, number + 1, body))
        else:
            if m := re.match(r"\s*(?:export|declare|readonly)\s+(?:-\w+\s+)*([A-Za-z_]\w*)=", line):
                out.link(root, out.node(make_id(out.stem, m[1]), m[1], number), "defines", number)
            elif m := re.match(r"\s*(?:source|\.)\s+[\"']?([^\s\"'$`;|&]+)", line):
                if m[1][0] in "./":
                    where = out.beside(m[1])
                    out.link_if(where, root, make_id(file_stem(where)), "imports_from", number, context="import")
                else:
                    out.link(root, make_id(m[1]), "imports", number, context="import")
            bodies[0][2].append(line)
        at += 1
    made = set()
    for caller, first, body in bodies:
        for k, line in enumerate(body):
            for part in re.split(r"&&|\|\||[;|]|\$\(|`", line):
                m = re.match(r"\s*(?:(?:if|then|else|do|while|until|!|time)\s+)*([\w:-]+)", part)
                target = functions.get(m[1]) if m else None
                if target and target != caller and (caller, target) not in made:
                    made.add((caller, target))
                    out.link(caller, target, "calls", first + k, context="call")
            if m := re.match(r"\s*(\.{0,2}/?[\w./-]+\.sh)\b", line):
                where = out.beside(m[1])
                out.link_if(where, caller, make_id(where) + "__entry", "calls", first + k, context="script_invocation")
            if m := re.match(r"\s*(?:bash|sh)\s+[\"']?(\.{0,2}/?[\w./-]+\.sh)\b", line):
                target = normpath(f"{folder}/{m[1]}" if folder else m[1])
                out.link(caller, make_id(target) + "__entry", "calls", first + k, context="script_invocation")
    return out


def extract_elixir(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("#",), (('"""', '"""'),), '"')
    module, bodies = None, []
    for number, line in enumerate(plain.splitlines(), 1):
        code = line.strip()
        if m := re.match(r"defmodule\s+([\w.]+)", code):
            module = out.node(make_id(out.stem, m[1]), m[1], number)
            out.link(root, module, "contains", number)
        elif m := re.match(r"(?:alias|import|require|use)\s+([\w.]+?)(?:\.\{([^}]*)\})?(?:,|\s|$)", code):
            for name in [f"{m[1]}.{x.strip()}" for x in m[2].split(",")] if m[2] else [m[1]]:
                out.link(root, make_id(name), "imports", number, context="import")
        elif m := re.match(r"defp?\s+([\w?!]+)", code):
            owner = module or root
            me = out.node(make_id(owner, m[1]), f"{m[1]}()", number)
            out.link(owner, me, "method" if module else "contains", number)
            bodies.append((me, number + 1, []))
        elif bodies:
            bodies[-1][2].append(line)
    _call_links(out, bodies, _labels(out), re.compile(r"(?<![.\w:@])([a-z_]\w*[?!]?)\("))
    return out


def extract_julia(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("#",), (("#=", "=#"),), '"')
    open_: list[tuple[str, str]] = [("file", root)]
    bodies: list[tuple[str, int, list[str]]] = []
    scope = lambda: next(o for k, o in reversed(open_) if k in ("file", "module"))
    for number, line in enumerate(plain.splitlines(), 1):
        code = line.strip()
        if m := re.match(r"(?:bare)?module\s+(\w+)", code):
            me = out.node(make_id(out.stem, m[1]), m[1], number)
            out.link(scope(), me, "defines", number)
            open_.append(("module", me))
        elif m := re.match(r"(?:using|import)\s+([^:]+)", code):
            for name in filter(None, (x.strip().lstrip(".") for x in m[1].split(","))):
                out.link(scope(), out.node(make_id(name), name, number), "imports", number, context="import")
        elif m := re.match(r"(abstract type|primitive type|mutable struct|struct)\s+(\w+)(?:\{[^}]*\})?(?:\s*<:\s*([\w.]+))?", code):
            me = out.node(make_id(out.stem, m[2]), m[2], number)
            out.link(scope(), me, "defines", number)
            if m[3]:
                out.link(me, out.stub(m[3].rsplit(".", 1)[-1]), "inherits", number)
            if not re.search(r"\bend\b", code):
                open_.append(("struct", me))
        elif m := re.match(r"(?:function|macro)\s+([\w.!]+)\s*(?:\{[^}]*\})?\(", code):
            me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
            out.link(scope(), me, "defines", number)
            open_.append(("function", me))
            bodies.append((me, number + 1, []))
        elif m := re.match(r"([A-Za-z_][\w!]*)\([^()]*\)(?:::\w+)?\s*=(?!=)\s*(.*)", code):
            me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
            out.link(scope(), me, "defines", number)
            bodies.append((me, number, [m[2]]))
        elif re.match(r"(?:if|for|while|begin|let|try|quote|do)\b", code):
            open_.append(("", ""))
        elif re.match(r"end\b", code) and len(open_) > 1:
            open_.pop()
        elif open_[-1][0] == "struct" and (m := re.match(r"\w+\s*::\s*(.+)", code)):
            for name, generic in type_names(m[1], frozenset(), "{"):
                out.link(open_[-1][1], out.stub(name), "references", number, context="generic_arg" if generic else "field")
        elif bodies and any(k == "function" for k, _ in open_):
            bodies[-1][2].append(line)
    made = set()
    for caller, first, lines in bodies:
        for k, line in enumerate(lines):
            for name in re.findall(r"(?<![.\w])([A-Za-z_][\w!]*)\s*\(", line):
                target = make_id(out.stem, name)
                if target != caller and (caller, target) not in made:
                    made.add((caller, target))
                    out.link(caller, target, "calls", first + k, context="call")
    return out


def extract_fortran(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("!",), (), "\"'").lower()
    open_: list[tuple[str, str]] = [("file", root)]
    bodies: list[tuple[str, int, list[str]]] = []
    params: dict[str, tuple[set[str], str]] = {}
    for number, line in enumerate(plain.splitlines(), 1):
        code = line.strip()
        holder = next(o for k, o in reversed(open_) if k != "procedure")
        if re.match(r"end\s*(?:module|program|subroutine|function|type|interface|if|do|select)?\b", code) and not re.match(r"end\s*(?:if|do|select)\b", code):
            if len(open_) > 1:
                open_.pop()
        elif (m := re.match(r"(module|program)\s+(\w+)$", code)) and m[2] != "procedure":
            me = out.node(make_id(out.stem, m[2]), m[2], number)
            out.link(root, me, "defines", number)
            open_.append((m[1], me))
            if m[1] == "program":
                bodies.append((me, number + 1, []))
        elif m := re.match(r"use\s*(?:,\s*\w+\s*::)?\s*(\w+)", code):
            out.link(holder, out.node(make_id(m[1]), m[1], number), "imports", number, context="use")
        elif m := re.match(r"type\s*(?:,[^:]*)?(?:::)?\s+(\w+)$|type\s*::\s*(\w+)", code):
            name = m[1] or m[2]
            me = out.node(make_id(out.stem, name), name, number)
            out.link(holder, me, "defines", number)
            open_.append(("type", me))
        elif m := re.match(r"(?:(?:pure|elemental|recursive|integer|real|logical|character|double precision|type\(\w+\))\s*(?:\([^)]*\))?\s+)*(subroutine|function)\s+(\w+)\s*(?:\(([^)]*)\))?(?:.*result\s*\(\s*(\w+)\s*\))?", code):
            me = out.node(make_id(out.stem, m[2]), f"{m[2]}()", number)
            out.link(holder, me, "defines", number)
            open_.append(("procedure", me))
            bodies.append((me, number + 1, []))
            params[me] = ({x.strip() for x in (m[3] or "").split(",")}, m[4] or (m[2] if m[1] == "function" else ""))
        elif open_[-1][0] == "procedure" and (m := re.match(r"(?:type|class)\s*\(\s*(\w+)\s*\)[^:]*::\s*(.+)", code)):
            me = open_[-1][1]
            for name in (re.match(r"\w+", x.strip()) for x in m[2].split(",")):
                if name and (name[0] in params[me][0] or name[0] == params[me][1]):
                    out.link(me, out.stub(m[1]), "references", number, context="parameter_type" if name[0] in params[me][0] else "return_type")
        elif bodies:
            bodies[-1][2].append(line)
    named = {n["label"].removesuffix("()"): n["id"] for n in out.nodes if n["label"].endswith("()")}
    _call_links(out, bodies, named, re.compile(r"(?:call\s+)?(\w+)\s*\("))
    return out


def extract_zig(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("//",), (), '"')
    for m in re.finditer(r'@import\("([^"]+)"\)', text):
        out.link(root, make_id(re.sub(r"\.zig$", "", m[1].rsplit("/", 1)[-1])), "imports_from", _number(text, m.start()))
    owners = []
    for m in re.finditer(r"\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union|opaque)\b(?:\([^)]*\))?\s*\{", plain):
        number = _number(plain, m.start())
        me = out.node(make_id(out.stem, m[1]), m[1], number)
        out.link(root, me, "contains", number)
        owners.append((m.end() - 1, closing(plain, m.end() - 1), me))
    bodies = []
    for m in re.finditer(r"\bfn\s+(\w+)\s*\(", plain):
        number, owner = _number(plain, m.start()), next((o for a, b, o in owners if a < m.start() < b), None)
        me = out.node(make_id(owner, m[1]), f".{m[1]}()", number) if owner else out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
        out.link(owner or root, me, "method" if owner else "contains", number)
        start = plain.find("{", m.end())
        if start >= 0:
            bodies.append((me, _number(plain, start), plain[start : closing(plain, start)].split("\n")))
    named: dict[str, str] = {}
    for n in out.nodes:
        if n["label"].endswith("()"):
            named.setdefault(n["label"].strip(".()"), n["id"])
    _call_links(out, bodies, named, re.compile(r"(?<![.@\w])(\w+)\s*\("), None)
    return out


def extract_sql(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node(line=None)
    out.nodes[0]["source_location"] = None
    plain = masked(text, ("--",), (("/*", "*/"),), "'")
    bare = lambda n: n.replace('"', "").replace("`", "").replace("[", "").replace("]", "")
    pattern = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+|unique\s+)*(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)(.*?)(?=\bcreate\s+(?:or\s+replace\s+)?(?:temp|materialized|table|view|function|procedure|trigger)|\Z)", re.I | re.S)
    for m in pattern.finditer(plain):
        kind, name, number = m[1].lower(), bare(m[2]), _number(plain, m.start())
        me = out.node(make_id(out.stem, name), f"{name}()" if kind in ("function", "procedure") else name, number)
        out.link(root, me, "contains", number)
        rest = m[3].split(";")[0] if kind in ("table", "view", "trigger") else ""
        if kind == "table":
            for r in re.finditer(r"\breferences\s+([\w.\"`\[\]]+)", rest, re.I):
                out.link(me, out.stub(bare(r[1])), "references", _number(plain, m.start(3) + r.start()))
        elif kind == "view":
            for r in re.finditer(r"\b(?:from|join)\s+([\w.\"`\[\]]+)", rest, re.I):
                out.link(me, out.stub(bare(r[1])), "reads_from", _number(plain, m.start(3) + r.start()))
        elif kind == "trigger" and (r := re.search(r"\bon\s+([\w.\"`\[\]]+)", rest, re.I)):
            out.link(me, out.stub(bare(r[1])), "triggers", number)
    for m in re.finditer(r"\balter\s+table\s+(?:only\s+)?([\w.\"`\[\]]+)[^;]*?\breferences\s+([\w.\"`\[\]]+)", plain, re.I | re.S):
        out.link(out.stub(bare(m[1])), out.stub(bare(m[2])), "references", _number(plain, m.start()))
    return out


def extract_terraform(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node(line=None)
    out.nodes[0]["source_location"] = None
    folder = path.rpartition("/")[0].rsplit("/", 1)[-1]
    plain = masked(text, ("#", "//"), (("/*", "*/"),), "", True)
    me_of = lambda address: make_id(folder, address)
    found: list[tuple[str, int, str]] = []

    def add(address: str, at: int, body: str) -> None:
        number = _number(plain, at)
        out.link(root, out.node(me_of(address), address, number), "contains", number)
        found.append((address, number, body))

    for m in re.finditer(r'^(\w+)((?:[ \t]+"[^"]*")*)[ \t]*\{', plain, re.M):
        names = re.findall(r'"([^"]*)"', m[2])
        body = plain[m.end() - 1 : closing(plain, m.end() - 1)]
        if m[1] == "locals":
            for x in re.finditer(r"^\s*(\w+)\s*=\s*([^\n]*)", body[1:-1], re.M):
                add(f"local.{x[1]}", m.end() + x.start(1), x[2])
        elif m[1] in ("variable", "module", "output", "data", "resource", "provider") and names:
            head = {"variable": "var.", "module": "module.", "output": "output.", "data": "data.", "provider": "provider."}.get(m[1], "")
            add(head + ".".join(names), m.start(), body)
    for address, number, body in found:
        depends = re.search(r"depends_on\s*=\s*\[([^\]]*)\]", body)
        for part, relation in ((re.sub(r"depends_on\s*=\s*\[[^\]]*\]", "", body), "references"), (depends[1] if depends else "", "depends_on")):
            part = re.sub(r'"[^"]*"', lambda s: " ".join(re.findall(r"\$\{([^}]*)\}", s[0])), part)
            for x in re.finditer(r"\b(var|local|module)\.(\w+)|\bdata\.(\w+)\.(\w+)|(?<![\w.])([a-z][a-z0-9]*_\w+)\.(\w+)", part):
                target = f"{x[1]}.{x[2]}" if x[1] else f"data.{x[3]}.{x[4]}" if x[3] else f"{x[5]}.{x[6]}"
                if target != address:
                    out.link(me_of(address), me_of(target), relation, number)
    if not path.endswith(".tfvars"):
        return out
    out.nodes, out.links = out.nodes[:1], []
    return out


def extract_powershell(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("#",), (("<#", "#>"),), "\"'")
    for m in re.finditer(r"^\s*using\s+(?:namespace|module|assembly)\s+([\w.]+)|^\s*Import-Module\s+([\w.]+)|^\s*\.\s+[\"']?([\w./\\$-]+)\.ps1", plain, re.M | re.I):
        name = re.split(r"[./\\]", m[1] or m[2] or m[3])[-1]
        out.link(root, make_id(name), "imports_from", _number(plain, m.start() + len(m[0]) - len(m[0].lstrip())))
    blocks = [("class", m) for m in re.finditer(r"^\s*class\s+(\w+)(?:\s*:\s*([\w, .]+))?\s*\{", plain, re.M | re.I)] + [("function", m) for m in re.finditer(r"^\s*(?:function|filter)\s+([\w:-]+)[^{]*\{", plain, re.M | re.I)]
    bodies = []
    for kind, m in sorted(blocks, key=lambda b: b[1].start()):
        number = _number(plain, m.start(1))
        end = closing(plain, m.end() - 1)
        if kind == "function":
            me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
            out.link(root, me, "contains", number)
            bodies.append((me, _number(plain, m.end()), plain[m.end() : end].split("\n")))
            continue
        me = out.node(make_id(out.stem, m[1]), m[1], number)
        out.link(root, me, "contains", number)
        for i, base in enumerate(x.strip() for x in (m[2] or "").split(",") if x.strip()):
            out.link(me, out.stub(base), "inherits" if i == 0 else "implements", number)
        at = m.end()
        for x in re.finditer(r"^\s*(?:(?:hidden|static)\s+)*(?:\[([\w.\[\]]+)\]\s*)?(?:\$(\w+)|(\w+)\s*\(([^)]*)\)\s*\{)", plain[at:end], re.M):
            if x.start() < 0 or plain[at : at + x.start()].count("{") != plain[at : at + x.start()].count("}"):
                continue
            line = _number(plain, at + x.start() + len(x[0]) - len(x[0].lstrip()))
            if x[2]:
                for name, _ in type_names(x[1] or "", frozenset()):
                    out.link(me, out.stub(name), "references", line, context="field")
                continue
            method = out.node(make_id(me, x[3]), f".{x[3]}()", line)
            out.link(me, method, "method", line)
            for name, _ in type_names(x[1] or "", frozenset()):
                out.link(method, out.stub(name), "references", line, context="return_type")
            for p in re.findall(r"\[([\w.\[\]]+)\]\s*\$", x[4]):
                for name, _ in type_names(p, frozenset()):
                    out.link(method, out.stub(name), "references", line, context="parameter_type")
    named = {n["label"].removesuffix("()").lower(): n["id"] for n in out.nodes if n["label"].endswith("()") and not n["label"].startswith(".")}
    _call_links(out, bodies, named, re.compile(r"(?<![\w$.-])([A-Za-z]+-\w+|\w+)(?=\s|\)|$)"), None, str.lower)
    return out


def extract_psd1(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("#",), (("<#", "#>"),), "", True)
    for key in ("RootModule", "ModuleToProcess", "NestedModules", "RequiredModules"):
        for m in re.finditer(rf"^\s*{key}\s*=\s*(@\((?:[^()]|\([^()]*\))*\)|[^\n]+)", plain, re.M | re.I):
            for x in re.finditer(r"ModuleName\s*=\s*['\"]([^'\"]+)['\"]|(?<![=\w]\s)(?<!=)['\"]([^'\"]+)['\"]", re.sub(r"(?:ModuleVersion|GUID|RequiredVersion|MaximumVersion)\s*=\s*['\"][^'\"]*['\"]", "", m[1])):
                name = re.sub(r"\.(?:psm1|psd1|ps1|dll)$", "", (x[1] or x[2]).replace("\\", "/").rsplit("/", 1)[-1])
                out.link(root, make_id(name), "imports_from", _number(plain, m.start(1) + x.start()), context="import")
    return out


def extract_objc(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("//",), (("/*", "*/"),), '"')
    for m in re.finditer(r"^\s*#\s*(?:import|include)\s*[<\"]([^>\"]+)[>\"]", text, re.M):
        name = m[1].split("/")[0] if "<" in m[0] and "/" in m[1] else m[1].rsplit("/", 1)[-1]
        out.link(root, make_id(re.sub(r"\.h$", "", name)), "imports", _number(text, m.start()), context="import")
    types: dict[str, str] = {}
    bodies: list[tuple[str, str, int, str]] = []
    for m in re.finditer(r"@(interface|implementation|protocol)\s+(\w+)(?:\s*\(\w*\))?(?:\s*:\s*(\w+))?(?:\s*<([^>]*)>)?(?!\s*;)(.*?)@end", plain, re.S):
        kind, name, number = m[1], m[2], _number(plain, m.start())
        label = f"<{name}>" if kind == "protocol" else name
        fresh = make_id(out.stem, name) not in out.known
        me = types[name] = out.node(make_id(out.stem, name), label, number)
        if fresh:
            out.link(root, me, "contains", number)
        if m[3]:
            out.link(me, types.get(m[3]) or out.stub(m[3]), "inherits", number)
        for p in filter(None, (x.strip() for x in (m[4] or "").split(","))):
            out.link(me, types.get(p) or out.stub(p), "implements", number)
        for x in re.finditer(r"@property\s*(?:\([^)]*\))?\s*([\w<>, ]+?)\s*\*?\s*\w+\s*;", m[5]):
            for t, generic in type_names(x[1], frozenset("int float double BOOL NSInteger NSUInteger CGFloat id char long short unsigned nonatomic strong".split())):
                out.link(me, types.get(t) or out.stub(t), "references", _number(plain, m.start(5) + x.start()), context="generic_arg" if generic else "field")
        for x in re.finditer(r"^\s*[-+]\s*\([^)]*\)\s*(\w+)[^;{]*?([;{])", m[5], re.M):
            at = m.start(5) + x.start() + len(x[0]) - len(x[0].lstrip())
            line = _number(plain, at)
            method = out.node(make_id(me, x[1]), f"{plain[at]}{x[1]}", line)
            out.link(me, method, "method", line)
            if x[2] == "{":
                start = m.start(5) + x.end() - 1
                bodies.append((method, me, start, plain[start : closing(plain, start)]))
    named = {re.sub(r"\W", "", n["label"]): n["id"] for n in out.nodes}
    for method, owner, start, body in bodies:
        for x in re.finditer(r"\[\s*(self|super)\s+(\w+)", body):
            line, target = _number(plain, start + x.start()), named.get(x[2])
            own = make_id(owner, x[2])
            target = own if own in out.known else target
            if target and target != method:
                out.link(method, target, "calls", line, context="call")
            if not target or target != own or x[1] == "super":
                out.link(method, owner, "references", line, context="call")
    return out


def extract_dart(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.node(make_id(out.stem), out.name, location=None)
    plain = masked(text, ("//",), (("/*", "*/"),), "\"'")
    own = lambda name: out.node(make_id(out.stem, name), name, location=None)
    for m in re.finditer(r"^\s*(?:abstract\s+|base\s+|final\s+|sealed\s+|interface\s+)*(class|mixin|enum|extension)\s+(?:class\s+)?(\w+)([^{;]*)", plain, re.M):
        me, head = own(m[2]), m[3]
        out.link(root, me, "defines")
        for word, relation in (("extends", "inherits"), ("with", "mixes_in"), ("implements", "implements"), ("on", "extends")):
            if x := re.search(rf"\b{word}\s+(.*?)(?=\b(?:extends|with|implements|on)\b|$)", head, re.S):
                for part in split_top(x[1]):
                    out.link(me, out.stub(re.match(r"[\w.]+", part)[0], re.match(r"[\w.]+", part)[0]), relation)
    for m in re.finditer(r"^typedef\s+(\w+)", plain, re.M):
        out.link(root, own(m[1]), "defines")
        out.link(root, out.node("typedef", "typedef", source_file="", location=None), "references", context="variable_type")
    for m in re.finditer(r"^\s+(?:late\s+|static\s+)*(?:final|const|var)\s+(?:[\w<>?]+\s+)?(\w+)\s*(?:=[^;]*)?;", plain, re.M):
        if not re.match(r"\s{4,}", m[0].lstrip("\n")):
            out.link(root, own(m[1]), "defines")
    for m in re.finditer(r"^\s*(?:static\s+|external\s+|override\s+)*(?:[\w<>?, ]+\s+)(?:get\s+)?([a-z_]\w*)\s*\([^)]*\)\s*(?:async\s*\*?\s*)?(?:\{|=>|;)", plain, re.M):
        if m[1] not in ("if", "for", "while", "switch", "catch", "return") and not re.match(r"\s*(?:return|await|throw|new|else)\b", m[0]):
            out.link(root, own(m[1]), "defines")
    for m in re.finditer(r"^\s*(import|export|part)\s+['\"]([^'\"]+)['\"]", text, re.M):
        out.link(root, out.node(make_id(m[2]), m[2], source_file="", location=None), "exports" if m[1] == "export" else "imports")
    return out


def extract_verilog(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("//",), (("/*", "*/"),), '"')
    score = {"confidence_score": 1.0}
    classes = list(re.finditer(r"^\s*(?:virtual\s+)?(?:interface\s+)?class\s+(\w+)\s*(?:#\s*\((?:[^()]|\([^()]*\))*\))?\s*(?:extends\s+(\w+)[^;]*?)?(?:implements\s+([\w, ]+))?\s*;(.*?)\bendclass", plain, re.M | re.S))
    outside = plain
    for m in classes:
        outside = outside[: m.start()] + re.sub(r"[^\n]", " ", m[0]) + outside[m.end() :]
    skip = frozenset("module begin end if else for case assign always initial wire reg logic input output inout parameter localparam function task return import typedef".split())
    for m in re.finditer(r"^\s*(?:module|macromodule)\s+(\w+)(.*?)\bendmodule", outside, re.M | re.S):
        number = _number(outside, m.start(1))
        me = out.node(make_id(out.stem, m[1]), m[1], number)
        out.link(root, me, "defines", number, **score)
        at = m.start(2)
        for x in re.finditer(r"\bimport\s+(\w+)::", m[2]):
            line = _number(outside, at + x.start())
            out.link(me, out.node(make_id(x[1]), x[1], line), "imports_from", line, **score)
        for x in re.finditer(r"\b(function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)*?(\w+)\s*[(;]", m[2]):
            line = _number(outside, at + x.start())
            node = out.node(make_id(me, x[2]), f"{x[2]}()" if x[1] == "function" else x[2], line)
            out.link(me, node, "contains", line, **score)
        flat = re.sub(r"\b(?:function|task)\b.*?\bend(?:function|task)\b", lambda s: re.sub(r"[^\n]", " ", s[0]), m[2], flags=re.S)
        for x in re.finditer(r"^\s*(\w+)\s+(?:#\s*\([^;]*?\)\s*)?(\w+)\s*\([^;]*\)\s*;", flat, re.M):
            if x[1] not in skip:
                line = _number(outside, at + x.start(1))
                out.link(me, out.node(make_id(x[1]), x[1], line), "instantiates", line, **score)
    for m in classes:
        out.link(root, out.node(make_id(out.stem, m[1]), m[1], _number(plain, m.start(1))), "defines", _number(plain, m.start(1)), **score)
        me, at = make_id(out.stem, m[1]), m.start(4)
        number = _number(plain, m.start(1))
        if m[2]:
            out.link(me, out.stub(m[2]), "inherits", number, **score)
        for p in split_top(m[3] or ""):
            out.link(me, out.stub(p), "implements", number, **score)
        builtin = frozenset("int bit logic byte string real void time integer shortint longint reg rand randc protected local static const virtual automatic".split())

        def refs(source: str, kind: str, context: str, line: int) -> None:
            for n, g in type_names(kind.replace("#", "").replace("(", "<").replace(")", ">"), builtin):
                known = make_id(out.stem, n)
                if known in out.known:
                    out.link(source, known, "references", line, context="generic_arg" if g else context, **score)

        for x in re.finditer(r"\bfunction\s+(?:automatic\s+|virtual\s+|static\s+)*([\w:]+\s*(?:#\s*\([^()]*\))?)\s+(\w+)\s*\(|\btask\s+(?:automatic\s+)?()(\w+)\s*[(;]", m[4]):
            line, name = _number(plain, at + x.start()), x[2] or x[4]
            method = out.node(make_id(me, name), name, line)
            out.link(me, method, "method", line, **score)
            refs(method, x[1] or "", "return_type", line)
        flat = re.sub(r"\b(?:function|task)\b.*?\bend(?:function|task)\b", lambda s: re.sub(r"[^\n]", " ", s[0]), m[4], flags=re.S)
        for x in re.finditer(r"^\s*((?:(?:rand|randc|protected|local|static|const)\s+)*[\w:]+\s*(?:#\s*\([^()]*\))?)\s+\w+\s*(?:=[^;]*)?;", flat, re.M):
            refs(me, x[1], "field", _number(plain, at + x.start(1)))
    return out


def extract_pascal(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("//",), (("{", "}"), ("(*", "*)")), "'")
    unit = re.search(r"^\s*(?:unit|program|library|package)\s+([\w.]+)\s*;", plain, re.M | re.I)
    scope = root
    if unit:
        scope = out.node(make_id(out.stem, unit[1]), unit[1], _number(plain, unit.start(1)))
        out.link(root, scope, "contains", _number(plain, unit.start(1)))
    for m in re.finditer(r"\buses\b([^;]*);", plain, re.I):
        for x in re.finditer(r"[\w.]+(?=\s*(?:,|$|\bin\b))", m[1]):
            out.link(scope, make_id(x[0]), "imports", _number(plain, m.start(1) + x.start()), context="import")
    parents: dict[str, list[str]] = {}
    for m in re.finditer(r"^\s*(\w+)\s*=\s*(?:packed\s+)?(class|interface|record|object)\b(?!\s+of\b)\s*(?:\(([^)]*)\))?(?!\s*;)", plain, re.M | re.I):
        number = _number(plain, m.start(1))
        me = out.node(make_id(out.stem, m[1]), m[1], number)
        out.link(scope, me, "contains", number)
        for base in split_top(m[3] or ""):
            own = make_id(out.stem, base)
            target = own if own in out.known else out.node(make_id(base), base, number)
            parents.setdefault(me, []).append(target)
            out.link(me, target, "inherits", number)
    bodies = []
    implementation = re.search(r"\bimplementation\b", plain, re.I)
    start = implementation.end() if implementation else 0
    heads = list(re.finditer(r"^\s*(?:class\s+)?(?:procedure|function|constructor|destructor|operator)\s+(?:(\w+)\.)?(\w+)", plain[start:], re.M | re.I))
    for i, m in enumerate(heads):
        at = start + m.start() + len(m[0]) - len(m[0].lstrip())
        number = _number(plain, at)
        owner = make_id(out.stem, m[1]) if m[1] else None
        if owner and owner in out.known:
            me = out.node(make_id(owner, m[2]), f"{m[2]}()", number)
            out.link(owner, me, "method", number)
        else:
            owner, me = None, out.node(make_id(out.stem, m[2]), f"{m[2]}()", number)
            out.link(scope, me, "contains", number)
        end = start + heads[i + 1].start() if i + 1 < len(heads) else len(plain)
        bodies.append((me, owner, start + m.end(), plain[start + m.end() : end]))
    made = set()
    for me, owner, at, body in bodies:
        begin = re.search(r"\bbegin\b", body, re.I)
        for x in re.finditer(r"(?<![.\w])([A-Za-z_]\w*)(?=\s*[;(])", body[begin.end() :] if begin else ""):
            if re.search(r"\binherited\s+$", body[: begin.end() + x.start()], re.I):
                continue
            level, target = [owner] if owner else [], None
            while level and not target:  # own class, then its ancestors, level by level
                hits = [make_id(c, x[1]) for c in level if make_id(c, x[1]) in out.known]
                target = hits[0] if len(set(hits)) == 1 else None
                level = [p for c in level for p in parents.get(c, ())] if not hits else []
            target = target or (make_id(out.stem, x[1]) if out.known.get(make_id(out.stem, x[1]), {}).get("label", "").endswith("()") else None)
            if target and target != me and (me, target) not in made:
                made.add((me, target))
                out.link(me, target, "calls", _number(plain, at + begin.end() + x.start()), context="call")
    return out


def extract_apex(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node()
    plain = masked(text, ("//",), (("/*", "*/"),), "'")
    if m := re.search(r"^\s*trigger\s+(\w+)\s+on\s+(\w+)", plain, re.M | re.I):
        number = _number(plain, m.start(1))
        me = out.node(make_id(out.stem, m[1]), m[1], number)
        out.link(root, me, "contains", number)
        out.link(me, out.node(make_id(m[2]), m[2], number), "uses", number, confidence="INFERRED")
        return out
    current, marks = None, []
    for number, line in enumerate(plain.splitlines(), 1):
        code = line.strip()
        marks += re.findall(r"^@(\w+)", code)
        if m := re.search(r"\b(class|interface|enum)\s+(\w+)([^{]*)", code):
            me = out.node(make_id(out.stem, m[2]), m[2], number)
            out.link(current or root, me, "contains", number)
            for word, relation in (("extends", "extends"), ("implements", "implements")):
                if x := re.search(rf"\b{word}\s+(.*?)(?=\b(?:extends|implements)\b|$)", m[3]):
                    for base in split_top(x[1]):
                        out.link(me, out.stub(re.match(r"\w+", base)[0]), relation, number)
            if m[1] == "class" and not current:
                current = me
            marks = []
        elif current and (m := re.match(r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|global|static|virtual|override|abstract|testmethod|webservice)\s+)*[\w.]+(?:<[\w<>, .]+>)?(?:\[\])?\s+(\w+)\s*\([^)]*\)\s*[{;]", code, re.I)) and not re.match(r"(?:return|new|else|throw)\b", code):
            me = out.node(make_id(current, m[1]), f".{m[1]}()", number)
            out.link(current, me, "method", number)
            if {x.lower() for x in marks} & {"auraenabled", "invocablemethod"}:
                out.link(root, me, "contains", number, confidence="INFERRED")
            marks = []
        if current:
            for x in re.finditer(r"\[\s*SELECT\b.*?\bFROM\s+(\w+)", code, re.I):
                out.link(current, out.node(make_id(x[1]), x[1], number), "uses", number, confidence="INFERRED")
            if m := re.match(r"(insert|update|delete|upsert|undelete|merge)\s+\w", code):
                out.link(current, out.node(make_id("dml", m[1]), m[1], number), "uses", number, confidence="INFERRED")
    return out


def _simple(functions: str, imports: str, line: tuple[str, ...], types: str = "(?!)()", quotes: str = '"', fold: bool = False):
    """Contained functions and types, imports, and calls between the functions; for languages of plain shape."""

    def run(path: str, text: str) -> Emitter:
        out = Emitter(path)
        root = out.file_node()
        plain = masked(text, line, (("/*", "*/"),), quotes)
        for m in re.finditer(imports, masked(text, line, (("/*", "*/"),), "", True), re.M | re.I):
            name = next((g for g in m.groups() if g), "")
            out.link(root, make_id(re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1]) if "/" in name else name), "imports", _number(text, m.start()), context="import")
        for m in re.finditer(types, plain, re.M | re.I):
            number = _number(plain, m.start(1))
            me = out.node(make_id(out.stem, m[1]), m[1], number)
            out.link(root, me, "contains", number)
            for base in split_top(m[2] if m.re.groups > 1 and m[2] else ""):
                out.link(me, out.stub(re.match(r"[\w.]+", base)[0]), "inherits", number)
        heads = list(re.finditer(functions, plain, re.M | re.I))
        bodies = []
        for i, m in enumerate(heads):
            number = _number(plain, m.start(1))
            me = out.node(make_id(out.stem, m[1]), f"{m[1]}()", number)
            out.link(root, me, "contains", number)
            end = heads[i + 1].start() if i + 1 < len(heads) else len(plain)
            bodies.append((me, number, plain[m.end() : end].split("\n")))
        change = str.lower if fold else str
        named = {change(n["label"].removesuffix("()")): n["id"] for n in out.nodes if n["label"].endswith("()")}
        _call_links(out, bodies, named, re.compile(r"(?<![.\w])([A-Za-z_][\w.]*)\s*[(;]" if fold else r"(?<![.\w])([A-Za-z_][\w.]*)\s*\("), "call", change)
        return out

    return run


EXTRACTORS = {
    **dict.fromkeys(("rb", "rake"), extract_ruby), **dict.fromkeys(("lua", "luau", "toc"), extract_lua), **dict.fromkeys(("sh", "bash"), extract_bash), **dict.fromkeys(("ex", "exs"), extract_elixir),
    "jl": extract_julia, **dict.fromkeys("f90 f95 f03 f08 f for ftn fpp".split(), extract_fortran), "zig": extract_zig, "sql": extract_sql, **dict.fromkeys(("tf", "hcl", "tfvars"), extract_terraform),
    **dict.fromkeys(("ps1", "psm1"), extract_powershell), "psd1": extract_psd1, **dict.fromkeys(("m", "mm"), extract_objc), "dart": extract_dart, **dict.fromkeys(("v", "sv", "svh", "vh"), extract_verilog),
    **dict.fromkeys("pas pp dpr dpk inc lpr".split(), extract_pascal), **dict.fromkeys(("cls", "trigger"), extract_apex),
    "r": _simple(r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\s*\(", r"^\s*(?:library|require)\(\s*[\"']?([\w.]+)|^\s*source\(\s*[\"']([^\"']+)", ("#",), quotes="\"'"),
    "nix": _simple(r"^\s*([A-Za-z_][\w'-]*)\s*=\s*(?:\{[^}]*\}|\w+)\s*:", r"\bimport\s+([<\w./-]+)", ("#",)),
    "sol": _simple(r"\bfunction\s+(\w+)\s*\(", r"^\s*import\s+(?:\{[^}]*\}\s*from\s*)?[\"']([^\"']+)", ("//",), r"\b(?:contract|interface|library)\s+(\w+)(?:\s+is\s+([\w, ]+))?"),
    **dict.fromkeys(("adb", "ads", "ada"), _simple(r"^\s*(?:procedure|function)\s+(\w+)", r"^\s*with\s+([\w.]+)", ("--",), r"^\s*package\s+(?:body\s+)?([\w.]+)", fold=True)),
}
