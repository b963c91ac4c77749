"""Project files, forms, markup and templates."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from ..functions.ids import basename, make_id, normpath
from .brace_languages import EXTRACTORS as BRACES, js_files
from .emitter import Emitter


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _beside(path: str, target: str) -> str:
    folder = path.rpartition("/")[0]
    return normpath(f"{folder}/{target}" if folder else target)


def _outer(path: str, target: str) -> str:
    """An id for a path that may lead out of the scanned folder."""
    where = _beside(path, target.replace("\\", "/"))
    return make_id(re.sub(r"^(?:\.\./)+", "ext/", where))


# --- Delphi and Lazarus


def extract_form(path: str, text: str) -> Emitter:
    out = Emitter(path)
    open_ = [out.file_node()]
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if m := re.match(r"(?:object|inherited|inline)\s+(?:\w+\s*:\s*)?(\w+)", line, re.I):
            me = out.node(make_id(out.stem, m[1]), m[1], number)
            if me != open_[-1]:
                out.link(open_[-1], me, "contains", number)
            open_.append(me)
        elif line.lower() == "end" and len(open_) > 1:
            open_.pop()
        elif (m := re.match(r"On\w+\s*=\s*(\w+)$", line)) and len(open_) > 1:
            out.link(open_[-1], out.node(make_id(out.stem, m[1]), f"{m[1]}()", number), "references", number, context="event")
    return out


def _xml(text: str) -> ET.Element | None:
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text.lstrip("﻿")))
    except ET.ParseError:
        return None


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def extract_lpk(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root, tree = out.file_node(), _xml(text)
    if tree is None:
        return out
    value = lambda e: e.get("Value", "")
    name = next((value(e) for e in tree.iter("Name") if value(e)), "")
    me = out.node(make_id(out.stem, name), name, 1) if name else root
    out.link(root, me, "contains", 1) if name else None
    for tag, relation, context in (("PackageName", "imports", "import"), ("UnitName", "contains", None)):
        for e in tree.iter(tag):
            if value(e):
                out.link(me, out.node(make_id(value(e)), value(e), 1), relation, 1, context=context)
    return out


# --- .NET


def extract_sln(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node(line=None)
    known: dict[str, str] = {}
    sections = list(re.finditer(r'^Project\("[^"]*"\)\s*=\s*"([^"]*)",\s*"([^"]*)",\s*"(\{[^}]*\})"(.*?)^EndProject', text, re.M | re.S))
    for m in sections:
        if m[2].endswith("proj"):
            known[m[3].upper()] = out.node(_outer(path, m[2]), m[1], location=None)
            out.link(root, known[m[3].upper()], "contains")
    for m in sections:
        for other in re.findall(r"(\{[^}]*\})\s*=\s*\{", m[4]):
            if m[3].upper() in known and other.upper() in known:
                out.link(known[m[3].upper()], known[other.upper()], "imports")
    return out


def extract_slnx(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root, tree = out.file_node(line=None), _xml(text)
    projects = [e for e in tree.iter() if _tag(e) == "Project" and e.get("Path")] if tree is not None else []
    label = lambda p: basename(p.replace("\\", "/")).rsplit(".", 1)[0]
    for e in projects:
        out.link(root, out.node(_outer(path, e.get("Path")), label(e.get("Path")), location=None), "contains")
    for e in projects:
        for d in e.iter():
            if _tag(d) == "BuildDependency" and d.get("Project"):
                out.link(_outer(path, e.get("Path")), _outer(path, d.get("Project")), "imports")
    return out


def extract_project(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root, tree = out.file_node(line=None), _xml(text)
    if tree is None:
        return out
    add = lambda node_id, label, relation, kind="concept": out.link(root, out.node(node_id, label, file_type=kind, location=None), relation)
    for e in tree.iter():
        if _tag(e) in ("TargetFramework", "TargetFrameworks") and e.text:
            for f in filter(None, (x.strip() for x in e.text.split(";"))):
                add(make_id("framework", f), f, "references")
    for e in tree.iter():
        include = e.get("Include")
        if _tag(e) == "PackageReference" and include:
            version = e.get("Version") or next((c.text for c in e if _tag(c) == "Version"), None)
            add(make_id("nuget", include), f"{include} ({version})" if version else include, "imports")
    for e in tree.iter():
        if _tag(e) == "ProjectReference" and e.get("Include"):
            add(_outer(path, e.get("Include")), basename(e.get("Include").replace("\\", "/")), "imports", "code")
    if tree.get("Sdk"):
        add(make_id("sdk", tree.get("Sdk")), tree.get("Sdk"), "references")
    return out


def extract_xaml(path: str, text: str) -> Emitter:
    out, tree = Emitter(path), _xml(text)
    if tree is None:
        return out
    root = out.file_node()
    where = lambda value: _line(text, max(text.find(value), 0))
    top = out.node(make_id(out.stem, _tag(tree)), _tag(tree), 1)
    out.link(root, top, "contains", 1)
    named = lambda e, key: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == key and k.startswith("{")), None)
    if full := named(tree, "Class"):
        short = full.rsplit(".", 1)[-1]
        out.link(top, out.node(make_id(out.stem, short), short, where(full)), "references", where(full), context="x_class")
    for e in tree.iter():
        me = top
        if name := named(e, "Name"):
            me, line = out.node(make_id(out.stem, name), name, where(f'"{name}"')), where(f'"{name}"')
            out.link(top, me, "contains", line)
            out.link(me, out.node(make_id("xaml", _tag(e)), _tag(e), line, "concept"), "references", line, context="type")
        bindings = [(k.rsplit("}", 1)[-1], v) for k, v in e.attrib.items() if v.startswith("{Binding")]
        if _tag(e) == "Binding":
            bindings.append(("", "{Binding " + ", ".join(f"{k}={v}" for k, v in e.attrib.items() if not k.startswith("{")) + "}"))
        for key, value in bindings:
            inside = value[len("{Binding") : -1].strip()
            target = re.search(r"\bPath\s*=\s*([\w.\[\]]+)", inside) or re.match(r"([\w.\[\]]+)\s*(?:,|$)", inside)
            if target:
                line = where(target[1])
                out.link(me, out.node(make_id("binding", target[1]), target[1], line, "concept"), "references", line, context="binding_command" if key == "Command" else "binding_path")
            if m := re.search(r"\bConverter\s*=\s*\{(?:StaticResource|DynamicResource)\s+(\w+)\}", inside):
                line = where(m[1])
                out.link(me, out.node(make_id("binding_converter", m[1]), m[1], line, "concept"), "references", line, context="binding_converter")
    return out


# --- web components and templates

_DYNAMIC = re.compile(r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)")
_STATIC = re.compile(r"^\s*import\s+(?:[^'\"\n]*?\sfrom\s+)?['\"]([^'\"]+)['\"]", re.M)


def _script_only(text: str, blocks: list[tuple[int, int]]) -> str:
    """The text with all outside the blocks blanked, so that lines stay."""
    keep, at = [], 0
    for a, b in blocks:
        keep += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*keep, re.sub(r"[^\n]", " ", text[at:])])


def _component(text: str, path: str, scripts: list[tuple[int, int]], language: str, rescue: bool) -> Emitter:
    out = BRACES[language](path, _script_only(text, scripts))
    root = make_id(out.stem)
    # components of other files are found by the pass over the whole text
    out.links = [x for x in out.links if not (rescue and x["target"].endswith(("_astro", "_svelte")))]
    named = {x["target"] for x in out.links}

    def add(target: str, relation: str) -> None:
        node_id = make_id(_beside(path, target)) if target.startswith(".") else make_id(target)
        out.node(node_id, target, location=None) if rescue or node_id not in named else None
        if node_id not in named:
            named.add(node_id)
            out.link(root, node_id, relation, weight=None)
            if target.startswith("."):
                out.choose(node_id, js_files(out.beside(target)))

    for m in _DYNAMIC.finditer(text):
        add(m[1], "dynamic_import")
    if rescue:
        for m in _STATIC.finditer(text):
            add(m[1], "imports_from")
    return out


def extract_vue(path: str, text: str) -> Emitter:
    scripts = [m.span(1) for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S)]
    typed = re.search(r"<script\b[^>]*\blang=[\"']tsx?[\"']", text) is not None
    return _component(text, path, scripts, "ts" if typed else "js", False)


def extract_svelte(path: str, text: str) -> Emitter:
    out = Emitter(path)
    out.file_node()
    more = _component(text, path, [], "js", True)
    out.nodes, out.links = more.nodes, more.links
    return out


def extract_astro(path: str, text: str) -> Emitter:
    fence = re.match(r"\s*---\s*\n(.*?)\n---", text, re.S)
    return _component(text, path, [fence.span(1)] if fence else [], "ts", True)


def extract_razor(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node(line=None)

    def add(node_id: str, label: str, relation: str, at: int, kind: str = "code") -> None:
        out.link(root, out.node(node_id, label, _line(text, at), kind), relation, _line(text, at))

    for m in re.finditer(r'^@page\s+"([^"]+)"', text, re.M):
        add(make_id("route", m[1]), f"route:{m[1]}", "references", m.start(), "concept")
    for word, relation in (("model", "references"), ("using", "imports"), ("inject", "imports"), ("inherits", "inherits")):
        for m in re.finditer(rf"^@{word}\s+(?:static\s+)?([\w.]+)", text, re.M):
            add(make_id(m[1]), m[1], relation, m.start())
    # fixed values: components that frameworks bring along
    own = {"Button", "Router", "Found", "NotFound", "LayoutView", "PageTitle", "HeadContent", "CascadingValue", "EditForm", "InputText", "ValidationSummary"}
    code = re.search(r"@(?:code|functions)\s*\{", text)
    for m in re.finditer(r"<([A-Z]\w*)|\bT\w*=\"([A-Z]\w*)\"|List<([A-Z]\w*)>", text):
        name = m[1] or m[2] or m[3]
        if name not in own:
            if make_id(name) not in out.known:
                add(make_id(name), name, "calls", m.start() if not m[2] else text.find(f"<{name}>") if f"<{name}>" in text else m.start())
    for m in re.finditer(r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\], ?.]+?\s+(\w+)\s*\(", text[code.end() :] if code else "", re.M):
        at = code.end() + m.start(1)
        out.link(root, out.node(make_id(out.stem, m[1]), m[1], _line(text, at)), "contains", _line(text, at))
    return out


def extract_blade(path: str, text: str) -> Emitter:
    out = Emitter(path)
    root = out.file_node(line=None)
    for pattern, relation in ((r"@include\(\s*['\"]([^'\"]+)['\"]", "includes"), (r"<livewire:([\w.\-]+)", "uses_component"), (r"wire:click=['\"]([\w]+)[^'\"]*['\"]", "binds_method")):
        for m in re.finditer(pattern, text):
            out.link(root, out.node(make_id(m[1]), m[1], location=None), relation)
    return out


# --- JSON

MOST_BYTES, MOST_SERVERS, MOST_PAIRS, MOST_DEPTH = 1 << 20, 200, 500, 6
_DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundledDependencies", "bundleDependencies")


def _servers(out: Emitter, servers: dict) -> None:
    root = out.file_node()
    for name, s in list(servers.items())[:MOST_SERVERS]:
        if not isinstance(s, dict):
            continue
        me = out.node(make_id(out.stem, "mcp_server", name), name, 1)
        out.link(root, me, "contains", 1)
        command, args = s.get("command"), [a for a in s.get("args") or [] if isinstance(a, str)]
        if isinstance(command, str) and command:
            out.link(me, out.node(make_id("mcp_command", basename(command)), basename(command), 1), "references", 1, context="command")
            if basename(command) in ("npx", "uvx", "bunx", "pnpx", "pipx", "bun", "deno"):
                package = next((a for a in args if not a.startswith("-") and a not in ("run", "x", "exec", "dlx")), None)
                if package:
                    bare = re.sub(r"(?<=.)@[^/]*$", "", package)
                    out.link(me, out.node(make_id("mcp_package", bare), bare, 1), "references", 1, context="package")
        for key in s.get("env") or {} if isinstance(s.get("env"), dict) else ():
            out.link(me, out.node(make_id("env_var", key), key, 1), "requires_env", 1)


def extract_json(path: str, text: str) -> Emitter:
    """Server configurations and manifests; plain data gives nothing.  Values of environment variables are not read."""
    out = Emitter(path)
    if len(text.encode()) > MOST_BYTES:
        return out
    try:
        doc = json.loads(text)
    except ValueError:
        return out
    if not isinstance(doc, dict):
        return out
    servers = doc.get("mcpServers")
    if isinstance(servers, dict) and servers:
        _servers(out, servers)
        return out
    manifest = any(k in doc for k in (*_DEPENDENCIES, "extends", "compilerOptions", "$ref", "$schema", "scripts"))
    if not manifest:
        return out
    root, pairs = out.file_node(), 0

    def visit(node: dict, owner: str, keys: tuple[str, ...], depth: int, at: int) -> None:
        nonlocal pairs
        for key, value in node.items():
            pairs += 1
            if pairs > MOST_PAIRS:
                return
            found = text.find(json.dumps(key, ensure_ascii=False), at)
            at = found if found >= 0 else at
            line = _line(text, at)
            me = out.node(make_id(out.stem, *keys, key), key, line)
            out.link(owner, me, "contains", line)
            if key in ("extends", "$ref") and isinstance(value, str):
                out.link(owner, out.node(make_id("ref", value), value, line, "concept"), "extends" if key == "extends" else "references", line, context="import")
            if keys and keys[-1] in _DEPENDENCIES and isinstance(value, str):
                out.link(me, out.node(make_id(key), key, line, "concept"), "imports", line, context="import")
            if isinstance(value, dict) and depth < MOST_DEPTH:
                visit(value, me, (*keys, key), depth + 1, at + len(key))

    visit(doc, root, (), 1, 0)
    return out


EXTRACTORS = {
    "dfm": extract_form, "lfm": extract_form, "lpk": extract_lpk, "sln": extract_sln, "slnx": extract_slnx, "csproj": extract_project, "fsproj": extract_project, "vbproj": extract_project,
    "xaml": extract_xaml, "vue": extract_vue, "svelte": extract_svelte, "astro": extract_astro, "razor": extract_razor, "cshtml": extract_razor, "blade.php": extract_blade, "json": extract_json,
}
