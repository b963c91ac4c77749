"""Tables of the languages with braces."""

from __future__ import annotations

import hashlib
import re

from ..functions.ids import make_id, normpath
from .scanner import Scan, Spec, extractor, split_top, type_names

_GENERIC = r"(?:\s*<[^{}();]*>)?"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|readonly|default|synchronized|native|strictfp|extern|unsafe|new|inline|constexpr|explicit|friend|open|data|inner|companion|suspend|operator|infix|tailrec|lateinit|external|fileprivate|mutating|convenience|required|lazy|weak|case|implicit|export|declare|const)\s+)*"
P = lambda s: re.compile(s, re.M)


def _after(head: str, word: str, stops: str) -> str:
    m = re.search(rf"\b{word}\b(.*?)(?=\b(?:{stops})\b|$)", head, re.S)
    return m[1] if m else ""


def _first(text: str):
    """(name, [generic names]) of each type of a list."""
    for part in split_top(text):
        part = re.sub(r"\(.*$", "", part, flags=re.S)
        names = type_names(part, frozenset())
        if names:
            yield names[0][0], [n for n, g in names[1:] if g]


def _import(relation: str, name):
    def do(scan: Scan, m: re.Match) -> None:
        target = name(m)
        if target:
            scan.out.link(scan.root, make_id(target), relation, scan.line(m.start() + len(m[0]) - len(m[0].lstrip())), context="import")

    return do


# --- JavaScript, TypeScript


#: What a relative import may leave out, in the order in which it is looked for.
JS_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json")
JS_INDEXES = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs")


def js_files(path: str) -> list[str]:
    """The files that a relative import of ``path`` may mean."""
    swapped = [path[: -len(a)] + b for a, b in ((".js", ".ts"), (".jsx", ".tsx")) if path.endswith(a)]
    return [path, *swapped, *(path + e for e in JS_ENDINGS), *(f"{path}/{i}" for i in JS_INDEXES)]


def _js_import(scan: Scan, m: re.Match) -> None:
    line, spec = scan.line(m.start()), m["path"]
    relative = spec.startswith(".")
    # without the folder, the id is that of the path as written
    base = scan.out.beside(spec) if relative else spec
    if relative:
        scan.out.choose(make_id(base), js_files(base))
    again = m[0].lstrip().startswith("export")
    scan.out.link(scan.root, make_id(base) if relative else make_id("ref", base), "re_exports" if again else "imports_from", line, context="re-export" if again else "import")
    if relative and not again:
        stem = re.sub(r"\.(?:[cm]?[jt]sx?)$", "", base)
        for part in split_top((re.search(r"\{(.*?)\}", m[0], re.S) or ["", ""])[1]):
            name = re.sub(r"^type\s+", "", part).split(" as ")[0].strip()
            scan.out.choose(make_id(stem, name), js_files(base), name)
            scan.out.link(scan.root, make_id(stem, name), "imports", line, context="import")


def _js_bases(kind: str, head: str):
    return [(n, "inherits", False) for n, _ in _first(_after(head, "extends", "implements"))] + [(n, "implements", False) for n, _ in _first(_after(head, "implements", "extends"))]


_JS = dict(
    functions=P(rf"^[ \t]*(?:export\s+(?:default\s+)?)?(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?:function\s*\*?\s*)?(?P<name>[A-Za-z_$][\w$]*){_GENERIC}\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*(?P<result>[^{{;=]+))?\{{"),
    import_pattern=P(r"^[ \t]*(?:import|export)\b[^;'\"]*?(?:from\s*)?['\"](?P<path>[^'\"]+)['\"]"),
    imports=_js_import,
    bases=_js_bases,
    references=False,
    bodiless=False,
)
JS = Spec(types=P(rf"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?P<kind>class)\s+(?P<name>[\w$]+)(?P<head>[^{{;]*)\{{"), **_JS)
TS = Spec(types=P(rf"^[ \t]*(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?P<kind>class|interface|enum)\s+(?P<name>[\w$]+)(?P<head>[^{{;]*)\{{"), **_JS)

# --- Java, Groovy

_JAVA_NOISE = frozenset(
    "void boolean byte char short int long float double var final String Object Integer Long Double Float Boolean Byte Short Character Number List ArrayList LinkedList Map HashMap TreeMap Set HashSet Collection Iterable Iterator Optional Stream Void Class CharSequence Exception RuntimeException Throwable extends super".split()
)


def _java_bases(kind: str, head: str):
    inherits = list(_first(_after(head, "extends", "implements|permits")))
    found = []
    for n, generics in inherits:
        found += [(n, "inherits", False)] + [(g, "", True) for g in generics if g not in _JAVA_NOISE]
    for n, generics in _first(_after(head, "implements", "extends|permits")):
        found += [(n, "implements", False)] + [(g, "", True) for g in generics if g not in _JAVA_NOISE]
    return found


def _java_cases(scan: Scan, me: str, kind: str, start: int, end: int) -> None:
    if kind != "enum":
        return
    constants = scan.plain[start + 1 : end - 1].split(";")[0]
    for m in re.finditer(r"(?:^|,)\s*(?:@\w+\s*)*([A-Za-z_]\w*)\s*(?=\(|,|\{|$)", re.sub(r"\([^()]*\)", lambda x: " " * len(x[0]), constants)):
        case = scan.out.node(make_id(me, m[1]), m[1], scan.line(start + 1 + m.start(1)))
        scan.out.link(me, case, "case_of", scan.line(start + 1 + m.start(1)))


def _java_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if not body or scan.spec.contexts.get("fields") is False:
        return
    for m in re.finditer(rf"^[ \t]*{_MODS}(?P<type>[A-Za-z_][\w.]*(?:<[^;=(){{}}]*>)?(?:\[\])?)\s+\w+\s*(?:=[^;]*)?;", scan.plain[body[0] : body[1]], re.M):
        at = body[0] + m.start("type")
        if m["type"] not in ("return", "package", "import", "throw", "break", "new") and scan.plain[body[0] : at].count("{") - scan.plain[body[0] : at].count("}") == 1:
            scan.refs(me, m["type"], "field", scan.line(at))


_JAVA_FUNCTION = P(rf"^[ \t]*(?P<marks>(?:@\w+(?:\([^)]*\))?\s*)*){_MODS}(?:<[^>(]*>\s*)?(?:(?P<result>[A-Za-z_][\w.]*(?:<[^;=(){{}}]*>)?(?:\[\])*)\s+)?(?P<name>[A-Za-z_]\w*)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w., ]+)?(?:\{{|;|$)")


class _JavaScan(Scan):
    enums: frozenset = frozenset()

    def type(self, kind, m, at):
        super().type(kind, m, at)
        if m["kind"] == "enum":
            self.enums |= {m["name"]}

    def signature(self, me, m, line):
        super().signature(me, m, line)
        for name in re.findall(r"@(\w+)", m["marks"] or ""):
            self.out.link(me, self.out.stub(name), "references", line, context="attribute")

    def function(self, m, at):
        if not m["result"] and not ((o := self.owner(at)) and self.out.known[o]["label"] == m["name"] and m["name"] not in self.enums):
            return
        if m["result"] in ("return", "new", "throw", "else", "case"):
            return
        super().function(m, at)


_JAVA_TYPES = P(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?P<kind>class|interface|enum|record|@interface|trait)\s+(?P<name>\w+)(?P<head>[^{{;]*)\{{")
JAVA = Spec(
    types=_JAVA_TYPES, functions=_JAVA_FUNCTION, bases=_java_bases, typed="before", noise=_JAVA_NOISE, cases=_java_cases, fields=_java_fields, member_calls="all",
    import_pattern=P(r"^[ \t]*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;?"), imports=_import("imports", lambda m: m["path"].removesuffix(".*").split(".")[-1]), quotes="\"'", contexts={},
)
GROOVY = Spec(
    types=_JAVA_TYPES, functions=_JAVA_FUNCTION, bases=lambda k, h: [(n, r, g) for n, r, g in _java_bases(k, h) if not g], references=False, import_pattern=P(r"^[ \t]*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;?"),
    imports=_import("imports", lambda m: m["path"].removesuffix(".*").split(".")[-1]), quotes="\"'", typed="before",
)

# --- C, C++ and dialects

_C_NOISE = frozenset(
    "void char short int long float double signed unsigned bool size_t ssize_t const static struct enum union volatile inline extern register auto constexpr virtual explicit friend typename class template mutable noexcept override int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t wchar_t char8_t char16_t char32_t nullptr_t FILE std".split()
)
_C_FUNCTION = P(r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?P<result>(?:[A-Za-z_][\w:]*(?:<[^;(){}]*>)?[\s*&]+)+)(?P<name>~?[A-Za-z_]\w*)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const\s*|noexcept\s*|override\s*)*\{")
_CPP_FUNCTION = P(r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?P<result>(?:[A-Za-z_][\w:]*(?:<[^;(){}]*>)?[\s*&]+)*)(?P<name>[A-Za-z_]\w*)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const\s*|noexcept\s*|override\s*)*(?::[^{};]*)?\{")


def _include(m: re.Match) -> str:
    return m["path"].rsplit("/", 1)[-1].split(".")[0]


def _cpp_bases(kind: str, head: str):
    found = []
    if ":" in head:
        for n, generics in _first(re.sub(r"\b(public|private|protected|virtual)\b", "", head.split(":", 1)[1])):
            found += [(n, "inherits", False)] + [(g, "", True) for g in generics]
    return found


def _cpp_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if not body:
        return
    inside = scan.plain[body[0] + 1 : body[1] - 1]
    for m in re.finditer(r"(?:^|[;{}:])\s*(?P<type>(?:[A-Za-z_][\w:]*(?:<[^;(){}]*>)?[\s*&]+)+)(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?(?=;)", inside):
        at = body[0] + 1 + m.start("name")
        depth = inside[: m.start("name")].count("{") - inside[: m.start("name")].count("}")
        if depth == 0 and not re.match(r"\s*(return|using|typedef|friend|delete|throw)\b", m["type"]):
            where = scan.line(at)
            scan.refs(me, m["type"], "field", where)
            scan.out.link(me, scan.out.node(make_id(me, m["name"]), m["name"], where), "defines", where, context="field")


class _CScan(Scan):
    def __init__(self, spec, path, text):
        super().__init__(spec, path, text)
        # access labels and attributes are no part of the declarations after them
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        self.plain = re.sub(r"\[\[[^\]]*\]\]", blank, re.sub(r"\b(?:public|private|protected)\s*:(?!:)", blank, self.plain))

    def function(self, m, at):
        if m["result"].strip() in ("else", "return", "new") or (not m["result"].strip() and not ((o := self.owner(at)) and self.out.known[o]["label"] == m["name"])):
            return
        super().function(m, at)


_C = dict(import_pattern=P(r"^[ \t]*#\s*include\s*[<\"](?P<path>[^>\"]+)[>\"]"), imports=_import("imports", _include), typed="before", noise=_C_NOISE, bodiless=False, quotes="\"'", contexts={"result_first": True})
C = Spec(types=P(r"(?!)(?P<name>)"), functions=_C_FUNCTION, **_C)
CPP = Spec(types=P(r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?P<kind>class|struct)\s+(?P<name>\w+)(?P<head>[^{;()]*)\{"), functions=_CPP_FUNCTION, bases=_cpp_bases, fields=_cpp_fields, **_C)

# --- C#

_CS_NOISE = frozenset("void string int long short byte bool float double decimal char object var dynamic uint ulong ushort sbyte nint nuint ref out in params this readonly const".split())


def _cs_bases(kind: str, head: str):
    found = []
    if ":" in head:
        for i, (n, generics) in enumerate(_first(head.split(":", 1)[1].split(" where ")[0])):
            interface = re.match(r"I[A-Z]", n) is not None
            relation = "inherits" if kind == "interface" or (i == 0 and not interface) else "implements"
            found += [(n, relation, False)] + [(g, "", True) for g in generics if g not in _CS_NOISE]
    return found


def _cs_pre(scan: Scan) -> None:
    scan.space, scan.space_id = "", ""
    if m := re.search(r"^[ \t]*namespace\s+([\w.]+)", scan.plain, re.M):
        scan.space = m[1]
        scan.space_id = "csharp_namespace:" + hashlib.sha1(m[1].encode()).hexdigest()[:16]
        line = scan.line(m.start(1))
        scan.out.node(scan.space_id, m[1], line)
        scan.out.link(scan.root, scan.space_id, "contains", line)


def _cs_id(scan: Scan, name: str) -> str:
    return make_id(scan.out.stem, scan.space, name)


def _cs_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if not body:
        return
    inside = scan.plain[body[0] + 1 : body[1] - 1]
    for m in re.finditer(rf"^[ \t]*{_MODS}(?P<type>[A-Za-z_][\w.]*(?:<[^;=(){{}}]*>)?(?:\[\]|\?)*)\s+\w+\s*(?:=[^;{{]*;|;|\{{\s*(?:get|set|init))", inside, re.M):
        before = inside[: m.start("type")]
        if m["type"] not in ("return", "using", "throw", "new", "namespace") and before.count("{") == before.count("}"):
            scan.refs(me, m["type"], "field", scan.line(body[0] + 1 + m.start("type")))


class _CsScan(Scan):
    def refs(self, source, text, context, line):
        for name, generic in type_names(text, self.spec.noise):
            own = _cs_id(self, name)
            target = own if own in self.out.known else self.out.node(make_id(name), name, source_file="")
            if target != source:
                self.out.link(source, target, "references", line, context="generic_arg" if generic else context)


CS = Spec(
    types=P(rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}(?P<kind>class|interface|struct|enum|record)\s+(?P<name>\w+)(?P<head>[^{{;]*)\{{"),
    functions=P(rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}(?P<result>[A-Za-z_][\w.]*(?:<[^;=(){{}}]*>)?(?:\[\]|\?)*)\s+(?P<name>[A-Za-z_]\w*){_GENERIC}\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:where[^{{;]*)?(?:\{{|;|=>)"),
    bases=_cs_bases, typed="before", noise=_CS_NOISE, fields=_cs_fields, pre=_cs_pre, type_id=_cs_id, member_calls="named", quotes="\"'", constructors=False, new_calls=False,
    import_pattern=P(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<path>[\w.]+)\s*;"), imports=_import("imports", lambda m: m["path"]),
)

# --- Kotlin, Swift, Scala

_KT_NOISE = frozenset("String Int Long Short Byte Boolean Float Double Char Unit Any Nothing List Map Set Array Pair Triple Sequence Iterable Collection vararg".split())


def _kt_bases(kind: str, head: str):
    head = re.sub(r"^\s*(?:<[^>]*>)?\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?", "", head)
    found = []
    if head.lstrip().startswith(":"):
        for part in split_top(head.split(":", 1)[1]):
            called = "(" in part
            for n, generics in _first(re.split(r"\sby\s", part)[0]):
                found += [(n, "inherits" if called else "implements", False)] + [(g, "", True) for g in generics]
    return found


def _enum_cases(scan: Scan, me: str, kind: str, start: int, end: int) -> None:
    if "enum" in (kind or ""):
        _java_cases(scan, me, "enum", start, end)


def _colon_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if not body:
        return
    inside = scan.plain[body[0] + 1 : body[1] - 1]
    for m in re.finditer(r"^[ \t]*(?:[a-z]+\s+)*(?:val|var|let)\s+\w+\s*:\s*(?P<type>[^=\n{]+)", inside, re.M):
        before = inside[: m.start()]
        if before.count("{") == before.count("}"):
            scan.refs(me, m["type"], "field", scan.line(body[0] + 1 + m.start("type")))


KOTLIN = Spec(
    types=P(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?P<kind>enum\s+class|class|interface|object)\s+(?P<name>\w+)(?P<head>(?:\s*<[^>]*>)?(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?(?:\s*:[^{{\n]*)?)\s*(?:\{{|$)"),
    functions=P(rf"^[ \t]*(?:@\w+\s*)*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*(?P<result>[^={{\n]+))?(?:\{{|=|$)"),
    bases=_kt_bases, noise=_KT_NOISE, cases=_enum_cases, fields=_colon_fields, quotes="\"", member_calls="upper",
)


def _swift_bases(kind: str, head: str):
    found = []
    if ":" in head:
        for i, (n, generics) in enumerate(_first(head.split(":", 1)[1].split(" where ")[0])):
            first = i == 0 and kind == "class"
            found += [(n, "inherits" if first else "implements", False)] + [(g, "", True) for g in generics]
    return found


def _swift_cases(scan: Scan, me: str, kind: str, start: int, end: int) -> None:
    if kind != "enum":
        return
    for m in re.finditer(r"^[ \t]*(?:indirect\s+)?case\s+([^\n]+)", scan.plain[start:end], re.M):
        line = scan.line(start + m.start(1))
        for part in split_top(m[1]):
            name = WORD[0] if (WORD := re.match(r"\w+", part)) else ""
            if name:
                case = scan.out.node(make_id(me, name), name, line)
                scan.out.link(me, case, "case_of", line)
            if "(" in part:
                scan.refs(me, re.sub(r"\w+\s*:", "", part[part.index("(") :]), "type", line)


class _SwiftScan(Scan):
    def run(self):
        # imported modules are nodes of the file
        for m in re.finditer(r"^[ \t]*import[ \t]+(?:\w+[ \t]+)?(\w+)", self.plain, re.M):
            line = self.line(m.start(1))
            self.out.link(self.root, self.out.node(make_id(m[1]), m[1], line), "imports", line, context="import")
        return super().run()


SWIFT = Spec(
    types=P(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?P<kind>class|struct|enum|protocol|actor)\s+(?P<name>\w+)(?P<head>[^{{\n]*)\{{"),
    functions=P(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?:func\s+)?(?P<name>(?<=func )\w+|init|deinit|subscript){_GENERIC}[?!]?\s*(?:\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\))?\s*(?:async\s*)?(?:throws\s*)?(?:->\s*(?P<result>[^{{\n]+))?\{{"),
    extend=P(r"^[ \t]*(?:\w+\s+)*(?P<kind>extension)\s+(?P<name>\w+)(?P<head>[^{\n]*)\{"), bases=_swift_bases, cases=_swift_cases, fields=_colon_fields, quotes="\"", bodiless=False,
)


def _scala_bases(kind: str, head: str):
    found = [(n, "inherits", False) for n, _ in _first(_after(head, "extends", "with"))]
    return found + [(n, "mixes_in", False) for w in re.findall(r"\bwith\s+([\w.\[\], ]+?)(?=\bwith\b|\{|$)", head) for n, _ in _first(w.replace("[", "<").replace("]", ">"))]


def _scala_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if m := re.match(r"\s*(?:\[[^\]]*\])?\s*\(([^()]*)\)", head):
        for p in split_top(m[1]):
            if ":" in p:
                scan.refs(me, p.split(":", 1)[1].split("=")[0], "field", line)
    _colon_fields(scan, me, kind, head, body, line)


SCALA = Spec(
    types=P(rf"^[ \t]*{_MODS}(?P<kind>class|object)\s+(?P<name>\w+)(?P<head>[^{{\n]*)(?:\{{|$)"),
    functions=P(rf"^[ \t]*{_MODS}def\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\))?\s*(?::\s*(?P<result>[^={{\n]+))?=?\s*\{{"),
    bases=_scala_bases, fields=_scala_fields, quotes="\"", bodiless=False, deep="[", import_pattern=P(r"^[ \t]*import\s+(?P<path>\w+)"), imports=_import("imports", lambda m: m["path"]),
    noise=frozenset("Unit Any Nothing".split()), new_calls=False,
)

# --- PHP

_PHP_NOISE = frozenset("string int float bool array object mixed void null callable iterable self static parent true false never readonly public private protected".split())


def _php_bases(kind: str, head: str):
    return [(n, "inherits", False) for n, _ in _first(_after(head, "extends", "implements"))] + [(n, "implements", False) for n, _ in _first(_after(head, "implements", "extends"))]


def _php_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if not body:
        return
    inside = scan.plain[body[0] + 1 : body[1] - 1]
    for m in re.finditer(r"^[ \t]*use\s+([\w\\, ]+)[;{]", inside, re.M):
        for n, _ in _first(m[1]):
            scan.out.link(me, scan.out.stub(n), "mixes_in", scan.line(body[0] + 1 + m.start(1)))
    for m in re.finditer(r"^[ \t]*(?:(?:public|private|protected|static|readonly|var)\s+)+(?P<type>\??[\w\\|]+)\s+\$\w+", inside, re.M):
        scan.refs(me, m["type"], "field", scan.line(body[0] + 1 + m.start("type")))


class _PhpScan(Scan):
    def signature(self, me, m, line):
        super().signature(me, m, line)
        owner = self.owner(m.start("name"))
        for p in split_top(m["params"] or ""):
            if owner and (q := re.match(r"(?:(?:public|private|protected|readonly)\s+)+(\??[\w\\|]+)\s+\$", p)):
                self.refs(owner, q[1], "field", line)

    def run(self):
        used = {m[1].rsplit("\\", 1)[-1]: m[1] for m in re.finditer(r"^use\s+([\w\\]+)\s*;", self.plain, re.M)}
        self.used = used
        out = super().run()
        # names that a use statement spells out
        for name, full in used.items():
            bare = make_id(name)
            if bare in out.known and not out.known[bare]["source_file"]:
                node = out.known[bare]
                node["id"], node["label"] = make_id(full), full
                for x in out.links:
                    for end in ("source", "target"):
                        if x[end] == bare:
                            x[end] = make_id(full)
        return out


def _php_use(scan: Scan, m: re.Match) -> None:
    scan.out.link(scan.root, make_id(m["path"].rsplit("\\", 1)[-1]), "imports", scan.line(m.start("path")), context="import")


PHP = Spec(
    types=P(r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?P<kind>class)\s+(?P<name>\w+)(?P<head>[^{;]*)\{"),
    functions=P(r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*(?P<result>[^{;]+))?[{;]"),
    bases=_php_bases, typed="before", noise=_PHP_NOISE, fields=_php_fields, quotes="\"'", line=("//", "#"), new_calls=False, import_pattern=P(r"^use\s+(?P<path>[\w\\]+)[^;{]*;"), imports=_php_use, member_calls="upper",
)

# --- Rust, Go

_RUST_NOISE = frozenset("str bool char i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 mut dyn impl ref const static where for self crate super pub fn".split())


class _RustScan(Scan):
    def events(self):
        found = [("impl", m) for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl(?:\s*<[^>]*>)?\s+(?:(?P<trait>[\w:]+(?:<[^{]*?>)?)\s+for\s+)?(?P<name>\w+)(?:<[^{]*>)?[^{;]*\{", self.plain, re.M)]
        return sorted(super().events() + found, key=lambda e: e[1].start())

    def type(self, kind, m, at):
        if kind != "impl":
            if m["kind"] == "trait":
                super().type(kind, m, at)
                self.owners.pop() if self.owners and self.owners[-1][2] == make_id(self.out.stem, m["name"]) else None
                self.bodies.append((m.end() - 1, self.closing(m.end() - 1), "")) if self.plain[m.end() - 1] == "{" else None
                return
            return super().type(kind, m, at)
        from .scanner import closing

        me = self.out.stub(m["name"])
        line = self.line(m.start("name"))
        if m["trait"]:
            for i, (n, _) in enumerate(type_names(m["trait"], self.spec.noise)):
                self.out.link(me, self.out.stub(n), "implements" if i == 0 else "references", line, context=None if i == 0 else "generic_arg")
        self.owners.append((m.end() - 1, closing(self.plain, m.end() - 1), me))

    def closing(self, at):
        from .scanner import closing

        return closing(self.plain, at)

    def calls(self):
        self.bodies = [b for b in self.bodies if b[2]]
        super().calls()


def _rust_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    if kind == "trait":
        return
    if body and kind == "enum":
        inside = scan.plain[body[0] + 1 : body[1] - 1]
        for m in re.finditer(r"\(([^()]*)\)|\{([^{}]*)\}", inside):
            where = scan.line(body[0] + 1 + m.start())
            for part in split_top(m[1] or m[2] or ""):
                scan.refs(me, part.split(":", 1)[-1] if m[2] else part, "field", where)
    elif body:
        for m in re.finditer(r"(?:^|,|\{)\s*(?:pub(?:\([^)]*\))?\s+)?\w+\s*:\s*(?P<type>[^\n}]+?)(?=,?\s*(?:\n|\}|$))", scan.plain[body[0] : body[1]], re.M):
            scan.refs(me, m["type"], "field", scan.line(body[0] + m.start("type")))
    elif m := re.search(r"\((.*)\)", head, re.S):
        for part in split_top(m[1]):
            scan.refs(me, part, "field", line)


RUST = Spec(
    types=P(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait)\s+(?P<name>\w+)(?P<head>[^{;]*)[{;]"),
    functions=P(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)(?:\s*<[^>(]*>)?\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:->\s*(?P<result>[^{;]+?))?\s*(?:where[^{;]*)?\{"),
    bases=lambda kind, head: [(n, "inherits", False) for n, _ in _first(head.split(":", 1)[1].replace("+", ","))] if kind == "trait" and ":" in head else [],
    keywords=frozenset("if for while match loop return".split()), noise=_RUST_NOISE, fields=_rust_fields, quotes="\"", bodiless=False, member_calls="", import_pattern=P(r"^[ \t]*(?:pub\s+)?use\s+(?P<path>[^;]+);"),
    imports=_import("imports_from", lambda m: re.split(r"::", m["path"].split("{")[0].rstrip(":* "))[-1].split(" as ")[0]),
)

_GO_NOISE = frozenset("bool string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64 complex64 complex128 error any map chan func struct interface nil true false".split())


def _go_id(scan: Scan, name: str) -> str:
    folder = scan.out.path.rpartition("/")[0].rsplit("/", 1)[-1]
    return make_id(folder, name)


def _go_fields(scan: Scan, me: str, kind: str, head: str, body, line: int) -> None:
    for at, row in enumerate(scan.plain[body[0] + 1 : body[1] - 1].split("\n")) if body else ():
        where, row = scan.line(body[0]) + at, row.strip()
        if re.fullmatch(r"\*?[\w.]+", row):
            for n, _ in type_names(row, scan.spec.noise):
                scan.out.link(me, _go_id(scan, n), "embeds", where)
        elif kind == "struct" and (m := re.match(r"[\w, ]+?\s+(?P<type>[^`]+)", row)):
            for n, g in type_names(m["type"], scan.spec.noise):
                if _go_id(scan, n) != me:
                    scan.out.link(me, _go_id(scan, n), "references", where, context="generic_arg" if g else "field")


class _GoScan(Scan):
    def refs(self, source, text, context, line):
        for n, g in type_names(text, self.spec.noise):
            if _go_id(self, n) != source:
                self.out.link(source, _go_id(self, n), "references", line, context="generic_arg" if g else context)

    def signature(self, me, m, line):
        for p in split_top(m["params"] or ""):
            self.refs(me, p.split(None, 1)[1] if " " in p else p if p[:1] in "*[" or p[:1].isupper() else "", "parameter_type", line)
        self.refs(me, m["result"] or "", "return_type", line)

    def run(self):
        for m in re.finditer(r"^import\s*(?:\((.*?)\)|([^\n]+))", masked_go(self.text), re.M | re.S):
            for x in re.finditer(r"\"([^\"]+)\"", m[0]):
                self.out.link(self.root, make_id("go", "pkg", x[1]), "imports_from", self.line(m.start() + x.start()), context="import")
        out = super().run()
        out.links = [x for x in out.links if x["relation"] == "imports_from" or (x["source"] in out.known and x["target"] in out.known)]
        return out


def masked_go(text: str) -> str:
    from .scanner import masked

    return masked(text, quotes="`", keep_strings=True)


GO = Spec(
    types=P(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*\{"),
    functions=P(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?P<result>\([^()]*\)|[^{\n]*?)\s*\{"),
    noise=_GO_NOISE, fields=_go_fields, quotes="\"`", bodiless=False, member_calls="upper", type_id=_go_id, deep="",
)


def _with(cls: type[Scan], spec: Spec):
    return lambda path, text: cls(spec, path, text).run()


EXTRACTORS = {
    **dict.fromkeys("js jsx mjs cjs".split(), extractor(JS)),
    **dict.fromkeys("ts mts cts tsx".split(), extractor(TS)),
    "java": _with(_JavaScan, JAVA),
    **dict.fromkeys("groovy gradle".split(), _with(_JavaScan, GROOVY)),
    **dict.fromkeys("c h".split(), _with(_CScan, C)),
    **dict.fromkeys("cpp cc cxx hpp hh hxx cu cuh metal".split(), _with(_CScan, CPP)),
    "cs": _with(_CsScan, CS),
    **dict.fromkeys("kt kts".split(), extractor(KOTLIN)),
    "swift": _with(_SwiftScan, SWIFT),
    **dict.fromkeys("scala sc".split(), extractor(SCALA)),
    "php": _with(_PhpScan, PHP),
    "rs": _with(_RustScan, RUST),
    "go": _with(_GoScan, GO),
}
