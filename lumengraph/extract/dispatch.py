"""The extractor of a file by its ending."""

from __future__ import annotations

from collections.abc import Callable

from . import brace_languages, formats, line_languages
from .emitter import Emitter
from .python_source import extract_python

EXTRACTORS: dict[str, Callable[[str, str], Emitter]] = {"py": extract_python, "pyi": extract_python, **brace_languages.EXTRACTORS, **line_languages.EXTRACTORS, **formats.EXTRACTORS}


def extract(path: str, data: bytes) -> Emitter:
    """Nodes and links of one file, repeats removed; empty for endings without an extractor."""
    name = path.rsplit("/", 1)[-1].lower()
    ending = "blade.php" if name.endswith(".blade.php") else name.rpartition(".")[2]
    extractor = EXTRACTORS.get(ending)
    out = extractor(path, data.decode("utf-8", "replace")) if extractor else Emitter(path)
    return settle(out)


def settle(out: Emitter) -> Emitter:
    """Within the file: sourceless nodes give way to the first sourced one of their name; first links stay."""
    key = lambda n: n["label"].strip("()").lstrip(".")
    real: dict[str, str] = {}
    for n in out.nodes:
        if n["source_file"] and key(n):
            real.setdefault(key(n), n["id"])
    swap = {n["id"]: real[key(n)] for n in out.nodes if not n["source_file"] and real.get(key(n), n["id"]) != n["id"]}
    out.nodes = [n for n in out.nodes if n["id"] not in swap]
    kept: dict[tuple, dict] = {}
    for link in out.links:
        link["source"], link["target"] = swap.get(link["source"], link["source"]), swap.get(link["target"], link["target"])
        kept.setdefault((link["source"], link["target"], link["relation"]), link)
    out.links = list(kept.values())
    for _, link in out.conditional:
        link["source"] = swap.get(link["source"], link["source"])
    return out
