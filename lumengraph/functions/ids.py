"""The identifier recipe for code that runs in Python workers; the same results as the Column functions."""

from __future__ import annotations

import re
import unicodedata

_BETWEEN = re.compile(r"(?:[^\w]|_)+")


def normalize_id(text: str) -> str:
    return _BETWEEN.sub("_", unicodedata.normalize("NFKC", text)).strip("_").lower()


def make_id(*parts: str) -> str:
    return normalize_id("_".join(filter(None, (p.strip("_.") for p in parts))))


def basename(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def file_stem(path: str) -> str:
    name = basename(path)
    if name in ("", ".", ".."):
        return ""
    dot = name.rfind(".")
    return path[: len(path) - len(name)] + (name[:dot] if dot > 0 else name)


def normpath(path: str) -> str:
    """Without . and .. as far as the text tells."""
    out: list[str] = [""] if path.startswith("/") else []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] not in ("..", ""):
            out.pop()
        else:
            out.append(part)
    return "/".join(out) or "."
