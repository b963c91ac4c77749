"""What an extractor hands over: ordered nodes and links of one file."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.ids import basename, file_stem, make_id, normpath


@dataclass
class Emitter:
    path: str
    nodes: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    #: (target as emitted, path of a file, id if that file is there), best first
    choices: list[tuple[str, str, str]] = field(default_factory=list)
    #: links that are there only if a file is: (its path, link)
    conditional: list[tuple[str, dict]] = field(default_factory=list)

    def __post_init__(self):
        self.stem = file_stem(self.path)
        self.name = basename(self.path)
        self.known: dict[str, dict] = {}

    def node(self, node_id: str, label: str, line: int | None = None, file_type: str = "code", source_file: str | None = None, location: str | None = "", **extra) -> str:
        """Adds a node unless its id is there; ``line`` gives its location."""
        if node_id and node_id not in self.known:
            row = {"id": node_id, "label": label, "file_type": file_type, "source_file": self.path if source_file is None else source_file, "source_location": f"L{line}" if line else location, **extra}
            self.known[node_id] = row
            self.nodes.append(row)
        return node_id

    def stub(self, name: str, label: str | None = None) -> str:
        """The file's own symbol of that name, or else a sourceless node."""
        own = make_id(self.stem, name)
        return own if own in self.known else self.node(make_id(name), label or name, source_file="")

    def link(self, source: str, target: str, relation: str, line: int | None = None, confidence: str | None = "EXTRACTED", weight: float | None = 1.0, context: str | None = None, **extra) -> None:
        if source and target:
            self.links.append(self._link(source, target, relation, line, confidence, weight, context, **extra))

    def _link(self, source: str, target: str, relation: str, line: int | None = None, confidence: str | None = "EXTRACTED", weight: float | None = 1.0, context: str | None = None, **extra) -> dict:
        return {"source": source, "target": target, "relation": relation, "confidence": confidence, "context": context, "source_file": self.path, "source_location": f"L{line}" if line else extra.pop("location", None), "weight": weight, **extra}

    def link_if(self, path: str, source: str, target: str, relation: str, line: int | None = None, **extra) -> None:
        """A link for the case that the folder has a file at ``path``."""
        if source and target:
            self.conditional.append((path, self._link(source, target, relation, line, **extra)))

    def choose(self, target: str, paths: list[str], *names: str) -> None:
        """``target`` stands for the first of ``paths`` that is a file of the folder, or for the symbol of that name in it."""
        self.choices += [(target, p, make_id(file_stem(p), *names)) for p in paths]

    def beside(self, path: str) -> str:
        """A path as written in this file, from the root of the scan."""
        folder = self.path.rpartition("/")[0]
        return normpath(f"{folder}/{path}" if folder and not path.startswith("/") else path)

    def file_node(self, file_type: str = "code", line: int | None = 1) -> str:
        return self.node(make_id(self.stem), self.name, line, file_type)
