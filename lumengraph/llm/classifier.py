"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of the
whole text is encoded as a vector (shares of character classes, word lengths,
repetition, hashed words); a learned layer, gated attention

    a_i = softmax_i( w . ( tanh(V h_i) * sigmoid(U h_i) ) )

and a linear head on the weighted sum of the passages are trained together on
document labels only.  Training takes a sample of at most ``max_bags`` labelled
documents and ``max_passages`` evenly spaced passages of each, so its cost does
not grow with the corpus; scoring reads every passage of every document.

Labels, language, source and id are never inputs of a score.

Defined results: null, empty and wordless texts are a bag with one zero passage;
rows without id are scored and never trained on; with several labels for an id
the smallest counts; without any label every score is 0.5; repeated rows give one
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches
from .shingles import _SPACES, blocks, word_hashes

PASSAGE_WORDS = 64
BUCKETS = 32
#: Byte classes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}-_/\\+=@~^`", b"\n", b" \t")
WIDTH = len(CLASSES) + 1 + 5 + BUCKETS
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS_OF[list(_chars)] = _i


def encode(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's passages as rows of WIDTH features; at least one row."""
    for part in blocks([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        hashes, counts = word_hashes(part)
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        inside = ~_SPACES[data]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        first_word = np.concatenate(([0], np.cumsum(counts)[:-1]))
        n_passages = -(-counts // PASSAGE_WORDS)
        total = int(n_passages.sum())
        out = np.zeros((total, WIDTH), np.float32)
        if total:
            word_doc = np.repeat(np.arange(len(part)), counts)
            base = np.cumsum(n_passages) - n_passages
            passage = base[word_doc] + (np.arange(len(hashes)) - first_word[word_doc]) // PASSAGE_WORDS
            edge = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            size = np.diff(np.concatenate((edge, [len(passage)]))).astype(np.float32)
            # bytes belong to the passage of the last word that has begun
            byte_passage = np.repeat(passage, np.diff(np.concatenate((starts, [len(data)]))))
            kinds = len(CLASSES) + 1
            shares = np.bincount(byte_passage * kinds + _CLASS_OF[data[starts[0] :]], minlength=total * kinds).reshape(total, kinds).astype(np.float32)
            letters = shares[:, :-3].sum(1) + shares[:, -1]
            out[:, :kinds] = shares / np.maximum(shares.sum(1, keepdims=True), 1)
            ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
            spread = np.add.reduceat(((ends - starts).astype(np.float32)) ** 2, edge) / size
            mean = letters / size
            for lag, col in ((1, kinds + 2), (2, kinds + 3)):
                same = np.zeros(len(hashes), np.float32)
                same[lag:] = (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])
                out[:, col] = np.add.reduceat(same, edge) / size
            out[:, kinds], out[:, kinds + 1] = mean / 10, np.sqrt(np.maximum(spread - mean**2, 0)) / 10
            # words that stand in the passage for the first time: equal words are neighbours after a stable sort
            order = np.lexsort((hashes, passage))
            new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
            out[:, kinds + 4] = np.bincount(passage[order], weights=new, minlength=total) / size
            bucket = (hashes >> np.uint64(59)).astype(np.int64)
            out[:, kinds + 5 :] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / size[:, None]
        at = 0
        for n in n_passages:
            yield out[at : at + n] if n else np.zeros((1, WIDTH), np.float32)
            at += n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights of the encoder layer, the gated attention and the head; small and of fixed size."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, rows: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """``first``: index of each bag's first row."""
        p, s = self.weights, {}
        bag = np.zeros(len(rows), np.int64)
        bag[first[1:]] = 1
        s["bag"] = bag = np.cumsum(bag)
        s["x"] = np.clip((rows - self.shift) / self.scale, -8, 8)
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["V"]), _sigmoid(s["h"] @ p["U"])
        e = (s["t"] * s["g"]) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        s["a"] = e / np.add.reduceat(e, first)[bag]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], first, axis=0)
        s["p"] = _sigmoid(s["z"] @ p["c"] + p["d"])
        return s

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        first = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self._forward(np.concatenate(bags), first)["p"].astype(float)

    def gradients(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags."""
        p, s = self.weights, self._forward(rows, first)
        bag, h, a, t, g = s["bag"], s["h"], s["a"], s["t"], s["g"]
        out = (s["p"] - labels) / len(labels)
        dz = out[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dgate = de[:, None] * p["w"]
        dt, dg = dgate * g * (1 - t**2), dgate * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h**2)
        return {"c": s["z"].T @ out, "d": out.sum(), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": s["x"].T @ dpre, "b": dpre.sum(0)}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, steps: int = 150, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel | None:
    """Full-batch Adam from a fixed seed; None without bags."""
    if not bags:
        return None
    rows, first = np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags[:-1]])
    rng = np.random.default_rng(7)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, hidden), "U": draw(hidden, hidden), "w": draw(hidden), "c": draw(hidden), "d": np.float32(0)}
    model = AttentionModel(rows.mean(0), rows.std(0) + 0.02, weights)
    m, v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))
    labels = labels.astype(np.float32)
    for step in range(1, steps + 1):
        for k, grad in model.gradients(rows, first, labels).items():
            grad = grad + decay * weights[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            weights[k] = (weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _bags(max_passages: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = [x[np.unique(np.linspace(0, len(x) - 1, max_passages).astype(int))] if len(x) > max_passages else x for x in encode(b["text"].tolist())]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "bag": [x.ravel() for x in bags]})

    return scan


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_bags: int = 3000, max_passages: int = 16) -> AttentionModel | None:
    """Learns from labelled documents outside the held-out fold: of all of them, the ``max_bags`` whose ids hash lowest."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_bags).collect()
    if not sample:
        return None
    # at most max_bags pairs of numbers
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sample, known.schema))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    rows = texts.mapInPandas(_bags(max_passages), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, bag array<float>")
    # repeated ids: still at most max_bags
    with small_batches(docs.sparkSession):
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("bag", "label")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    return train([np.array(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["label"] for r in rows]))


def _scorer(model: AttentionModel | None) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), 256):
                out += model.score(list(encode(texts.iloc[at : at + 256].tolist()))).tolist() if model else [0.5] * len(texts.iloc[at : at + 256])
            yield pd.Series(out, dtype="float64")

    return scored


def score(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``score`` (0 to 1, higher: label 1 is likelier) of each document; only texts go to Python."""
    return docs.select(*keep, _scorer(model)(F.col(text_col)).alias("score"))


def keep_good(docs: DataFrame, model: AttentionModel | None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose score reaches ``min_score``."""
    return packed(docs, score=_scorer(model)(F.col(text_col))).where(F.col("score") >= min_score).select("row.*")
