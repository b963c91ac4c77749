"""Near-duplicate documents by min-max hashing.

Every document becomes its set of word shingles.  Under each permutation of the
hash space both the minimum and the maximum of the set are kept, so that
``permutations`` hash evaluations give twice as many signature values; bands of
``rows`` values are the buckets.  Documents with the same set are one class from
the start, so that groups of exact copies count once in everything that follows.

Links are confirmed on the full sets.  In a bucket, members are compared with one of
them, its centre; those that it links become one component.  Buckets whose members
all lie in one component are done.  In the others, what is left are members outside
the centre's component.  They are held against all members of their buckets in other
components, block by block, by a bitmap of each set, whose length follows the set's:
two sets differ in at least as many shingles as their bitmaps in bits, so that most pairs
below the threshold are ruled out exactly and without their sets.  Of those that may be linked, rounds compare the
nearest partners of each member first, eight times as many in each round, and
contract what is linked; they end when no member outside has a possible partner in
another component that has not been compared.  No candidate is dropped, and no pairs
leave a block but those that are compared.

Defined results: words are runs of anything but space and \\t..\\r, A-Z in lower
case; null, empty and wordless texts have an empty set and link with nothing;
ids may be null or repeat: a component's id is the smallest id that is not null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, small_batches, stored
from .components import components, extended
from .shingles import mix, shingle_sets

#: Partners of a member that the first round compares; each further round takes GROWTH times as many.
FIRST_TRIES, GROWTH = 4, 64
#: Members of a block, and members outside that are held against it in one go.
PER_BLOCK, PER_GO = 1024, 256
#: Pairs of one class that one copy of its set serves, and documents of one class that one copy of its component serves.
PER_COPY, PER_CLASS = 256, 1024
#: Bits for each shingle in the bitmap of a set (then up to a power of two); bits of a bitmap at least and at most.
PER_SHINGLE, FEWEST, MOST = 2, 64, 1 << 16


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, the two of one permutation far apart."""
    k = np.arange(permutations, dtype=np.uint64)
    factor, addend = mix(k) | np.uint64(1), mix(k + np.uint64(1 << 40))
    low, high = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), 1024):  # blocks that stay in the cache
        block = shingles[at : at + 1024, None] * factor + addend
        low, high = np.minimum(low, block.min(axis=0)), np.maximum(high, block.max(axis=0))
    return np.concatenate([low, high])


def _band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    table = values.reshape(-1, rows)
    keys = mix(np.arange(len(table), dtype=np.uint64))
    for j in range(rows):
        keys = mix(keys ^ table[:, j])
    return keys


def _sign(width: int, permutations: int, rows: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, sizes, bands = [], [], []
            for s in shingle_sets(b.pop("text").tolist(), width):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(_band_keys(signature(s, permutations), rows).view(np.int64) if len(s) else None)
            yield b.assign(key=keys, n_shingles=sizes, bands=bands)

    return scan


def _bitmap(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit: what two sets share leaves no trace between their bitmaps."""
    width = min(MOST, max(FEWEST, 1 << (PER_SHINGLE * len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as they would be with ``words`` words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _sets(width: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"].tolist(), width))
            yield pd.DataFrame({"key": b["key"], "shingles": [s.view(np.int64) for s in sets], "bits": [_bitmap(s) for s in sets]})

    return scan


def _compare(percent: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            linked = []
            for x, y in zip(b.pop("x"), b.pop("y")):
                n = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(n * 100 >= (len(x) + len(y) - n) * percent)
            yield b[linked]

    return scan


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs ``a, b`` of classes those whose full sets share at least ``percent`` of their union; ``pairs`` is a stored table.

    A class of many pairs has its set copied, so that they part.  Both ends read the same copies: sets are shuffled once.
    """
    many = _ends(pairs).groupBy("key").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies")).where("copies > 1")
    many = stored(many)
    copies = F.coalesce("copies", F.lit(1))
    held = sets.select("key", "shingles").join(many, "key", "left").select("key", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "shingles")
    dealt = pairs
    for end in ("a", "b"):
        dealt = dealt.join(many.withColumnRenamed("key", end), end, "left").withColumn(f"{end}_copy", F.pmod(F.xxhash64("a", "b"), copies).cast("int")).drop("copies")
    joined = dealt.join(held.toDF("a", "a_copy", "x"), ["a", "a_copy"]).join(held.toDF("b", "b_copy", "y"), ["b", "b_copy"])
    out = stored(joined.select("a", "b", "x", "y").mapInPandas(_compare(percent), "a binary, b binary"))
    dropped(many)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b"))


def _named(keys: DataFrame, labels: DataFrame, key: str, comp: str) -> DataFrame:
    """``keys`` with the component of the class in column ``key``; classes without links are components of their own."""
    named = keys.join(labels.select(F.col("node").alias(key), F.col("comp").alias(comp)), key, "left")
    return named.withColumn(comp, F.coalesce(comp, key))


#: A member in one binary value: its class, component and size, then its bitmap.
_HEAD = np.dtype([("key", "V16"), ("comp", "V16"), ("size", ">i4")])


def _by_width(records: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the records with bitmaps of one length, and these bitmaps."""
    lengths = np.array([len(r) for r in records])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(records[k][_HEAD.itemsize :] for k in at), np.uint64).reshape(len(at), -1)


def _apart(xs: list[bytes], ys: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair: whether it may be linked and lies in two components; shingles that only one has, at least; both sizes."""
    x, y = (np.frombuffer(b"".join(r[: _HEAD.itemsize] for r in rows), _HEAD) for rows in (xs, ys))
    # components as numbers
    comp = np.unique(np.concatenate((x["comp"], y["comp"])).view("S16"), return_inverse=True)[1]
    sizes, others = x["size"].astype(np.int64)[:, None], y["size"].astype(np.int64)
    apart, both = np.abs(sizes - others), sizes + others
    near = lambda: apart * (100 + percent) <= both * (100 - percent)
    able, groups = (comp[: len(x), None] != comp[len(x) :]) & near(), list(_by_width(ys))
    for i, bits in _by_width(xs):
        for j, held in groups:
            some = able[np.ix_(i, j)]
            if some.any():
                words = min(bits.shape[1], held.shape[1])
                v = _folded(held, words)
                for k, u, m in zip(i, _folded(bits, words), some):
                    apart[k, j[m]] = np.maximum(apart[k, j[m]], np.bitwise_count(u ^ v[m]).sum(axis=1, dtype=np.int64))
    return able & near(), apart, both


def _near(percent: int, tries: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for xs, ys in zip(b["xs"], b["ys"]):
                able, apart, both = _apart(xs, ys, percent)
                share = np.where(able, apart / both, 2.0)
                for i in np.flatnonzero(able.any(axis=1)):
                    n = int(able[i].sum())
                    best = np.argsort(share[i], kind="stable")[: min(n, tries)]
                    out.append((xs[i][:16], [ys[j][:16] for j in best], share[i][best], n > tries))
            yield pd.DataFrame(out, columns=["x", "found", "apart", "more"])

    return scan


def _partners(open_: DataFrame, sets: DataFrame, percent: int, tries: int) -> DataFrame:
    """``x, found, more``: the ``tries`` nearest members of its buckets that may be linked with a member outside and lie in other components, and whether there are more.

    ``open_``: ``bucket, key, comp, away``.
    """
    size = F.to_binary(F.lpad(F.hex("size"), 8, "0"), F.lit("hex"))
    rows = open_.join(sets.select("key", F.size("shingles").alias("size"), "bits"), "key").select("bucket", "key", "away", F.concat("key", "comp", size, "bits").alias("record"))
    away = F.sum(F.col("away").cast("int"))
    counts = open_.groupBy("bucket").agg(F.ceil(F.count("*") / PER_BLOCK).cast("int").alias("blocks"), F.ceil(away / PER_GO).cast("int").alias("goes"))
    rows = rows.join(counts.where("goes > 0"), "bucket")
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    y = rows.withColumn("block", part("blocks")).groupBy("bucket", "block").agg(F.collect_list("record").alias("ys"))
    x = rows.where("away").withColumn("go", part("goes")).groupBy("bucket", "go", "blocks").agg(F.collect_list("record").alias("xs"))
    x = x.select("bucket", "xs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = x.join(y, ["bucket", "block"]).select("xs", "ys").mapInPandas(_near(percent, tries), "x binary, found array<binary>, apart array<double>, more boolean")
    listed = F.transform("found", lambda y, i: F.struct(F.get("apart", i).alias("apart"), y.alias("y")))
    found = found.groupBy("x").agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("found"), F.max("more").alias("more"))
    # a partner in several buckets counts once
    found = found.select("x", F.array_distinct(F.transform("found", lambda f: f["y"])).alias("found"), "more")
    return found.select("x", F.slice("found", 1, tries).alias("found"), (F.col("more") | (F.size("found") > tries)).alias("more"))


def _settled(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` with all links between members of one bucket, by rounds of nearest partners first."""
    open_, tries, tried = members, FIRST_TRIES, None
    while True:
        named = _named(_named(open_.select("bucket", "key", "centre"), labels, "key", "comp"), labels, "centre", "home")
        named = stored(named.withColumn("away", F.col("comp") != F.col("home")).drop("home"))
        if tries > FIRST_TRIES:
            dropped(open_)
        open_ = stored(named.join(named.where("away").select("bucket").distinct(), "bucket", "left_semi"))
        found = stored(_partners(open_, sets, percent, tries))
        pairs = found.select("x", F.explode("found").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        # without more, these are all possible partners: what they link only brings components together
        last = found.where("more").isEmpty()
        dropped(named, found)
        if not (last and pairs.isEmpty()):
            needed = stored(sets.select("key", "shingles").join(_ends(pairs).distinct(), "key", "left_semi"))
            linked = _linked(pairs, needed, percent)
            labels = extended(labels, linked)
            dropped(needed, linked)
        if last:
            return labels
        tried = pairs if tried is None else tried.union(pairs)
        tries *= GROWTH


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 40, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, component_key, kept``.

    ``component_key`` names the component by one of its sets (null for an empty
    set), where ids may be null or repeat.

    Two documents are linked when their sets share at least ``percent`` of their
    union.  With the default bands a link of exactly 0.8 is missed with a chance
    of (1 - 0.8**4)**20 = 2.6e-5, a closer one less often.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    # ids are text in Python, which has no whole numbers beside nulls
    signed = source.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_sign(width, permutations, rows), "doc_id string, text_key long, key binary, n_shingles long, bands array<long>")
    with small_batches(docs.sparkSession):
        signed = stored(signed.withColumn("doc_id", F.col("doc_id").cast(id_type)))

    # one class for each distinct set, known by the smallest of its documents
    classes = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = stored(classes)
    bands = classes.select("key", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other").select("bucket", "n")
    members = stored(bands.join(shared, "bucket"))
    # a bucket's centre is its member that most others meet in any bucket: the text that copies were made from, or one close to it
    met = members.groupBy("key").agg(F.sum("n").alias("met"))
    centres = members.join(met, "key").groupBy("bucket").agg(F.max_by("key", F.struct("met", "key")).alias("centre"))
    members = stored(members.select("bucket", "key").join(centres, "bucket"))

    # no id has the name of a null one
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("name")
    wanted = members.select("key").distinct().join(classes.select("key", "one"), "key")
    wanted = wanted.select("key", name("one.doc_id"), F.col("one.text_key").alias("text_key"))
    # the join has brought rows that are alike together already
    texts = source.select(name("doc_id"), "text_key", "text").join(wanted, ["name", "text_key"]).dropDuplicates(["name", "text_key"]).select("key", "text")
    with small_batches(docs.sparkSession):
        sets = stored(texts.mapInPandas(_sets(width), "key binary, shingles array<long>, bits binary"))

    stars = stored(members.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    linked = _linked(stars, sets, percent)
    labels = _settled(members, components(linked), sets, percent)
    dropped(stars, linked, members, sets)

    # smallest id of each component, then of each class in it
    placed = labels.select(F.col("node").alias("key"), "comp").join(classes.select("key", "low"), "key")
    lows = placed.groupBy("comp").agg(F.min("low").alias("comp_low"))
    known = placed.join(lows, "comp").select("key", "comp", "comp_low")
    known = classes.select("key", "low").join(known, "key", "left").select("key", F.coalesce("comp", "key").alias("component_key"), F.coalesce("comp_low", "low").alias("component_id"))
    # a class of many documents has its component copied, so that they part
    many = classes.where(F.col("n") > PER_CLASS).select("key", F.ceil(F.col("n") / PER_CLASS).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    known = known.join(many, "key", "left").select("key", "component_key", "component_id", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    out = signed.select("doc_id", "text_key", "n_shingles", "key").join(many, "key", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "text_key"), copies).cast("int"))
    out = out.join(known, ["key", "copy"], "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", "component_key", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, one row of each component: the smallest id (null last), then the smallest text key.

    Texts without words all stay, but rows alike in id and text leave once.
    """
    found = near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = found.where("component_key is not null").groupBy("component_key").agg(F.min(order).alias("one")).select("one.doc_id", "one.text_key")
    chosen = chosen.union(found.where("component_key is null").select("doc_id", "text_key").distinct())
    # no id has the name of a null one
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    chosen = chosen.select(name("doc_id").alias("id"), F.col("text_key").alias("key"))
    keyed = packed(docs, id=name(id_col), key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # the join has brought rows that are alike together already
    return keyed.join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("row.*")
