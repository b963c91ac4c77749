"""The two tables of a property graph, and tables kept between steps."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "ord long, id string, label string, file_type string, source_file string, source_location string, community int, community_name string, extra string"
LINK_SCHEMA = "ord long, source string, target string, relation string, confidence string, context string, source_file string, source_location string, weight double, extra string"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
LINK_COLUMNS = [c.split()[0] for c in LINK_SCHEMA.split(", ")]
#: Rows of a file at most; ``ord`` is the file's rank times this, plus the row's place, and stays below BEYOND.
PER_FILE, BEYOND = 1 << 24, 1 << 60
#: Fixed values.
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


@dataclass
class PropertyGraph:
    """``ord`` is the order of first appearance: ties, first and last writers and traversals go by it."""

    nodes: DataFrame
    links: DataFrame
    meta: dict = field(default_factory=dict)

    def shaped(self) -> PropertyGraph:
        """With all columns of the schemas, null where missing."""
        fill = lambda df, schema: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))])
        return PropertyGraph(fill(self.nodes, NODE_SCHEMA), fill(self.links, LINK_SCHEMA), self.meta)

    def node_ids(self) -> DataFrame:
        return self.nodes.where("id is not null").select("id")


def scratch(spark: SparkSession) -> str:
    """The folder for tables between steps: the cluster's shared one.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a folder of its own; a cluster, whose
    machines would not see it, is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lumengraph-"))
    return sc.getCheckpointDir()


#: Tables that this process has written and not dropped.
_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in _written.items():
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may end first; a folder left over harms nothing
                _delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the scratch folder and reads them back: a short plan of known size, which survives lost executors.

    A checkpoint would keep the constraints that the optimiser has derived, and in a loop those multiply.
    The table goes with :func:`dropped` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _written[path] = spark
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables whose readers have all been written in turn."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path in _written:
            _delete(_written.pop(path), path)
