"""The replace store as generations: cheap to read after many deliveries.

Layout under the store's root (all written and read by Spark):

- ``batches/delivery=<key>/<by>=<directory>/``: one folder per delivery, keyed by
  who delivers and the batch id. A delivery that is run again before it was
  committed overwrites its own folder; once committed it is not written again.
- ``data/generation=<n>/<by>=<directory>/``: what a merge resolved. Only the
  directories that deliveries touched since the last generation are written.
- ``manifest/generation=<n>/``: one row per live directory, naming the
  generation that holds it (its own for touched directories, else carried over).
- ``commits/``: one single-row file per committed delivery or generation. The
  file appears by one rename, so a delivery or generation is in it or not.

Readers follow the commits: the newest generation's manifest says which folders
are live, and only deliveries that no generation has merged are resolved on top,
in the directories they touch. A crash before a commit leaves folders nobody
reads, which the next run overwrites. One writer at a time per store.

Defined results: records without directory (null, empty, or the reserved name of
the null folder) or file name are rejects; rows with equal order keep one of
them; an empty delivery is committed and changes nothing; columns named
``generation`` or ``delivery`` are refused; columns that came later are null in
older rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.sinks import NULL_FOLDER, latest
from flowspark.records import CREATED_AT, RECORD_ID

COMMITS = "kind string, key string, number bigint, schema string, merged array<string>, directories bigint"


@dataclass
class State:
    """What the commits say: the newest generation, deliveries it hasn't merged, and all merged ones."""

    generation: int | None
    pending: list[str]
    schema: T.StructType | None
    settled: set[str]


@dataclass
class GenerationStore:
    spark: SparkSession
    root: str
    by: str
    filename: str
    order: Sequence[str] = (CREATED_AT, RECORD_ID)

    # ------------------------------------------------------------ commits
    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commit(self, kind: str, key: str, number: int, schema: T.StructType, merged: list[str], directories: int) -> None:
        row = self.spark.createDataFrame([(kind, key, number, schema.json(), merged, directories)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def state(self) -> State:
        """Reads the commits: a row per delivery and per generation, no data."""
        commits = self._commits()
        rows = [] if commits is None else commits.collect()
        merged = {k for r in rows for k in r.merged}
        batches = [r for r in rows if r.kind == "batch"]
        generations = [r.number for r in rows if r.kind == "generation"]
        fields: dict[str, T.StructField] = {}
        for r in sorted(rows, key=lambda r: (r.number, r.key)):
            fields |= {f.name: f for f in T.StructType.fromJson(json.loads(r.schema)).fields}
        return State(max(generations, default=None), sorted(r.key for r in batches if r.key not in merged),
                     T.StructType(list(fields.values())) if rows else None, {r.key for r in batches})

    # ------------------------------------------------------------ writing
    def append(self, df: DataFrame, batch_id: int, writer: str = "batch") -> DataFrame:
        """Store one delivery; returns its rejects. The same (writer, batch id) again stores nothing twice."""
        clash = {"generation", "delivery"} & set(df.columns)
        if clash:
            raise ValueError(f"columns that the store adds: {sorted(clash)}")
        folder = F.col(self.by).cast("string")
        ok = F.coalesce(folder.isNotNull() & (folder != "") & (folder != NULL_FOLDER)
                        & F.col(self.filename).isNotNull(), F.lit(False))
        key = f"{re.sub('[^A-Za-z0-9-]', '-', writer)}-{int(batch_id)}"
        if key not in self.state().settled:
            good = latest(df.filter(ok).withColumn(self.by, folder), [self.by, self.filename], self.order)
            path = f"{self.root}/batches/delivery={key}"
            good.hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(path)
            self._commit("batch", key, int(batch_id), good.schema, [], 0)
        return df.filter(~ok)

    def merge(self) -> int | None:
        """Resolve the deliveries since the last generation into a new one; its number, or the last if there are none."""
        now = self.state()
        if not now.pending:
            return now.generation
        number = (now.generation or 0) + 1
        fresh = self._batches(now)
        touched = fresh.select(self.by).distinct()
        live = self._manifest(now)
        old = self._data(now.schema, live.join(touched, self.by, "left_semi")) if live is not None else None
        both = fresh if old is None else old.unionByName(fresh)
        resolved = latest(both, [self.by, self.filename], self.order)
        resolved.hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(
            f"{self.root}/data/generation={number}")
        rows = touched.withColumn("holder", F.lit(number).cast("bigint"))
        if live is not None:
            rows = rows.unionByName(live.join(touched, self.by, "left_anti"))
        path = f"{self.root}/manifest/generation={number}"
        rows.write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()
        self._commit("generation", f"generation-{number}", number, now.schema, now.pending, n)
        return number

    # ------------------------------------------------------------ reading
    def _batches(self, now: State) -> DataFrame:
        paths = [f"{self.root}/batches/delivery={k}" for k in now.pending]
        schema = T.StructType([*now.schema.fields, T.StructField("delivery", T.StringType())])
        return (self.spark.read.schema(schema).option("basePath", f"{self.root}/batches").parquet(*paths)
                .select(*now.schema.names))

    def _manifest(self, now: State) -> DataFrame | None:
        """(directory, holder): the generation whose folder holds each live directory."""
        if now.generation is None:
            return None
        return self.spark.read.schema(f"`{self.by}` string, holder bigint").parquet(
            f"{self.root}/manifest/generation={now.generation}")

    def _generations(self, schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField("generation", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/data")

    def _data(self, schema: T.StructType, live: DataFrame) -> DataFrame:
        """The resolved rows of the live folders. Both join keys are partition columns: folders that no row of
        ``live`` names are pruned when it is known at run time, and no row of theirs passes in any case."""
        pairs = live.withColumnRenamed("holder", "generation")
        return self._generations(schema).join(pairs, ["generation", self.by], "left_semi").select(*schema.names)

    def read(self, directories: Sequence[str] | None = None) -> DataFrame | None:
        """What the store holds; None before the first delivery.

        With ``directories`` the manifest's rows of those directories become partition
        filters, so the scan lists their live folders only.
        """
        now = self.state()
        if now.schema is None:
            return None
        live, fresh = self._manifest(now), self._batches(now) if now.pending else None
        names = list(directories) if directories is not None else None
        if names is not None and fresh is not None:
            fresh = fresh.filter(F.col(self.by).isin(names))
        old = None
        if live is not None and names is None:
            old = self._data(now.schema, live)
        elif live is not None:
            held: dict[int, list[str]] = {}
            for r in live.filter(F.col(self.by).isin(names)).collect():  # at most a row per asked directory
                held.setdefault(r.holder, []).append(r[self.by])
            keep = F.lit(False)
            for holder, there in sorted(held.items()):
                keep = keep | ((F.col("generation") == holder) & F.col(self.by).isin(sorted(there)))
            old = self._generations(now.schema).filter(keep).select(*now.schema.names)
        if fresh is None:
            return old
        if old is None:
            return latest(fresh, [self.by, self.filename], self.order).select(*now.schema.names)
        touched = fresh.select(self.by).distinct()
        untouched = old.join(touched, self.by, "left_anti")
        changed = latest(old.join(touched, self.by, "left_semi").unionByName(fresh), [self.by, self.filename], self.order)
        return untouched.unionByName(changed).select(*now.schema.names)

    # ------------------------------------------------------------ housekeeping
    def vacuum(self) -> list[str]:
        """Delete folders that the newest generation has replaced: merged deliveries, older manifests, and
        generations that hold no live directory. Returns them. Not while an older state is being read."""
        now = self.state()
        if now.generation is None:
            return []
        holders = {r.holder for r in self._manifest(now).select("holder").distinct().collect()}  # at most one a generation
        gone = [f"batches/delivery={k}" for k in sorted(now.settled - set(now.pending))]
        gone += [f"data/generation={n}" for n in range(1, now.generation) if n not in holders]
        gone += [f"manifest/generation={n}" for n in range(1, now.generation)]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for folder in gone:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            if path.getFileSystem(conf).delete(path, True):
                out.append(folder)
        return out

    # ------------------------------------------------------------ as a stream sink
    def sink(self, writer: str, merge_every: int | None = None) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` function: store each micro-batch, merge after every ``merge_every`` of them.

        ``writer`` names the stream, and must stay the same over its restarts: a
        micro-batch that is run again has the same id and is stored once.
        """
        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id, writer)
            if merge_every and (batch_id + 1) % merge_every == 0:
                self.merge()
        return write
