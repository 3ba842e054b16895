"""Parquet tables with a commit log (SNK-1, SNK-2, SNK-3 for several writers).

A table is a folder::

    data/commit=<uuid>/scope=<scope>/*.parquet     rows, written once, never changed
    _log/<version>.json                            the state of the table at a version

A writer stages its rows in a folder of its own, which no reader looks at, and
then publishes the next version of the state: the live folders, the ids in use,
the schema.  A version is a complete file that is renamed to a name which must
not exist yet, so of two writers that publish the same version one fails, reads
the new state and tries again; the staged rows stay as they are.  A reader
takes one version, so it sees all of a commit or nothing of it.  Rows of a
writer that dies are in no version; ``vacuum`` deletes them.

Ids.  A staged row has its task and its number in it (``_local``).  The commit
reserves a range for the folder, and the id is ``base + number * tasks + task``:
unequal over all commits, close to dense, computed when the table is read.  A
retried commit gets another range without a row being written again.

The log folder needs a file system whose rename does not replace a file (HDFS,
a shared POSIX folder); the driver handles states only, one entry per live
folder and scope.

Cases: an empty commit publishes a version without rows.  A null scope is a
folder of its own, as Spark writes it.  Later commits may add columns (null in
earlier rows), not change a column's type.  An unpublished table reads as None.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCAL, COMMIT = "_local", "commit"
#: bits of monotonically_increasing_id that number the rows of a task
ROW_BITS = 33
TRIES = 20


class Conflict(Exception):
    """Another writer changed what this commit was computed from."""


@dataclass(frozen=True)
class State:
    """One version: live folders as (commit, scope folder), reserved ranges."""
    version: int = -1
    next_id: int = 0
    schema: str | None = None
    live: tuple = ()                                 # (commit, scope folder)
    ranges: dict = field(default_factory=dict)       # commit -> [base, tasks]
    batches: dict = field(default_factory=dict)      # stream -> last batch committed

    def folders(self, scopes) -> set:
        return {x for x in self.live if x[1] in scopes}


@dataclass(frozen=True)
class Staged:
    """Rows of one writer, stored but not yet part of the table."""
    commit: str
    scopes: tuple
    schema: str
    tasks: int
    rows: int                                        # most rows of a task
    seen: State


class LoggedTable:
    def __init__(self, spark: SparkSession, path: str, id_column: str | None = None):
        self.spark, self.path, self.id_column = spark, path.rstrip("/"), id_column
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    # ------------------------------------------------------------ files
    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _version_path(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def _publish(self, state: State) -> bool:
        """Make ``state`` the table's next version; False if there is one already."""
        draft = self._at(f"{self.path}/_log/.{uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        keep = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._at(self._version_path(state.version))
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), keep)
            return True
        except Exception:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    # ------------------------------------------------------------ reading
    def state(self, version: int | None = None) -> State:
        """The newest state, or that of an earlier version."""
        if version is None:
            found = [int(n[:-5]) for n in self._names(f"{self.path}/_log")
                     if n.endswith(".json") and n[0] != "."]
            if not found:
                return State()
            version = max(found)
        text = self.spark.read.text(self._version_path(version), wholetext=True).first()[0]
        raw = json.loads(text)
        return State(**{**raw, "live": tuple(tuple(x) for x in raw["live"])})

    def read(self, state: State | None = None) -> DataFrame | None:
        """The rows of one version (default: the newest), with their ids."""
        state = state or self.state()
        if state.schema is None:
            return None
        kind = StructType.fromJson(json.loads(state.schema))
        columns = [f.name for f in kind.fields]
        stored = StructType(kind.fields).add(LOCAL, "long").add(COMMIT, "string")
        if not state.live:
            rows = self.spark.createDataFrame([], stored)
        else:
            rows = (self.spark.read.schema(stored).option("basePath", f"{self.path}/data")
                    .parquet(*[f"{self.path}/data/{COMMIT}={c}/{s}" for c, s in state.live]))
        if self.id_column is None:
            return rows.select(*columns)
        commits = sorted({c for c, _ in state.live})
        ranges = self.spark.createDataFrame([(c, *state.ranges[c]) for c in commits],
                                            f"{COMMIT} string, _base long, _tasks long")
        task, number = F.shiftright(LOCAL, ROW_BITS), F.col(LOCAL).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        return (rows.join(ranges, COMMIT)
                .select((F.col("_base") + number * F.col("_tasks") + task).alias(self.id_column), *columns))

    # ------------------------------------------------------------ writing
    def stage(self, df: DataFrame) -> Staged:
        """Store the rows of ``df`` in a folder that no version names yet."""
        clash = {LOCAL, COMMIT, self.id_column} & set(df.columns)
        if clash or "scope" not in df.columns:
            raise ValueError(f"a logged table has a column scope and none of {sorted(clash) or LOCAL}")
        seen, commit = self.state(), uuid4().hex
        folder = f"{self.path}/data/{COMMIT}={commit}"
        df.withColumn(LOCAL, F.monotonically_increasing_id()).write.partitionBy("scope").parquet(folder)
        scopes = tuple(sorted(n for n in self._names(folder) if n.startswith("scope=")))
        tasks = rows = 0
        if scopes:
            at = self.spark.read.schema(f"{LOCAL} long").parquet(folder).agg(
                F.max(F.shiftright(LOCAL, ROW_BITS)).alias("task"),
                F.max(F.col(LOCAL).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("row")).first()
            tasks, rows = at.task + 1, at.row + 1
        return Staged(commit, scopes, df.schema.json(), tasks, rows, seen)

    def commit(self, staged: Staged, replaces: bool = False, computed_from: State | None = None,
               batch: tuple[str, int] | None = None) -> State:
        """Publish staged rows: appended, or (``replaces``) instead of the rows
        of their scopes.  Rows ``computed_from`` a state raise ``Conflict`` if
        another commit has changed their scopes since.  A ``batch`` (stream,
        number) that is committed already is not committed again."""
        state = staged.seen
        for _ in range(TRIES):
            if batch and state.batches.get(batch[0], -1) >= batch[1]:
                return state
            if computed_from and state.folders(staged.scopes) != computed_from.folders(staged.scopes):
                raise Conflict(f"scopes of {staged.commit} changed after version {computed_from.version}")
            live = tuple(x for x in state.live if not (replaces and x[1] in staged.scopes))
            live += tuple((staged.commit, s) for s in staged.scopes)
            used = {c for c, _ in live}
            ranges = {c: r for c, r in state.ranges.items() if c in used}
            if staged.scopes:
                ranges[staged.commit] = [state.next_id, staged.tasks]
            new = replace(state, version=state.version + 1, next_id=state.next_id + staged.tasks * staged.rows,
                          schema=_merged(state.schema, staged.schema), live=live, ranges=ranges,
                          batches={**state.batches, **({batch[0]: batch[1]} if batch else {})})
            if self._publish(new):
                return new
            state = self.state()
        raise Conflict(f"no free version in {TRIES} tries")

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> State:
        """Add rows; every row gets an id that no other commit has."""
        if batch and self.state().batches.get(batch[0], -1) >= batch[1]:
            return self.state()
        return self.commit(self.stage(df), batch=batch)

    def replace_scopes(self, df: DataFrame) -> State:
        """Replace the scopes that ``df`` has rows of; other scopes stay."""
        return self.commit(self.stage(df), replaces=True)

    def upsert(self, df: DataFrame, keys=("scope", "name")) -> State:
        """Rows of ``df`` replace stored rows of equal keys (nulls equal each
        other); the rest of their scopes is kept.  Computed again if another
        writer changed a scope."""
        for _ in range(TRIES):
            base = self.state()
            old = None if base.schema is None else self.read(base)
            rows = df
            if old is not None:
                same = lambda cols: [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cols]
                old = old.drop(*([self.id_column] if self.id_column else []))
                touched = old.alias("o").join(df.select("scope").distinct().alias("n"), same(["scope"]), "left_semi")
                kept = touched.alias("o").join(df.select(*keys).alias("n"), same(keys), "left_anti")
                rows = kept.unionByName(df, allowMissingColumns=True)
            try:
                return self.commit(self.stage(rows), replaces=True, computed_from=base)
            except Conflict:
                continue
        raise Conflict(f"scopes changed in each of {TRIES} tries")

    def vacuum(self, older_than_hours: float = 168) -> list[str]:
        """Delete folders that the newest version does not name and whose last
        change is older; longer than any writer or reader runs."""
        named = {c for c, _ in self.state().live}
        before = self._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
        gone = []
        for name in self._names(f"{self.path}/data"):
            at = self._at(f"{self.path}/data/{name}")
            if (name.startswith(f"{COMMIT}=") and name.split("=", 1)[1] not in named
                    and self._fs.getFileStatus(at).getModificationTime() <= before):
                self._fs.delete(at, True)
                gone.append(name)
        return sorted(gone)


def _merged(old: str | None, new: str) -> str:
    """The old columns, then those that are new, all nullable."""
    fields = {}
    for text in (old, new):
        for f in StructType.fromJson(json.loads(text)).fields if text else ():
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name}: {fields[f.name].dataType.simpleString()} is stored, "
                                 f"{f.dataType.simpleString()} is written")
            fields.setdefault(f.name, f)
            fields[f.name].nullable = True
    return StructType(list(fields.values())).json()


def posts_log(spark: SparkSession, path: str) -> LoggedTable:
    """Posts by scope; ``post_id`` is the table's, the platform's is ``native_id``."""
    return LoggedTable(spark, path, id_column="post_id")


def append_posts(posts: DataFrame, path: str, batch: tuple[str, int] | None = None) -> State:
    """SNK-1 for any number of writers at once (likes and shares default to 0)."""
    rows = (posts.withColumnRenamed("post_id", "native_id")
            .withColumn("likes", F.coalesce("likes", F.lit(0)).cast("long"))
            .withColumn("shares", F.coalesce("shares", F.lit(0)).cast("long")))
    return posts_log(posts.sparkSession, path).append(rows, batch)
