"""A store of results in a shared folder: partitions written beside each other, and a commit record that is written last.

Every write of a partition goes to a folder of its own; nothing is overwritten. A commit is one small file that names, for each key, the folder that
counts, its rows and its fingerprint. It is written under a temporary name and renamed to the next number, which fails if another writer was faster. So a
write that is cut short is never read, a reader sees one commit or the next, and doing the same write again leaves the same result. Files are reached through Spark's
own file systems.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingResultsError(LookupError):
    """A result that is required is not committed."""


@dataclasses.dataclass(frozen=True)
class Entry:
    """What a commit says of a key: where its rows are, how many, their columns, and the fingerprint of what they were made from."""

    key: str
    path: str
    rows: int
    columns: str
    fingerprint: str


class ResultStore:
    """Results of one kind under `root`, by key. Keys are few (scenarios, leads): a commit names all of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entries(self, number: int | None = None) -> dict[str, Entry]:
        """What the newest commit (or that of a number) holds; nothing if there is none."""
        numbers = self._numbers()
        if not numbers:
            return {}
        file = f"{self.root}/commits/{numbers[-1] if number is None else number:012d}.json"
        text = self.spark.read.option("wholetext", "true").text(file).first()[0]
        record = json.loads(text)
        return {e["key"]: Entry(**e) for e in record["entries"]}

    def _commit(self, number: int, entries: dict[str, Entry]) -> bool:
        """Whether this writer made the commit; False if another has taken the number."""
        text = json.dumps({"entries": [dataclasses.asdict(entries[k]) for k in sorted(entries)]}, sort_keys=True)
        draft = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._path(f"{self.root}/commits/{number:012d}.json")
        try:
            done = not self._files.exists(final) and self._files.rename(draft, final)
        except Py4JJavaError:
            done = False
        if not done:
            self._files.delete(draft, False)
        return done

    def write(self, rows: DataFrame, by: str, fingerprints: dict[str, str] | None = None, most_tries: int = 10) -> dict[str, Entry]:
        """Writes `rows` by the column `by` and commits them in place of what these keys held; other keys stay. Returns the new commit.

        A null key is refused. With `fingerprints`, its keys are committed even if they have no rows.
        """
        target = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("_key", F.coalesce(F.col(by).cast("string"), F.raise_error(F.lit("a result without a key")))).write.partitionBy("_key").parquet(target)
        there = self._read(target, rows.schema.json())
        counts = {r["key"]: r["n"] for r in there.groupBy(F.col(by).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a key
        named = fingerprints or {}
        new = {k: Entry(k, target, counts.get(k, 0), rows.schema.json(), named.get(k, "")) for k in {*counts, *named}}
        for _ in range(most_tries):
            numbers = self._numbers()
            entries = self.entries(numbers[-1]) if numbers else {}
            if all(entries.get(k) is not None and (entries[k].rows, entries[k].fingerprint) == (e.rows, e.fingerprint) and e.fingerprint for k, e in new.items()) and new:
                self._files.delete(self._path(target), True)  # the same has been committed already
                return entries
            if self._commit(numbers[-1] + 1 if numbers else 0, entries | new):
                return entries | new
        raise RuntimeError(f"no commit in {most_tries} tries: too many writers")

    def _read(self, path: str, columns: str) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(columns)).fields
        return self.spark.read.schema(T.StructType([*fields, T.StructField("_key", T.StringType())])).parquet(path)

    def load(self, required: tuple[str, ...] = (), only: bool = False) -> DataFrame:
        """The committed rows of all keys (or of the required ones only); MissingResultsError names the required keys that are not committed, or says that there is nothing.

        Results that were written with other columns have null in those that they lack.
        """
        entries = self.entries()
        missing = [k for k in required if k not in entries]
        if missing or not entries:
            raise MissingResultsError(f"no results for {', '.join(missing)}" if missing else "nothing is committed")
        folders: dict[str, list[Entry]] = {}
        for e in entries.values():
            if not only or e.key in required:
                folders.setdefault(e.path, []).append(e)
        parts = [self._read(path, some[0].columns).where(F.col("_key").isin([e.key for e in some])).drop("_key") for path, some in sorted(folders.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def swept(self) -> int:
        """Removes data folders that the newest commit does not name (cut-short writes, replaced results); returns how many. For times without readers or writers."""
        folder = self._path(f"{self.root}/data")
        counting = {e.path.rsplit("/", 1)[-1] for e in self.entries().values()}
        gone = [s.getPath() for s in (self._files.listStatus(folder) if self._files.exists(folder) else ()) if s.getPath().getName() not in counting]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)


def summaries(store: ResultStore) -> DataFrame:
    """A row for each committed key: key, rows, fingerprint."""
    return store.spark.createDataFrame([(e.key, e.rows, e.fingerprint) for e in store.entries().values()], "key string, rows long, fingerprint string")
