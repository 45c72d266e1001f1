"""Tables of fold states in segments: each batch adds one, and segments of a kind are merged now and then.

A segment is a folder of Parquet files in hash buckets of the first key column. A batch writes its own segment and reads of
the others only the buckets that the keys it asks for fall into; FAN segments of a level are merged into one of the next, so
a row is rewritten a number of times that grows with the logarithm of the table. What counts is what the manifest names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.staging import removed
from eventloom.operators.folds import Fold, merged

#: Rows that a bucket is meant to have, segments of a level before they are merged, steps that run at a time.
BUCKET_ROWS, FAN, AT_ONCE = 50_000, 8, 8


class Folder:
    """Names, files and marks under a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def names(self, name: str = "") -> list[str]:
        fs, at = self._fs(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def put(self, name: str, text: str) -> None:
        """Writes a small file beside its place and moves it there, so that it is whole or absent."""
        fs, at = self._fs(name)
        _, draft = self._fs(f"{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(draft, at)

    def get(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())  # one small file

    def drop(self, name: str) -> None:
        removed(self.spark, f"{self.path}/{name}")


class Manifest(Folder):
    """Numbered versions of a small document; the newest counts, two are kept."""

    def versions(self) -> list[int]:
        return sorted(int(x[1:-5]) for x in self.names() if x.startswith("v") and x.endswith(".json"))

    def load(self) -> dict:
        done = self.versions()
        return json.loads(self.get(f"v{done[-1]}.json")) if done else {"segments": {}, "batch": -1}

    def publish(self, doc: dict) -> None:
        done = self.versions()
        self.put(f"v{(done[-1] if done else 0) + 1}.json", json.dumps(doc))
        for old in done[:-1]:
            self.drop(f"v{old}.json")


def at_once(steps: Iterable[Callable[[], object]]) -> list:
    """Independent steps, several at a time: each is a small job, whose fixed costs then overlap."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n) - 1).bit_length() if n > 1 else 1


class Segments(Folder):
    """One fold's segments. The list of those that count comes from, and goes back to, the caller's manifest."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, shape: T.StructType):
        super().__init__(spark, path)
        self.fold, self.shape = fold, shape
        self.bucketed_by = fold.key[0]

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.bucketed_by), F.lit(n)).cast("int")

    def write(self, rows: DataFrame, name: str, expected: int, level: int = 0) -> dict:
        """Writes a segment of about so many rows; name's former files go."""
        n = power_of_two(expected / BUCKET_ROWS)
        if n == 1:
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/bucket=0")
        else:
            rows.withColumn("bucket", self.bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        have = [int(x[7:]) for x in self.names(name) if x.startswith("bucket=")]
        return {"name": name, "level": level, "buckets": n, "have": have, "rows": expected}

    def read(self, segments: list[dict], touched: set[int] | None = None, of: int = 1) -> DataFrame:
        """All rows of these segments, or those of the buckets (of so many) that are touched."""
        paths = []
        for s in segments:
            mine = None if touched is None or s["buckets"] > of else {b % s["buckets"] for b in touched}
            paths += [f"{self.path}/{s['name']}/bucket={b}" for b in s["have"] if mine is None or b in mine]
        return self.spark.read.schema(self.shape).parquet(*paths) if paths else self.spark.createDataFrame([], self.shape)

    def state(self, segments: list[dict]) -> DataFrame:
        return merged(self.read(segments), self.fold)

    def lookup(self, segments: list[dict], keys: DataFrame) -> DataFrame:
        """The merged rows whose first key column is among keys' only column."""
        n = max((s["buckets"] for s in segments), default=1)
        keys = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
        touched = None
        if n > 1:
            touched = {r[0] for r in keys.select(F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int")).distinct().collect()}  # buckets, not keys
        rows = self.read(segments, touched, n)
        return merged(rows.join(keys, F.col(self.bucketed_by).eqNullSafe(F.col("_key")), "left_semi"), self.fold)

    def compacted(self, segments: list[dict], newest: str) -> tuple[list[dict], list[str]]:
        """The segments, with FAN of a level merged into one of the next, and the names of those that go. The newest batch's stays as it is: it may run again."""
        out, gone = list(segments), []
        for level in range(20):
            same = [s for s in out if s["level"] == level and s["name"] != newest]
            if len(same) < FAN:
                continue
            rows = sum(s["rows"] for s in same)
            name = f"m{level + 1}-{same[-1]['name'].removeprefix('m').replace('-', '_')}"
            one = self.write(merged(self.read(same), self.fold), name, rows, level + 1)
            names = {s["name"] for s in same}
            out = [s for s in out if s["name"] not in names] + [one]
            gone += sorted(names)
        return out, gone
