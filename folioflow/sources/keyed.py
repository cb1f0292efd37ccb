"""Tables by key on plain Parquet that micro-batches change: ledgers, stream state, the chunk table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

_BUCKET, _PART = "__bucket", "__part"


class KeyedTable:
    """Rows by key, each key's rows replaced as a whole by later batches.

    Keys are hashed into buckets. A batch appends its rows and the keys that it replaces, so it writes in proportion to what
    it changes; a key without rows is a tombstone. A read takes, for each key, the rows of the last part that names it, and
    reads the asked buckets only. A bucket with more than `most_parts` parts is written anew by the batch that finds it so,
    and rows that `expired` names are left out then, which bounds tables whose rows have an end.

    Batch n writes the parts 2n (changes) and 2n + 1 (buckets written anew), then its manifest, a small file that names the
    parts to read of each bucket. A batch reads only manifests before it, so a repeated batch, after a failure at any point, writes the same again.
    Old parts stay for readers until `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16, most_parts: int = 8, expired: Callable[[DataFrame], Column] | None = None) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets, self.most_parts, self.expired = spark, path, key, StructType.fromDDL(schema), buckets, most_parts, expired

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: at most as many as there are."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def _at(self, name: str) -> tuple[object, object]:
        """A path below the table's, and its file system, whatever store that is."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._at(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _buckets_in(self, folder: str) -> set[int]:
        return {int(n.partition("=")[2]) for n in self._names(folder) if n.startswith(f"{_BUCKET}=")}

    def manifest(self, before: int | None = None) -> dict[int, list[tuple[int, bool]]]:
        """For each bucket its parts, and whether they have rows, as of the last batch before this one (null: the last)."""
        known = [int(n) for n in self._names("manifest") if n.isdigit() and (before is None or int(n) < before)]
        if not known:
            return {}
        path, fs = self._at(f"manifest/{max(known)}")
        listed = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8"))
        return {int(b): [(p, has) for p, has in parts] for b, parts in listed.items()}

    def _read(self, kind: str, schema: StructType, places: list[tuple[int, int]]) -> DataFrame:
        full = StructType(schema.fields).add(_PART, IntegerType()).add(_BUCKET, IntegerType())
        if not places:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/{kind}/{_PART}={p}/{_BUCKET}={b}" for p, b in places]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _key_schema(self) -> StructType:
        return StructType([self.schema[self.key]])

    def _current(self, parts: dict[int, list[tuple[int, bool]]]) -> DataFrame:
        rows = self._read("rows", self.schema, [(p, b) for b, ps in parts.items() for p, has in ps if has])
        if all(len(ps) == 1 for ps in parts.values()):
            return rows.drop(_PART)
        keys = self._read("keys", self._key_schema(), [(p, b) for b, ps in parts.items() for p, _ in ps])
        last = keys.groupBy(F.col(self.key).alias("__key")).agg(F.max(_PART).alias("__last"))
        return rows.join(last, F.col(self.key).eqNullSafe(F.col("__key")) & (F.col(_PART) == F.col("__last")), "left_semi").drop(_PART)

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The table's rows, of some buckets only if they are given, as of the last batch (before one)."""
        parts = self.manifest(before)
        if buckets is not None:
            parts = {b: parts[b] for b in set(buckets) & set(parts)}
        return self._current(parts).drop(_BUCKET).select(self.schema.names)

    def replace(self, number: int, rows: DataFrame, changed: DataFrame | None = None) -> None:
        """In batch `number`, replace all rows of the changed keys (null: of the keys of the rows) by the given ones."""
        write = lambda df, kind, part: df.withColumn(_BUCKET, self.bucket()).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{kind}/{_PART}={part}")
        mine, anew = 2 * number, 2 * number + 1
        write(rows.select(self.schema.names), "rows", mine)
        having = self._buckets_in(f"rows/{_PART}={mine}")
        if changed is None:
            changed = self._read("rows", self.schema, [(mine, b) for b in having])
        write(changed.select(self.key).distinct(), "keys", mine)
        parts = self.manifest(number)
        for b in self._buckets_in(f"keys/{_PART}={mine}"):
            parts[b] = [*parts.get(b, []), (mine, b in having)]
        full = {b: ps for b, ps in parts.items() if len(ps) > self.most_parts}
        if full:
            whole = self._current(full).drop(_BUCKET)
            write(whole.where(~F.coalesce(self.expired(whole), F.lit(False))) if self.expired else whole, "rows", anew)
            having = self._buckets_in(f"rows/{_PART}={anew}")
            write(self._read("rows", self.schema, [(anew, b) for b in having]).select(self.key).distinct(), "keys", anew)
            parts |= {b: [(anew, True)] if b in having else [] for b in full}
        path, fs = self._at(f"manifest/{number}")
        out = fs.create(path, True)
        out.writeBytes(json.dumps(parts))
        out.close()

    def vacuum(self) -> None:
        """Delete parts that the last manifest no longer names, once no reader of an earlier one is left."""
        used = {p for ps in self.manifest().values() for p, _ in ps}
        for kind in ("rows", "keys"):
            for name in self._names(kind):
                if name.startswith(f"{_PART}=") and int(name.partition("=")[2]) not in used:
                    path, fs = self._at(f"{kind}/{name}")
                    fs.delete(path, True)
