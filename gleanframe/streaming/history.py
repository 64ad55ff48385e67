"""The bounded memory of what has been delivered."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
#: The largest history that goes to all tasks: about 100 bytes for each id.
BROADCAST_IDS = 100_000


def newest(rows: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """The last ``size`` rows in ``order``; each task sends no more than that many."""
    return rows.orderBy(F.col(order).desc()).limit(size)


class History:
    """Ids in order of arrival, at most ``size``; an id that is held already keeps its place.

    Kept as versions of a small table in ``path``: a new version is written whole, then a pointer
    file names it, so a crash leaves the old version in force. A missing or unreadable history
    is empty.
    """

    SCHEMA = "job_id string, seq long"

    def __init__(self, spark: SparkSession, path: str, size: int):
        if size < 1:
            raise ValueError("a history holds one id at least")
        self.spark, self.path, self.size = spark, path.rstrip("/"), size

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _version(self) -> str | None:
        fs, at = self._fs("current.json")
        if not fs.exists(at):
            return None
        try:
            return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/current.json").collect()))["version"]
        except (ValueError, KeyError, TypeError):
            LOG.warning("the history at %s can't be read; starting empty", self.path)
            return None

    def ids(self) -> DataFrame:
        """(job_id, seq), oldest first by seq."""
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{version}")

    def _save(self, rows: DataFrame) -> None:
        version, old = f"v-{uuid.uuid4().hex}", self._version()
        rows.coalesce(1).write.parquet(f"{self.path}/{version}")
        jvm = self.spark.sparkContext._jvm
        fs, at = self._fs("current.json.new")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"version": version, "size": self.size}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(at, self._fs("current.json")[1], options)
        if old:
            fs.delete(self._fs(old)[1], True)

    def add(self, ids: DataFrame, key: str = "job_id", order: str = "seq") -> None:
        """Appends new ids in ``order`` and lets the oldest go. Exact while one call adds at most ``size`` ids."""
        held = self.ids()
        top = held.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        fresh = ids.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("job_id")).agg(F.min(order).alias("at")).join(held.select("job_id"), "job_id", "left_anti")
        # No more than the history's size is numbered in one task.
        last = newest(fresh, self.size, "at").withColumn("seq", F.row_number().over(Window.orderBy("at")) + F.lit(top)).select("job_id", F.col("seq").cast("long").alias("seq"))
        self._save(newest(held.unionByName(last), self.size))

    def add_all(self, ids: Sequence[str]) -> None:
        """``add`` for a list in its order."""
        if ids:
            self.add(self.spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), self.SCHEMA))

    def load_json(self, path: str) -> None:
        """Takes the ids of a JSON file, a list or an object with ``ids``, oldest first: texts that aren't empty, each
        at its first place, the newest ``size``. A missing file changes nothing; one that can't be read leaves it empty."""
        try:
            rows = self.spark.read.text(path, wholetext=True).collect()
        except AnalysisException:
            return
        try:
            data = json.loads("".join(r.value for r in rows))
        except ValueError:
            LOG.warning("%s can't be read; the history starts empty", path)
            data = []
        ids = data.get("ids") if isinstance(data, dict) else data
        kept = list(dict.fromkeys(x for x in (ids if isinstance(ids, list) else []) if isinstance(x, str) and x))[-self.size :]
        self.clear()
        self.add_all(kept)

    def json(self) -> str:
        """The history as an object with ``size`` and ``ids``, oldest first."""
        return json.dumps({"size": self.size, "ids": list(self)})

    def fresh(self, rows: DataFrame, key: str = "job_id") -> DataFrame:
        """The rows whose id isn't held; rows without id all stay. Held ids are broadcast only up to BROADCAST_IDS of them."""
        held = self.ids().select(F.col("job_id").alias("__sent"))
        return rows.join(F.broadcast(held) if self.size <= BROADCAST_IDS else held, F.col(key) == F.col("__sent"), "left_anti")

    def resize(self, size: int) -> None:
        if size < 1:
            raise ValueError("a history holds one id at least")
        self.size = size
        self._save(newest(self.ids(), size))

    def clear(self) -> None:
        self._save(self.ids().limit(0))

    def __iter__(self) -> Iterator[str]:
        """Ids, oldest first; the history is small by its size."""
        return (r.job_id for r in self.ids().orderBy("seq").toLocalIterator())

    def __repr__(self) -> str:
        return f"History({len(self)} of {self.size} at {self.path})"

    def __len__(self) -> int:
        return self.ids().count()

    def __contains__(self, job_id: object) -> bool:
        return isinstance(job_id, str) and not self.ids().where(F.col("job_id") == job_id).isEmpty()
