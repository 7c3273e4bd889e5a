"""Tables kept by streams: each micro-batch merges into a new version, named by its batch id, so a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from brindle.operators import prefix
from brindle.sources.sinks import first_of_key

#: Versions that stay: the newest, and those before it that readers may still hold.
KEPT = 2
#: Milliseconds of the reference's defaults: how far apart requests of a host are, how long one that fends visits off
#: is left alone, and how long a host is remembered after it was free.
APART, PROTECTED, MEMORY = 250, 2_000, 900_000


class VersionedTable:
    """Parquet versions below ``path``: ``version=<batch id>``. A version counts once its job has committed (``_SUCCESS``).

    A version is never changed: a writer that dies leaves one without the mark, which the batch's next try overwrites.
    One writer at a time, as a streaming query is; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Complete versions, oldest first: a listing of at most KEPT and a few folders, whatever the table's size."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [n.removeprefix("version=") for n in names if n.startswith("version=")]
        return sorted(int(n) for n in found if self._fs.exists(self._path(f"version={n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest below ``before``; no rows if there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={found[-1]}")

    def merge(self, batch_id: int, merged: Callable[[DataFrame], DataFrame]) -> bool:
        """Writes ``merged(the version before)`` as version ``batch_id``; False if that batch was merged already."""
        found = self.versions()
        if found and found[-1] >= batch_id:
            return False
        merged(self.read(batch_id)).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for old in found[: max(0, len(found) + 1 - KEPT)]:
            self._fs.delete(self._path(f"version={old}"), True)
        return True


def kept_table(stream: DataFrame, table: VersionedTable, checkpoint: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``stream`` over what is there: each micro-batch goes into ``table`` by ``merged(stored, batch)``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch_id, lambda stored: merged(stored, batch))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries_patched(stored: DataFrame, patches: DataFrame, key: str, counters: list[str], rests: list[str], counts: list[str]) -> DataFrame:
    """Run summaries with patches merged in, in any order and however often: counters keep their largest value, rests their least.

    Columns of ``counts`` are maps from a name to a number, merged by name to the largest. A null, or a name without
    a number, says nothing; what no patch names stays null, maps stay null without entries. Patches are reduced map-side before the shuffle by key;
    rows with a null key are left out.
    """
    names = [*counters, *rests]
    rows = stored.select(key, *names, *counts).unionByName(patches.select(key, *names, *counts)).where(F.col(key).isNotNull())
    sums = rows.groupBy(key).agg(*(F.max(c).alias(c) for c in counters), *(F.min(c).alias(c) for c in rests))
    for column in counts:
        entries = rows.select(key, F.explode(column).alias("name", "n")).where("n IS NOT NULL").groupBy(key, "name").agg(F.max("n").alias("n"))
        maps = entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(column))
        sums = sums.join(maps, key, "left")
    return sums.select(key, *names, *counts)


def records_kept(stored: DataFrame, batch: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """``stored`` with a batch's records: new ones go in, changed ones take the place of the old, ``changed`` counts how often.

    Of a batch's rows of one key the first by ``ord`` counts; an equal record changes nothing; a row with a null key is left out.
    """
    new = first_of_key(batch, key, content).withColumnRenamed("_row", "_new")
    old = stored.select(*key, F.struct(*content).alias("_old"), "changed")
    differs = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
    joined = old.join(new, key, "full").select(*key, F.coalesce("_new", "_old").alias("_row"), (F.coalesce("changed", F.lit(0)) + differs.cast("int")).alias("changed"))
    return joined.select(*key, "_row.*", "changed")


def slots_served(stored: DataFrame, batch: DataFrame, apart: int = APART, protected: int = PROTECTED) -> DataFrame:
    """(host, id, now, slot) of a batch's requests, by what ``stored`` (host, free_at) remembers; hosts without a row start free.

    ``batch`` is (host, id, now, fended): requests, and where ``fended`` outcomes that ask for a pause of ``protected``.
    Rows count by (now, id); those without a host or a time are left out. A request's slot is max(now, free_at), and free_at then ``apart`` later; an outcome makes free_at
    at least now + protected. With n requests so far that unrolls to slot = apart * n + max(what a row asks for - apart * its n),
    a running sum and a running maximum: in blocks, so no host's rows meet in one task. What is stored is the row before all others.
    """
    asked = batch.where("host IS NOT NULL AND now IS NOT NULL").select("host", F.col("now").alias("_when"), "id", "now", F.when(F.col("fended"), 1).otherwise(0).alias("_kind"))
    first = stored.join(asked.select("host").distinct(), "host", "left_semi")
    first = first.select("host", F.lit(-(1 << 62)).alias("_when"), F.lit(None).cast("long").alias("id"), F.col("free_at").alias("now"), F.lit(2).alias("_kind"))
    told = prefix.running(asked.unionByName(first), "host", ["_when", "id"], {"_n": (prefix.SUM, F.when(F.col("_kind") == 0, 1).otherwise(0))})
    asks = F.when(F.col("_kind") == 0, F.col("now") - apart * F.col("_n")).when(F.col("_kind") == 1, F.col("now") + protected - apart * (F.col("_n") + 1)).otherwise(F.col("now") - apart)
    served = prefix.running(told, "host", ["_when", "id"], {"_most": (prefix.MAX, asks)})
    return served.select("host", "id", "now", "_kind", (F.col("_most") + apart * F.col("_n")).alias("slot"))


def hosts_kept(stored: DataFrame, served: DataFrame, apart: int = APART, memory: int = MEMORY) -> DataFrame:
    """(host, free_at) after a batch that ``slots_served`` gave: hosts free for longer than ``memory`` at its last time are forgotten.

    Forgetting changes no slot, since such a host would start free; it bounds the table by the hosts of a span of time.
    """
    rows = served.where("_kind <> 2")
    free = rows.groupBy("host").agg((F.max("slot") + apart).alias("free_at"))
    now = rows.agg(F.max("now")).first()[0]
    merged = stored.unionByName(free).groupBy("host").agg(F.max("free_at").alias("free_at"))
    return merged if now is None else merged.where(F.col("free_at") + memory >= now)


def paced_stream(requests: DataFrame, table: VersionedTable, out: str, checkpoint: str, apart: int = APART, protected: int = PROTECTED, memory: int = MEMORY) -> StreamingQuery:
    """Serves a stream of (host, id, now, fended) as ``slots_served`` says: (host, id, slot) go below ``out``, by batch; ``table`` remembers hosts.

    A batch that is tried again starts from the version before it and overwrites its own slots, so it gives the same.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch={batch_id}"
        slots_served(table.read(batch_id), batch, apart, protected).write.mode("overwrite").parquet(path)
        served = table.spark.read.schema("host string, id long, now long, _kind int, slot long").parquet(path)
        table.merge(batch_id, lambda stored: hosts_kept(stored, served, apart, memory))

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
