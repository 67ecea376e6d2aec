"""A registry of named word lists: all files must be there when it is opened, each is read once, and their terms go to workers as one automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions import spans
from storyspark.sources import files


class Registry:
    """Word lists of a folder by name. A missing file is an error when the registry is opened, so no query runs on an empty list."""

    def __init__(self, spark: SparkSession, folder: str, names: dict[str, str]):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), dict(names)
        self._read: dict[str, DataFrame] = {}
        at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        missing = [f"{key} ({name})" for key, name in sorted(self.names.items()) if not at(name).getFileSystem(conf).exists(at(name))]
        if missing:
            raise FileNotFoundError(f"word lists without a file in {self.folder}: {', '.join(missing)}")

    def catalogue(self) -> DataFrame:
        """(key, file, terms): every list and how many different terms it has."""
        counted = None
        for key in sorted(self.names):
            part = self.terms(key).select(F.lit(key).alias("key"))
            counted = part if counted is None else counted.unionAll(part)
        listed = self.spark.createDataFrame(sorted(self.names.items()), "key string, file string")
        if counted is None:
            return listed.withColumn("terms", F.lit(0).cast("long"))
        n = counted.groupBy("key").agg(F.count("*").alias("terms"))
        return listed.join(F.broadcast(n), "key", "left").select("key", "file", F.coalesce("terms", F.lit(0)).alias("terms"))  # a row a list

    def terms(self, key: str) -> DataFrame:
        """(term, ord) of one list, in the order of the file, repeated terms once; the same table each time it is asked for."""
        if key not in self._read:
            self._read[key] = files.read_lexicon(self.spark, f"{self.folder}/{self.names[key]}").persist()
        return self._read[key]

    def automaton(self, *keys: str) -> spans.Automaton:
        """The terms of some lists in one automaton; more than ``spans.LEXICON_BYTES`` of them are an error before they are gathered."""
        rows = None
        for key in keys:
            part = self.terms(key).select("term")
            rows = part if rows is None else rows.unionAll(part)
        rows = rows.distinct()
        size = rows.agg(F.sum(F.octet_length("term"))).first()[0] or 0
        if size > spans.LEXICON_BYTES:
            raise ValueError(f"word lists of {size} bytes are not broadcast: look them up by parts")
        return spans.Automaton(r["term"] for r in rows.collect())

    def close(self) -> None:
        for df in self._read.values():
            df.unpersist()
        self._read.clear()
