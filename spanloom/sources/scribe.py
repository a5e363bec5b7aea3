"""Writers that loaders fill: a store, a collection with a stored index, or nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Collection
from ..streaming.store import Store
from . import jsonpaths, loaders, readers


class Scribe:
    """Takes documents and annotations; finalize() gives what they became. This one counts calls and keeps nothing."""

    def __init__(self) -> None:
        self.calls = 0

    def write(self, collection: Collection) -> None:
        """All documents and annotations of a collection, as one transaction."""
        self.calls += 1

    def finalize(self) -> Collection | None:
        return None


class StoreScribe(Scribe):
    """Writes each collection as a commit of a store."""

    def __init__(self, store: Store):
        super().__init__()
        self.store = store

    def write(self, collection: Collection) -> None:
        super().write(collection)
        t = self.store.begin().append(collection.docs)
        if collection.annotations is not None:
            t.annotate(collection.annotations)
        t.commit()

    def finalize(self) -> Collection:
        return self.store.snapshot().collection()


class BuilderScribe(Scribe):
    """Gathers collections and builds one with a stored index below a path."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.parts = path, []

    def write(self, collection: Collection) -> None:
        super().write(collection)
        self.parts.append(collection)

    def finalize(self) -> Collection | None:
        if not self.parts:
            return None
        marks = [c.annotations for c in self.parts if c.annotations is not None]
        whole = Collection(reduce(DataFrame.unionByName, [c.docs for c in self.parts]), reduce(DataFrame.unionByName, marks) if marks else None)
        return whole.indexed(self.path)


def scribe_files(spark: SparkSession, paths: list[str], scribe: Scribe) -> Scribe:
    """Whole files, each with its name, in one transaction."""
    scribe.write(loaders.file_tree(spark, *paths))
    return scribe


def scribe_json_lines(spark: SparkSession, paths: list[str], scribe: Scribe) -> Scribe:
    """Lines of JSON: a record's scalars, one on each line of its text, are annotated with their paths, and the whole with ":" and the path of its file."""
    rows = readers.json_lines(spark, *paths).withColumn("doc", loaders.doc_of(F.concat_ws("\n", "source", "json")))
    rows = rows.dropDuplicates(["doc"])
    values = jsonpaths.flatten(rows, "doc", "json").where("ok and value is not null and kind <> 'null'").withColumnRenamed("id", "doc")
    parts = values.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "value"))), lambda x: F.struct(x["path"].alias("feature"), x["value"].alias("text"))).alias("parts"))
    c = loaders.of_parts(parts, [":"])
    where = c.annotations.where("feature = ':'").join(rows.select("doc", "source"), "doc").select(F.col("source").alias("feature"), "doc", "p", "q", "v", "n")
    scribe.write(c.annotate(where))
    return scribe
