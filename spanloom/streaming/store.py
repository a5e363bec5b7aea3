"""A versioned store: transactional appends, erasure, snapshot reads and compaction over Parquet.

A version is a manifest, one small JSON file that names the data files it
consists of, how large they are, and what streams have committed so far.  It is
published by creating its file, which fails if another writer was first, so a
commit names all its files at once and readers see whole versions only.  Files
that no manifest names don't exist for readers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc long, text string"
ANNOTATIONS = "feature string, doc long, p long, q long, v double, n long"
ERASED = "lo long, hi long"
FORAGERS = "name string, tag string, parameters string"
#: Erased ranges that become a filter, and documents (as a power of 2) of a run in the join that more of them need.
FEW_RANGES, RUN_BITS = 1000, 20
KINDS = {"docs": DOCS, "annotations": ANNOTATIONS, "erased": ERASED, "foragers": FORAGERS}
#: Bytes of a file that compaction writes, about; entries below TINY are merged in runs, larger ones by the smallest pair of neighbours while that is below LARGE.
FILE_BYTES, TINY, LARGE = 256 << 20, 8 << 20, 1 << 30
#: Seconds after which a claim without its version, and staged data that no version names, count as left by a dead writer.
DEAD_AFTER = 24 * 3600.0


class Conflict(RuntimeError):
    """Another writer published a version first."""


class Store:
    """A store below a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}")

    def _list(self, name: str) -> list:
        return list(self._fs.listStatus(self._p(name))) if self._fs.exists(self._p(name)) else []

    def _age(self, status) -> float:
        return time.time() - status.getModificationTime() / 1000

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._list("versions") if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the latest where none is given) consists of: [kind, folder, commit, bytes] entries, the last batch of each stream, and the version itself."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "files": [], "streams": {}}
        stream = self._fs.open(self._p(f"versions/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict, dead_after: float = DEAD_AFTER) -> None:
        """Write a temporary file, claim the version's name, then rename the file to it.

        Creating the claim without overwriting is the one atomic step.  A claim
        whose version doesn't appear within dead_after seconds was left by a
        writer that died in between; it is taken away, and the version is free.
        """
        name = f"versions/{manifest['version']:012d}"
        target, claim, temp = self._p(f"{name}.json"), self._p(f"{name}.claim"), self._p(f"versions/{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(self._p("versions"))
        if self._fs.exists(target):
            raise Conflict(f"version {manifest['version']} is taken")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        for again in (True, False):
            try:
                self._fs.create(claim, False).close()
                break
            except Exception as e:
                if again and not self._fs.exists(target) and self._fs.exists(claim) and self._age(self._fs.getFileStatus(claim)) > dead_after:
                    self._fs.delete(claim, False)
                    continue
                self._fs.delete(temp, False)
                raise Conflict(f"version {manifest['version']} is taken") from e
        self._fs.rename(temp, target)

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._p(name)).getLength()

    def compact(self, entries: list[list] | None = None) -> int:
        """Rewrite the entries of a version (all of the latest one where none are given) without what was erased, an entry of each kind in files of about FILE_BYTES; older versions stay readable.

        What erases rows of entries that aren't rewritten stays.
        """
        now = self.manifest()
        chosen = now["files"] if entries is None else entries
        names = {f[1] for f in chosen}
        snap, t = Snapshot(self, now), Transaction(self, now)
        kept = [f for f in now["files"] if f[1] not in names]
        for kind in ("docs", "annotations", "foragers"):
            own = [f for f in chosen if f[0] == kind]
            if own:
                rows, files = snap._live(kind, own), max(1, round(sum(f[3] for f in own) / FILE_BYTES))
                by = "doc" if kind != "foragers" else "name"
                t._stage(kind, rows.repartitionByRange(files, by) if files > 1 else rows.coalesce(1))
        t.base = {**now, "files": kept}
        t.replaces = True
        return t.commit()

    def plan_compaction(self, manifest: dict | None = None) -> list[list] | None:
        """The entries that should be merged next: a run of three or more tiny ones, else the smallest pair of neighbours below LARGE; None if there are none."""
        for kind in ("docs", "annotations"):
            own = [f for f in (manifest or self.manifest())["files"] if f[0] == kind]
            run: list = []
            for f in [*own, None]:
                if f is not None and f[3] < TINY:
                    run.append(f)
                elif len(run) >= 3:
                    return run
                else:
                    run = []
            pairs = [[a, b] for a, b in zip(own, own[1:]) if a[3] + b[3] < LARGE]
            if pairs:
                return min(pairs, key=lambda x: x[0][3] + x[1][3])
        return None

    def compact_by_policy(self, most: int = 100) -> int:
        """Merge as plan_compaction() says until nothing is left to merge; gives the number of merges.  A merge that another commit overtakes is planned anew."""
        done = 0
        while done < most and (entries := self.plan_compaction()):
            try:
                self.compact(entries)
                done += 1
            except Conflict:
                continue
        return done

    def vacuum(self, keep: int = 1, older_than: float = DEAD_AFTER) -> int:
        """Delete data older than `older_than` seconds that none of the last `keep` versions names; gives the number of folders deleted.  Younger data may belong to a writer that hasn't committed yet."""
        named = {f[1] for v in self.versions()[-keep:] for f in self.manifest(v)["files"]}
        gone = 0
        for kind in KINDS:
            for s in self._list(kind):
                if f"{kind}/{s.getPath().getName()}" not in named and self._age(s) >= older_than:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    def sanitize(self, older_than: float = DEAD_AFTER) -> int:
        """Remove what dead writers left: temporary manifests, claims without a version, data that no version at all names; gives how many."""
        known, gone = set(self.versions()), 0
        for s in self._list("versions"):
            name = s.getPath().getName()
            stray = name.endswith(".tmp") or (name.endswith(".claim") and int(name.split(".")[0]) not in known)
            if stray and self._age(s) >= older_than:
                self._fs.delete(s.getPath(), False)
                gone += 1
        return gone + self.vacuum(keep=max(1, len(known)), older_than=older_than)


class Transaction:
    """Staged changes: nothing is visible before commit(), abort() leaves nothing behind."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base, self.files, self.state = store, base, [], "open"
        self.replaces, self.streams = False, {}

    def _stage(self, kind: str, df: DataFrame) -> None:
        if self.state != "open":
            raise RuntimeError(f"the transaction is {self.state}")
        name = f"{kind}/{uuid.uuid4().hex}"
        schema = self.store.spark.createDataFrame([], KINDS[kind]).schema
        df.select([F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.store.path}/{name}")
        self.files.append([kind, name])

    def append(self, docs: DataFrame) -> Transaction:
        """docs: (doc, text)."""
        self._stage("docs", docs)
        return self

    def annotate(self, rows: DataFrame) -> Transaction:
        """rows: (feature, doc, p, q, v, n); those without a feature or with p > q or p < 0 are dropped."""
        self._stage("annotations", rows.where("feature <> '' and p <= q and p >= 0"))
        return self

    def erase(self, lo: int, hi: int) -> Transaction:
        """Documents lo .. hi of earlier commits; ranges add up, whatever they overlap."""
        self._stage("erased", self.store.spark.createDataFrame([(lo, hi)], ERASED))
        return self

    def record(self, name: str, tag: str, parameters: dict[str, str]) -> Transaction:
        """That a forager ran."""
        self._stage("foragers", self.store.spark.createDataFrame([(name, tag, json.dumps(parameters, sort_keys=True))], FORAGERS))
        return self

    def ready(self) -> bool:
        """Vote: the staged files are whole and the transaction can't change any more."""
        if self.state == "open":
            self.state = "ready" if all(self.store._fs.exists(self.store._p(f"{n}/_SUCCESS")) for _, n in self.files) else "failed"
        return self.state == "ready"

    def commit(self, retries: int = 10, dead_after: float = DEAD_AFTER) -> int:
        """Publish; appends of others that came first are kept.  Gives the version."""
        if not self.ready():
            raise RuntimeError(f"the transaction is {self.state}")
        sizes = {n: self.store.size(n) for _, n in self.files}
        for _ in range(retries):
            version = self.base["version"] + 1
            files = self.base["files"] + [[k, n, version, sizes[n]] for k, n in self.files]
            try:
                self.store._publish({"version": version, "files": files, "streams": {**self.base.get("streams", {}), **self.streams}}, dead_after)
                self.state = "committed"
                return version
            except Conflict:
                if self.replaces:
                    self.abort()
                    raise  # a compaction must not lose what came between
                self.base = self.store.manifest()
                for stream, batch in self.streams.items():
                    if self.base["streams"].get(stream, -1) >= batch:
                        self.abort()
                        return self.base["version"]  # another run of the stream was first
        raise Conflict("too many writers")

    def abort(self) -> None:
        for _, n in self.files:
            self.store._fs.delete(self.store._p(n), True)
        self.files, self.state = [], "aborted"


class Snapshot:
    """A version as DataFrames; later commits don't change it."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.version, self.files = store, manifest["version"], manifest["files"]

    def _read(self, kind: str, files: list[list] | None = None) -> DataFrame:
        """Rows of a kind with their commit: one scan of all folders, however many commits they come from."""
        spark = self.store.spark
        own = [f for f in (self.files if files is None else files) if f[0] == kind]
        if not own:
            return spark.createDataFrame([], KINDS[kind] + ", commit int")
        rows = spark.read.schema(KINDS[kind]).parquet(*[f"{self.store.path}/{f[1]}" for f in own])
        commits = sorted({f[2] for f in own})
        if len(commits) == 1:
            return rows.withColumn("commit", F.lit(commits[0]))
        of = spark.createDataFrame([(f[1].split("/")[1], f[2]) for f in own], "folder string, commit int")  # a row an entry of the manifest
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.select("*", folder.alias("folder")).join(F.broadcast(of), "folder").drop("folder")

    def _live(self, kind: str, files: list[list] | None = None) -> DataFrame:
        rows = self._read(kind, files)
        if kind == "foragers" or not any(f[0] == "erased" for f in self.files):
            return rows.drop("commit")
        erased = self._read("erased")
        few = [(r.lo, r.hi, r.commit) for r in erased.limit(FEW_RANGES + 1).collect()]
        if len(few) <= FEW_RANGES:  # a filter that Parquet statistics can use
            for lo, hi, commit in few:
                rows = rows.where(~((F.col("doc") >= lo) & (F.col("doc") <= hi) & (F.col("commit") < commit)))
            return rows.drop("commit")
        # many ranges: an equi-join on runs of documents, of which a range covers all between its ends
        bucket = lambda c: F.shiftright(c, RUN_BITS)
        gone = erased.select("lo", "hi", F.col("commit").alias("at"), F.explode(F.sequence(bucket("lo"), bucket("hi"))).alias("run"))
        hit = (F.col("doc") >= F.col("lo")) & (F.col("doc") <= F.col("hi")) & (F.col("commit") < F.col("at"))
        return rows.withColumn("r", bucket("doc")).join(gone, (F.col("r") == F.col("run")) & hit, "left_anti").drop("commit", "r")

    def docs(self) -> DataFrame:
        return self._live("docs")

    def annotations(self) -> DataFrame:
        return self._live("annotations")

    def foragers(self) -> DataFrame:
        return self._live("foragers")

    def collection(self, index: bool = False):
        """The version as a Collection; index: with stored postings, which are built once for a version."""
        from ..model import Collection

        has = any(f[0] == "annotations" for f in self.files)
        c = Collection(self.docs(), self.annotations() if has else None)
        return c.indexed(f"{self.store.path}/indexes/{self.version:012d}") if index else c


def commit_batches(store: Store, stream: str = "stream"):
    """A foreachBatch function: each micro-batch of (doc, text) is a commit; one that was published already is skipped.

    The manifest holds the last batch of each stream, so a restarted stream
    doesn't append twice, and streams of different names don't mistake each
    other's batches for their own.
    """

    def sink(batch: DataFrame, number: int) -> None:
        now = store.manifest()
        if now["streams"].get(stream, -1) >= number:
            return
        t = Transaction(store, now).append(batch.select("doc", "text"))
        t.streams = {stream: number}
        t.commit()

    return sink


#: Foragers by name: functions (Collection, intervals, parameters) to annotation rows.
FORAGERS_BY_NAME: dict[str, Callable] = {}


def forager(name: str):
    """Register a forager."""

    def add(f: Callable) -> Callable:
        FORAGERS_BY_NAME[name] = f
        return f

    return add


def check_forager(name: str, tag: str, parameters: dict[str, str]) -> None:
    """Raises ValueError where a forager can't be run."""
    if name not in FORAGERS_BY_NAME:
        raise ValueError(f"no forager {name}")
    if ":" in tag or any(not isinstance(x, str) for kv in parameters.items() for x in kv):
        raise ValueError("a tag holds no colon, and parameters are strings")


def forager_json(name: str, tag: str = "", parameters: dict[str, str] | None = None) -> str:
    """What records a run: read_forager() reads it again."""
    return json.dumps({"name": name, "tag": tag, "parameters": dict(parameters or {})}, indent=2)


def read_forager(text: str) -> tuple[str, str, dict[str, str]]:
    """(name, tag, parameters) of forager_json()'s text; only `name` must be there, and nothing else may."""
    try:
        x = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"no forager: {e}") from e
    if not isinstance(x, dict) or not isinstance(x.get("name"), str) or set(x) - {"name", "tag", "parameters"}:
        raise ValueError("a forager has a name, and may have a tag and parameters")
    parameters = x.get("parameters", {})
    if not isinstance(x.get("tag", ""), str) or not isinstance(parameters, dict) or any(not isinstance(v, str) for v in parameters.values()):
        raise ValueError("a tag and parameters are strings")
    return x["name"], x.get("tag", ""), parameters


def forage(collection, intervals: DataFrame, forager: Callable, tag: str = "") -> DataFrame:
    """Annotations that a forager (Collection, intervals -> rows) makes, features prefixed by the tag."""
    rows = forager(collection, intervals)
    return rows.withColumn("feature", F.concat(F.lit(f"{tag}:"), "feature")) if tag else rows


def forage_once(store: Store, query: str, name: str, tag: str = "", parameters: dict[str, str] | None = None) -> int | None:
    """Run a forager over the intervals of a query and commit its rows with a record of the run; None where that name and tag have run already."""
    parameters = dict(parameters or {})
    check_forager(name, tag, parameters)
    snap = store.snapshot()
    if snap.foragers().where((F.col("name") == name) & (F.col("tag") == tag)).limit(1).count():
        return None
    c = snap.collection()
    rows = forage(c, c.gcl(query), lambda x, y: FORAGERS_BY_NAME[name](x, y, parameters), tag)
    return store.begin().annotate(rows).record(name, tag, parameters | {"gcl": query}).commit()


@forager("tf-idf")
def tf_idf_forager(collection, intervals: DataFrame, parameters: dict | None = None) -> DataFrame:
    """tf:term at each interval's start with its frequency as payload, and df:term once with the number of intervals.

    Texts meet their intervals in one join; an interval's words are then counted
    within its row.  Where intervals overlap a word counts in each.
    """
    from ..functions import text as T
    from ..operators import intervals as I

    spans = I.minimal(I.plain(intervals)).groupBy("doc").agg(F.collect_list(F.struct("p", "q")).alias("spans"))
    texts = collection.docs.join(spans, "doc").select("doc", "spans", F.transform(T.ascii_words(F.col("text")), F.lower).alias("words"))
    size = lambda x: F.greatest(F.least(x["q"], F.size("words") - 1) - x["p"] + 1, F.lit(0)).cast("int")
    own = F.transform("spans", lambda x: F.struct(x["p"].alias("p"), F.slice("words", x["p"].cast("int") + 1, size(x)).alias("words")))
    each = texts.select("doc", F.explode(own).alias("x")).select("doc", "x.p", "x.words")
    tf = T.counted(each, "words", "feature", "n")
    rows = tf.select(F.concat(F.lit("tf:"), "feature").alias("feature"), "doc", "p", F.col("p").alias("q"), F.lit(0.0).alias("v"), "n")
    df = each.select("doc", F.explode(F.array_distinct("words")).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    return rows.unionByName(df.select(F.concat(F.lit("df:"), "feature").alias("feature"), "doc", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0.0).alias("v"), "n"))


@forager("null")
def null_forager(collection, intervals: DataFrame, parameters: dict | None = None) -> DataFrame:
    return collection.docs.sparkSession.createDataFrame([], ANNOTATIONS)
