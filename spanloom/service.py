"""Search over several collections: query, next page, documents, with snippets; what a server would answer, as functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import Collection
from .operators import rank as R

DEPTH, WINDOW = 1000, 200


class Service:
    """collections by name; a query ranks all of them and merges by score, then collection, then document."""

    def __init__(self, collections: dict[str, Collection], depth: int = DEPTH, window: int = WINDOW):
        self.collections, self.depth, self.window = dict(collections), depth, window
        self.open: dict[str, DataFrame] = {}
        self.at: dict[str, int] = {}

    def query(self, text: str, gcl: bool = False) -> str:
        """Rank a bag of words by tiers, or a query expression by its covers; gives a number for next()."""
        every = None
        for name, c in self.collections.items():
            run = R.ssr(c, text, depth=self.depth) if gcl else R.tiered(c, R.build_tiers(c, text), depth=self.depth)
            one = run.select(F.lit(name).alias("collection"), F.col("tier") if "tier" in run.columns else F.lit(0).alias("tier"), "doc", "cp", "p", "q", "score")
            every = one if every is None else every.unionByName(one)
        order = Window.partitionBy(F.lit(0)).orderBy("tier", F.desc("score"), "collection", "doc", "cp")  # depth rows a collection
        merged = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.depth)
        qid = uuid.uuid4().hex
        self.open[qid], self.at[qid] = R.settle(merged)[0], 0
        return qid

    def page(self, qid: str, offset: int, size: int) -> DataFrame:
        if qid not in self.open:
            raise KeyError(f"no query {qid}")
        return self.open[qid].where((F.col("rank") > offset) & (F.col("rank") <= offset + size))

    def next(self, qid: str, size: int = 10) -> list[dict]:
        """The next results of a query as dictionaries, with snippets; empty at the end."""
        rows = self.page(qid, self.at[qid], size)
        self.at[qid] += size
        out = []
        for name, c in self.collections.items():
            for r in self.snippets(rows.where(F.col("collection") == name), c).select("collection", "doc", "rank", "score", "snippet").collect():  # size rows at most
                out.append({"op": "next", "ok": True, "qid": qid, **r.asDict()})
        return sorted(out, key=lambda x: x["rank"])

    def snippets(self, run: DataFrame, c: Collection) -> DataFrame:
        """run with `snippet`: half the window's words on either side of the cover, which is marked."""
        half = self.window // 2
        w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+[^A-Za-z0-9]*"), F.lit(0))
        run = R.small(run)
        j = c.docs.join(run, "doc").withColumn("w", w).withColumn("lo", F.greatest(F.lit(0), F.col("p") - half))
        cut = lambda a, n: F.array_join(F.slice("w", (a + 1).cast("int"), F.greatest(F.lit(0), n).cast("int")), "")
        marked = F.concat(cut(F.col("lo"), F.col("p") - F.col("lo")), F.lit("<cover>"), cut(F.col("p"), F.col("q") - F.col("p") + 1), F.lit("</cover>"), cut(F.col("q") + 1, F.lit(half)))
        return j.withColumn("snippet", marked).drop("w", "lo", "text")

    def documents(self, collection: str, docs: list[int]) -> DataFrame:
        """(doc, text) of some documents of a collection."""
        return self.collections[collection].docs.where(F.col("doc").isin(docs))

    def answer(self, request: dict) -> list[dict]:
        """Responses to {"op": "query", "query": ...}, {"op": "next", "qid": ...} and {"op": "document", "collection": ..., "doc": ...}; an error is one with ok false."""
        op = request.get("op")
        try:
            if op == "query":
                qid = self.query(request["query"], bool(request.get("gcl")))
                return [{"op": op, "ok": True, "qid": qid}, *self.next(qid, int(request.get("size", 10)))]
            if op == "next":
                return self.next(request["qid"], int(request.get("size", 10)))
            if op == "document":
                found = self.documents(request["collection"], [int(request["doc"])]).collect()
                return [{"op": op, "ok": True, "doc": r.doc, "text": r.text} for r in found] or [{"op": op, "ok": False, "error": "no such document"}]
            return [{"op": op, "ok": False, "error": f"unknown operation {op}"}]
        except (KeyError, ValueError) as e:
            return [{"op": op, "ok": False, "error": str(e)}]
