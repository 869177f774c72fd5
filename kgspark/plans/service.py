"""The service: build or reuse the graph, retrieve, answer with guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, guards, lexical, retrieve, store
from ..operators.extract import extract
from ..session import cut
from ..sources.markdown import corpus_fingerprint, read_notes
from ..vocab import REFUSAL


class EchoProvider:
    """A provider that always gives the same text, for tests."""

    def __init__(self, text: str):
        self.text = text

    def complete(self, prompt: str) -> str:
        return self.text


def grounded_prompt(question: str, contexts: list[str]) -> str:
    told = "\n\n".join(f"[{i + 1}] {c}" for i, c in enumerate(contexts))
    return f"Answer from the notes below alone. If they don't tell, say so.\n\n{told}\n\nQuestion: {question}"


class Service:
    """Retrieval over the notes under some roots; the graph is kept under ``path`` and built anew when a note changes."""

    def __init__(self, spark: SparkSession, roots: list[str], path: str | None = None, llm: Callable | None = None, rebuild: bool = False, resolve_links: bool = True):
        self.spark, self.roots, self.store = spark, roots, store.Store(spark, path)
        notes = read_notes(spark, roots)
        now = corpus_fingerprint(notes).first()["fingerprint"]
        if rebuild or self.store.get_meta("fingerprint") != now:
            self.store.clear()
            self.store.write(*extract(notes, resolve_links, llm))
            self.store.set_meta("fingerprint", now)
        self._notes, self._docs, self._kept = notes, None, None
        self.nodes, self.edges = self.store.nodes, self.store.edges
        self.adj = store.adjacency(self.edges)

    @property
    def docs(self) -> DataFrame:
        """id, text, ord of the notes, read once."""
        if self._docs is None:
            self._docs = cut(self._notes.select(F.col("path").alias("id"), "text", F.col("walk_ord").alias("ord")))
        return self._docs

    @property
    def kept(self) -> tuple:
        """The notes' TF-IDF index, made once."""
        if self._kept is None:
            self._kept = lexical.kept_index(self.docs)
        return self._kept

    def health(self) -> dict:
        return store.counts(self.nodes, self.edges).first().asDict()

    def query(self, text: str, k: int = 5, adj: DataFrame | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return retrieve.retrieve(asked, self.docs, self.nodes, self.adj if adj is None else adj, k, kept=self.kept).orderBy("rank")

    def seeds(self, text: str, limit: int = 8) -> list[str]:
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return [r["id"] for r in retrieve.link_entities(asked, self.nodes, limit).orderBy(F.desc("overlap"), F.desc("id")).collect()]

    def answer(self, question: str, provider, k: int = 5) -> dict:
        if not self.seeds(question):
            return {"answer": REFUSAL, "refused": True, "grounded": None, "support": 0.0, "sources": []}
        hits = self.query(question, k).collect()
        text = provider.complete(grounded_prompt(question, [h["text"] for h in hits]))
        said = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        had = self.spark.createDataFrame([(0, h["id"]) for h in hits], "query_id long, id string")
        g = guards.groundedness(said, had, self.nodes).first()
        return {"answer": text, "refused": False, "grounded": g["grounded"], "support": g["support"], "sources": [h["id"] for h in hits]}

    def graph_scores(self, seeds: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(0, s) for s in seeds], "query_id long, id string")
        return graph.note_scores(graph.personalized_pagerank(self.adj, asked), self.adj, self.nodes).orderBy(F.desc("score"), F.asc("seq"))


_SHARED: dict[str, Service] = {}


def shared(spark: SparkSession, roots: list[str] | None = None, path: str | None = None) -> Service:
    """The session's one service; roots and path count on the first call only."""
    if "service" not in _SHARED:
        if not roots:
            raise ValueError("the first call names the roots")
        _SHARED["service"] = Service(spark, roots, path or cache_path(spark))
    return _SHARED["service"]


def query(spark: SparkSession, text: str, k: int = 5, roots: list[str] | None = None) -> DataFrame:
    return shared(spark, roots).query(text, k)


def reset() -> None:
    """The next call builds or reads the graph anew."""
    _SHARED.clear()


def cache_path(spark: SparkSession) -> str:
    """Where the graph is kept if no path is given: spark.kgspark.path, else a folder of the warehouse."""
    return spark.conf.get("spark.kgspark.path", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kgspark"
