"""The library's calls as one object: search, songs, neighbours, graphs, paths, and the similarity in use."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cleaning, graph
from .operators.knn import Corpus, nearest
from .operators.text_index import TextIndex
from .operators.vectors import embed, resolve_weights
from .schemas import DEFAULT_WEIGHTS, GROUPS
from .sources.scratch import materialize

#: Of so many songs a search for a path compares one by itself, before it compares all.
SHARE = 16


@dataclass(frozen=True)
class Weighting:
    """What a query compares by: a name, the group weights, the vectors (id, embedding) and those as a corpus, which is sized and sent
    or indexed once."""

    mode: str
    weights: dict[str, float] = field(hash=False)
    vectors: DataFrame = field(hash=False)
    corpus: Corpus = field(hash=False, compare=False)


class Explorer:
    """metadata: id, title, artist_name and more; vectors: id, embedding; grouped: id and nine unweighted groups; weights: those
    of the vectors; edges: src, dst, score, rank, the neighbours under the default weighting, as many for each song as are kept.

    The active weighting is the only state that changes; each is immutable.  Calls read the kept edges where the
    weighting and k allow, and otherwise compare the songs they meet with all."""

    def __init__(self, metadata: DataFrame, vectors: DataFrame, grouped: DataFrame | None = None, weights: dict[str, float] | None = None, edges: DataFrame | None = None):
        self.metadata, self.grouped, self.edges = metadata, grouped, edges
        self.kept = (edges.agg(F.max("rank")).first()[0] or 0) if edges is not None else 0
        self.default = Weighting("default", dict(weights or DEFAULT_WEIGHTS), vectors, Corpus(vectors))
        self.custom: Weighting | None = None
        self.active = self.default
        self.indexes: dict[str, TextIndex] = {}

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Explorer:
        """From the tables that plans.build writes."""
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        weights = read("weights").first()
        return cls(read("metadata"), read("embeddings"), read("groups"), {g: weights[f"weight_{g}"] for g in GROUPS}, read("knn_edges"))

    def index_search(self) -> None:
        """Make trigram indexes of titles and artists, which search reads from now on."""
        songs = self.metadata.select("id", "title", "artist_name")
        self.indexes = {column: TextIndex(songs, column, "id") for column in ("title", "artist_name")}

    def _songs(self, text: str, column: str) -> DataFrame:
        """The songs that a search for text must look at."""
        if column in self.indexes:
            return self.indexes[column].search(text)[0]
        return self.metadata.select("id", "title", "artist_name")

    def search(self, query: str | None = None, artist: str | None = None, limit: int | None = None) -> DataFrame:
        """By title, or else by artist; neither gives nothing."""
        if query:
            return cleaning.search(self._songs(query, "title"), query, "title", limit, "id")
        if artist:
            return cleaning.search(self._songs(artist, "artist_name"), artist, "artist_name", limit, "id")
        return self.metadata.select("id", "title", "artist_name").limit(0)

    def song(self, song_id: int) -> dict:
        row = cleaning.lookup(self.metadata, song_id, "id").first().asDict()
        return {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}

    def _check(self, song_id: int, k: int) -> None:
        self.song(song_id)
        if self.active.vectors.where(F.col("id") == song_id).isEmpty():
            raise ValueError(f"song {song_id} has no vector")
        if k < 1:
            raise ValueError("k must be at least 1")

    def _stored(self, k: int) -> DataFrame | None:
        """The kept edges, if they are those of the active weighting and enough for k."""
        return self.edges.where(F.col("rank") <= k) if self.active is self.default and k <= self.kept else None

    def _edges(self, ids: DataFrame, k: int) -> DataFrame:
        """src, dst, score, rank: the k nearest of the songs in ids."""
        if (stored := self._stored(k)) is not None:
            return stored.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        return nearest(self.active.vectors.join(ids, "id", "left_semi"), self.active.corpus, k)

    def _expanding(self, k: int):
        """A function for shortest_path: makes the edges of nodes that it has not met before.  One that meets more than a SHARE-th of all
        songs makes all edges at once, which reads the songs once instead of once a round."""
        made: list[DataFrame] = []
        asked, whole = 0, None

        def expand(nodes: DataFrame) -> DataFrame:
            nonlocal asked, whole
            if whole is None and (n := nodes.count()):
                asked += n
                if asked * SHARE > self.active.corpus.size[0]:
                    whole = materialize(self.active.corpus.nearest(self.active.vectors, k), "edges")
                else:
                    made.append(materialize(self._edges(nodes, k), "edges"))
            return functools.reduce(DataFrame.union, made) if whole is None else whole

        return expand

    def _only(self, song_id: int) -> DataFrame:
        return self.active.vectors.where(F.col("id") == song_id).select("id")

    def neighbours(self, song_id: int, k: int = 10) -> DataFrame:
        """id, title, artist_name, score of the k most alike songs, best first."""
        self._check(song_id, k)
        found = materialize(self._edges(self._only(song_id), k), "edges").withColumnRenamed("dst", "id")
        return graph.named(found, self.metadata).orderBy("rank").select("id", "title", "artist_name", "score")

    def graph(self, song_id: int, k: int = 5) -> tuple[DataFrame, DataFrame]:
        self._check(song_id, k)
        return graph.one_hop(materialize(self._edges(self._only(song_id), k), "edges"), song_id, self.metadata)

    def two_hop_graph(self, song_id: int, k: int = 5) -> tuple[DataFrame, DataFrame]:
        self._check(song_id, k)
        first = materialize(self._edges(self._only(song_id), k), "edges")
        second = self._edges(first.select(F.col("dst").alias("id")), k)
        return graph.two_hop(materialize(first.union(second.select(first.columns)), "edges"), song_id, self.metadata)

    def path(self, start: int, end: int, k: int = 10):
        """nodes, edges, total cost; empty tables and None if end can't be reached."""
        self._check(start, k)
        self.song(end)
        stored = self._stored(k)
        return graph.shortest_path(self._expanding(k) if stored is None else stored, start, end, self.metadata)

    def status(self) -> dict:
        return {"mode": self.active.mode, "weights": dict(self.active.weights), "custom_available": self.custom is not None}

    def build_custom(self, weights: dict[str, float]) -> dict:
        """Compare by these weights from now on."""
        if self.grouped is None:
            raise RuntimeError("unweighted feature groups are not loaded")
        resolved = resolve_weights(weights)
        vectors = embed(self.grouped.select("id", *GROUPS), resolved).select("id", "embedding")
        self.custom = self.active = Weighting("custom", resolved, vectors, Corpus(vectors))
        return self.status()

    def use_default(self) -> dict:
        self.active = self.default
        return self.status()

    def use_custom(self) -> dict:
        if self.custom is None:
            raise RuntimeError("no custom similarity has been built")
        self.active = self.custom
        return self.status()
