"""Ingestion + dependency graph plan: files -> tree -> imports -> edges -> PageRank -> central files."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import graph as G
from ..operators import imports as IM
from ..operators import ingest as I
from ..operators import pagerank as PR
from ..operators import resolve as RS
from ..session import stage


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Stage boundary: written once to the checkpoint folder and read back (see session.stage)."""
    return stage(df, name)


@dataclass
class RepoGraph:
    """Lazily built pieces of the dependency analysis of every repository in ``files``."""
    files: DataFrame
    max_source_files: int | None = None
    max_file_size: int | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def preset(self, **pieces: DataFrame) -> None:
        """Take pieces (edges, pagerank, ...) that are known already, e.g. from a stored version, for these files."""
        self._cache.update(pieces)

    @property
    def tree(self) -> DataFrame:
        """Kept files: a projection of ``files``, neither joined nor written, so each reader prunes it to its columns."""
        return self._get("tree", lambda: I.ingest(self.files, self.max_file_size, self.max_source_files))

    @property
    def imports(self) -> DataFrame:
        """Distinct (repo_id, src, module), written once: small, and read by every resolution rule."""
        return self._get("imports", lambda: materialise(IM.extract_imports(self.tree).distinct(), "imports"))

    @property
    def resolved(self) -> DataFrame:
        return self._get("resolved", lambda: RS.resolve_imports(self.imports, self.tree))

    @property
    def edges(self) -> DataFrame:
        return self._get("edges", lambda: materialise(RS.dependency_edges(self.resolved), "edges"))

    @property
    def pagerank(self) -> DataFrame:
        """Iterative; materialised once per RepoGraph (checkpointed inside)."""
        return self._get("pagerank", lambda: stage(PR.pagerank(G.nodes_of(self.tree), self.edges), "pagerank"))

    def central(self, top_n: int = K.REPORT_CENTRAL_TOP_N) -> DataFrame:
        return self._get(f"central{top_n}", lambda: G.central_files(self.pagerank, self.tree, top_n))


def ingestion_report(g: RepoGraph, top_n: int = K.REPORT_CENTRAL_TOP_N) -> DataFrame:
    """One row per repository: total_files, signal_files (tree order), graph_nodes, graph_edges,
    top_central_files (rank order)."""
    stats = G.repo_stats(g.tree, g.edges).drop("signal_files")
    signals = G.ordered_list(g.tree.where(F.col("is_signal")), "repo_id", ["tree_ord"], "path", "signal_files")
    central = G.ordered_list(g.central(top_n), "repo_id", ["rank"], "path", "top_central_files")
    empty = F.array().cast("array<string>")
    return (stats.join(signals, "repo_id", "left").join(central, "repo_id", "left")
            .select("repo_id", "total_files",
                    F.coalesce("signal_files", empty).alias("signal_files"),
                    "graph_nodes", "graph_edges",
                    F.coalesce("top_central_files", empty).alias("top_central_files")))
