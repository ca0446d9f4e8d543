"""Settings of the clusterer, with the default values of each."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: fixed values: the twelve feature slots, in order, by the names that weight files use
FEATURES = (
    "embedding_all", "NEWEST_TS", "OLDEST_TS", "RELEVANCE_TS", "title_repr", "paragraph_repr", "title_paragraph_repr",
    "paragraph_centroid", "title_paragraph_centroid", "cluster_density", "mean_similarity", "target_density",
)
#: fixed values: slots that each kind of training line holds
RANK_MASK = (1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0)
JOIN_MASK = (1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1)
#: fixed values: upper bounds of the size bins and the step between their values
SIZE_BINS = (3, 10, 20, 30, 40, 50)
SIZE_STEP = 0.1428

MODELS = Path(__file__).parent / "plans" / "models"


#: the defaults below are fixed values
@dataclass(frozen=True)
class ClusterConfig:
    gaussian_std_days: float = 3.0
    relevance_z: float = 1.282
    k_first: int = 4
    pool_size: int = 15000
    save_interval: int = 100
    merge_threshold: float = 0.0
    join_threshold: float = 0.0
    size_rank_threshold: int = 5
    check_cluster_join: bool = True
    use_timestamps: bool = True
    use_title: bool = False
    use_paragraph: bool = True
    use_title_paragraph: bool = True
    use_density: bool = False
    use_mean_similarity: bool = False
    use_forced_label: bool = False
    deviate_from_gold: bool = False
    deviation_step: int = 10
    #: documents that go by their gold label are scored, too, for the log (similarity, relevance, best index); assignments do not hang on it
    score_forced: bool = True
    refresh_after_join: bool = False
    merge_languages: bool = True
    #: "relevance" archives the cluster of least relevance stamp; "first" the oldest place in the pool
    eviction: str = "relevance"
    rank_model: str = str(MODELS / "rank.cls")
    merge_model: str | None = str(MODELS / "merge.cls")
    join_model: str = str(MODELS / "join.cls")
    #: module -> {"rank": path, "merge": path or None, "join": path}, for modules with models of their own
    modules: dict = field(default_factory=dict, compare=False)

    def models(self, module: str) -> dict:
        """The paths of a module's weight files."""
        return {"rank": self.rank_model, "merge": self.merge_model, "join": self.join_model, **self.modules.get(module, {})}
