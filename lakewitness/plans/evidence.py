"""Evidence of a set of dataset versions: profile, comparison and diagnosis, computed for all at once.

Relations that several later ones read are written to the shared folder on first use, so that each is
computed once and later plans start from stored tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lakewitness.functions.ordered import BUCKETS
from lakewitness.operators import diagnosis, diff, fingerprint, profile
from lakewitness.operators.value_counts import column_catalog, value_counts
from lakewitness.session import cut, shared, together

VERSION_SCHEMA = (
    "version_id long, study_id long, dataset_id long, dataset_name string, version_number int, parent_version_id long, "
    "generation_method string, version_notes string, created_at string, task_type string, target_column string, "
    "primary_metric string, validation_strategy string, feature_selection_mode string, selected_features array<string>, "
    "scaling_strategy string"
)


class Evidence:
    """``frames``: version id to DataFrame. ``registry``: one row per version, in ``VERSION_SCHEMA``."""

    def __init__(self, spark: SparkSession, frames: dict[int, DataFrame] | None = None, registry: DataFrame | None = None):
        self.spark = spark
        self._kept: dict[str, DataFrame] = {}
        # Measured evidence the scores take into account where it is given: F32, F33 and F34 per version.
        self.conflicts: DataFrame | None = None
        self.overlap: DataFrame | None = None
        self.associations: DataFrame | None = None
        if frames is not None:
            self.frames = frames
        if registry is not None:
            self.registry = registry

    def once(self, name: str, build) -> DataFrame:
        """A relation several queries share, written on first use."""
        if name not in self._kept:
            self._kept[name] = cut(build())
        return self._kept[name]

    @shared
    def configurations(self) -> DataFrame:
        return self.registry.select(
            "version_id", "task_type", "target_column", "primary_metric", "validation_strategy",
            "feature_selection_mode", "selected_features", "scaling_strategy",
        )

    @shared
    def configuration_hashes(self) -> DataFrame:
        return fingerprint.configuration_hashes(self.configurations)

    @shared
    def contents(self) -> DataFrame:
        return cut(fingerprint.content_hashes(self.frames))

    @shared
    def versions(self) -> DataFrame:
        """The registry with the shape every version turned out to have."""
        return self.registry.join(self.tables.select("version_id", "row_count", "column_count"), "version_id", "left")

    @shared
    def buckets(self) -> int:
        """Ranges that order statistics are split into."""
        return BUCKETS

    @shared
    def catalog(self) -> DataFrame:
        return column_catalog(self.spark, self.frames)

    @shared
    def vc(self) -> DataFrame:
        return cut(value_counts(self.frames))

    @shared
    def columns(self) -> DataFrame:
        return cut(profile.column_profile(self.vc, self.catalog, self.configurations, self.frames))

    @shared
    def tops(self) -> DataFrame:
        return cut(profile.top_values(self.vc, self.catalog))

    @shared
    def duplicates(self) -> DataFrame:
        # Where the columns are known, rows with a column of different values throughout are known to differ.
        known = self.__dict__.get("columns")
        return cut(profile.duplicate_rows(self.frames, {} if known is None else profile.rows_that_differ(known)))

    @shared
    def correlations(self) -> DataFrame:
        found = profile.high_correlations(self.frames)
        none = self.spark.createDataFrame([], "version_id long, left string, right string, correlation double")
        return none if found is None else cut(found)

    @shared
    def tables(self) -> DataFrame:
        return cut(profile.table_profile(self.columns, self.duplicates))

    @shared
    def classes(self) -> DataFrame:
        return cut(profile.class_distribution(self.vc, self.columns, self.configurations))

    @shared
    def classification(self) -> DataFrame:
        return profile.classification_profile(self.classes)

    @shared
    def regression(self) -> DataFrame:
        return cut(profile.regression_profile(self.frames, self.configurations))

    @shared
    def clustering(self) -> DataFrame:
        return profile.clustering_profile(self.columns, self.configurations)

    @shared
    def pairs(self) -> DataFrame:
        return cut(diff.parent_pairs(self.registry, self.configurations))

    @shared
    def diff(self) -> "PairEvidence":
        return PairEvidence(self, self.pairs)

    @shared
    def all_pairs(self) -> "PairEvidence":
        return PairEvidence(self, cut(diff.any_pairs(self.registry, self.configurations)))

    def measure(self, splits: dict[int, tuple[str, list[str]]] | None = None, versions: list[int] | None = None) -> "Evidence":
        """Let conflicting duplicates, exact associations and, for versions with a split column and the keys of an entity, split
        overlap count in the scores. To be called before these are read."""
        some = {v: df for v, df in self.frames.items() if versions is None or v in versions}
        found = diagnosis.measured_evidence(some, self.configurations, splits or {})
        self.conflicts, self.overlap, self.associations = (None if df is None else cut(df) for df in found)
        return self

    def compare(self, requests: DataFrame) -> "PairEvidence":
        """Comparison evidence of the requested pairs (previous_version_id, current_version_id)."""
        return PairEvidence(self, cut(diff.requested_pairs(requests, self.registry, self.configurations)))

    def ahead(self, *more: Callable[[], object]) -> None:
        """What the facts of the versions are made of, and ``more``: relations that need nothing of each other at the same time."""
        self.frames, self.registry  # made by one thread
        own = ("tables", "correlation_clusters", "regression", "classes")
        tasks = [partial(getattr, self, name) for name in own[:2]]
        tasks += [partial(getattr, self.diff, name) for name in ("counts", "rows", "numeric", "categories")]
        together(self.spark, [*tasks, *[partial(getattr, self, name) for name in own[2:]], *more])

    @shared
    def facts(self) -> DataFrame:
        self.ahead()
        return cut(
            diagnosis.version_facts(
                self.registry, self.columns, self.tables, self.classification, self.regression, self.clustering,
                self.correlation_clusters, self.diff.worsening, self.diff.scores,
            )
        )

    @shared
    def correlation_clusters(self) -> DataFrame:
        return cut(diagnosis.correlation_clusters(self.correlations, self.configurations))

    @shared
    def leakage(self) -> DataFrame:
        return cut(diagnosis.leakage_features(self.columns, self.correlations, self.configurations, self.associations))

    @shared
    def components(self) -> DataFrame:
        return cut(diagnosis.risk_components(self.facts, self.leakage, self.conflicts, self.overlap))

    @shared
    def risks(self) -> DataFrame:
        return cut(diagnosis.risk_scores(self.components))

    @shared
    def findings(self) -> DataFrame:
        return cut(diagnosis.findings(self.facts, self.columns, self.correlation_clusters, self.leakage, self.risks))


class PairEvidence:
    """Comparison evidence for one relation of pairs."""

    def __init__(self, ws: Evidence, pairs: DataFrame):
        self.ws, self.pairs = ws, pairs

    @shared
    def paired(self) -> DataFrame:
        return cut(diff.paired_columns(self.pairs, self.ws.columns))

    @shared
    def counts(self) -> DataFrame:
        return cut(diff.paired_counts(self.pairs, self.ws.vc))

    @shared
    def keys(self) -> DataFrame:
        return cut(diff.stable_keys(self.paired))

    @shared
    def rows(self) -> DataFrame:
        found = diff.row_diffs(self.ws.frames, self.pairs, self.keys)
        return None if found is None else cut(found)

    @shared
    def numeric(self) -> DataFrame:
        return cut(diff.numeric_shifts(self.paired, self.counts))

    @shared
    def changes(self) -> DataFrame:
        return cut(diff.category_changes(self.paired, self.counts))

    @shared
    def categories(self) -> DataFrame:
        return cut(diff.category_shifts(self.changes))

    @shared
    def shifts(self) -> DataFrame:
        return cut(diff.shifts(self.numeric, self.categories))

    @shared
    def overall(self) -> DataFrame:
        return cut(diff.missing_overall(self.pairs, self.ws.columns))

    @shared
    def duplicates(self) -> DataFrame:
        return diff.duplicate_changes(self.pairs, self.ws.tables)

    @shared
    def scores(self) -> DataFrame:
        together(self.ws.spark, [partial(getattr, self, name) for name in ("rows", "counts", "numeric", "categories")])
        return cut(
            diff.diff_scores(
                self.pairs,
                diff.schema_scores(self.pairs, diff.schema_events(self.paired)),
                self.rows,
                diff.missingness_scores(self.paired),
                diff.structure_scores(self.categories),
                diff.dsi_components(self.pairs, self.shifts),
            )
        )

    @shared
    def worsening(self) -> DataFrame:
        return diagnosis.readiness_worsening(self.pairs, self.overall, self.duplicates, diff.missingness_changes(self.paired))

    @shared
    def facts(self) -> DataFrame:
        together(self.ws.spark, [partial(getattr, self.ws, "tables"), *[partial(getattr, self, name) for name in ("counts", "numeric", "categories")]])
        return cut(diff.transition_facts(self.pairs, self.paired, self.overall, self.duplicates, self.shifts))
