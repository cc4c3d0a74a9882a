"""Thresholds of every operator in one place.

Each operator takes ``opts: Options = DEFAULTS``; use ``dataclasses.replace`` to change a value.
"""

from dataclasses import dataclass, field

# Rule profiles. Numbers the results depend on.
RULE_PROFILES = {
    "strict": dict(currency_limit=1.1e9, max_tax_rate=0.30, rel_tol=0.01, abs_tol=0.5,
                   w_complete=0.55, w_consistent=0.35, w_dedup=0.10),
    "balanced": dict(currency_limit=1e9, max_tax_rate=0.40, rel_tol=0.02, abs_tol=1.0,
                     w_complete=0.50, w_consistent=0.40, w_dedup=0.10),
    "lenient": dict(currency_limit=1e10, max_tax_rate=0.60, rel_tol=0.05, abs_tol=2.0,
                    w_complete=0.40, w_consistent=0.30, w_dedup=0.30),
}


@dataclass(frozen=True)
class Options:
    # profiling
    key_ratio: float = 0.95
    fence: float = 1.5
    min_fence_values: int = 4
    normal_skew: float = 0.5
    normal_kurtosis: float = 1.0
    skewed: float = 1.0
    zero_share: float = 0.25
    report_r: float = 0.5
    # tagging
    parse_share: float = 80.0
    analysis_missing_pct: float = 20.0
    one_hot_max: int = 20
    # cleaning
    rule_profile: str = "balanced"
    fuzzy_distance: int = 2
    fuzzy_min_length: int = 6
    fuzzy_rare_pct: float = 1.0
    fuzzy_off_labels: int = 3
    one_hot_full: int = 10
    one_hot_top: int = 8
    near_unique: float = 0.5
    knn_k: int = 5
    iterative_rounds: int = 10
    unknown_label: str = "Unknown"
    other_label: str = "Other"
    survival_share: float = 0.5
    # reconciliation of derived columns
    reconcile_r: float = 0.99
    reconcile_mape_pct: float = 1.0
    reconcile_pairs: int = 5
    # rules
    review_pct: float = 90.0
    example_rows: int = 5
    # statistics
    strong_r: float = 0.7
    min_variation: float = 0.03
    rank_n: int = 5
    hint_share: float = 0.1
    max_dimensions: int | None = None
    most_labels: int | None = None
    z_limit: float = 3.5
    anomaly_skew: float = 1.0
    anomaly_fence: float = 3.0
    max_bars: int = 15
    top_bars: int = 14
    bins: int = 20
    keep_insights: int = 16
    # output checks and facts
    trend_min_n: int = 10
    max_rule_fail_pct: float = 15.0
    merge_change_pct: float = 5.0
    merge_common_pct: float = 1.0
    min_kappa: float = 0.4
    top_facts: int = 5
    slice_rows: int = 3
    claim_abs_tol: float = 1.0
    claim_rel_tol: float = 0.05
    row_documents: int = 20_000
    top_rows: int = 8
    top_fact_docs: int = 6
    chart_rows: int = 15
    # physical limits (they choose a method, never a result)
    in_memory_rows: int = 1_000_000
    chunk_rows: int = 5_000_000
    max_chunks: int = 4096
    rank_cells: int = 200_000

    @property
    def rules(self) -> dict:
        return RULE_PROFILES[self.rule_profile]


DEFAULTS = Options()
