"""Named models: their features, class weights and costs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Every numeric feature of the training set that a model may use.
FULL_NUMERIC = (
    "has_ise",
    "integration_educlimber",
    "integration_fast",
    "integration_google_classroom",
    "integration_pra",
    "asmt_admin_flex",
    "asmt_admin_ib",
    "asmt_admin_inspect_prebuilt",
    "cumulative_common_assessment_count_per_ay",
    "hs_1_lag_band",
    "hs_1year_lag_band",
    "hs_4_lag_band",
    "hs_5_lag_band",
    "hs_6_lag_band",
    "hs_7_lag_band",
    "hs_band",
    "matrix_distinct_users",
    "matrix_times_accessed",
    "mltp_asmt_smry_distinct_users",
    "mltp_asmt_smry_times_accessed",
    "rsp_freq_distinct_users",
    "rsp_freq_times_accessed",
    "site_asmt_ovr_distinct_users",
    "site_asmt_ovr_times_accessed",
    "site_peer_comp_distinct_users",
    "site_peer_comp_times_accessed",
    "skills_letter_distinct_users",
    "skills_letter_times_accessed",
    "subscriber_tenure_days",
    "summary_asmt_created",
    "ticket_count",
    "tile_layouts_created_modified",
    "user_created_custom_reports",
    "arr_dna",
    "atd_client_health_score",
    "atd_feature_adoption_score",
    "atd_students_assessed_percent",
    "atd_users_login_percent",
    "sa_tenure_in_days",
    "teachers_login_percent",
)
# Features dropped from the full set for being collinear with others.
COLLINEAR = (
    "matrix_times_accessed",
    "rsp_freq_times_accessed",
    "site_asmt_ovr_times_accessed",
    "site_peer_comp_distinct_users",
    "site_peer_comp_times_accessed",
    "skills_letter_times_accessed",
    "atd_client_health_score",
    "atd_feature_adoption_score",
)
CATEGORICAL = ("csm_name", "state")
LAG_NUMERIC = (
    "hs_1year_lag_band",
    "hs_7_lag_band",
    "hs_6_lag_band",
    "hs_5_lag_band",
    "hs_4_lag_band",
    "hs_1_lag_band",
)


@dataclass(frozen=True)
class ModelSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    weights: tuple[float, float] | None = (30.0, 70.0)  # of label 0 and label 1
    costs: tuple[float, ...] = (0.2,)
    kind: str = "rbf"  # or "lbfgs"
    select: int | None = None
    drop_first: bool = False
    folds: int = 5
    undersample: bool = field(default=False)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


REDUCED_NUMERIC = tuple(c for c in FULL_NUMERIC if c not in COLLINEAR)

# Weights and costs per model.
MARGIN_MODELS = {
    "baseline": ModelSpec(("atd_client_health_score",)),
    "lag_only": ModelSpec(LAG_NUMERIC),
    "full": ModelSpec(FULL_NUMERIC, CATEGORICAL, (35.0, 65.0), (0.25, 0.5, 1.0, 1.25)),
    "kbest10": ModelSpec(FULL_NUMERIC, CATEGORICAL, select=10),
    "collinearity_reduced": ModelSpec(REDUCED_NUMERIC, CATEGORICAL, (35.0, 65.0), (0.25, 0.5, 1.0, 1.25)),
}
LOGIT_COSTS = (1.0, 10.0, 30.0, 60.0, 100.0)
LOGIT_MODELS = {
    "baseline": ModelSpec(("atd_client_health_score",), costs=LOGIT_COSTS, kind="lbfgs", folds=10),
    "full": ModelSpec(FULL_NUMERIC, CATEGORICAL, costs=LOGIT_COSTS, kind="lbfgs", folds=10),
    "kbest10": ModelSpec(FULL_NUMERIC, CATEGORICAL, costs=LOGIT_COSTS, kind="lbfgs", select=10, folds=10),
    "low_collinearity": ModelSpec(REDUCED_NUMERIC, CATEGORICAL, costs=LOGIT_COSTS, kind="lbfgs", folds=10),
}
UNDERSAMPLED_MODELS = {
    "full": ModelSpec(FULL_NUMERIC, CATEGORICAL, drop_first=True, folds=10, undersample=True),
    "collinearity_reduced": ModelSpec(REDUCED_NUMERIC, CATEGORICAL, drop_first=True, folds=10, undersample=True),
}
# The grid searched, with ten folds and F1.
GRID_SPEC = ModelSpec(REDUCED_NUMERIC, CATEGORICAL, folds=10)
GRID_COSTS = (0.1, 0.2, 0.25)
GRID_WEIGHTS = ((20.0, 80.0), (25.0, 75.0), (30.0, 70.0))
