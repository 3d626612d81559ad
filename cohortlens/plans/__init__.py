"""Query plans: the registered queries (Spark + oracle SQL) and the
multi-step chronological / scenario runs built from the operators."""

from cohortlens.plans.registry import QUERIES, ORACLES, register  # noqa: F401


def load_all() -> None:
    """Import every catalog module so its queries register themselves."""
    from cohortlens.plans import catalog_events, catalog_cohort, catalog_eval  # noqa: F401
    from cohortlens.plans import catalog_closed_forms, catalog_models, catalog_scale  # noqa: F401
