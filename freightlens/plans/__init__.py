from freightlens.plans.catalog import ANALYSES, run

__all__ = ["ANALYSES", "run"]
