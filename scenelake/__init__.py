"""Spark-native analytics over multi-sensor driving scenes."""

from scenelake.plans.catalog import Catalog, ForeignKey
from scenelake.plans.query import SceneQuery
from scenelake.plans.scenarios import SCENARIOS, Scenario, register_scenario

__all__ = [
    "Catalog",
    "ForeignKey",
    "SCENARIOS",
    "Scenario",
    "SceneQuery",
    "register_scenario",
]
