"""Scenario algebra: named conditions on time of day and weather."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    """Accepted values per filter column.

    ``a * b`` requires both, ``a + b`` widens the values of a column. The
    columns of one scenario are always combined with AND.
    """

    name: str
    conditions: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def is_tod(self) -> bool:
        return "tod" in self.conditions

    @property
    def is_weather(self) -> bool:
        return "weather" in self.conditions

    def __mul__(self, other: object) -> Scenario:
        if not isinstance(other, Scenario):
            return NotImplemented
        for column in self.conditions.keys() & other.conditions.keys():
            ours, theirs = self.conditions[column], other.conditions[column]
            # Weather lists agree as multisets; time-of-day lists also in order.
            same = sorted(ours) == sorted(theirs) if column == "weather" else ours == theirs
            if not same:
                raise NotImplementedError(f"{self.name} * {other.name}: {column} values differ")
        return Scenario(self.name + other.name, self.conditions | other.conditions)

    def __add__(self, other: object) -> Scenario:
        if not isinstance(other, Scenario):
            return NotImplemented
        columns = list(self.conditions) + [c for c in other.conditions if c not in self.conditions]
        return Scenario(
            self.name + other.name,
            {c: self.conditions.get(c, ()) + other.conditions.get(c, ()) for c in columns},
        )

    def predicate(self, column: Callable[[str], Column] = F.col) -> Column:
        tests = [column(name).isin(*values) for name, values in self.conditions.items()]
        return reduce(Column.__and__, tests, F.lit(True)) if tests else F.lit(True)


# The accepted spellings per condition.
ALL = Scenario("all")
DAY = Scenario("day", {"tod": ("Day", "day")})
NIGHT = Scenario("night", {"tod": ("Night", "night")})
TWILIGHT = Scenario("twilight", {"tod": ("Dawn/Dusk", "Dawn", "Dusk", "dusk", "dawn")})
RAIN = Scenario(
    "rain",
    {
        "weather": (
            "rain",
            "Light Drizzle",
            "Moderate Drizzle",
            "Dense Drizzle",
            "Light Rain",
            "Moderate Rain",
            "Heavy Rain",
        )
    },
)
SUN = Scenario("sun", {"weather": ("sunny", "Clear Sky", "Mainly Clear")})
CLOUD = Scenario("cloud", {"weather": ("Partly Cloudy", "Overcast")})
SNOW = Scenario("snow", {"weather": ("Light Snow", "Moderate Snow")})

SCENARIOS: dict[str, Scenario] = {}


def register_scenario(scenario: Scenario) -> Scenario:
    """Make a scenario available to requests by its name."""
    SCENARIOS[scenario.name] = scenario
    return scenario


for _s in (ALL, DAY, NIGHT, TWILIGHT, SUN, RAIN, CLOUD, SNOW, DAY * (RAIN + SUN)):
    register_scenario(_s)
for _tod in (DAY, NIGHT, TWILIGHT):
    for _sky in (SUN, RAIN, CLOUD, SNOW):
        register_scenario(_tod * _sky)


def scenario_counts(samples: DataFrame) -> DataFrame:
    """(scenario, samples) for every registered scenario, zero counts included, in one pass."""
    counts = samples.agg(*[F.count_if(s.predicate()).alias(f"c{i}") for i, s in enumerate(SCENARIOS.values())])
    rows = [
        F.struct(F.lit(name).alias("scenario"), F.col(f"c{i}").alias("samples")) for i, name in enumerate(SCENARIOS)
    ]
    return counts.select(F.inline(F.array(*rows)))
