import pytest

from scenelake import SCENARIOS, Scenario, register_scenario
from scenelake.plans import scenarios as S


def test_there_are_21_named_scenarios():
    assert len(SCENARIOS) == 21
    assert {"all", "dayrainsun", "twilightsnow", "nightcloud"} <= set(SCENARIOS)
    assert all(name == s.name for name, s in SCENARIOS.items())


def test_product_needs_both_dimensions():
    both = S.DAY * S.RAIN
    assert both.name == "dayrain"
    assert both.conditions == {"tod": S.DAY.conditions["tod"], "weather": S.RAIN.conditions["weather"]}
    assert both.is_tod and both.is_weather


def test_product_of_unequal_values_is_refused():
    with pytest.raises(NotImplementedError):
        S.DAY * S.NIGHT
    with pytest.raises(NotImplementedError):
        S.RAIN * S.SUN


def test_weather_agrees_as_multiset_but_tod_in_order():
    a = Scenario("a", {"weather": ("x", "y")}) * Scenario("b", {"weather": ("y", "x")})
    assert a.conditions["weather"] == ("y", "x")
    with pytest.raises(NotImplementedError):
        Scenario("a", {"tod": ("x", "y")}) * Scenario("b", {"tod": ("y", "x")})


def test_sum_widens_each_dimension():
    rainsun = S.RAIN + S.SUN
    assert rainsun.conditions["weather"] == S.RAIN.conditions["weather"] + S.SUN.conditions["weather"]
    assert (S.DAY + S.RAIN).conditions.keys() == {"tod", "weather"}


@pytest.mark.parametrize("other", [None, 1, "rain"])
def test_other_operands_are_type_errors(other):
    with pytest.raises(TypeError):
        S.DAY * other
    with pytest.raises(TypeError):
        S.DAY + other


def test_own_scenario_can_be_registered():
    try:
        assert SCENARIOS[register_scenario(S.SNOW + S.CLOUD).name].is_weather
    finally:
        SCENARIOS.pop("snowcloud", None)


def test_predicate(spark):
    rows = [("Day", "rain"), ("day", "Fog"), ("Night", "rain"), (None, "rain")]
    df = spark.createDataFrame(rows, "tod STRING, weather STRING")
    assert df.where(SCENARIOS["dayrain"].predicate()).count() == 1
    assert df.where(SCENARIOS["all"].predicate()).count() == 4
    assert df.where((S.DAY + S.RAIN).predicate()).count() == 1


def test_counts_keep_empty_scenarios(spark):
    df = spark.createDataFrame([("Day", "rain")], "tod STRING, weather STRING")
    counts = {r.scenario: r.samples for r in S.scenario_counts(df).collect()}
    assert counts["dayrain"] == counts["all"] == 1 and counts["nightsnow"] == 0 and len(counts) == 21
