"""Comparison units found by symbol, then by name, and made once."""

from ticketlake.operators import catalogue

UNIT = "record_id string, name string, normalized_name string, slug string, symbol string"


def run(spark, stored, asked):
    units, found = catalogue.find_or_create_units(spark.createDataFrame(stored, UNIT), spark.createDataFrame(asked, "unit_symbol string, unit_name string"))
    return [tuple(u) for u in units.collect()], {(r.unit_symbol, r.unit_name): r.comparison_unit_id for r in found.collect()}


def test_units_by_symbol_then_name(spark):
    stored = [("u1", "Kilogramme", "kilogramme", "kilogramme", "kg"), ("u2", "Litre", "litre", "litre", "l"), ("u3", "Piece", "piece", "piece", None)]
    asked = [("kg", "Litre"), ("cl", "LITRE"), (None, "Piece"), (" ", None), (None, None), ("m", None), (None, "Square Metre"), ("m", None), ("m", "Metre")]
    units, found = run(spark, stored, asked)
    assert [found["kg", "Litre"], found["cl", "LITRE"], found[None, "Piece"]] == ["u1", "u2", "u3"]
    assert {u for u in units if u[0] in {"u1", "u2", "u3"}} == set(stored)
    assert (" ", None) not in found and (None, None) not in found
    new = {u[4]: u[1:4] for u in units if u[0] not in {"u1", "u2", "u3"}}
    assert new == {"m": ("m", "m", "m"), "square-metre": ("Square Metre", "square metre", "square-metre")}
    assert found["m", None] == found["m", "Metre"]


def test_crossed_symbols_and_names_stay_unique(spark):
    asked = [("a", "one"), ("b", "one"), ("b", "two"), ("c", "two"), ("c", "three")]
    units, found = run(spark, [], asked)
    assert set(found) == set(asked) and all(found.values())
    assert len({u[2] for u in units}) == len(units) == len({u[4] for u in units})
    again, same = run(spark, units, asked)
    assert sorted(again) == sorted(units) and same == found


def test_no_unit_asked_for(spark):
    assert run(spark, [], []) == ([], {})
