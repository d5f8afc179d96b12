"""Rows without a key form no group, as a data frame library that drops missing keys has it."""

import pytest

from opsrisk.operators import eda, features

ROWS = [
    (2020, 1, "AA", "Alpha", "X", 0.2), (2020, 2, "AA", "Alpha", "Y", 0.4), (2021, 1, "BB", "Beta", "X", 0.1),
    (None, 1, "BB", "Beta", "X", 0.3), (2020, None, None, None, "X", 0.9), (2020, None, None, None, "Y", 0.9),
    (2020, 2, None, None, None, 0.0), (2021, 2, "BB", "Beta", None, 0.5),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        ROWS, "year int, month int, carrier string, carrier_name string, airport string, delay_rate double"
    )


def test_no_group_of_nulls(rows):
    assert [r.month for r in eda.delay_by_month(rows).collect()] == [1, 2]
    assert [r.year for r in eda.delay_by_year(rows).collect()] == [2020, 2021]
    carriers = eda.delay_by_carrier(rows, min_rows=1).collect()
    assert sorted(r.carrier for r in carriers) == ["AA", "BB"]
    assert carriers[0].overall_mean == pytest.approx(sum(r[5] for r in ROWS) / len(ROWS))
    assert sorted(r.carrier_name for r in eda.top_carriers(rows, 3).collect()) == ["Alpha", "Beta"]
    assert sorted(r.carrier_name for r in eda.delay_heatmap(rows, 3).collect()) == ["Alpha", "Beta"]
    extremes = {r.dimension: (r.highest, r.lowest) for r in eda.delay_extremes(rows).collect()}
    # means: Jan 0.2, Feb 0.3; Alpha 0.3, Beta 0.3, of which the first name is taken
    assert extremes == {"month": ("Feb", "Jan"), "carrier": ("Alpha", "Alpha")}


def test_both_forms_of_averages_agree(rows):
    one = features.add_group_averages(rows).collect()
    two = features.add_group_averages_by_window(rows).collect()
    columns = ("year", "month", "carrier", "airport", "airport_avg_delay_rate", "carrier_avg_delay_rate")
    plain = lambda found: sorted(str([None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in found)
    assert plain(one) == plain(two)
