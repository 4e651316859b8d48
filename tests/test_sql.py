from pathlib import Path

import pytest
from against_sql import SF_DIR, differences

from sectora.queries import ORACLE_SQL, QUERIES

pytest.importorskip("duckdb")
SOME = ["iot_footprint_f", "iot_prices_by_solve", "sut_footprint_ma", "sut_prices_c", "linkages", "structural_paths", "trade_exposure", "aggregate_coefficients", "to_iot_a_flows", "chenery_moses_supply", "pool_trade_supply", "region_subset_demand", "shock_output", "trade_mix_coefficients", "record_scatter", "nearest_year", "add_sector_output", "add_activity_output", "split_sector_z", "concordance", "first_seen_order", "iot_value_added_of_demand", "sut_demand_of_activities"]


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name]) == []
