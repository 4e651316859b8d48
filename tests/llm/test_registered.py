import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from against_sql import SF_DIR, differences  # noqa: E402

from sectora.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytest.importorskip("duckdb")


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name]) == []
