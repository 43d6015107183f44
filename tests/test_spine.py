"""Days without events stay in the spine of availability."""

import pandas as pd

from tidemark.plans import catalog


def test_days_without_events_are_in_the_spine(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-03 05:00", "2024-03-01 07:00"])
    pd.DataFrame({"ts": ts.astype("datetime64[us]"), "event_type": ["view", "error"], "value": [1.0, 2.0]}).to_parquet(tmp_path / "events.parquet")
    rows = catalog.QUERIES["availability"](spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 61 and sum(r.has_rows for r in rows) == 2
