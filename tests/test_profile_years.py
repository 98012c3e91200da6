"""Active months by year in the point-in-time profile: one number a year, with years and months missing."""

import datetime
import statistics

from siembra.operators.panel import point_in_time_profile


def test_season_by_the_median_of_years(spark):
    months = [(y, m) for y in (2019, 2020, 2022, 2023) for m in range(1, 13) if (y * 7 + m) % 5]
    rows = [("a", datetime.date(y, m, 1), float((y + m * m) % 3)) for y, m in months]
    out = point_in_time_profile(spark.createDataFrame(rows, "product_id string, periodo date, target_qty double"), top_share=2.0)
    assert "collect_list(CASE" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        years = [p.year for _, p, q in rows if p < r["periodo"] and q > 0]
        counts = [years.count(y) for y in set(years)]
        assert r["es_estacional"] == (len(counts) >= 2 and statistics.median(counts) <= 4), r
