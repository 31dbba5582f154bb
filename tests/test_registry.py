"""What the comparison with SQL does to a result, and that the engine's own result is untouched."""

import math

from skyweave.plans.registry import Query, plain


def test_results_are_not_cut(spark):
    rows = spark.sql("SELECT double('NaN') AS a, 1e-9D AS b, 1e14D AS c, timestamp_ntz'2024-01-01 00:00:00.5' AS t")
    q = Query("x", (), lambda s, sf: rows, None)
    r = q.run(spark, "").first()
    assert math.isnan(r.a) and (r.b, r.c, r.t.microsecond) == (1e-9, 1e14, 500000)
    p = plain(rows).first()
    assert math.isnan(p.a) and p.c == 1e14 and p.t == "2024-01-01 00:00:00.500000"
