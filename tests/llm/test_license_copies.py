from __future__ import annotations

import pytest

from siembra.llm import license_scan as LS


@pytest.mark.parametrize("copies", [2, 3, 9])
@pytest.mark.parametrize("name", ["MIT", "MIT-notice", "BSD-2-Clause"])
def test_copies_that_follow_each_other(spark, name, copies):
    text = "the to under " + " of ".join([LS.TEMPLATES[name]] * copies) + " the to any under"
    got = LS.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).where(f"license = '{name}'").collect()
    assert [r["coverage"] for r in got] == [1.0]
    assert got[0]["start_word"] < got[0]["end_word"]
