from __future__ import annotations

from siembra.llm import license_scan as LS


def found(spark, texts):
    rows = list(enumerate(texts))
    got = LS.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [{r["license"]: r for r in got if r["doc_id"] == k} for k, _ in rows]


def test_families_apart(spark):
    t = LS.TEMPLATES
    named = t["BSD-3-Clause"].replace("the copyright holder nor", "Example Inc. nor")
    texts = ["Licensed under CC BY-NC 4.0.", "x All rights reserved. y", t["BSD-2-Clause"], t["BSD-3-Clause"], named, t["GPL-2.0-notice"], t["CC-BY-NC-4.0-notice"], t["CC-BY-4.0-notice"], t["ISC"], t["GPL-3.0-notice"]]
    names = ["CC-BY-NC-4.0-short-notice", "all-rights-reserved-notice", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "GPL-2.0-notice", "CC-BY-NC-4.0-notice", "CC-BY-4.0-notice", "ISC", "GPL-3.0-notice"]
    assert [set(x) for x in found(spark, texts)] == [{n} for n in names]


def test_every_template_finds_itself(spark):
    for (name, _), got in zip(LS.TEMPLATES.items(), found(spark, list(LS.TEMPLATES.values())), strict=True):
        assert got[name]["coverage"] == 1


def test_half_a_license_is_none(spark):
    mit = LS.TEMPLATES["MIT"].split()
    assert found(spark, [" ".join(mit[: len(mit) // 2])]) == [{}]
