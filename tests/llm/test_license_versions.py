from __future__ import annotations

import pytest

from siembra.llm import license_scan as LS
from tests.llm.test_license_families import found

WHOLE_GPL_2, WHOLE_LGPL_21 = LS.TEMPLATES["GPL-2.0"], LS.TEMPLATES["LGPL-2.1"]


def test_other_names_and_versions_are_no_match(spark):
    header = LS.TEMPLATES["GPL-3.0-header"]
    texts = [
        "Released under the BSD License.", "Released under the terms License.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.", "All rights not reserved.", "Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        header.replace("version 3", "version 2"), header.replace("GNU General", "GNU Lesser General"), LS.TEMPLATES["Apache-2.0-header"].replace("Version 2.0", "Version 1.1"),
    ]
    assert found(spark, texts) == [{}] * len(texts)


def test_whole_texts_are_no_newer_header(spark):
    got = found(spark, [WHOLE_GPL_2, WHOLE_LGPL_21])
    assert "GPL-2.0" in got[0] and "LGPL-2.1" in got[1]
    assert all("GPL-3.0-header" not in g and "GPL-3.0" not in g for g in got)


def test_marks_at_the_ends_of_words_do_not_count(spark):
    texts = ["This project is licensed under the MIT License", "(Released under the 'MIT' License!)", "Licensed under the Apache License, Version 2.0", "All rights reserved", "... Licensed under CC BY-SA 4.0, 2021 ..."]
    assert [set(g) for g in found(spark, texts)] == [{"MIT-notice"}, {"MIT-notice"}, {"Apache-2.0-notice"}, {"all-rights-reserved-notice"}, {"CC-BY-SA-4.0-short-notice"}]


def brute(words, template, keys, coverage=LS.COVERAGE):
    """Whether some stretch of four template lengths aligns enough of the template, by the longest common subsequence."""
    reach = int(LS.SPREAD * len(template))
    for at in range(max(1, len(words) - reach + 1)):
        part = words[at : at + reach]
        table = [0] * (len(template) + 1)
        for w in part:
            before = 0
            for k, t in enumerate(template):
                before, table[k + 1] = table[k + 1], before + 1 if w == t else max(table[k + 1], table[k])
        joined = " ".join(part)
        if table[-1] >= coverage * len(template) - 1e-9 and all(key in joined for key in keys):
            return True
    return False


@pytest.mark.parametrize("seed", range(3))
def test_notices_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    short = {k: v for k, v in LS.TEMPLATES.items() if len(v.split()) < 16}
    plain = lambda text: [w.strip(".,;:!?()'\"").lower() for w in text.split()]
    texts = []
    for _ in range(120):
        words = rng.choice(list(short.values())).split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [words[at], "uno"], ["dos"], [words[at], "x", "y", "z"]])
            words = words or ["nada"]
        texts.append(" ".join(["al", "principio", *words, "fin"]))
    for text, got in zip(texts, found(spark, texts), strict=True):
        want = {k for k, v in short.items() if brute(plain(text), plain(v), [" ".join(plain(x)) for x in LS.KEYS.get(k, ())])}
        # the alignment is patient, not longest: it may find less, never more
        assert set(got) <= want
        assert len(want - set(got)) == 0, (text, want, set(got))
