from __future__ import annotations

import numpy as np

from siembra.llm.repeated_passages import repeated_passages


def test_frequent_passage_after_a_rare_shared_lead_in(spark):
    rng = np.random.default_rng(5)
    rows, expected, n = [], set(), 0
    for t in range(12):
        frequent = " ".join(f"f{t}_{k}" for k in range(45))
        for d in range(60):
            pair = d // 2 if d < 6 else None  # three pairs share a lead-in of 10 words, the others none
            lead = " ".join(f"l{t}_{pair}_{k}" for k in range(10)) if pair is not None else " ".join(f"o{n}_{k}" for k in range(10))
            tail = " ".join(f"t{n}_{k}_{rng.integers(1 << 30)}" for k in range(20))
            rows.append((n, f"{' '.join(f'h{n}_{k}' for k in range(7))} {lead} {frequent} {tail}"))
            if pair is not None:
                expected.add((n, 7, 62))
            n += 1
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == expected
