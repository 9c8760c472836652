import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm.runs import base_runs, event_runs, sequence_runs


def brute(seq: str) -> list[tuple]:
    s = re.sub("[^ACGT]", "N", seq.upper())
    out = []
    for b in "ACGT":
        for m in re.finditer(f"{b}(?:N{{0,2}}{b}){{7,}}", s):
            out.append((b, m.start(), m.end(), m.group().count(b)))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("AaCNn", max_size=60), max_size=5))
def test_sequence_runs_against_regex(seqs):
    data = "".join(seqs).encode()
    offsets = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
    row, value, beg, end, n = sequence_runs(offsets, np.frombuffer(data, np.uint8), 2, 8)
    got = sorted((int(r), "ACGT"[v], int(b), int(e), int(c)) for r, v, b, e, c in zip(row, value, beg, end, n))
    assert got == sorted((i, *x) for i, s in enumerate(seqs) for x in brute(s))


def test_base_runs_edges(spark):
    long = "ACGT" * 50_000 + "A" * 9
    rows = [(1, "AAAAnnAAAA", 5), (2, "AAAANNNAAAA", 5), (3, None, None), (4, "", 5), (None, "g" * 8, 1), (5, long, 1), (5, long, 1), (6, "NN" + "t" * 8 + "NN", 1)]
    df = spark.createDataFrame(rows, "read_idx bigint, seq string, key int")
    got = sorted(((r.key, r.base, r.run_beg, r.run_end, r.n_events, r.n_positions) for r in base_runs(df, "read_idx", "seq").collect()), key=repr)
    last = (5, "A", 200_000, 200_009, 9, 9)
    assert got == sorted([(1, "A", 0, 10, 8, 10), (None, "G", 0, 8, 8, 8), last, last, (6, "T", 2, 10, 8, 8)], key=repr)
    assert base_runs(df.limit(0), "read_idx", "seq").count() == 0


def test_event_runs_with_a_hot_entity(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), i, None if v == 3 else "xyz"[v], "clash") for i, (u, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 600), rng.integers(0, 4, 600)))]
    df = spark.createDataFrame(rows + [(None, 5, "x", ""), (1, None, "x", "")], "u bigint, t bigint, v string, entity string")
    want, open_ = [], {}
    for u, t, v, _ in rows:
        if u in open_ and open_[u][0] == v:
            open_[u][2], open_[u][3] = t, open_[u][3] + 1
        else:
            if u in open_:
                want.append((u, *open_[u]))
            open_[u] = [v, t, t, 1]
    want += [(u, *x) for u, x in open_.items()]
    got = [(r.entity, r.value, r.first, r.last, r.n_events) for r in event_runs(df, "u", ["t"], "v").select("entity", "value", F.col("first").alias("first"), "last", "n_events").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert event_runs(df.limit(0), "u", ["t"], "v").count() == 0
