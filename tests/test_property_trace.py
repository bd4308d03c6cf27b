"""Property test: successor columns equal a pure-Python trace walk, with and without splitting."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathweave.operators.trace import SkewPolicy, with_successor

T0 = dt.datetime(2024, 1, 1)

events = st.lists(
    st.tuples(st.sampled_from(["c1", "c2", "c3", "hot"]),          # case (hot is frequent below)
              st.sampled_from(["a", "b", "c"]),                      # activity
              st.integers(0, 5),                                     # start minute (many ties)
              st.integers(0, 3)),                                    # duration minutes (ties too)
    min_size=1, max_size=60)


def _expected(rows):
    by_case = {}
    for eid, (case, act, s, d) in enumerate(rows):
        by_case.setdefault(case, []).append((s, s + d, eid, act))
    out = {}
    for case, evs in by_case.items():
        evs.sort()
        for i, (s, e, eid, act) in enumerate(evs):
            nxt = evs[i + 1] if i + 1 < len(evs) else None
            out[eid] = (None, None) if nxt is None else (T0 + dt.timedelta(minutes=nxt[0]), nxt[3])
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=events, hot_share=st.integers(0, 40))
def test_successor_matches_python(spark, rows, hot_share):
    rows = rows + [("hot", "a", 1, 0)] * hot_share + [("hot", "b", 1, 0)] * (hot_share // 2)
    data = [(c, a, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=s + d), i)
            for i, (c, a, s, d) in enumerate(rows)]
    log = spark.createDataFrame(data, "case_id string, activity string, start_ts timestamp_ntz, "
                                      "end_ts timestamp_ntz, event_id long")
    exp = _expected(rows)
    for pol in (None, SkewPolicy(hot_case_rows=5, segment_rows=3)):
        got = {r["event_id"]: (r["next_start"], r["next_activity"])
               for r in with_successor(log, policy=pol).collect()}
        assert got == exp, pol
