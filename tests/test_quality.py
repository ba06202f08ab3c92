import datetime as dt

import pytest

from adpulse.operators import quality
from adpulse.operators.quality import Check

AS_OF = "2024-01-10 00:00:00"


def _run(tables, checks, as_of=AS_OF):
    return {(r.check_name, r.table_name): r for r in quality.run_checks(tables, checks, batch_id="t", as_of=as_of).collect()}


def test_completeness_threshold_inclusive(df):
    at = df([(None,)] + [("x",)] * 99, "c string")            # exactly 1% -> PASS
    above = df([(None,)] * 3 + [("x",)] * 197, "c string")    # 1.5% -> FAIL
    r = _run({"a": at, "b": above}, [Check("completeness", "a", ("c",)), Check("completeness", "b", ("c",))])
    assert r[("null_check_c", "a")].status == "PASS" and r[("null_check_c", "a")].metric_value == 0.01
    assert r[("null_check_c", "b")].status == "FAIL" and r[("null_check_c", "b")].metric_value == 0.015
    assert r[("null_check_c", "b")].details == "Detected 3 nulls in 200 rows"


def test_completeness_empty_table(df):
    r = _run({"e": df([], "c string, d string")}, [Check("completeness", "e", ("c", "d"))])
    assert list(r) == [("completeness", "e")] and r[("completeness", "e")].status == "FAIL"


def test_non_negative_and_range(df):
    t = df([(1.0, 0.5), (-2.0, 1.5), (3.0, None)], "spend double, ctr double")
    r = _run({"t": t}, [Check("non_negative", "t", ("spend",)), Check("range", "t", ("ctr",), 0.0, 1.0),
                        Check("range", "t", ("spend",))])
    assert r[("non_negative_spend", "t")].status == "FAIL" and r[("non_negative_spend", "t")].metric_value == 1.0
    rc = r[("range_check_ctr", "t")]
    assert rc.status == "FAIL" and rc.details == "Target range [0.0, 1.0] - Violations: 1"   # 1/3 >= 1%
    assert ("range_check_spend", "t") not in r                                             # no bounds, no check


def test_range_warn_under_one_percent(df):
    t = df([(2.0,)] + [(0.5,)] * 199, "ctr double")
    r = _run({"t": t}, [Check("range", "t", ("ctr",), 0.0, 1.0)])
    assert r[("range_check_ctr", "t")].status == "WARN"


@pytest.mark.parametrize("n_out,status", [(1, "PASS"), (3, "WARN"), (6, "FAIL")])
def test_zscore_bands(df, n_out, status):
    t = df([(100.0,)] * n_out + [(0.0,)] * (100 - n_out) + [(None,)], "x double")
    r = _run({"t": t}, [Check("zscore", "t", ("x",))])[("anomaly_x", "t")]
    assert (r.status, r.metric_value, r.threshold) == (status, float(n_out), 3.0)


def test_zscore_constant_and_empty(df):
    const = df([(5.0,)] * 10, "x double")
    empty = df([(None,)], "x double")
    r = _run({"c": const, "e": empty}, [Check("zscore", "c", ("x",)), Check("zscore", "e", ("x",))])
    assert r[("anomaly_x", "c")].status == "PASS" and ("anomaly_x", "e") not in r


def test_freshness(df):
    t = df([(dt.date(2024, 1, 8),)], "date date")
    fresh = _run({"t": t}, [Check("freshness", "t", ("date",))], as_of="2024-01-09 23:00:00")[("freshness_t", "t")]
    stale = _run({"t": t}, [Check("freshness", "t", ("date",))], as_of="2024-01-10 01:00:00")[("freshness_t", "t")]
    none = _run({"t": df([], "date date")}, [Check("freshness", "t", ("date",))])[("freshness_t", "t")]
    assert (fresh.status, fresh.metric_value) == ("PASS", 47.0)
    assert (stale.status, stale.metric_value, stale.details) == ("WARN", 49.0, "Latency: 49.0h (SLA Boundary: 48h)")
    assert none.status == "FAIL"


def test_referential_summary_and_gate(df):
    child = df([("C1",), ("C9",), ("C9",), (None,)], "campaign_id string")
    parent = df([("C1",)], "campaign_id string")
    res = quality.run_checks({"f": child, "d": parent},
                             [Check("referential", "f", ("campaign_id",), parent_table="d", parent_column="campaign_id"),
                              Check("non_negative", "d", ())], batch_id="b")
    r = res.where("check_name = 'ref_integrity_campaign_id'").first()
    assert (r.status, r.metric_value) == ("WARN", 1.0)
    s = quality.summary(res).first()
    assert (s.total, s.passed, s.warned, s.failed, s.pass_rate, s.score_band) == (1, 0, 1, 0, 0.0, "CRITICAL")
    log = quality.audit_log(res, "consistency").collect()
    assert [r.check_name for r in log] == ["ref_integrity_campaign_id"]
    assert quality.audit_log(res, "freshness").count() == 0
    quality.enforce(res)     # WARN does not trip the gate
    bad = quality.run_checks({"t": df([(-1.0,)], "x double")}, [Check("non_negative", "t", ("x",))], batch_id="b")
    with pytest.raises(quality.QualityGateError):
        quality.enforce(bad)


def test_check_ids_are_stable(df):
    t = df([(1.0,)], "x double")
    a = quality.run_checks({"t": t}, [Check("non_negative", "t", ("x",))], batch_id="b").first().check_id
    b = quality.run_checks({"t": t}, [Check("non_negative", "t", ("x",))], batch_id="b").first().check_id
    assert a == b and len(a) == 12


def test_no_audited_tables_gives_empty_results(spark):
    res = quality.run_checks({}, batch_id="b")
    assert res.count() == 0 and "check_id" in res.columns
    s = quality.summary(res).first()
    assert (s.total, s.pass_rate) == (0, 0.0)


def test_unique_key_check(df):
    dims = df([("C1", "a"), ("C1", "b"), ("C2", "c"), (None, "d")], "campaign_id string, campaign_name string")
    r = _run({"d": dims}, [Check("unique", "d", ("campaign_id",))])[("unique_campaign_id", "d")]
    assert (r.status, r.metric_value, r.details) == ("FAIL", 1.0, "Duplicate key rows: 1")
    ok = _run({"d": dims.where("campaign_name != 'b'")}, [Check("unique", "d", ("campaign_id",))])
    assert ok[("unique_campaign_id", "d")].status == "PASS"
