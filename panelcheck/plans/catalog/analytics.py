"""Catalog: enforcement analytics."""

from pyspark.sql import functions as F

from panelcheck.operators import analytics as A
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views

view("enforced", ("inspections",), "SELECT * FROM inspections WHERE NOT is_self_check")
view("vcount", ("violations",), "SELECT inspection_id, count(*) AS n FROM violations GROUP BY 1")

_STATUS = """SELECT count(*) AS total_inspections, count(*) FILTER (WHERE status = 'completed') AS completed_inspections,
 count(*) FILTER (WHERE status = 'needs_review') AS needs_review_inspections, count(*) FILTER (WHERE status = 'draft') AS draft_inspections
 FROM enforced {where}"""
_SPLIT = """SELECT count(*) FILTER (WHERE v.n IS NULL) AS compliant_inspections, count(v.n) AS violation_inspections,
 CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE v.n IS NULL) / count(*) * 100.0e0, 2) ELSE 100.0e0 END AS overall_compliance_rate
 FROM enforced i LEFT JOIN vcount v ON v.inspection_id = i.id WHERE i.status = 'completed' {and_}"""
_ACTIVITY = """SELECT (SELECT count(*) FROM audit_logs {log_where}) AS total_audit_overrides,
 (SELECT count(DISTINCT officer_id) FROM enforced) AS active_officers_count"""
_SEV = """SELECT count(*) AS total_violations, count(*) FILTER (WHERE severity = 'critical') AS critical_violations,
 count(*) FILTER (WHERE severity = 'major') AS major_violations, count(*) FILTER (WHERE severity = 'moderate') AS moderate_violations
 FROM violations v JOIN enforced i ON v.inspection_id = i.id {where}"""


def summary_sql(officer=None):
    w = "" if officer is None else f"WHERE officer_id = {officer}"
    a = "" if officer is None else f"AND officer_id = {officer}"
    l = "" if officer is None else f"WHERE actor_user_id = {officer}"
    return (
        f"SELECT * FROM ({_STATUS.format(where=w)}) a, ({_SPLIT.format(and_=a)}) b, ({_SEV.format(where=w)}) c,"
        f" ({_ACTIVITY.format(log_where=l)}) d"
    )


_VIEWS = with_views("enforced", "vcount", "audit_logs")


@query("a1_status_counts", with_views("enforced") + "SELECT status, count(*) AS inspections FROM enforced GROUP BY 1")
def _(f):
    return A.status_counts(f.inspections())


@query("a2_compliance_split", with_views("enforced", "vcount") + _SPLIT.format(and_=""))
def _(f):
    return A.compliance_split(f.inspections(), f.violations())


@query(
    "a3_severity_counts",
    with_views("enforced", "violations")
    + "SELECT severity, count(*) AS violations FROM violations v JOIN enforced i ON v.inspection_id = i.id GROUP BY 1",
)
def _(f):
    return A.severity_counts(f.inspections(), f.violations())


@query("a4_activity_counts", with_views("enforced", "audit_logs") + _ACTIVITY.format(log_where=""))
def _(f):
    return A.activity_counts(f.inspections(), f.audit_logs())


@query("a5_analytics_summary", _VIEWS + summary_sql())
def _(f):
    return A.analytics_summary(f.inspections(), f.violations(), f.audit_logs())


@query("a5_analytics_summary_officer", _VIEWS + summary_sql(3))
def _(f):
    return A.analytics_summary(f.inspections(), f.violations(), f.audit_logs(), officer_id=3)


def trend_sql(where="", join=""):
    return f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS total_inspections,
 count(*) FILTER (WHERE v.n IS NULL) AS compliant_count, count(v.n) AS violation_count,
 round(count(*) FILTER (WHERE v.n IS NULL) / count(*) * 100.0e0, 2) AS compliance_rate
 FROM enforced i LEFT JOIN vcount v ON v.inspection_id = i.id {join} {where} GROUP BY 1"""


@query("a6_compliance_trends", with_views("enforced", "vcount") + trend_sql())
def _(f):
    return A.compliance_trends(f.inspections(), f.violations())


@query(
    "a6_compliance_trends_filtered",
    with_views("enforced", "vcount", "users")
    + trend_sql(
        "WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-12-31'"
        " AND commodity_category = 'food' AND u.region = 'ASIA'",
        "JOIN users u ON u.id = i.officer_id",
    ),
)
def _(f):
    return A.compliance_trends(
        f.inspections(), f.violations(), f.users(), start="1996-01-01", end="2000-12-31", category="food",
        region="ASIA", officer_id=1,
    )


@query(
    "a7_trend_period",
    with_views("enforced", "vcount")
    + f"SELECT DATE '1996-03-01' AS period_start, max(date) AS period_end FROM ({trend_sql()}) p WHERE date >= DATE '1996-03-01'",
)
def _(f):
    points = A.compliance_trends(f.inspections(), f.violations(), start="1996-03-01")
    return A.trend_period(points, start="1996-03-01")


_BY_RULE = """SELECT rule_id, min(citation) AS citation, min(description) AS description, min(severity) AS severity, count(*) AS count
 FROM violations v JOIN enforced i ON v.inspection_id = i.id GROUP BY 1 ORDER BY count DESC, rule_id LIMIT {k}"""


@query("a8_hotspots_by_rule", with_views("enforced", "violations") + _BY_RULE.format(k=5))
def _(f):
    return A.hotspots_by_rule(f.inspections(), f.violations(), 5)


_RATE = "round(greatest(0.0e0, (count(DISTINCT i.id) - count(v.id)) / count(DISTINCT i.id) * 100), 2)"
_BY_CATEGORY = f"""SELECT coalesce(commodity_category, 'general') AS commodity_category, count(DISTINCT i.id) AS total_inspections,
 count(v.id) AS violations_count, {_RATE} AS compliance_rate
 FROM enforced i LEFT JOIN violations v ON v.inspection_id = i.id GROUP BY i.commodity_category"""


@query("a9_hotspots_by_category", with_views("enforced", "violations") + _BY_CATEGORY)
def _(f):
    return A.hotspots_by_category(f.inspections(), f.violations())


@query(
    "a10_hotspots_by_region",
    with_views("enforced", "violations", "users")
    + f"""SELECT coalesce(u.region, 'Unassigned') AS region, count(DISTINCT i.id) AS total_inspections,
 count(v.id) AS violations_count, {_RATE} AS compliance_rate
 FROM users u JOIN enforced i ON u.id = i.officer_id LEFT JOIN violations v ON v.inspection_id = i.id GROUP BY u.region""",
)
def _(f):
    return A.hotspots_by_region(f.inspections(), f.violations(), f.users())


_THROUGHPUT = """SELECT u.id AS officer_id, u.full_name AS officer_name, u.email, u.region,
 (SELECT count(*) FROM enforced i WHERE i.officer_id = u.id) AS total_inspections,
 (SELECT count(*) FROM enforced i WHERE i.officer_id = u.id AND status = 'completed') AS completed_inspections,
 (SELECT count(*) FROM enforced i WHERE i.officer_id = u.id AND status = 'needs_review') AS needs_review_inspections,
 (SELECT count(*) FROM audit_logs l WHERE l.actor_user_id = u.id) AS human_overrides_count,
 (SELECT max(created_at) FROM enforced i WHERE i.officer_id = u.id) AS last_inspection_at
 FROM users u WHERE u.role IN ('officer', 'supervisor')"""


@query("a11_officer_throughput", with_views("enforced", "users", "audit_logs") + _THROUGHPUT)
def _(f):
    return A.officer_throughput(f.inspections(), f.users(), f.audit_logs())


@query(
    "a12_recent_trend",
    with_views("enforced", "vcount")
    + f"""SELECT *, date = (SELECT date FROM (SELECT * FROM ({trend_sql()}) b ORDER BY date DESC LIMIT 30) c
 ORDER BY total_inspections DESC, date LIMIT 1) AS is_peak FROM ({trend_sql()}) a ORDER BY date DESC LIMIT 30""",
)
def _(f):
    return A.recent_trend(A.compliance_trends(f.inspections(), f.violations()))


@query(
    "a12_top_rules",
    with_views("enforced", "violations")
    + f"""SELECT concat('0', CAST(row_number() OVER (ORDER BY count DESC, rule_id) AS VARCHAR), '.') AS rank, rule_id, description,
 upper(severity) AS severity, citation, count,
 CAST(least(100, floor(count / (SELECT max(count) FROM ({_BY_RULE.format(k=10)}) m) * 100 + 0.5e0)) AS INT) AS width_pct,
 CAST(floor(count / (SELECT count(*) FROM violations v JOIN enforced i ON v.inspection_id = i.id) * 100 + 0.5e0) AS INT) AS share_pct
 FROM ({_BY_RULE.format(k=5)}) r""",
)
def _(f):
    i, v = f.inspections(), f.violations()
    total = A.severity_counts(i, v).agg(F.sum("violations").alias("n")).scalar()
    return A.top_rules(A.hotspots_by_rule(i, v, 10), total)


@query(
    "a12_category_badges",
    with_views("enforced", "violations")
    + f"""SELECT *, CASE WHEN compliance_rate < 70 THEN 'HIGH RISK' WHEN compliance_rate < 85 THEN 'STANDARD' ELSE 'COMPLIANT' END AS badge
 FROM ({_BY_CATEGORY}) c ORDER BY violations_count DESC, commodity_category LIMIT 4""",
)
def _(f):
    return A.category_badges(A.hotspots_by_category(f.inspections(), f.violations()))


@query(
    "a12_officer_states",
    with_views("enforced", "users", "audit_logs")
    + f"""SELECT officer_id, officer_name, coalesce(region, 'Zonal Enforcement') AS region, total_inspections, completed_inspections,
 needs_review_inspections, human_overrides_count,
 CASE WHEN needs_review_inspections > 5 THEN 'Pending Review' ELSE 'Active Field' END AS state FROM ({_THROUGHPUT}) t""",
)
def _(f):
    return A.officer_states(A.officer_throughput(f.inspections(), f.users(), f.audit_logs()))


_LEDGER = [
    (1, "Total Inspections", "CAST(total_inspections AS VARCHAR)"),
    (2, "Compliant Packages", "CAST(compliant_inspections AS VARCHAR)"),
    (3, "Violations Detected", "CAST(violation_inspections AS VARCHAR)"),
    (4, "Overall Compliance Rate",
     r"concat(regexp_replace(printf('%.2f', overall_compliance_rate), '\.?0+$', ''), '%')"),
    (5, "Critical Breaches", "CAST(critical_violations AS VARCHAR)"),
    (6, "Major Breaches", "CAST(major_violations AS VARCHAR)"),
    (7, "Needs Review Queue", "CAST(needs_review_inspections AS VARCHAR)"),
    (8, "Active Officers", "CAST(active_officers_count AS VARCHAR)"),
]


@query(
    "s13_summary_ledger",
    _VIEWS + f", s AS ({summary_sql()}) "
    + " UNION ALL ".join(f"SELECT {n} AS line, '{m}' AS metric, {v} AS value FROM s" for n, m, v in _LEDGER),
)
def _(f):
    return A.summary_ledger(A.analytics_summary(f.inspections(), f.violations(), f.audit_logs()))
