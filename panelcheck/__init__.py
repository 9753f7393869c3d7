"""Label-compliance analytics as Spark jobs.

Tables of recognised label text, inspections, rule packs, audit events and
annotation boxes go in; declarations, verdicts, discrepancies, dashboards and
evaluation metrics come out.  Every operator is a function from DataFrames to a
DataFrame, so a plan stays lazy until the caller writes or collects it.
"""
