"""The fixture views as SQL, for the oracle statements.

``with_views("a", "b")`` gives the WITH clause that defines the named views and
whatever they read.
"""

from __future__ import annotations

_V: dict[str, tuple[tuple[str, ...], str]] = {}

_V["users"] = ((), """
SELECT s_suppkey AS id, concat('officer', CAST(s_suppkey AS VARCHAR), '@example.in') AS email, s_name AS full_name,
       CASE WHEN s_suppkey % 5 = 4 THEN 'supervisor' WHEN s_suppkey % 13 = 12 THEN 'admin' ELSE 'officer' END AS role,
       CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE r_name END AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

_V["inspections"] = ((), """
SELECT o_orderkey AS id, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM supplier) AS officer_id,
       CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS batch_id,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'needs_review' WHEN o_orderkey % 4 = 0 THEN 'sync_pending' ELSE 'draft' END AS status,
       CASE o_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'general' WHEN 2 THEN 'food' WHEN 3 THEN 'cosmetics' WHEN 4 THEN 'pan_masala' WHEN 5 THEN 'electronics' WHEN 6 THEN 'blown_glass' ELSE 'garments' END AS commodity_category,
       CASE WHEN o_orderkey % 9 = 0 THEN '2025.01.01' ELSE '2026.02.01' END AS rule_pack_version,
       o_orderpriority = '5-LOW' AS is_self_check,
       CASE o_custkey % 6 WHEN 1 THEN 'Mumbai Zone' WHEN 2 THEN 'Delhi North' WHEN 3 THEN 'Chennai' WHEN 4 THEN 'Kolkata' WHEN 5 THEN 'Pune_West' END AS region,
       o_orderkey % 3 = 0 AS captured_offline, o_orderdate AS created_at,
       concat('c-', CAST(o_orderkey % 1000 AS VARCHAR)) AS client_id
FROM orders""")

_V["images"] = ((), """
SELECT o_orderkey * 10 + k AS id, o_orderkey AS inspection_id,
       CASE k WHEN 0 THEN 'front_pdp' WHEN 1 THEN 'back_panel' WHEN 2 THEN 'sticker' WHEN 3 THEN 'ecommerce_listing' ELSE 'side_panel' END AS image_role,
       CASE WHEN (o_orderkey + k) % 17 = 0 THEN NULL ELSE 800 + (o_orderkey * 13 + k) % 1200 END AS width_px,
       CASE WHEN (o_orderkey + k) % 17 = 0 THEN NULL ELSE 900 + (o_orderkey * 29 + k) % 1500 END AS height_px,
       CASE WHEN (o_orderkey + k) % 4 = 0 THEN NULL ELSE 0.03e0 + ((o_orderkey * 3 + k) % 12) / 100.0e0 END AS calibration_scale_mm_per_px,
       (o_orderkey + k) % 6 <> 0 AS quality_check_passed, o_orderdate AS captured_at,
       concat('i-', CAST((o_orderkey * 10 + k) % 500 AS VARCHAR)) AS client_id,
       CASE WHEN (o_orderkey * 10 + k) % 5 = 1 THEN concat('https://store.example/', CAST(o_orderkey * 10 + k AS VARCHAR), '.jpg')
            ELSE concat('local://', CAST(o_orderkey AS VARCHAR), '/', CAST(o_orderkey * 10 + k AS VARCHAR), '.jpg') END AS storage_url,
       CASE WHEN (o_orderkey * 10 + k) % 10 = 3 THEN NULL ELSE sha256(concat('img-', CAST(o_orderkey * 10 + k AS VARCHAR))) END AS sha256_hash
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4)) r(k) WHERE k <= o_orderkey % 5""")

_V["extracted_fields"] = (("images",), """
SELECT *, concat('seen ', parsed_value) AS raw_text FROM (
SELECT i.id * 10 + t AS id, i.inspection_id, i.id AS source_image_id, i.id * 10 + t AS field_seq,
       CASE t WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacturer_address' WHEN 3 THEN 'mfg_date' WHEN 4 THEN 'consumer_care' WHEN 5 THEN 'country_of_origin' ELSE 'commodity_name' END AS field_type,
       CASE t WHEN 0 THEN concat('Rs. ', CAST(100 + (i.inspection_id % 50) + CASE WHEN i.id % 11 = 2 THEN 35 WHEN i.id % 13 = 3 THEN -10 ELSE 0 END AS VARCHAR), '.00')
              WHEN 1 THEN concat(CAST(50 * (1 + i.inspection_id % 20) + CASE WHEN i.id % 19 = 1 THEN 50 ELSE 0 END AS VARCHAR), ' g')
              WHEN 2 THEN CASE WHEN i.id % 23 = 3 THEN 'Other Foods Pvt Ltd' ELSE 'Acme Foods' END
              WHEN 3 THEN concat('0', CAST(1 + (i.inspection_id + CASE WHEN i.id % 29 = 1 THEN 1 ELSE 0 END) % 9 AS VARCHAR), '/2026')
              WHEN 5 THEN CASE WHEN i.id % 31 = 3 THEN 'CHINA' ELSE 'INDIA' END ELSE 'x' END AS parsed_value,
       0.60e0 + ((i.id * 7 + t * 13) % 40) / 100.0e0 AS confidence,
       CAST((i.id * 3 + t) % 400 AS DOUBLE) AS box_x, CAST((i.id * 11 + t) % 500 AS DOUBLE) AS box_y,
       CAST(60 + (i.id + t) % 90 AS DOUBLE) AS box_w, (i.id * 5 + t) % 40 + 4 AS box_h,
       CASE WHEN (i.id + t) % 12 = 5 THEN 'needs_review' WHEN (i.id + t) % 41 = 7 THEN 'fail' WHEN (i.id + t) % 43 = 9 THEN 'not_applicable' ELSE 'pass' END AS verdict,
       (i.id + t) % 10 = 3 AS reviewed_by_officer,
       CASE WHEN (i.id + t) % 20 = 3 THEN concat('fixed ', CAST(t AS VARCHAR)) END AS officer_override_value
FROM images i CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) f(t) WHERE (i.id + t * 5) % 6 <> 0) q""")

_V["violations"] = ((), """
SELECT o_orderkey * 10 + n AS id, o_orderkey AS inspection_id, CASE WHEN n % 3 <> 0 THEN o_orderkey * 100 + n END AS extracted_field_id,
       concat('rule-', CAST(n AS VARCHAR)) AS rule_id,
       concat('Rule 6(', CAST(n AS VARCHAR), ')') AS citation, concat('deficiency ', CAST(n AS VARCHAR)) AS description,
       CASE WHEN n < 2 THEN 'critical' WHEN n < 5 THEN 'major' ELSE 'minor' END AS severity, o_orderdate AS created_at
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(n) WHERE (o_orderkey * 7 + n * 5) % 11 < 2 AND o_orderkey % 3 <> 1""")

_V["audit_logs"] = ((), """
SELECT event_id AS id, user_id % (SELECT count(*) FROM supplier) AS actor_user_id, concat('field_', event_type) AS action,
       CASE WHEN event_id % 5 = 0 THEN 'inspection' ELSE 'extracted_field' END AS entity_type, event_id % 200 AS entity_id,
       CASE WHEN event_id % 4 = 1 THEN '{"verdict": "needs_review"}' END AS before_value, props AS after_value, ts AS created_at
FROM events""")

_V["ocr_lines"] = ((), """
SELECT p_partkey AS source_image_id, n AS line_number,
       CASE n WHEN 0 THEN concat(upper(p_name), ' NET WEIGHT') WHEN 1 THEN concat('NET QTY: ', CAST(p_size * 10 AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN ' GMS' WHEN p_partkey % 3 = 1 THEN ' ml' ELSE ' N' END)
              WHEN 2 THEN concat('M.R.P. Rs. ', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR), '.50') WHEN 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'PRICE AS STAMPED' ELSE '(Incl. of all taxes)' END
              WHEN 4 THEN concat('MFD: 0', CAST(1 + p_partkey % 9 AS VARCHAR), '/2026') WHEN 5 THEN 'Manufactured by: Acme Foods Ltd.' WHEN 6 THEN concat('Gurugram, Haryana ', CAST(122000 + p_partkey % 900 AS VARCHAR))
              WHEN 7 THEN concat('Consumer Care: care', CAST(p_partkey AS VARCHAR), '@acme.in') ELSE 'Country of Origin: India' END AS text,
       0.70e0 + ((p_partkey * 3 + n * 7) % 30) / 100.0e0 AS confidence, 10.0e0 AS x, 30.0e0 * n AS y, 200.0e0 AS w, 25.0e0 AS h
FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) l(n)""")

_V["boxes"] = ((), """
SELECT o_orderkey AS task_id, src, k AS box_id, CASE (o_orderkey + k) % 4 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'barcode' ELSE 'consumer_care' END AS label,
       5.0e0 + 12 * k + CASE WHEN src = 'prediction' THEN (o_orderkey % 7) ELSE 0 END AS x, 10.0e0 + (o_orderkey % 30) AS y, 20.0e0 AS width, 15.0e0 AS height
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) b(k) CROSS JOIN (VALUES ('truth'), ('prediction')) s(src)
WHERE k <= o_orderkey % 4 AND NOT (src = 'prediction' AND (o_orderkey + k) % 5 = 0)""")


def view(name: str, reads: tuple[str, ...], sql: str) -> None:
    """Register a further view, e.g. an intermediate result several statements share."""
    _V[name] = (reads, sql)


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in _V[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_V[n][1]})" for n in order) + "\n"
