"""The role tables of ``sources/roles.py`` as SQL, for the checks."""

AS_OF_SQL = "DATE '2001-11-04'"

ROLE_SQL = {
    "account": """
  SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry,
         CASE WHEN c_acctbal < 0 THEN 'Prospect' ELSE 'Customer' END AS customer_type,
         CASE WHEN c_acctbal < 1000 THEN 'Inactive' ELSE 'Active' END AS account_status,
         n_name AS city, r_name AS province
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "salesperson": """
  SELECT s_suppkey AS person_id, s_name AS person,
         CASE WHEN s_acctbal < -500 THEN '' ELSE r_name END AS department,
         CASE WHEN s_acctbal < 0 THEN DATE '1999-06-30' END AS quit_date
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "deal_core": f"""
  SELECT o_orderkey AS deal_id, o_custkey AS account_id, 'Deal ' || o_orderkey AS deal_name,
         CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'P' THEN 'Lost' ELSE 'Open' END AS status,
         110 - 20 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS possibility,
         o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(12,2)) AS plan_amount,
         CAST(o_orderdate AS DATE) AS created, CAST(o_orderdate AS DATE) + 120 AS est_close,
         date_diff('day', CAST(o_orderdate AS DATE), {AS_OF_SQL}) AS aging_days
  FROM orders""",
    "deal_owner": """
  SELECT l_orderkey AS deal_id, min(l_suppkey) AS person_id, min(l_partkey) AS part_id FROM lineitem GROUP BY 1""",
    "deal": """
  SELECT d.*, o.person_id, p_type AS solution, s.person
  FROM deal_core d LEFT JOIN deal_owner o USING (deal_id)
  LEFT JOIN part ON o.part_id = p_partkey LEFT JOIN salesperson s ON s.person_id = o.person_id""",
    "actual": """
  SELECT l_orderkey AS deal_id, l_partkey AS part_id, l_suppkey AS person_id, CAST(l_shipdate AS DATE) AS actual_date,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS amount
  FROM lineitem""",
    "target": """
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS target_month, l_suppkey AS person_id,
         sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS target_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "activity": """
  SELECT event_id AS activity_id, user_id AS deal_id, event_type AS activity_type, ts, CAST(ts AS DATE) AS activity_date,
         CAST(value AS DECIMAL(12,2)) AS value, props
  FROM events""",
    "contact": """
  SELECT conv_id || '-' || turn AS contact_id, conv_id AS account_id,
         'Contact ' || conv_id || '-' || turn AS contact_name, role AS job_title
  FROM conversations""",
    "note": """
  SELECT page_id AS note_id, page_id AS account_id, url AS title, html AS body FROM pages""",
    "income": """
  SELECT department, p_name AS deal_label, p_type AS solution, amount, actual_date AS day
  FROM actual a LEFT JOIN part ON part_id = p_partkey LEFT JOIN salesperson s ON s.person_id = a.person_id""",
    "expense": """
  SELECT department, p_name AS deal_label, CASE WHEN l_returnflag = 'N' THEN '' ELSE p_brand END AS project_code,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS amount, CAST(l_shipdate AS DATE) AS day
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN salesperson s ON s.person_id = l_suppkey""",
    "employee_cost": """
  SELECT l_suppkey AS person_id, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS DECIMAL(12,2)) AS cost,
         department, quit_date
  FROM lineitem LEFT JOIN salesperson s ON s.person_id = l_suppkey""",
    "allocation": """
  SELECT l_suppkey AS person_id, p_type AS allocate_type, CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INTEGER) AS assign_percent,
         least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS start_date,
         greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS finish_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
}
