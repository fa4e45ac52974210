"""Shared parts of the DuckDB statements the Spark results are compared with.

``PRELUDE`` states the test-data mapping a second time, in SQL; the statements
on top keep the plain join shape of the definitions (no pre-aggregation), so
they check the Spark plans rather than repeat them.
"""

from __future__ import annotations

CTES = {
    "users": """
  SELECT 'S' || c_custkey AS id, lower(c_name) || '@x' AS email, 'student' AS role, c_name AS first_name,
         c_mktsegment AS last_name, CASE WHEN c_nationkey % 3 = 0 THEN 'M' || c_nationkey END AS middle_name,
         CASE WHEN c_custkey % 4 <> 0 THEN 'P' || c_custkey END AS phone, c_acctbal >= 0 AS is_active,
         TIMESTAMP '2018-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS created_at
  FROM customer
  UNION ALL
  SELECT 'T' || s_suppkey, lower(s_name) || '@x', 'teacher', s_name, 'SUPP' || (s_suppkey % 7), NULL,
         'P' || s_suppkey, s_acctbal >= 0, TIMESTAMP '2018-01-01' + to_days(CAST(s_suppkey % 2000 AS INTEGER))
  FROM supplier
  UNION ALL
  SELECT 'A' || r_regionkey, lower(r_name) || '@x', 'admin', r_name, 'ADMIN', NULL,
         'P' || r_regionkey, r_regionkey <> 4, TIMESTAMP '2018-01-01' + to_days(CAST(r_regionkey % 2000 AS INTEGER))
  FROM region""",
    "topics": "SELECT r_regionkey AS id, r_name AS name FROM region",
    # number of courses made of parts
    "cat": "SELECT max(p_partkey) // 10 + 1 AS n FROM part",
    "courses": """
  SELECT id, id % 5 AS topic_id, title, 'SUBJ_' || (id % 6) AS subject, CAST(1900 + 100 * (id % 25) AS DECIMAL(10,2)) AS price_monthly,
         CAST(16900 + 1000 * (id % 25) AS DECIMAL(10,2)) AS price_yearly, id % 6 <> 5 AS is_active
  FROM (SELECT p_partkey // 10 AS id, 'C' || (p_partkey // 10) AS title FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT (SELECT n FROM cat) + n_nationkey, n_name FROM nation)""",
    "course_teachers": """
  SELECT s_suppkey // 2 * 4 % n AS course_id, 'T' || s_suppkey AS teacher_id, TIMESTAMP '2018-01-01' AS assigned_at FROM supplier, cat
  UNION ALL
  SELECT (s_suppkey // 2 * 4 + 1 + s_suppkey % 3) % n, 'T' || s_suppkey, TIMESTAMP '2018-01-01' FROM supplier, cat""",
    "modules": """
  SELECT c.id * 10 + i AS id, c.id AS course_id, 'M' || (c.id * 10 + i) AS title, i AS order_index
  FROM courses c, (VALUES (1), (2), (3)) v(i)""",
    "lessons": """
  SELECT p_partkey AS id, p_partkey // 10 * 10 + 1 + p_partkey % 10 % 3 AS module_id, p_name AS title,
         CASE WHEN p_partkey % 10 % 3 = 1 THEN 'webinar' ELSE 'video' END AS lesson_type,
         1 + p_partkey % 10 // 3 AS order_index,
         CASE WHEN p_partkey % 10 % 3 <> 1 THEN 'u' || p_partkey END AS video_url,
         CASE WHEN p_partkey % 10 % 3 = 1 THEN 'u' || p_partkey END AS webinar_url,
         CASE WHEN p_partkey % 10 % 3 = 1
              THEN TIMESTAMP '2024-01-31' + to_days(CAST(p_partkey % 60 - 15 AS INTEGER)) END AS webinar_scheduled_at,
         p_size AS duration_minutes, p_size > 5 AS is_published
  FROM part""",
    "homeworks": """
  SELECT p_partkey AS id, p_partkey AS lesson_id, 'HW ' || p_partkey AS title,
         CASE WHEN p_partkey % 4 = 0 THEN 'auto' ELSE 'manual' END AS check_type, 10 + p_size AS max_score,
         CASE WHEN p_partkey % 10 < 6 THEN 24 * (1 + p_partkey % 10) END AS deadline_hours
  FROM part WHERE p_partkey % 2 = 0""",
    # orders, line items and events with the course, homework or lesson they stand for
    "placed": """
  SELECT orders.*, CASE WHEN o_orderkey % 6 < 5 THEN (o_custkey // 8 + o_orderkey % 6) % n ELSE n + o_custkey // 8 % 25 END AS course_id
  FROM orders, cat""",
    "handed": """
  SELECT lineitem.*, o_custkey, (o_custkey // 8 + l_partkey % 5) % n * 10 + l_partkey // 5 % 5 * 2 AS homework_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey, cat""",
    "viewed": """
  SELECT events.*, (user_id // 8 + event_id % 5) % n * 10 + event_id // 5 % 10 AS lesson_id FROM events, cat""",
    "enrollments": """
  SELECT o_custkey * 100000000 + course_id AS id, 'S' || o_custkey AS student_id, course_id,
         min(o_orderdate) + INTERVAL 8200 DAY AS enrolled_at, bool_or(o_orderstatus <> 'F') AS is_active
  FROM placed GROUP BY o_custkey, course_id""",
    "payments": """
  SELECT *, CAST(payment_date + CASE WHEN subscription_type = 'yearly' THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END
                 - INTERVAL 1 DAY AS DATE) AS period_end
  FROM (SELECT o_orderkey AS id, 'S' || o_custkey AS student_id, course_id,
               CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yearly' ELSE 'monthly' END AS subscription_type,
               CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) AS payment_date,
               CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) AS period_start, 'A0' AS created_by
        FROM placed)""",
    "hand_ins": "SELECT h.*, hw.check_type, hw.max_score FROM handed h JOIN homeworks hw ON hw.id = h.homework_id",
    "homework_submissions": """
  SELECT homework_id * 100000000 + o_custkey AS id, homework_id, 'S' || o_custkey AS student_id,
         'a' || l_orderkey AS answer_text, CAST(NULL AS VARCHAR) AS answer_url,
         CASE WHEN check_type = 'auto' THEN max_score
              WHEN l_returnflag <> 'N' AND l_linenumber % 3 <> 0 THEN least(CAST(l_quantity AS INTEGER), max_score) END AS score,
         CASE WHEN check_type = 'auto' THEN 'auto_checked' WHEN l_returnflag = 'N' THEN 'submitted'
              ELSE 'checked' END AS status,
         CASE WHEN check_type <> 'auto' AND l_returnflag <> 'N' THEN 'T' || l_suppkey END AS checked_by,
         CASE WHEN check_type = 'auto' OR l_returnflag <> 'N'
              THEN l_shipdate + INTERVAL 8101 DAY END AS checked_at,
         l_shipdate + INTERVAL 8100 DAY AS submitted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY homework_id, o_custkey
                                     ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
        FROM hand_ins) WHERE rn = 1""",
    "lesson_progress": """
  SELECT user_id * 100000000 + lesson_id AS id, 'S' || user_id AS student_id, lesson_id,
         bool_or(event_type IN ('purchase', 'signup')) AS is_completed,
         min(ts) FILTER (WHERE event_type IN ('purchase', 'signup')) AS completed_at, max(ts) AS last_viewed_at
  FROM viewed GROUP BY user_id, lesson_id""",
    "activity_log": """
  SELECT event_id AS id, 'S' || user_id AS user_id,
         CASE event_type WHEN 'view' THEN 'view_lesson' WHEN 'purchase' THEN 'complete_lesson'
              WHEN 'click' THEN 'submit_hw' WHEN 'signup' THEN 'login' WHEN 'error' THEN 'enroll' END AS action,
         'lesson' AS entity_type, CAST(lesson_id AS VARCHAR) AS entity_id, props AS metadata, ts AS created_at
  FROM viewed""",
    # as_of, and names used by several statements
    "clock": "SELECT TIMESTAMP '2024-01-31' AS now, DATE '2024-01-31' AS today",
    "names": """
  SELECT id, trim(last_name || ' ' || first_name || coalesce(' ' || middle_name, '')) AS full_name FROM users""",
}

PRELUDE = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())

# the same mapping up to the cut-offs: what a snapshot refreshed then was made from
EARLIER = {
    "enrollments": CTES["enrollments"].replace("FROM placed", "FROM placed WHERE o_orderdate < TIMESTAMP '2000-01-01'"),
    "lesson_progress": CTES["lesson_progress"].replace("FROM viewed", "FROM viewed WHERE ts < TIMESTAMP '2024-01-16'"),
    "homework_submissions": f"SELECT * FROM ({CTES['homework_submissions']}) WHERE submitted_at < TIMESTAMP '2000-01-01' + INTERVAL 8100 DAY",
}


def on_snapshot(sql: str) -> str:
    """A statement of current tables as one of the earlier tables."""
    for name, body in EARLIER.items():
        sql = sql.replace(f"{name} AS ({CTES[name]})", f"{name} AS ({body})", 1)
    return sql


def statement(body: str, ints: str = "", doubles: str = "", ctes: str = "") -> str:
    """A complete statement: mapping, extra CTEs, and the body with result types pinned."""
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()] + [
        f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split()
    ]
    replace = f" REPLACE ({', '.join(casts)})" if casts else ""
    extra = f",\n{ctes}" if ctes else ""
    return f"{PRELUDE}{extra}\nSELECT *{replace} FROM (\n{body.strip()}\n) result"


def pct(num: str, den: str) -> str:
    """num / den in percent, one decimal, halves up; NULL on 0 (num >= 0)."""
    return f"(CASE WHEN ({den}) > 0 THEN ((2000 * ({num}) + ({den})) // (2 * ({den}))) / 10.0 END)"


def pct0(num: str, den: str) -> str:
    return f"coalesce({pct(num, den)}, 0)"
