"""Statements for the quality reports, change rules and change jobs."""

from __future__ import annotations

import re

from learnmart.oracle.base import statement
from learnmart.oracle.marts import COMPLETION, M1, M4, SCORE_INTS

CUT = "TIMESTAMP '2000-01-01'"
EVENT_CUT = "TIMESTAMP '2024-01-16'"
PERSON = """CASE WHEN o_custkey % 40 = 0 THEN 'T' || (o_custkey % 10) WHEN o_custkey % 41 = 0 THEN 'X' || o_custkey
            ELSE 'S' || o_custkey END"""
BY_PRIORITY = "'A' || (CAST(o_orderpriority[1] AS INTEGER) - 1)"
KIND = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yearly' WHEN o_orderpriority = '4-NOT SPECIFIED'
          THEN 'weekly' ELSE 'monthly' END"""
AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(10,2)) - 20000 AS DECIMAL(10,2))"
ISO = "'%Y-%m-%dT%H:%M:%S'"


def line_id(prefix: str) -> str:
    return (f"'{prefix}-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
            "strftime(l_shipdate, '%Y%m%d')")


BEFORE = f"""
enr_before AS (SELECT o_custkey * 100000000 + course_id AS id, 'S' || o_custkey AS student_id, course_id,
    min(o_orderdate) + INTERVAL 8200 DAY AS enrolled_at, bool_or(o_orderstatus <> 'F') AS is_active
  FROM placed WHERE o_orderdate < {CUT} GROUP BY o_custkey, course_id),
enr_after AS (SELECT o_custkey * 100000000 + course_id AS id, 'S' || o_custkey AS student_id, course_id,
    min(o_orderdate) + INTERVAL 8200 DAY AS enrolled_at, bool_or(o_orderstatus = 'O') AS is_active
  FROM placed GROUP BY o_custkey, course_id),
prog_before AS (SELECT user_id * 100000000 + lesson_id AS id, 'S' || user_id AS student_id, lesson_id,
    bool_or(event_type IN ('purchase', 'signup')) AS is_completed,
    min(ts) FILTER (WHERE event_type IN ('purchase', 'signup')) AS completed_at, max(ts) AS last_viewed_at
  FROM viewed WHERE ts < {EVENT_CUT} GROUP BY user_id, lesson_id),
sub_before AS (SELECT * FROM homework_submissions WHERE submitted_at < {CUT} + INTERVAL 8100 DAY),
hw_course AS (SELECT hw.id AS homework_id, hw.title, hw.check_type, hw.max_score, m.course_id, l.is_published
  FROM homeworks hw JOIN lessons l ON l.id = hw.lesson_id JOIN modules m ON m.id = l.module_id),
raw_sub AS (SELECT {line_id('R')} AS id, homework_id, 'S' || o_custkey AS student_id,
    CASE WHEN l_linenumber <> 3 THEN 'a' || l_orderkey END AS answer_text, CAST(NULL AS VARCHAR) AS answer_url,
    CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity AS INTEGER) - CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END END AS score,
    CASE l_returnflag WHEN 'N' THEN 'submitted' WHEN 'R' THEN 'checked' ELSE 'graded' END AS status,
    CASE WHEN l_partkey % 7 = 0 THEN 'X' || l_partkey ELSE 'T' || l_suppkey END AS checked_by, CAST(NULL AS TIMESTAMP) AS checked_at,
    l_shipdate + INTERVAL 8100 DAY AS submitted_at, check_type, max_score FROM hand_ins),
raw_prog AS (SELECT event_id AS id, 'S' || user_id AS student_id, CASE WHEN event_id % 21 = 20 THEN -1 ELSE lesson_id END AS lesson_id,
    CASE WHEN event_type <> 'error' THEN event_type IN ('purchase', 'signup') END AS is_completed, ts AS last_viewed_at
  FROM viewed),
raw_pay AS (SELECT o_orderkey AS id, 'S' || o_custkey AS student_id, CASE WHEN o_orderkey % 27 >= 25 THEN -1 ELSE course_id END AS course_id, {AMOUNT} AS amount,
    {KIND} AS subscription_type, CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) AS period_start,
    CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS period_end,
    'A' || (o_custkey % 6) AS created_by FROM placed),
raw_enr AS (SELECT o_orderkey AS id, {PERSON} AS student_id, CASE WHEN o_orderkey % 27 >= 25 THEN -1 ELSE course_id END AS course_id FROM placed),
raw_ct AS (SELECT s_suppkey // 2 * 4 % n AS course_id, 'T' || s_suppkey AS teacher_id FROM supplier, cat
  UNION ALL SELECT c_custkey // 8 % n, 'S' || c_custkey FROM customer, cat
  UNION ALL SELECT p_partkey // 10, 'T' || p_partkey FROM part)"""

ENROL = f"""{BEFORE},
cmds AS (SELECT 'E' || o_orderkey AS cmd_id, o_orderdate + INTERVAL 8200 DAY AS cmd_ts, {PERSON} AS student_id,
    CASE WHEN o_orderkey % 27 >= 25 THEN -1 ELSE course_id END AS course_id, {BY_PRIORITY} AS admin_id FROM placed WHERE o_orderdate >= {CUT}),
judged AS (SELECT x.*, c.title AS course_title, e.id AS enrollment_id, e.is_active AS was_active,
    CASE WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN u.id IS NULL OR NOT u.is_active THEN 'student_not_found_or_inactive'
         WHEN u.role <> 'student' THEN 'not_a_student' WHEN c.id IS NULL THEN 'course_not_found'
         WHEN NOT c.is_active THEN 'course_not_active' END AS reason
  FROM cmds x LEFT JOIN users u ON u.id = x.student_id LEFT JOIN courses c ON c.id = x.course_id
  LEFT JOIN enr_before e ON e.student_id = x.student_id AND e.course_id = x.course_id),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN coalesce(was_active, FALSE) OR rn > 1
       THEN 'already_enrolled' WHEN enrollment_id IS NOT NULL THEN 'reactivated' ELSE 'enrolled' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, course_id, reason IS NULL ORDER BY cmd_ts, cmd_id) AS rn
        FROM judged))"""

PAY = f"""{BEFORE},
cmds AS (SELECT 'P' || o_orderkey AS cmd_id, o_orderdate + INTERVAL 8200 DAY AS cmd_ts, 'S' || o_custkey AS student_id,
    course_id, 'A' || (o_custkey % 6) AS admin_id, {AMOUNT} AS amount, {KIND} AS subscription_type,
    CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) END AS period_start,
    o_orderstatus AS notes FROM placed WHERE o_orderdate >= {CUT}),
judged AS (SELECT x.*, c.title AS course_title,
    CASE x.subscription_type WHEN 'monthly' THEN c.price_monthly WHEN 'yearly' THEN c.price_yearly END AS expected_price,
    CASE WHEN x.subscription_type NOT IN ('monthly', 'yearly') THEN 'bad_subscription_type'
         WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN NOT EXISTS (SELECT 1 FROM enr_before e WHERE e.student_id = x.student_id AND e.course_id = x.course_id
                          AND e.is_active) THEN 'not_enrolled'
         WHEN c.id IS NULL THEN 'course_not_found' WHEN x.period_start IS NULL THEN 'missing_period_start'
         WHEN x.amount IS NULL OR x.amount <= 0 THEN 'amount_not_positive' END AS reason,
    CAST(x.period_start + CASE WHEN x.subscription_type = 'yearly' THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END
         - INTERVAL 1 DAY AS DATE) AS period_end
  FROM cmds x LEFT JOIN courses c ON c.id = x.course_id),
decided AS (SELECT *, CASE WHEN reason IS NULL THEN 'recorded' ELSE 'rejected' END AS outcome FROM judged)"""

UNIT = f"""{BEFORE},
cmds AS (SELECT 'U' || o_orderkey AS cmd_id, o_orderdate + INTERVAL 8200 DAY AS cmd_ts, {PERSON} AS student_id,
    CASE WHEN o_orderkey % 27 >= 25 THEN -1 ELSE course_id END AS course_id, {BY_PRIORITY} AS admin_id, {AMOUNT} AS amount, {KIND} AS subscription_type,
    CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) AS period_start FROM placed WHERE o_orderdate >= {CUT}),
judged AS (SELECT x.*, c.title AS course_title, e.id AS enrollment_id, e.is_active AS was_active,
    CASE WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN u.id IS NULL OR NOT u.is_active THEN 'student_not_found_or_inactive'
         WHEN u.role <> 'student' THEN 'not_a_student' WHEN c.id IS NULL THEN 'course_not_found'
         WHEN NOT c.is_active THEN 'course_not_active'
         WHEN x.subscription_type NOT IN ('monthly', 'yearly') THEN 'bad_subscription_type'
         WHEN x.amount <= 0 THEN 'amount_not_positive' END AS reason
  FROM cmds x LEFT JOIN users u ON u.id = x.student_id LEFT JOIN courses c ON c.id = x.course_id
  LEFT JOIN enr_before e ON e.student_id = x.student_id AND e.course_id = x.course_id),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN coalesce(was_active, FALSE) OR rn > 1
       THEN 'already_enrolled' WHEN enrollment_id IS NOT NULL THEN 'reactivated' ELSE 'enrolled' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, course_id, reason IS NULL ORDER BY cmd_ts, cmd_id) AS rn
        FROM judged))"""

# units handled one after the other: two customers' units touch no places of others, so each pair is a fold of its own
GROUP = f"""{BEFORE},
cmds AS (SELECT kind || '-' || o_orderkey AS cmd_id, o_orderdate + INTERVAL 8200 DAY AS cmd_ts, o_custkey // 2 AS pair,
    o_custkey // 2 || '-' || year(o_orderdate) || '-' || quarter(o_orderdate) AS unit_id, kind, {PERSON} AS student_id,
    (o_custkey // 8 + o_orderkey % 3) % n AS course_id, 'A' || (o_orderkey % 17 % 5) AS admin_id,
    CAST(CAST(o_totalprice AS DECIMAL(10,2)) - 5000 AS DECIMAL(10,2)) AS amount,
    CASE WHEN o_orderkey % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS subscription_type,
    CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) AS period_start, o_orderstatus AS notes
  FROM orders, cat, (VALUES ('enroll'), ('pay')) k(kind)
  WHERE o_orderdate >= {CUT} AND CASE kind WHEN 'enroll' THEN o_orderkey % 8 < 4 ELSE o_orderkey % 3 < 2 END),
judged AS (SELECT x.*, c.title AS course_title, e.id AS enrollment_id, coalesce(e.is_active, FALSE) AS was_active,
    x.student_id || '/' || x.course_id AS place, row_number() OVER (PARTITION BY unit_id ORDER BY cmd_ts, cmd_id) AS pos,
    CASE WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN kind = 'enroll' AND (u.id IS NULL OR NOT u.is_active) THEN 'student_not_found_or_inactive'
         WHEN kind = 'enroll' AND u.role <> 'student' THEN 'not_a_student' WHEN c.id IS NULL THEN 'course_not_found'
         WHEN kind = 'enroll' AND NOT c.is_active THEN 'course_not_active'
         WHEN kind = 'pay' AND x.amount <= 0 THEN 'amount_not_positive' END AS own_reason
  FROM cmds x LEFT JOIN users u ON u.id = x.student_id LEFT JOIN courses c ON c.id = x.course_id
  LEFT JOIN enr_before e ON e.student_id = x.student_id AND e.course_id = x.course_id),
leaning AS (SELECT j.*, kind = 'pay' AND NOT was_active AND own_reason IS NULL
      AND NOT EXISTS (SELECT 1 FROM judged o WHERE o.unit_id = j.unit_id AND o.place = j.place AND o.kind = 'enroll'
                      AND o.own_reason IS NULL AND o.pos < j.pos) AS leans FROM judged j),
turns AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY unit_ts, unit_id) AS n
  FROM (SELECT pair, unit_id, min(cmd_ts) AS unit_ts, bool_or(own_reason IS NOT NULL) AS bad,
          list(DISTINCT place) FILTER (WHERE leans) AS asks,
          list(DISTINCT place) FILTER (WHERE kind = 'enroll' AND NOT was_active) AS gives
        FROM leaning GROUP BY pair, unit_id)),
fold AS (SELECT DISTINCT pair, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS unit_id, FALSE AS stands, CAST([] AS VARCHAR[]) AS seen,
    CAST([] AS VARCHAR[]) AS held FROM turns
  UNION ALL
  SELECT pair, n, unit_id, stands, seen, CASE WHEN stands THEN list_concat(seen, coalesce(gives, [])) ELSE seen END
  FROM (SELECT f.pair, s.n, s.unit_id, f.held AS seen, s.gives, NOT s.bad AND list_has_all(f.held, coalesce(s.asks, [])) AS stands
        FROM fold f JOIN turns s ON s.pair = f.pair AND s.n = f.n + 1)),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN kind = 'pay' THEN 'recorded'
      WHEN was_active OR list_contains(seen, place) OR before > 0 THEN 'already_enrolled'
      WHEN enrollment_id IS NOT NULL THEN 'reactivated' ELSE 'enrolled' END AS outcome,
    CAST(period_start + CASE WHEN subscription_type = 'yearly' THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END - INTERVAL 1 DAY AS DATE) AS period_end
  FROM (SELECT l.*, f.seen, CASE WHEN own_reason IS NOT NULL THEN own_reason
           WHEN leans AND NOT list_contains(f.seen, place) THEN 'not_enrolled' WHEN NOT stands THEN 'unit_refused' END AS reason,
         count(*) FILTER (WHERE kind = 'enroll') OVER (PARTITION BY l.unit_id, place ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM leaning l JOIN fold f ON f.unit_id = l.unit_id))"""


def in_turn(body: str, **pinned: str) -> str:
    """A statement over the fold of units."""
    return statement(body, ctes=GROUP, **pinned).replace("WITH ", "WITH RECURSIVE ", 1)


GRADE_CMDS = f"""
cmds AS (SELECT {line_id('G')} AS cmd_id, l_shipdate + INTERVAL 8100 DAY AS cmd_ts,
    homework_id * 100000000 + o_custkey + CASE WHEN l_linenumber = 7 THEN 50000000 ELSE 0 END AS submission_id,
    'T' || l_suppkey AS teacher_id, CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS INTEGER) END AS score,
    l_returnflag AS comment FROM hand_ins WHERE l_returnflag <> 'A')"""

FIRST_CMDS = """
cmds AS (SELECT 'first-' || id AS cmd_id, (SELECT now FROM clock) AS cmd_ts, id AS submission_id,
    (SELECT min(teacher_id) FROM course_teachers ct WHERE ct.course_id = w.course_id) AS teacher_id, 17 AS score,
    CAST(NULL AS VARCHAR) AS comment
  FROM (SELECT hs.id, h.course_id, row_number() OVER (PARTITION BY hs.student_id ORDER BY hs.submitted_at, hs.id) AS rn
        FROM homework_submissions hs JOIN hw_course h ON h.homework_id = hs.homework_id
        WHERE hs.status = 'submitted' AND h.check_type = 'manual') w WHERE rn = 1)"""

GRADED = """
judged AS (SELECT x.*, s.homework_id, s.student_id, h.max_score, h.check_type,
    CASE WHEN s.id IS NULL THEN 'submission_not_found' WHEN h.check_type = 'auto' THEN 'auto_checked_homework'
         WHEN s.status <> 'submitted' THEN 'already_checked'
         WHEN NOT EXISTS (SELECT 1 FROM course_teachers ct WHERE ct.course_id = h.course_id AND ct.teacher_id = x.teacher_id)
           THEN 'not_course_teacher'
         WHEN x.score < 0 OR x.score > h.max_score THEN 'score_out_of_range' END AS own_reason
  FROM cmds x LEFT JOIN homework_submissions s ON s.id = x.submission_id LEFT JOIN hw_course h ON h.homework_id = s.homework_id),
ordered AS (SELECT *, count(*) FILTER (WHERE own_reason IS NULL) OVER (PARTITION BY submission_id ORDER BY cmd_ts, cmd_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS graded_before FROM judged),
decided AS (SELECT * EXCLUDE (own_reason), CASE WHEN graded_before > 0 THEN 'already_checked' ELSE own_reason END AS reason,
    CASE WHEN graded_before > 0 OR own_reason IS NOT NULL THEN 'rejected' ELSE 'graded' END AS outcome FROM ordered)"""

GRADE = f"{BEFORE},{GRADE_CMDS},{GRADED}"
FIRST = f"{BEFORE},{FIRST_CMDS},{GRADED}"

DEACTIVATE = f"""{BEFORE},
cmds AS (SELECT 'D' || o_orderkey AS cmd_id, o_orderdate + INTERVAL 8200 DAY AS cmd_ts, {PERSON} AS student_id,
    {BY_PRIORITY} AS admin_id, o_orderpriority AS note FROM orders WHERE o_orderdate >= {CUT} AND o_orderstatus = 'F'),
judged AS (SELECT x.*, u.is_active AS user_active, n.full_name,
    CASE WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN u.id IS NULL THEN 'user_not_found' WHEN u.role <> 'student' THEN 'not_a_student' END AS reason
  FROM cmds x LEFT JOIN users u ON u.id = x.student_id LEFT JOIN names n ON n.id = u.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY student_id, reason IS NULL ORDER BY cmd_ts, cmd_id) AS rn FROM judged),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN rn = 1 AND user_active THEN 'deactivated'
       ELSE 'already_inactive' END AS outcome,
    CASE WHEN reason IS NULL AND rn = 1 THEN (SELECT count(*) FROM enrollments e WHERE e.student_id = ordered.student_id AND e.is_active)
         ELSE 0 END AS courses_affected FROM ordered),
gone AS (SELECT student_id FROM decided WHERE reason IS NULL AND rn = 1)"""

COMPLETE = f"""{BEFORE},
cmds AS (SELECT 'C' || event_id AS cmd_id, ts AS cmd_ts, 'S' || user_id AS student_id, CASE WHEN event_id % 21 = 20 THEN -1 ELSE lesson_id END AS lesson_id
  FROM viewed WHERE event_type IN ('purchase', 'signup') AND ts >= {EVENT_CUT}),
judged AS (SELECT x.*, p.is_completed AS was_completed,
    CASE WHEN l.id IS NULL THEN 'lesson_not_found'
         WHEN NOT EXISTS (SELECT 1 FROM enr_before e WHERE e.student_id = x.student_id AND e.course_id = m.course_id
                          AND e.is_active) THEN 'not_enrolled' END AS reason
  FROM cmds x LEFT JOIN lessons l ON l.id = x.lesson_id LEFT JOIN modules m ON m.id = l.module_id
  LEFT JOIN prog_before p ON p.student_id = x.student_id AND p.lesson_id = x.lesson_id),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN coalesce(was_completed, FALSE) OR rn > 1
       THEN 'already_complete' WHEN was_completed IS NULL THEN 'inserted' ELSE 'completed' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, lesson_id, reason IS NULL ORDER BY cmd_ts, cmd_id) AS rn
        FROM judged))"""

SUBMIT = f"""{BEFORE},
cmds AS (SELECT {line_id('H')} AS cmd_id, l_shipdate + INTERVAL 8100 DAY AS cmd_ts, 'S' || o_custkey AS student_id,
    CASE WHEN l_partkey % 10 = 9 THEN -1 ELSE homework_id END AS homework_id, CASE WHEN l_returnflag <> 'R' THEN 'a' || l_orderkey END AS answer_text,
    CASE WHEN l_linenumber > 5 THEN 'http://x/' || l_orderkey END AS answer_url
  FROM handed WHERE l_shipdate >= {CUT}),
judged AS (SELECT x.*, h.check_type, h.max_score,
    CASE WHEN h.homework_id IS NULL THEN 'homework_not_found'
         WHEN NOT EXISTS (SELECT 1 FROM enr_before e WHERE e.student_id = x.student_id AND e.course_id = h.course_id
                          AND e.is_active) THEN 'not_enrolled'
         WHEN x.answer_text IS NULL AND x.answer_url IS NULL THEN 'no_answer'
         WHEN EXISTS (SELECT 1 FROM sub_before s WHERE s.homework_id = x.homework_id AND s.student_id = x.student_id)
           THEN 'already_submitted' END AS own_reason
  FROM cmds x LEFT JOIN hw_course h ON h.homework_id = x.homework_id),
decided AS (SELECT *, CASE WHEN own_reason IS NULL AND rn > 1 THEN 'already_submitted' ELSE own_reason END AS reason,
    CASE WHEN own_reason IS NULL AND rn = 1 THEN 'submitted' ELSE 'rejected' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, homework_id, own_reason IS NULL ORDER BY cmd_ts, cmd_id) AS rn
        FROM judged))"""

DECISIONS = "SELECT cmd_id, outcome, reason FROM decided"


def log(action: str, entity_type: str, user: str, entity: str, metadata: str, source: str, key: str) -> str:
    return f"""SELECT sha256('{action}~' || {key}) AS id, {user} AS user_id, '{action}' AS action, '{entity_type}' AS entity_type,
    CAST({entity} AS VARCHAR) AS entity_id, {metadata} AS metadata, TIMESTAMP '2024-01-31' AS created_at FROM {source}"""


def json_text(**fields: str) -> str:
    """A JSON object as SQL text; values are SQL expressions, '#'-prefixed ones are text and get quoted."""
    parts = []
    for key, value in fields.items():
        if value.startswith("#"):
            value = value[1:]
            text = f"'\"' || CAST({value} AS VARCHAR) || '\"'"
        else:
            text = f"CAST({value} AS VARCHAR)"
        parts.append(f"'\"{key}\":' || coalesce({text}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


ENROL_LOG = " UNION ALL ".join([
    log("enroll", "course", "student_id", "course_id",
        json_text(enrollment_id="#sha256(student_id || '~' || course_id)", enrolled_at="#'2024-01-31T00:00:00'"),
        "decided WHERE outcome = 'enrolled'", "sha256(student_id || '~' || course_id) || '~2024-01-31T00:00:00'"),
    log("admin_enroll", "enrollment", "admin_id", "course_id",
        json_text(student_id="#student_id", course_id="course_id", course_title="#course_title"),
        "decided WHERE outcome IN ('enrolled', 'reactivated')", "cmd_id"),
])

PAY_META = json_text(student_id="#student_id", course_id="course_id", course_title="#course_title", amount="amount",
                     subscription_type="#subscription_type", period_start="#period_start", period_end="#period_end")

NEW_SUBMISSION = """SELECT sha256(homework_id || '~' || student_id) AS id, homework_id, student_id, answer_text, answer_url,
    CASE WHEN check_type = 'auto' THEN max_score END AS score,
    CASE WHEN check_type = 'auto' THEN 'auto_checked' ELSE 'submitted' END AS status, CAST(NULL AS VARCHAR) AS checked_by,
    CASE WHEN check_type = 'auto' THEN TIMESTAMP '2024-01-31' END AS checked_at, TIMESTAMP '2024-01-31' AS submitted_at
FROM decided WHERE outcome = 'submitted'"""

ENROL_STATE = """
SELECT CAST(e.id AS VARCHAR) AS id, e.student_id, e.course_id,
       CASE WHEN d.cmd_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE e.enrolled_at END AS enrolled_at,
       e.is_active OR d.cmd_id IS NOT NULL AS is_active
FROM enr_before e LEFT JOIN decided d ON d.outcome = 'reactivated' AND d.student_id = e.student_id AND d.course_id = e.course_id
UNION ALL SELECT sha256(student_id || '~' || course_id), student_id, course_id, TIMESTAMP '2024-01-31', TRUE
FROM decided WHERE outcome = 'enrolled'"""

PAY_ROWS = """
SELECT sha256(cmd_id) AS id, student_id, course_id, amount, subscription_type, DATE '2024-01-31' AS payment_date, period_start,
       period_end, notes, admin_id AS created_by, TIMESTAMP '2024-01-31' AS created_at FROM decided WHERE outcome = 'recorded'"""

JOBS = {
    "apply_enrollments": statement(DECISIONS, ctes=ENROL),
    "apply_enrollments_state": statement(
        ENROL_STATE,
        ints="course_id",
        ctes=ENROL,
    ),
    "apply_enrollments_log": statement(ENROL_LOG, ctes=ENROL),
    "apply_units": in_turn(DECISIONS),
    "apply_units_state": in_turn(ENROL_STATE, ints="course_id"),
    "apply_units_payments": in_turn(PAY_ROWS, ints="course_id", doubles="amount"),
    "apply_units_log": in_turn(
        ENROL_LOG + " UNION ALL "
        + log("record_payment", "payment", "admin_id", "sha256(cmd_id)", PAY_META, "decided WHERE outcome = 'recorded'", "cmd_id")),
    "apply_payments": statement(DECISIONS, ctes=PAY),
    "apply_payments_rows": statement(
        PAY_ROWS,
        ints="course_id",
        doubles="amount",
        ctes=PAY,
    ),
    "apply_payments_log": statement(
        log("record_payment", "payment", "admin_id", "sha256(cmd_id)", PAY_META, "decided WHERE outcome = 'recorded'", "cmd_id"),
        ctes=PAY,
    ),
    "payment_warnings": statement(
        "SELECT cmd_id, amount, expected_price FROM decided WHERE outcome = 'recorded' AND amount <> expected_price",
        doubles="amount expected_price",
        ctes=PAY,
    ),
    "apply_grades": statement(DECISIONS, ctes=GRADE),
    "apply_grades_state": statement(
        """
SELECT s.id, s.homework_id, s.student_id, CASE WHEN d.cmd_id IS NOT NULL THEN d.score ELSE s.score END AS score,
       CASE WHEN d.cmd_id IS NOT NULL THEN 'checked' ELSE s.status END AS status,
       CASE WHEN d.cmd_id IS NOT NULL THEN d.teacher_id ELSE s.checked_by END AS checked_by,
       CASE WHEN d.cmd_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE s.checked_at END AS checked_at
FROM homework_submissions s LEFT JOIN decided d ON d.outcome = 'graded' AND d.submission_id = s.id""",
        ints="id homework_id score",
        ctes=GRADE,
    ),
    "apply_grades_log": statement(
        log("check_homework", "homework_submission", "teacher_id", "submission_id",
            json_text(homework_id="homework_id", student_id="#student_id", score="score", max_score="max_score",
                      comment="#comment"),
            "decided WHERE outcome = 'graded'", "submission_id"),
        ctes=GRADE,
    ),
    "grade_first_pending": statement(
        "SELECT cmd_id, submission_id, teacher_id, score, outcome, reason FROM decided", ints="submission_id score", ctes=FIRST
    ),
    "apply_deactivations": statement(
        "SELECT cmd_id, outcome, reason, courses_affected FROM decided", ints="courses_affected", ctes=DEACTIVATE
    ),
    "apply_deactivations_users": statement(
        """
SELECT u.id, u.is_active AND g.student_id IS NULL AS is_active,
       CASE WHEN u.is_active AND g.student_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE u.created_at END AS updated_at
FROM users u LEFT JOIN gone g ON g.student_id = u.id""",
        ctes=DEACTIVATE,
    ),
    "apply_deactivations_enrollments": statement(
        """
SELECT e.id, e.student_id, e.course_id, e.is_active AND g.student_id IS NULL AS is_active
FROM enrollments e LEFT JOIN gone g ON g.student_id = e.student_id""",
        ints="id course_id",
        ctes=DEACTIVATE,
    ),
    "apply_deactivations_log": statement(
        log("unenroll", "course", "e.student_id", "e.course_id", json_text(enrollment_id="#e.id", reason="#'deactivated'"),
            "enrollments e JOIN gone g ON g.student_id = e.student_id WHERE e.is_active", "e.id || '~2024-01-31T00:00:00'")
        + " UNION ALL "
        + log("deactivate_student", "user", "admin_id", "student_id",
              json_text(student_name="#full_name", reason="#note", courses_affected="courses_affected"),
              "decided WHERE reason IS NULL", "cmd_id"),
        ctes=DEACTIVATE,
    ),
    "complete_lessons": statement(DECISIONS, ctes=COMPLETE),
    "complete_lessons_state": statement(
        """
SELECT CAST(p.id AS VARCHAR) AS id, p.student_id, p.lesson_id, p.is_completed OR d.cmd_id IS NOT NULL AS is_completed,
       CASE WHEN d.cmd_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE p.completed_at END AS completed_at,
       CASE WHEN d.cmd_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE p.last_viewed_at END AS last_viewed_at
FROM prog_before p LEFT JOIN decided d ON d.outcome = 'completed' AND d.student_id = p.student_id AND d.lesson_id = p.lesson_id
UNION ALL SELECT sha256(student_id || '~' || lesson_id), student_id, lesson_id, TRUE, NULL, TIMESTAMP '2024-01-31'
FROM decided WHERE outcome = 'inserted'""",
        ints="lesson_id",
        ctes=COMPLETE,
    ),
    "complete_lessons_log": statement(
        log("view_lesson", "lesson", "student_id", "lesson_id", "'{\"first_view\":true}'",
            "decided WHERE outcome = 'inserted'", "student_id || '~' || lesson_id")
        + " UNION ALL "
        + log("complete_lesson", "lesson", "student_id", "lesson_id", "'{\"completed_at\":\"2024-01-31T00:00:00\"}'",
              "decided WHERE outcome = 'completed'", "student_id || '~' || lesson_id || '~2024-01-31T00:00:00'"),
        ctes=COMPLETE,
    ),
    "submit_homeworks": statement(DECISIONS, ctes=SUBMIT),
    "submit_homeworks_rows": statement(NEW_SUBMISSION, ints="homework_id score", ctes=SUBMIT),
    "enroll_and_pay": statement(DECISIONS, ctes=UNIT),
    "enroll_and_pay_log": statement(
        ENROL_LOG + " UNION ALL "
        + log("record_payment", "payment", "admin_id", "sha256(cmd_id)", PAY_META,
              """(SELECT *, CAST(period_start + CASE WHEN subscription_type = 'yearly' THEN INTERVAL 1 YEAR
                  ELSE INTERVAL 1 MONTH END - INTERVAL 1 DAY AS DATE) AS period_end FROM decided) WHERE outcome <> 'rejected'""",
              "cmd_id"),
        ctes=UNIT,
    ),
}

RULES = {
    "validate_scores": statement(
        """
SELECT * FROM (SELECT id, homework_id, score, status, CASE WHEN score > max_score THEN 'score_above_max'
    WHEN score IS NOT NULL AND status = 'submitted' THEN 'score_while_submitted' END AS reject_reason FROM raw_sub)
WHERE reject_reason IS NOT NULL""",
        ints="homework_id score",
        ctes=BEFORE,
    ),
    "auto_check": statement(
        """
SELECT id, homework_id, CASE WHEN check_type = 'auto' THEN max_score ELSE score END AS score,
       CASE WHEN check_type = 'auto' THEN 'auto_checked' ELSE status END AS status,
       CASE WHEN check_type = 'auto' THEN TIMESTAMP '2024-01-31' END AS checked_at FROM raw_sub""",
        ints="homework_id score",
        ctes=BEFORE,
    ),
    "touch_updated_at": statement(
        """
SELECT id, CASE WHEN id IN (SELECT student_id FROM prog_before) THEN TIMESTAMP '2024-01-31' ELSE created_at END AS updated_at
FROM users""",
        ctes=BEFORE,
    ),
    "log_enrollment": statement(
        f"""
SELECT sha256('enroll~' || n.id || '~' || strftime(n.enrolled_at, {ISO})) AS id, n.student_id AS user_id, 'enroll' AS action,
       'course' AS entity_type, CAST(n.course_id AS VARCHAR) AS entity_id,
       {json_text(enrollment_id='#n.id', enrolled_at=f'#strftime(n.enrolled_at, {ISO})')} AS metadata,
       TIMESTAMP '2024-01-31' AS created_at
FROM enr_after n WHERE NOT EXISTS (SELECT 1 FROM enr_before o WHERE o.id = n.id)
UNION ALL
{log('unenroll', 'course', 'n.student_id', 'n.course_id', json_text(enrollment_id='#n.id', reason="#'deactivated'"),
     'enr_after n JOIN enr_before o ON o.id = n.id WHERE o.is_active AND NOT n.is_active', "n.id || '~2024-01-31T00:00:00'")}""",
        ctes=BEFORE,
    ),
    "log_progress": statement(
        log("view_lesson", "lesson", "n.student_id", "n.lesson_id", "'{\"first_view\":true}'",
            "lesson_progress n WHERE NOT EXISTS (SELECT 1 FROM prog_before o WHERE o.id = n.id)",
            "n.student_id || '~' || n.lesson_id")
        + " UNION ALL "
        + log("complete_lesson", "lesson", "n.student_id", "n.lesson_id",
              json_text(completed_at=f"#strftime(n.completed_at, {ISO})"),
              "lesson_progress n JOIN prog_before o ON o.id = n.id WHERE NOT o.is_completed AND n.is_completed",
              f"n.student_id || '~' || n.lesson_id || '~' || strftime(n.completed_at, {ISO})"),
        ctes=BEFORE,
    ),
    "check_teacher_role": statement(
        """
SELECT r.course_id, r.teacher_id, CASE WHEN u.id IS NULL THEN 'user_not_found' ELSE 'not_a_teacher' END AS reject_reason
FROM raw_ct r LEFT JOIN users u ON u.id = r.teacher_id WHERE u.id IS NULL OR u.role <> 'teacher'""",
        ints="course_id",
        ctes=BEFORE,
    ),
    "check_student_role": statement(
        """
SELECT r.id, r.student_id, CASE WHEN u.id IS NULL THEN 'user_not_found' ELSE 'not_a_student' END AS reject_reason
FROM raw_enr r LEFT JOIN users u ON u.id = r.student_id WHERE u.id IS NULL OR u.role <> 'student'""",
        ctes=BEFORE,
    ),
    "set_completed_at": statement(
        """
SELECT n.id, n.student_id, n.lesson_id, n.is_completed,
       CASE WHEN n.is_completed AND NOT o.is_completed THEN TIMESTAMP '2024-01-31'
            WHEN NOT n.is_completed AND o.is_completed THEN NULL ELSE n.completed_at END AS completed_at,
       CASE WHEN n.is_completed AND NOT o.is_completed THEN TIMESTAMP '2024-01-31' ELSE n.last_viewed_at END AS last_viewed_at
FROM lesson_progress n LEFT JOIN prog_before o ON o.id = n.id""",
        ints="id lesson_id",
        ctes=BEFORE,
    ),
    "queue_refresh": statement(
        """
SELECT sha256(v || '~' || cmd_id) AS id, v AS view_name, TIMESTAMP '2024-01-31' AS triggered_at, FALSE AS processed
FROM decided, (VALUES ('mv_admin_dashboard'), ('mv_student_scores'), ('mv_course_completion'), ('mv_teacher_workload')) q(v)
WHERE outcome IN ('enrolled', 'reactivated')""",
        ctes=ENROL,
    ),
}

PURGE = """
judged_courses AS (SELECT id, CASE WHEN id IN (SELECT course_id FROM enrollments) THEN 'enrollments.course_id'
    WHEN id IN (SELECT course_id FROM payments) THEN 'payments.course_id' END AS reason FROM courses WHERE NOT is_active),
gone_c AS (SELECT id FROM judged_courses WHERE reason IS NULL),
kept_m AS (SELECT * FROM modules WHERE course_id NOT IN (SELECT id FROM gone_c)),
kept_l AS (SELECT * FROM lessons WHERE module_id IN (SELECT id FROM kept_m)),
kept_h AS (SELECT * FROM homeworks WHERE lesson_id IN (SELECT id FROM kept_l)),
paid AS (SELECT student_id AS id FROM payments UNION SELECT created_by FROM payments),
grades AS (SELECT checked_by, student_id FROM homework_submissions
    WHERE checked_by <> student_id AND homework_id IN (SELECT id FROM kept_h)),
leaving AS (SELECT id FROM users WHERE NOT is_active AND id NOT IN (SELECT id FROM paid) AND id NOT IN (SELECT checked_by FROM grades)),
judged_users AS (SELECT id, CASE WHEN id IN (SELECT student_id FROM payments) THEN 'payments.student_id'
    WHEN id IN (SELECT created_by FROM payments) THEN 'payments.created_by'
    WHEN id IN (SELECT checked_by FROM grades WHERE student_id NOT IN (SELECT id FROM leaving))
      THEN 'homework_submissions.checked_by' END AS reason FROM users WHERE NOT is_active),
gone_u AS (SELECT id FROM judged_users WHERE reason IS NULL)"""


def counted(name: str, where: str, source: str | None = None) -> str:
    return f"SELECT 'kept' AS kind, '{name}' AS name, count(*) AS rows FROM {source or name} WHERE {where}"


QUALITY = {
    "unique_violations": statement(
        """
SELECT 'homework_submissions' AS table_name, 'homework_id,student_id' AS rule, homework_id || '~' || student_id AS key_value,
       count(*) AS rows_count FROM raw_sub GROUP BY homework_id, student_id HAVING count(*) > 1
UNION ALL SELECT 'homework_submissions', 'id', id, count(*) FROM raw_sub GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'lesson_progress', 'id', CAST(id AS VARCHAR), count(*) FROM raw_prog GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'enrollments', 'id', CAST(id AS VARCHAR), count(*) FROM raw_enr GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'payments', 'id', CAST(id AS VARCHAR), count(*) FROM raw_pay GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'activity_log', 'id', CAST(id AS VARCHAR), count(*) FROM activity_log GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'users', 'id', id, count(*) FROM users GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'users', 'email', email, count(*) FROM users GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'course_teachers', 'course_id,teacher_id', course_id || '~' || teacher_id, count(*) FROM course_teachers
GROUP BY course_id, teacher_id HAVING count(*) > 1
UNION ALL SELECT 'lesson_progress', 'student_id,lesson_id', student_id || '~' || lesson_id, count(*) FROM raw_prog
GROUP BY student_id, lesson_id HAVING count(*) > 1
UNION ALL SELECT 'enrollments', 'student_id,course_id', student_id || '~' || course_id, count(*) FROM raw_enr
GROUP BY student_id, course_id HAVING count(*) > 1""",
        ctes=BEFORE,
    ),
    "orphan_rows": statement(
        " UNION ALL ".join(
            f"""SELECT '{table}' AS table_name, '{column}->{parent}' AS rule, CAST(x.{column} AS VARCHAR) AS key_value,
       count(*) AS rows_count FROM {source} x WHERE x.{column} IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = x.{column}) GROUP BY x.{column}"""
            for table, source, column, parent in (
                ("courses", "courses", "topic_id", "topics"),
                ("course_teachers", "course_teachers", "course_id", "courses"),
                ("course_teachers", "course_teachers", "teacher_id", "users"),
                ("modules", "modules", "course_id", "courses"),
                ("lessons", "lessons", "module_id", "modules"),
                ("homeworks", "homeworks", "lesson_id", "lessons"),
                ("homework_submissions", "raw_sub", "homework_id", "homeworks"),
                ("homework_submissions", "raw_sub", "student_id", "users"),
                ("homework_submissions", "raw_sub", "checked_by", "users"),
                ("enrollments", "raw_enr", "student_id", "users"),
                ("enrollments", "raw_enr", "course_id", "courses"),
                ("lesson_progress", "raw_prog", "student_id", "users"),
                ("lesson_progress", "raw_prog", "lesson_id", "lessons"),
                ("activity_log", "activity_log", "user_id", "users"),
                ("payments", "raw_pay", "student_id", "users"),
                ("payments", "raw_pay", "course_id", "courses"),
                ("payments", "raw_pay", "created_by", "users"),
            )
        ),
        ctes=BEFORE,
    ),
    "check_violations": statement(
        """
SELECT 'homework_submissions' AS table_name, 'score_not_negative' AS rule, id AS key_value FROM raw_sub WHERE score < 0
UNION ALL SELECT 'homework_submissions', 'answer_provided', id FROM raw_sub WHERE answer_text IS NULL AND answer_url IS NULL
UNION ALL SELECT 'payments', 'amount_positive', CAST(id AS VARCHAR) FROM raw_pay WHERE amount <= 0
UNION ALL SELECT 'payments', 'period_order', CAST(id AS VARCHAR) FROM raw_pay WHERE period_end <= period_start
UNION ALL SELECT 'lessons', 'duration_positive', CAST(id AS VARCHAR) FROM lessons WHERE duration_minutes <= 0
UNION ALL SELECT 'lessons', 'webinar_fields', CAST(id AS VARCHAR) FROM lessons
WHERE lesson_type = 'webinar' AND (webinar_url IS NULL OR webinar_scheduled_at IS NULL)
UNION ALL SELECT 'lessons', 'video_fields', CAST(id AS VARCHAR) FROM lessons WHERE lesson_type = 'video' AND video_url IS NULL""",
        ctes=BEFORE,
    ),
    "domain_violations": statement(
        """
SELECT 'homework_submissions' AS table_name, 'status in submission_status' AS rule, id AS key_value FROM raw_sub
WHERE status NOT IN ('submitted', 'checked', 'auto_checked')
UNION ALL SELECT 'lesson_progress', 'is_completed required', CAST(id AS VARCHAR) FROM raw_prog WHERE is_completed IS NULL
UNION ALL SELECT 'payments', 'subscription_type in subscription_type', CAST(id AS VARCHAR) FROM raw_pay
WHERE subscription_type NOT IN ('monthly', 'yearly')
UNION ALL SELECT 'users', 'email length', id FROM users WHERE length(email) > 255""",
        ctes=BEFORE,
    ),
    "cascade_purge": statement(
        " UNION ALL ".join([
            counted("users", "id NOT IN (SELECT id FROM gone_u)"),
            counted("courses", "id NOT IN (SELECT id FROM gone_c)"),
            counted("course_teachers", "teacher_id NOT IN (SELECT id FROM gone_u) AND course_id NOT IN (SELECT id FROM gone_c)"),
            counted("modules", "TRUE", "kept_m"),
            counted("lessons", "TRUE", "kept_l"),
            counted("homeworks", "TRUE", "kept_h"),
            counted("homework_submissions",
                    "student_id NOT IN (SELECT id FROM gone_u) AND homework_id IN (SELECT id FROM kept_h)"),
            counted("enrollments", "student_id NOT IN (SELECT id FROM gone_u)"),
            counted("lesson_progress", "student_id NOT IN (SELECT id FROM gone_u) AND lesson_id IN (SELECT id FROM kept_l)"),
            counted("activity_log", "user_id NOT IN (SELECT id FROM gone_u)"),
            "SELECT 'rejected users', reason, count(*) FROM judged_users WHERE reason IS NOT NULL GROUP BY reason",
            "SELECT 'rejected courses', reason, count(*) FROM judged_courses WHERE reason IS NOT NULL GROUP BY reason",
        ]),
        ctes=PURGE,
    ),
}

PURGE_SIX = """
judged_courses AS (SELECT id, CASE WHEN id IN (SELECT course_id FROM enrollments) THEN 'enrollments.course_id'
    WHEN id IN (SELECT course_id FROM payments) THEN 'payments.course_id' END AS reason FROM courses WHERE NOT is_active),
kept_c AS (SELECT id FROM courses EXCEPT SELECT id FROM judged_courses WHERE reason IS NULL),
kept_m AS (SELECT id FROM modules WHERE id % 7 <> 0 AND course_id IN (FROM kept_c)),
kept_l AS (SELECT id FROM lessons WHERE id % 11 <> 0 AND module_id IN (FROM kept_m)),
kept_h AS (SELECT id FROM homeworks WHERE id % 13 <> 0 AND lesson_id IN (FROM kept_l)),
grades AS (SELECT checked_by, student_id FROM homework_submissions WHERE homework_id IN (FROM kept_h)),
leaving AS (SELECT id FROM users WHERE NOT is_active
    AND id NOT IN (SELECT student_id FROM payments UNION SELECT created_by FROM payments UNION SELECT checked_by FROM grades WHERE checked_by IS NOT NULL)),
judged_users AS (SELECT id, CASE WHEN id IN (SELECT student_id FROM payments) THEN 'payments.student_id'
    WHEN id IN (SELECT created_by FROM payments) THEN 'payments.created_by'
    WHEN id IN (SELECT checked_by FROM grades WHERE student_id NOT IN (FROM leaving)) THEN 'homework_submissions.checked_by' END AS reason
  FROM users WHERE NOT is_active),
kept_u AS (SELECT id FROM users EXCEPT SELECT id FROM judged_users WHERE reason IS NULL)"""

QUALITY["cascade_purge_refused"] = statement(
    """
SELECT 'courses' AS kind, CAST(id AS VARCHAR) AS id, reason FROM judged_courses WHERE reason IS NOT NULL
UNION ALL SELECT 'users', id, reason FROM judged_users WHERE reason IS NOT NULL
UNION ALL SELECT 'topics', CAST(id AS VARCHAR), 'courses.topic_id' FROM topics WHERE id = 1 AND id IN (SELECT topic_id FROM courses)""",
    ctes=PURGE_SIX,
)
QUALITY["cascade_purge_rows"] = statement(
    " UNION ALL ".join(f"SELECT '{table}' AS table_name, CAST(id AS VARCHAR) AS id FROM {table} WHERE {where}" for table, where in (
        ("users", "id IN (FROM kept_u)"), ("topics", "id <> 1 OR id IN (SELECT topic_id FROM courses)"), ("courses", "id IN (FROM kept_c)"),
        ("modules", "id IN (FROM kept_m)"), ("lessons", "id IN (FROM kept_l)"), ("homeworks", "id IN (FROM kept_h)"),
        ("homework_submissions", "homework_id IN (FROM kept_h) AND student_id IN (FROM kept_u)"), ("enrollments", "student_id IN (FROM kept_u)"),
        ("lesson_progress", "lesson_id IN (FROM kept_l) AND student_id IN (FROM kept_u)"), ("activity_log", "user_id IN (FROM kept_u)"))),
    ctes=PURGE_SIX,
)

# why a table refuses a hand-in, before keys: from the table definition and the score rules
REFUSED = """CASE WHEN status NOT IN ('submitted', 'checked', 'auto_checked') THEN 'status_not_allowed'
    WHEN score > max_score THEN 'score_above_max' WHEN score IS NOT NULL AND status = 'submitted' THEN 'score_while_submitted'
    WHEN score < 0 THEN 'score_not_negative' WHEN answer_text IS NULL AND answer_url IS NULL THEN 'answer_provided'
    WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.student_id) THEN 'student_id_unknown'
    WHEN checked_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.checked_by) THEN 'checked_by_unknown' END"""

LOADED_SUB = f"""
open_sub AS (SELECT *, {REFUSED} AS refused FROM raw_sub r),
loaded_sub AS (SELECT *, coalesce(refused, CASE WHEN same_id > 1 THEN 'id_taken' WHEN nth > 1 THEN 'homework_id_student_id_taken' END, 'stored') AS verdict
  FROM (SELECT *, row_number() OVER (PARTITION BY id, refused IS NULL) AS same_id,
               row_number() OVER (PARTITION BY homework_id, student_id, refused IS NULL ORDER BY submitted_at, id) AS nth FROM open_sub))"""

REFRESH = {
    "load_seed_submissions": statement(
        """
SELECT id, homework_id, student_id, CASE WHEN check_type = 'auto' THEN max_score ELSE score END AS score,
       CASE WHEN check_type = 'auto' THEN 'auto_checked' ELSE status END AS status, checked_by, submitted_at
FROM loaded_sub WHERE verdict = 'stored'""",
        ints="homework_id score",
        ctes=f"{BEFORE},{LOADED_SUB}",
    ),
    "refresh_marts": statement(
        """
SELECT 'mv_admin_dashboard' AS mart, count(*) AS rows, sum(total_submissions) AS total FROM m1
UNION ALL SELECT 'mv_student_scores', count(*), sum(rank_in_course) FROM scores
UNION ALL SELECT 'mv_course_completion', count(*), sum(completed_lessons) FROM completion
UNION ALL SELECT 'mv_teacher_workload', count(*), sum(total_students) FROM m4""",
        ints="total",
        ctes=f"{M1},{COMPLETION},{M4}",
    ),
    "load_seed": statement(
        """
SELECT 'course_teachers' AS table_name, CASE WHEN why IS NOT NULL THEN why WHEN nth > 1 THEN 'course_id_teacher_id_taken' ELSE 'stored' END AS reason,
  count(*) AS rows
FROM (SELECT *, row_number() OVER (PARTITION BY course_id, teacher_id, why IS NULL) AS nth
      FROM (SELECT r.*, CASE WHEN u.id IS NULL THEN 'user_not_found' WHEN u.role <> 'teacher' THEN 'not_a_teacher' END AS why
            FROM raw_ct r LEFT JOIN users u ON u.id = r.teacher_id)) GROUP BY 2
UNION ALL SELECT 'enrollments', reason, count(*) FROM decided WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'enrollments', 'stored', (SELECT count(*) FROM enr_before) + (SELECT count(*) FROM decided WHERE outcome = 'enrolled')
UNION ALL SELECT 'payments', reason, count(*) FROM pay_decided WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'payments', 'stored', (SELECT count(*) FROM payments) + (SELECT count(*) FROM pay_decided WHERE reason IS NULL)
UNION ALL SELECT 'lesson_progress', 'stored', count(*) FROM lesson_progress
UNION ALL SELECT 'homework_submissions', verdict, count(*) FROM loaded_sub GROUP BY 2
UNION ALL SELECT 'activity_log', 'stored', (SELECT count(*) FROM activity_log)
  + (SELECT count(*) FROM decided WHERE outcome IN ('enrolled', 'reactivated'))
  + (SELECT count(*) FROM decided WHERE outcome = 'enrolled') + (SELECT count(*) FROM pay_decided WHERE reason IS NULL)
  + (SELECT count(*) FROM lesson_progress)
UNION ALL SELECT 'mv_refresh_queue', 'stored', 4 * count(*) FROM decided WHERE outcome IN ('enrolled', 'reactivated')""",
        ints="rows",
        ctes=ENROL + f""",{LOADED_SUB},
pay_cmds AS (SELECT 'S' || o_custkey AS student_id, course_id, 'A' || (o_custkey % 6) AS admin_id,
    {AMOUNT} AS amount, {KIND} AS subscription_type,
    CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderdate + INTERVAL 8200 DAY AS DATE) END AS period_start
  FROM placed WHERE o_orderdate >= {CUT}),
pay_decided AS (SELECT CASE WHEN x.subscription_type NOT IN ('monthly', 'yearly') THEN 'bad_subscription_type'
         WHEN NOT EXISTS (SELECT 1 FROM users a WHERE a.id = x.admin_id AND a.role = 'admin' AND a.is_active)
           THEN 'admin_not_active'
         WHEN NOT EXISTS (SELECT 1 FROM enr_before e WHERE e.student_id = x.student_id AND e.course_id = x.course_id
                          AND e.is_active)
          AND NOT EXISTS (SELECT 1 FROM decided d WHERE d.student_id = x.student_id AND d.course_id = x.course_id
                          AND d.outcome IN ('enrolled', 'reactivated')) THEN 'not_enrolled'
         WHEN x.period_start IS NULL THEN 'missing_period_start'
         WHEN x.amount IS NULL OR x.amount <= 0 THEN 'amount_not_positive' END AS reason FROM pay_cmds x)""",
    ),
}

STREAM_SUB = f"""{BEFORE},
judged AS (SELECT r.*, {REFUSED} AS own_reason FROM raw_sub r),
decided AS (SELECT *, coalesce(own_reason, CASE WHEN rn > 1 OR EXISTS (SELECT 1 FROM sub_before s
       WHERE s.homework_id = o.homework_id AND s.student_id = o.student_id) THEN 'duplicate' END, 'accepted') AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY homework_id, student_id, own_reason IS NULL ORDER BY submitted_at, id) AS rn
        FROM judged) o)"""

STREAM_PROG = f"""{BEFORE},
incoming AS (SELECT 'S' || user_id AS student_id, lesson_id, arg_min(event_type IN ('purchase', 'signup'), (ts, event_id)) AS first_done,
    bool_or(event_type IN ('purchase', 'signup')) AS any_done, max(ts) AS last
  FROM viewed WHERE ts >= {EVENT_CUT} GROUP BY 1, 2),
changed AS (SELECT i.student_id, i.lesson_id, o.id IS NULL AS inserted, coalesce(o.is_completed, i.first_done) OR i.any_done AS is_completed,
    NOT coalesce(o.is_completed, i.first_done) AND i.any_done AS completed, o.completed_at AS old_completed_at,
    greatest(i.last, o.last_viewed_at) AS viewed_at
  FROM incoming i LEFT JOIN prog_before o ON o.student_id = i.student_id AND o.lesson_id = i.lesson_id)"""

STREAMS = {
    "stream_submissions": statement(
        "SELECT id, homework_id, student_id, outcome FROM decided", ints="homework_id", ctes=STREAM_SUB
    ),
    "stream_submissions_accepted": statement(
        """
SELECT id, homework_id, student_id, CASE WHEN check_type = 'auto' THEN max_score ELSE score END AS score,
       CASE WHEN check_type = 'auto' THEN 'auto_checked' ELSE status END AS status,
       CASE WHEN check_type = 'auto' THEN TIMESTAMP '2024-01-31' END AS checked_at FROM decided WHERE outcome = 'accepted'""",
        ints="homework_id score",
        ctes=STREAM_SUB,
    ),
    "stream_progress": statement(
        """
SELECT student_id, lesson_id, is_completed, CASE WHEN completed THEN TIMESTAMP '2024-01-31' ELSE old_completed_at END AS completed_at,
       CASE WHEN completed THEN TIMESTAMP '2024-01-31' ELSE viewed_at END AS last_viewed_at FROM changed""",
        ints="lesson_id",
        ctes=STREAM_PROG,
    ),
    "stream_progress_log": statement(
        """
SELECT student_id AS user_id, 'view_lesson' AS action, CAST(lesson_id AS VARCHAR) AS entity_id, '{"first_view":true}' AS metadata
FROM changed WHERE inserted
UNION ALL SELECT student_id, 'complete_lesson', CAST(lesson_id AS VARCHAR), '{"completed_at":"2024-01-31T00:00:00"}'
FROM changed WHERE completed""",
        ctes=STREAM_PROG,
    ),
    "stream_enrollments": statement(DECISIONS, ctes=ENROL),
    "stream_last_activity": statement(
        """
SELECT user_id, count(*) AS actions, count(*) FILTER (WHERE action = 'view_lesson') AS lessons_viewed,
       count(*) FILTER (WHERE action = 'complete_lesson') AS lessons_completed,
       count(*) FILTER (WHERE action = 'submit_hw') AS homeworks_sent, max(created_at) AS last_activity_at
FROM activity_log GROUP BY user_id"""
    ),
}



def _own(ctes: str) -> str:
    """The parts of a job's CTEs that are its own."""
    return ctes.removeprefix(f"{BEFORE},")


# the tables after three batches that were all decided on the earlier state
AFTER = f"""{BEFORE},
enr_now AS (WITH {_own(ENROL)}
  SELECT e.student_id, e.course_id, CASE WHEN d.cmd_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE e.enrolled_at END AS enrolled_at,
         e.is_active OR d.cmd_id IS NOT NULL AS is_active
  FROM enr_before e LEFT JOIN decided d ON d.outcome = 'reactivated' AND d.student_id = e.student_id AND d.course_id = e.course_id
  UNION ALL SELECT student_id, course_id, TIMESTAMP '2024-01-31', TRUE FROM decided WHERE outcome = 'enrolled'),
prog_now AS (WITH {_own(COMPLETE)}
  SELECT p.student_id, p.lesson_id, p.is_completed OR d.cmd_id IS NOT NULL AS is_completed
  FROM prog_before p LEFT JOIN decided d ON d.outcome = 'completed' AND d.student_id = p.student_id AND d.lesson_id = p.lesson_id
  UNION ALL SELECT student_id, lesson_id, TRUE FROM decided WHERE outcome = 'inserted'),
sub_now AS (WITH {_own(SUBMIT)}
  SELECT homework_id, student_id, score, status, checked_by FROM sub_before
  UNION ALL SELECT homework_id, student_id, score, status, checked_by FROM ({NEW_SUBMISSION}))"""


def _now(sql: str) -> str:
    for table, now in (("enrollments", "enr_now"), ("lesson_progress", "prog_now"), ("homework_submissions", "sub_now")):
        sql = re.sub(rf"\b{table}\b", now, sql)
    return sql


# events of the log are views and the like, and those of the changes (at the clock's time)
FOLLOWED = {
    "follow_student_scores": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM scores", ints="course_id " + SCORE_INTS, doubles="score_pct",
        ctes=f"{AFTER},{_now(COMPLETION)}"),
    "follow_course_completion": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM completion", ints="course_id total_lessons completed_lessons",
        doubles="completion_pct avg_completion_pct_in_course", ctes=f"{AFTER},{_now(COMPLETION)}"),
    "follow_teacher_workload": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM m4", ints="courses_count total_students pending_checks total_checked",
        ctes=f"{AFTER},{_now(M4)}"),
    "follow_admin_dashboard": statement(
        "SELECT * FROM m1", ints="id", doubles="revenue_current_month revenue_current_year revenue_total",
        ctes=f"""{AFTER},
log_now AS (SELECT user_id, created_at FROM activity_log
  UNION ALL SELECT user_id, created_at FROM (WITH {_own(ENROL)} {ENROL_LOG})
  UNION ALL SELECT user_id, created_at FROM (WITH {_own(COMPLETE)}
    SELECT student_id AS user_id, TIMESTAMP '2024-01-31' AS created_at FROM decided WHERE outcome IN ('inserted', 'completed'))),
{_now(M1).replace('activity_log', 'log_now')}"""),
    "apply_enrollments_stored": JOBS["apply_enrollments_state"],
    "complete_lessons_stored": JOBS["complete_lessons_state"],
    "apply_grades_stored": JOBS["apply_grades_state"],
}

STREAMS["stream_active_days"] = statement(
    "SELECT user_id, count(DISTINCT CAST(created_at AS DATE)) AS active_days FROM activity_log GROUP BY user_id")

STATEMENTS = {**REFRESH, **FOLLOWED, **STREAMS, **RULES, **JOBS, **QUALITY}
