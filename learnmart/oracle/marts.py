"""Statements for the marts."""

from __future__ import annotations

from learnmart.oracle.base import pct, pct0, statement

# Every number is counted where it arises (per course, per student and course, per teacher) and looked up from there.
CARD = """
card AS (SELECT k.id AS course_id, k.title AS course_title, k.subject, (SELECT name FROM topics WHERE topics.id = k.topic_id) AS topic_name
         FROM courses k),
spot AS (SELECT x.id AS lesson_id, x.is_published, (SELECT course_id FROM modules WHERE modules.id = x.module_id) AS course_id FROM lessons x)"""

SHORT = "(SELECT last_name || ' ' || first_name FROM users WHERE users.id = {})"

COMPLETION = f"""{CARD},
task AS (SELECT h.id AS homework_id, h.max_score, spot.course_id FROM homeworks h, spot WHERE spot.lesson_id = h.lesson_id AND spot.is_published),
offer AS (SELECT course_id, sum(a) AS lessons, sum(b) AS tasks, sum(c) AS points
          FROM (SELECT course_id, 1 AS a, 0 AS b, 0 AS c FROM spot WHERE is_published UNION ALL SELECT course_id, 0, 1, max_score FROM task)
          GROUP BY course_id),
seen AS (SELECT student_id, course_id, count(*) AS n FROM lesson_progress NATURAL JOIN (SELECT lesson_id, course_id FROM spot WHERE is_published)
         WHERE is_completed GROUP BY ALL),
marked AS (SELECT student_id, course_id, count(*) AS n, sum(score) AS points
           FROM homework_submissions NATURAL JOIN (SELECT homework_id, course_id FROM task) WHERE status <> 'submitted' GROUP BY ALL),
place AS (SELECT p.*, coalesce(o.lessons, 0) AS n_lessons, coalesce(o.tasks, 0) AS n_tasks, coalesce(o.points, 0) AS most,
                 coalesce(s.n, 0) AS n_seen, coalesce(k.n, 0) AS n_marked, coalesce(k.points, 0) AS got, k.points AS given
          FROM (SELECT student_id, course_id, enrolled_at, is_active FROM enrollments) p LEFT JOIN offer o USING (course_id)
          LEFT JOIN seen s USING (student_id, course_id) LEFT JOIN marked k USING (student_id, course_id)),
v5 AS (SELECT student_id, {SHORT.format('student_id')} AS student_name, (SELECT email FROM users WHERE users.id = student_id) AS email,
              course_id, course_title, subject, topic_name, enrolled_at, is_active AS enrollment_active,
              n_lessons AS total_lessons, n_seen AS completed_lessons, {pct0('n_seen', 'n_lessons')} AS lessons_progress_pct,
              n_tasks AS total_homeworks, n_marked AS submitted_homeworks, got AS total_score, most AS max_possible_score,
              {pct0('got', 'most')} AS score_pct
       FROM place JOIN card USING (course_id)),
class_scores AS (SELECT course_id, got, count(*) AS n FROM place WHERE is_active AND n_tasks > 0 GROUP BY ALL),
scores AS (SELECT student_id, (SELECT full_name FROM names WHERE names.id = student_id) AS full_name,
              (SELECT email FROM users WHERE users.id = student_id) AS email, course_id, course_title, subject, topic_name,
              got AS total_score, most AS max_possible_score, {pct('given', 'most')} AS score_pct,
              n_marked AS completed_hw_count, n_tasks AS total_hw_count,
              1 + coalesce((SELECT sum(n) FROM class_scores c WHERE c.course_id = place.course_id AND c.got > place.got), 0) AS rank_in_course
       FROM place JOIN card USING (course_id) WHERE is_active AND n_tasks > 0),
class_seen AS (SELECT course_id, sum(n_seen) AS seen_in_all, sum(n_lessons) AS of_all FROM place WHERE is_active GROUP BY course_id),
completion AS (SELECT student_id, course_id, course_title, subject, topic_name, n_lessons AS total_lessons, n_seen AS completed_lessons,
              {pct0('n_seen', 'n_lessons')} AS completion_pct, {pct0('seen_in_all', 'of_all')} AS avg_completion_pct_in_course
       FROM place JOIN card USING (course_id) JOIN class_seen USING (course_id) WHERE is_active)"""

HEADS = "heads AS (SELECT course_id, count(*) AS n FROM (SELECT DISTINCT course_id, student_id FROM enrollments WHERE is_active) GROUP BY course_id)"

V1 = """
v1 AS (SELECT p.id AS student_id, (SELECT full_name FROM names WHERE names.id = p.id) AS full_name, p.email, p.phone,
       p.created_at AS registered_at,
       (SELECT count(*) FROM (SELECT DISTINCT student_id, course_id FROM enrollments WHERE is_active) a WHERE a.student_id = p.id) AS active_courses_count,
       (SELECT max(created_at) FROM activity_log WHERE user_id = p.id) AS last_activity_at
FROM users p WHERE p.is_active AND p.role = 'student')"""

V3 = f"""{CARD}, {HEADS},
staff AS (SELECT course_id, string_agg(who, ', ' ORDER BY who) AS teachers
          FROM (SELECT DISTINCT course_id, {SHORT.format('teacher_id')} AS who FROM course_teachers) GROUP BY course_id),
v3 AS (SELECT x.id AS lesson_id, x.title AS lesson_title, x.webinar_scheduled_at, x.webinar_url, x.duration_minutes,
       (SELECT title FROM modules WHERE modules.id = x.module_id) AS module_title, course_id, course_title, subject, topic_name,
       coalesce(heads.n, 0) AS enrolled_count, teachers
FROM lessons x JOIN spot ON spot.lesson_id = x.id JOIN card USING (course_id) LEFT JOIN heads USING (course_id) LEFT JOIN staff USING (course_id)
WHERE x.is_published AND x.lesson_type = 'webinar' AND x.webinar_scheduled_at >= (SELECT now FROM clock)
  AND x.webinar_scheduled_at <= (SELECT now + INTERVAL 30 DAY FROM clock))"""

V4 = f"""{CARD},
staff AS (SELECT course_id, string_agg(teacher_id, ',' ORDER BY teacher_id) AS ids FROM (SELECT DISTINCT course_id, teacher_id FROM course_teachers)
          GROUP BY course_id),
asked AS (SELECT h.id AS homework_id, h.title AS homework_title, h.max_score, x.id AS lesson_id, x.title AS lesson_title,
                 (SELECT title FROM modules WHERE modules.id = x.module_id) AS module_title, spot.course_id
          FROM homeworks h, lessons x, spot WHERE x.id = h.lesson_id AND spot.lesson_id = x.id AND h.check_type = 'manual'),
v4 AS (SELECT w.id AS submission_id, w.submitted_at, w.student_id, {SHORT.format('w.student_id')} AS student_name,
       homework_id, homework_title, max_score, lesson_id, lesson_title, module_title, course_id, course_title,
       coalesce(ids, 'NULL') AS teacher_ids, w.answer_text, w.answer_url
FROM homework_submissions w JOIN asked USING (homework_id) JOIN card USING (course_id) LEFT JOIN staff USING (course_id)
WHERE w.status = 'submitted')"""

V6 = f"""{CARD},
money AS (SELECT course_id, sum(amount) AS a, sum(CASE subscription_type WHEN 'monthly' THEN amount END) AS m,
                 sum(CASE subscription_type WHEN 'yearly' THEN amount END) AS y, count(*) AS n, min(payment_date) AS d0, max(payment_date) AS d1
          FROM payments GROUP BY course_id),
payers AS (SELECT course_id, count(*) AS n FROM (SELECT DISTINCT course_id, student_id FROM payments) GROUP BY course_id),
v6 AS (SELECT course_id, course_title, subject, topic_name, coalesce(a, 0) AS total_revenue, coalesce(m, 0) AS revenue_monthly,
       coalesce(y, 0) AS revenue_yearly, coalesce(money.n, 0) AS payments_count, coalesce(payers.n, 0) AS paying_students_count,
       d0 AS first_payment_date, d1 AS last_payment_date
FROM card LEFT JOIN money USING (course_id) LEFT JOIN payers USING (course_id))"""

M1 = """
m1 AS (SELECT 1 AS id, people.students AS total_active_students, people.teachers AS total_active_teachers, open.n AS total_active_courses,
       places.n AS total_active_enrollments, work.waiting AS pending_hw_checks, work.n AS total_submissions,
       money.of_month AS revenue_current_month, money.of_year AS revenue_current_year, money.whole AS revenue_total,
       visitors.n AS active_users_last_7days, ahead.first AS next_webinar_at, clock.now AS refreshed_at
FROM clock,
  (SELECT count(CASE WHEN role = 'student' THEN 1 END) AS students, count(CASE WHEN role = 'teacher' THEN 1 END) AS teachers FROM users WHERE is_active) people,
  (SELECT count(CASE WHEN is_active THEN 1 END) AS n FROM courses) open, (SELECT count(CASE WHEN is_active THEN 1 END) AS n FROM enrollments) places,
  (SELECT count(CASE WHEN status = 'submitted' THEN 1 END) AS waiting, count(*) AS n FROM homework_submissions) work,
  (SELECT coalesce(sum(CASE WHEN payment_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' THEN amount END), 0) AS of_month,
          coalesce(sum(CASE WHEN year(payment_date) = 2024 THEN amount END), 0) AS of_year, coalesce(sum(amount), 0) AS whole FROM payments) money,
  (SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM activity_log WHERE created_at >= TIMESTAMP '2024-01-24')) visitors,
  (SELECT min(webinar_scheduled_at) AS first FROM lessons
   WHERE is_published AND lesson_type = 'webinar' AND webinar_scheduled_at > TIMESTAMP '2024-01-31') ahead)"""

M4 = """
desk AS (SELECT DISTINCT teacher_id, course_id FROM course_teachers),
manual AS (SELECT h.id AS homework_id, (SELECT course_id FROM modules WHERE modules.id = x.module_id) AS course_id
           FROM homeworks h, lessons x WHERE x.id = h.lesson_id AND h.check_type = 'manual'),
pupils AS (SELECT teacher_id, count(*) AS n FROM (SELECT DISTINCT teacher_id, student_id FROM desk
           JOIN (SELECT course_id, student_id FROM enrollments WHERE is_active) USING (course_id)) GROUP BY teacher_id),
paper AS (SELECT d.teacher_id, count(CASE WHEN w.status = 'submitted' THEN 1 END) AS waiting, count(CASE WHEN w.checked_by = d.teacher_id THEN 1 END) AS own
          FROM homework_submissions w JOIN manual USING (homework_id) JOIN desk d USING (course_id) GROUP BY d.teacher_id),
m4 AS (SELECT teacher_id, (SELECT full_name FROM names WHERE names.id = teacher_id) AS full_name, p.email, taught.n AS courses_count,
       coalesce(pupils.n, 0) AS total_students, coalesce(waiting, 0) AS pending_checks, coalesce(own, 0) AS total_checked
FROM (SELECT id AS teacher_id, email FROM users WHERE is_active AND role = 'teacher') p
JOIN (SELECT teacher_id, count(*) AS n FROM desk GROUP BY teacher_id) taught USING (teacher_id)
LEFT JOIN pupils USING (teacher_id) LEFT JOIN paper USING (teacher_id))"""

V5_INTS = "total_lessons completed_lessons total_homeworks submitted_homeworks total_score max_possible_score"
SCORE_INTS = "total_score max_possible_score completed_hw_count total_hw_count rank_in_course"

STATEMENTS = {
    "active_students": statement("SELECT * FROM v1", ctes=V1),
    "teachers_courses": statement(
        """
SELECT d.teacher_id, (SELECT full_name FROM names WHERE names.id = d.teacher_id) AS full_name,
       (SELECT email FROM users WHERE users.id = d.teacher_id) AS email, topic_name, course_id, course_title, subject,
       (SELECT is_active FROM courses WHERE courses.id = d.course_id) AS course_is_active, coalesce(heads.n, 0) AS enrolled_students_count,
       d.assigned_at
FROM course_teachers d JOIN card USING (course_id) LEFT JOIN heads USING (course_id)
WHERE d.teacher_id IN (SELECT id FROM users WHERE role = 'teacher')""",
        ctes=f"{CARD}, {HEADS}",
        ints="course_id",
    ),
    "upcoming_webinars": statement("SELECT * FROM v3", ints="lesson_id course_id duration_minutes", ctes=V3),
    "pending_homeworks": statement(
        "SELECT * FROM v4", ints="submission_id homework_id max_score lesson_id course_id", ctes=V4
    ),
    "student_progress": statement(
        "SELECT * FROM v5", ints="course_id " + V5_INTS, doubles="lessons_progress_pct score_pct", ctes=COMPLETION
    ),
    "course_finance": statement(
        "SELECT * FROM v6", ints="course_id", doubles="total_revenue revenue_monthly revenue_yearly", ctes=V6
    ),
    "admin_dashboard": statement(
        "SELECT * FROM m1", ints="id", doubles="revenue_current_month revenue_current_year revenue_total", ctes=M1
    ),
    "student_scores": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM scores",
        ints="course_id " + SCORE_INTS,
        doubles="score_pct",
        ctes=COMPLETION,
    ),
    "course_completion": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM completion",
        ints="course_id total_lessons completed_lessons",
        doubles="completion_pct avg_completion_pct_in_course",
        ctes=COMPLETION,
    ),
    "teacher_workload": statement(
        "SELECT *, (SELECT now FROM clock) AS refreshed_at FROM m4",
        ints="courses_count total_students pending_checks total_checked",
        ctes=M4,
    ),
}
