from __future__ import annotations

import pytest

from claimloom.plans import guard

ALLOWED = {"claims_flat", "audit_trail"}


@pytest.fixture(scope="module")
def views(spark):
    def claims(s):
        return s.sql("SELECT id AS id, CASE WHEN id % 2 = 0 THEN 'critical' ELSE 'normal' END AS urgency, 'İzmir' AS city, id * 1.25D AS estimated_amount, timestamp'2026-08-01 00:00:00' AS received_at, id % 3 = 0 AS injury FROM range(300)")

    def audit(s):
        return s.sql("SELECT id AS claim_id, 'extraction' AS step, CAST(id AS INT) AS duration_ms FROM range(300)")

    return {"claims_flat": claims, "audit_trail": audit}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) AS n FROM claims_flat", "select city, count(*) as n from claims_flat where city is not null group by city order by n desc limit 5",
        "SELECT a.step, c.urgency FROM claims_flat c JOIN audit_trail a ON a.claim_id = c.id", "WITH recent AS (SELECT * FROM claims_flat WHERE id > 5) SELECT count(*) FROM recent",
        "SELECT 'a;b -- c' AS x FROM claims_flat", "```sql\nSELECT 1 FROM claims_flat\n```", "SELECT ROUND(AVG(estimated_amount)::numeric, 2) AS m FROM claims_flat WHERE injury IS TRUE",
        "SELECT * FROM claims_flat WHERE id IN (SELECT claim_id FROM audit_trail WHERE duration_ms > 10)", "SELECT count(*) FROM claims_flat WHERE received_at >= NOW() - INTERVAL '7 days'",
        "SELECT city ILIKE '%stanbul%' OR city ILIKE 'x' FROM claims_flat", "SELECT count(DISTINCT city), date_trunc('month', received_at) AS m FROM claims_flat GROUP BY m HAVING count(*) > 1", "SELECT DISTINCT urgency FROM claims_flat;",
        "SELECT (SELECT max(duration_ms) FROM audit_trail) AS m FROM claims_flat WHERE received_at > DATE '2026-01-01'",
    ],
)
def test_allowed(spark, views, sql):
    assert len(guard.guarded_sql(spark, sql, views).collect()) <= 100


@pytest.mark.parametrize(
    "sql",
    [
        "", "   ", "SELECT 1; SELECT 2", "DROP TABLE claims_flat", "INSERT INTO claims_flat VALUES (1)", "DELETE FROM claims_flat", "UPDATE claims_flat SET city = 'x'", "CREATE TABLE t AS SELECT * FROM claims_flat",
        "SELECT * FROM claims_flat UNION SELECT * FROM claims_flat", "SELECT * FROM users", "SELECT * FROM other.claims_flat", "SELECT * FROM claims_flat WHERE id IN (SELECT id FROM users)", "SELECT (SELECT max(x) FROM secrets) FROM claims_flat",
        "WITH x AS (SELECT * FROM users) SELECT * FROM x", "SELECT java_method('java.lang.System', 'exit', 1) FROM claims_flat", "SELECT pg_sleep(10) FROM claims_flat", "SELECT dblink('x') FROM claims_flat", "SELECT input_file_name() FROM claims_flat",
        "SELECT * FROM parquet.`/etc`", "SET spark.x = 1", "SHOW TABLES", "not sql at all", "SELECT * FROM range(10)", "SELECT * FROM claims_flat WHERE EXISTS (SELECT 1 FROM users)",
    ],
)
def test_refused(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, ALLOWED)


def test_bounded_and_apart(spark, views):
    assert guard.guarded_sql(spark, "SELECT * FROM claims_flat LIMIT 250", views).count() == 100
    assert guard.guarded_sql(spark, "SELECT * FROM claims_flat ORDER BY id LIMIT 3", views).count() == 3
    assert not spark.catalog.tableExists("claims_flat")


def test_wide_numerics():
    assert guard.wide_numerics("a::numeric, b::NUMERIC(3,1), c::text") == "a::decimal(38,10), b::NUMERIC(3,1), c::string"
    assert guard._unquoted("'x::numeric' || y::numeric", guard.wide_numerics) == "'x::numeric' || y::decimal(38,10)"


def test_rows_and_timeout(spark, views):
    assert guard.run(guard.guarded_sql(spark, "SELECT count(*) AS n FROM claims_flat", views)) == [{"n": 300}]
    slow = spark.sql("SELECT count(*) AS n FROM range(0, 100000000000, 1, 4) WHERE sqrt(id) > 1e9")
    with pytest.raises(guard.Refused, match="stopped"):
        guard.run(slow, timeout_s=0.5)


def test_one_correction(spark, views):
    seen = []

    def write(question, refusal):
        seen.append(refusal)
        return "SELECT * FROM users" if refusal is None else "SELECT count(*) AS n FROM claims_flat WHERE injury"

    answer = guard.ask(spark, "how many?", write, views)
    assert answer["rows"] == [{"n": 100}] and answer["refusal"] is None and "users" in seen[1]
    assert guard.ask(spark, "?", lambda q, r: "SELECT * FROM users", views)["rows"] == []
    assert guard.ask(spark, "?", lambda q, r: "SELECT * FROM claims_flat WHERE id < 0", views)["refusal"] == "no matching record"
