"""The same results as the registered queries, stated independently in SQL."""

# Character classes as the SQL engine's regular expressions spell them.
_SEPARATOR = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
_BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINES = f"regexp_split_to_array(regexp_replace(text, '{_SEPARATOR}$', ''), '{_SEPARATOR}')"

_KEY = "regexp_extract(url, '^[a-z0-9]+://[^/?#]*/*([^?#]*)', 1)"
_BASENAME = f"regexp_extract({_KEY}, '([^/]*)$', 1)"

_RECORDS = """
WITH r AS (
  SELECT 'jr-' || o_orderkey AS id, 'vc-' || o_custkey AS vc, o_orderpriority AS name,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS state,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 END AS rc,
         CAST(epoch(o_orderdate) AS DOUBLE) AS s,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(epoch(o_orderdate) AS DOUBLE) + floor(o_totalprice) END AS f,
         o_orderpriority = '1-URGENT' AS remote
  FROM orders)
"""

_TENANT = """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 6),
     gone_o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
"""

_LOG_LINES = """
WITH l AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id,
         trim(CASE event_type WHEN 'error' THEN 'pkg.StepError: ' || event_id
                              WHEN 'view' THEN '24/01/01 00:00:00 ERROR x'
                              WHEN 'purchase' THEN 'Caused by: p' || event_id
                              ELSE '  noise' END) AS line
  FROM events)
"""
_IS_CAUSE = r"""(NOT regexp_matches(line, '^\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}')
  AND (starts_with(line, 'Caused by:')
       OR regexp_matches(line, '^[\p{L}\p{N}_.$]+(?:Error|Exception|Failure|Failed)(?::.*)?$')))"""

ORACLES: dict[str, str] = {
    "q01_range_count": """
        SELECT count(*) AS n, min(i) AS first_id, max(i) AS last_id
        FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i)""",
    "q02_overwrite_roundtrip": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "q03_scope_filter": """
        SELECT p_partkey, p_type AS section, p_brand AS name FROM part
        WHERE p_type IN ('ECONOMY', 'PROMO', 'ABSENT') AND p_brand IN ('Brand#6', 'Brand#11', 'NO_SUCH_BRAND')""",
    "q04_partition_clone": """
        SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer WHERE c_nationkey IN (6, 11)""",
    "q05_manifest_summary": """
        SELECT source AS prefix, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes
        FROM documents GROUP BY source""",
    "q06_sync_plan": """
        WITH s AS (SELECT 'documents/' || doc_id AS key, n_chars AS len, doc_id % 7 AS at FROM documents),
             t AS (SELECT 'documents/' || d.doc_id AS key, d.n_chars + l.toxic AS len, 5 AS at
                   FROM documents d JOIN labels l ON d.doc_id = l.doc_id
                   UNION ALL SELECT 'benchmark/' || item_id, length(text), 0 FROM benchmark)
        SELECT coalesce(s.key, t.key) AS key,
               CASE WHEN t.key IS NULL THEN 'copy_new' WHEN s.key IS NULL THEN 'stale'
                    WHEN s.len <> t.len OR s.at > t.at THEN 'copy_changed' ELSE 'same' END AS action
        FROM s FULL JOIN t ON s.key = t.key""",
    "q07_prefix_remap": f"""
        SELECT page_id,
               CASE WHEN starts_with(url, 'http://') THEN 's3a://' || substr(url, 8) ELSE url END AS uri,
               CASE WHEN {_KEY} = 'en' OR starts_with({_KEY}, 'en/') THEN 'local/' || {_KEY} ELSE {_KEY} END AS path
        FROM pages""",
    "q08_uri_parts": f"""
        SELECT page_id, regexp_extract(url, '^([a-z0-9]+)://', 1) AS scheme,
               regexp_extract(url, '^[a-z0-9]+://([^/?#]+)', 1) AS authority,
               regexp_extract(url, '^[a-z0-9]+://[^/]+/([^?#]*)', 1) AS key,
               regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS basename
        FROM pages""",
    "q09_template_resolve": """
        SELECT s_suppkey, replace(replace('s3://data-{bucket_suffix}/{env}/' || s_name || '/{unknown}/{env}',
                                          '{env}', 'local'), '{bucket_suffix}', 'dev') AS location
        FROM supplier""",
    "q10_expectations": """
        SELECT 'customer' AS tbl, 'non_empty' AS rule, count(*) > 0 AS ok FROM customer
        UNION ALL SELECT 'customer', 'key_unique', count(*) = count(DISTINCT c_custkey) FROM customer
        UNION ALL SELECT 'customer', 'acctbal_positive', bool_and(c_acctbal >= 0) FROM customer
        UNION ALL SELECT 'lineitem', 'non_empty', count(*) > 0 FROM lineitem
        UNION ALL SELECT 'lineitem', 'key_unique', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""",
    "q11_ordinal_progress": """
        SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS idx,
               count(*) OVER () AS total
        FROM orders""",
    "q12_batch_outcome": """
        SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS total,
               count(*) FILTER (event_type = 'error') AS failed,
               CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 1 ELSE 0 END AS exit_code
        FROM events GROUP BY ALL""",
    "q13_parent_autoregister": """
        WITH known AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0)
        SELECT c_custkey, c_name FROM known
        UNION ALL
        SELECT DISTINCT o_custkey, 'auto-' || o_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.c_custkey = o_custkey)""",
    "q14_upsert": """
        WITH b AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0),
             u AS (SELECT c_custkey, 'upd-' || c_name AS c_name, 'MOVED' AS c_mktsegment
                   FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT coalesce(u.c_custkey, b.c_custkey) AS c_custkey, coalesce(u.c_name, b.c_name) AS c_name,
               coalesce(u.c_mktsegment, b.c_mktsegment) AS c_mktsegment,
               CASE WHEN b.c_custkey IS NULL THEN 'create' WHEN u.c_custkey IS NULL THEN 'keep'
                    ELSE 'update' END AS action
        FROM b FULL JOIN u ON b.c_custkey = u.c_custkey""",
    "q15_tenant_delete": f"""
        {_TENANT}
        SELECT 'customer' AS tbl, * FROM customer WHERE c_nationkey <> 6
        UNION ALL BY NAME
        SELECT 'orders' AS tbl, * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone_o)
        UNION ALL BY NAME
        SELECT 'lineitem' AS tbl, * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_o)""",
    "q16_tenant_recovery": """
        SELECT 'customer' AS tbl, * FROM customer
        UNION ALL BY NAME SELECT 'orders' AS tbl, * FROM orders
        UNION ALL BY NAME SELECT 'lineitem' AS tbl, * FROM lineitem""",
    "q17_compact": """
        SELECT o_orderkey, o_custkey, o_orderstatus, true AS files_as_asked, true AS ranged FROM orders""",
    "q18_vacuum_plan": """
        SELECT doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND n_chars < 2000""",
    "q19_latest_state": """
        SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(ts, event_id) AS ts
        FROM events GROUP BY user_id""",
    "q20_run_state_fold": """
        WITH e AS (
          SELECT user_id, CAST(ts AS DATE) AS day,
                 min(event_id) FILTER (event_type IN ('purchase', 'error')) AS end_at,
                 arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS ended,
                 min(event_id) FILTER (event_type = 'click') AS cancel_at,
                 arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'view')) AS reported
          FROM events GROUP BY ALL)
        SELECT user_id, day,
               CASE WHEN cancel_at IS NOT NULL AND end_at IS NULL THEN 'CANCEL_PENDING'
                    WHEN cancel_at < end_at THEN 'CANCELLED'
                    WHEN ended = 'purchase' THEN 'COMPLETED'
                    WHEN ended = 'error' THEN 'FAILED'
                    WHEN reported = 'signup' THEN 'SUBMITTED'
                    ELSE 'RUNNING' END AS state
        FROM e""",
    "q21_failure_summary": f"""
        {_LOG_LINES},
        m AS (SELECT user_id, day, arg_max(line, event_id) AS summary FROM l WHERE {_IS_CAUSE} GROUP BY ALL)
        SELECT u.user_id, u.day, coalesce(m.summary, '') AS summary
        FROM (SELECT DISTINCT user_id, day FROM l) u LEFT JOIN m USING (user_id, day)""",
    "q22_override_last_wins": """
        SELECT user_id, event_type AS k, arg_max(value, event_id) AS v FROM events GROUP BY user_id, event_type""",
    "q23_run_stats": f"""
        {_RECORDS}
        SELECT state, count(*) AS n, min(s) AS first_at, max(f) AS last_at,
               min(f - s) AS min_s, max(f - s) AS max_s, avg(f - s) AS avg_s
        FROM r GROUP BY state""",
    "q24_priority_top": """
        SELECT event_id, event_type FROM events
        ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 9 END,
                 event_id LIMIT 20""",
    "q25_stream_latest": """
        SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY user_id""",
    "q26_batch_failures": """
        SELECT user_id, CAST(ts AS DATE) AS day, event_id, 'step failed with ' || props AS error
        FROM events WHERE event_type = 'error'""",
    "q27_publish_version": """
        SELECT p_partkey, p_name, p_size, p_partkey + 1 AS p_next,
               CAST((SELECT count(DISTINCT p_size) FROM part WHERE p_size > 20) AS INTEGER) AS partitions
        FROM part WHERE p_size > 20""",
    "q28_list_prefix": """
        SELECT DISTINCT 'c_nationkey=' || c_nationkey AS name, true AS is_dir, CAST(0 AS BIGINT) AS length FROM customer
        UNION ALL
        SELECT 'files', false, CAST(sum(octet_length(encode(c_custkey || '|' || c_name)) + 1) AS BIGINT)
        FROM customer WHERE c_nationkey = 6""",
    "q29_file_manifest": """
        WITH l AS (
          SELECT 'supplier/s_nationkey=' || s_nationkey AS folder, s_suppkey || '|' || s_name AS line FROM supplier
          UNION ALL SELECT 'customer/c_nationkey=' || c_nationkey, c_custkey || '|' || c_name FROM customer
          UNION ALL SELECT 'orders/o_orderstatus=' || o_orderstatus, o_orderkey || '|' || o_orderpriority FROM orders)
        SELECT folder, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM l GROUP BY folder""",
    "q30_table_definitions": """
        WITH b AS (SELECT p_type, p_brand, min(p_size) AS s, max(p_size) AS l FROM part GROUP BY ALL)
        SELECT p_type || '/' || p_brand || '.json' AS path, p_brand AS name,
               CASE WHEN s <> 1 THEN 'local_db' END AS db, CASE WHEN s <> 1 THEN 't' || l END AS tbl,
               CASE WHEN s <> 1 THEN 's3://data-dev/local/' || p_type || '/t' || s END AS location,
               CASE WHEN s <> 1 THEN p_brand END AS second_column, s <> 1 AS ok
        FROM b WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE')""",
    "q31_catalog_roundtrip": """
        SELECT s_suppkey, s_name, CAST(2 AS BIGINT) AS failed, CAST(1 AS INTEGER) AS exit_code, true AS kept
        FROM supplier""",
    "q32_run_status_stats": f"""
        {_RECORDS}
        SELECT vc AS "virtualClusterId", state, count(*) AS n, min(s) AS first_at, max(f) AS last_at,
               min(f - s) AS min_s, max(f - s) AS max_s
        FROM r GROUP BY vc, state""",
    "q33_run_logs_summary": f"""
        {_LOG_LINES},
        m AS (SELECT day, arg_max(line, event_id) AS summary FROM l WHERE {_IS_CAUSE} GROUP BY ALL)
        SELECT strftime(u.day, '%Y-%m') AS vc_id, CAST(u.day AS VARCHAR) AS jr_id,
               coalesce(m.summary, '') AS summary
        FROM (SELECT DISTINCT day FROM l) u LEFT JOIN m USING (day)""",
    "q34_run_log_lines": f"""
        WITH d AS (SELECT lang, source, doc_id, {_LINES} AS lines FROM documents WHERE text <> ''),
             l AS (SELECT lang, source, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d)
        SELECT lang AS vc_id, source AS jr_id,
               row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, pos) AS line_no, line
        FROM l""",
    "q35_offboard_report": f"""
        {_TENANT},
        c AS (
          SELECT 'customer' AS tbl, count(*) AS n_before, count(*) FILTER (c_nationkey = 6) AS n_deleted FROM customer
          UNION ALL
          SELECT 'orders', count(*), count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM gone_o)) FROM orders
          UNION ALL
          SELECT 'lineitem', count(*), count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM gone_o)) FROM lineitem)
        SELECT tbl, n_before, n_before - n_deleted AS n_after, n_deleted FROM c""",
    "q36_cluster_runs": f"""
        {_RECORDS}
        SELECT r.vc AS "virtualClusterId", r.id, r.state, c.c_name AS cluster_name,
               CASE WHEN c.c_custkey IS NOT NULL THEN 'RUNNING' END AS cluster_state,
               r.state IN ('COMPLETED', 'FAILED', 'CANCELLED') AS is_terminal
        FROM r LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON r.vc = 'vc-' || c.c_custkey""",
    "q37_cluster_lookup": """
        SELECT 'listed' AS kind, 'jr-' || o_orderkey AS id FROM orders WHERE o_custkey = 6
        UNION ALL
        SELECT 'found', 'jr-' || o_orderkey FROM orders WHERE o_custkey = 899 AND o_orderkey = 0""",
    "q38_run_defaults": f"""
        {_RECORDS}
        SELECT id, CASE WHEN remote THEN 's3://logs' END AS log_uri,
               CASE state WHEN 'COMPLETED' THEN name WHEN 'RUNNING' THEN '' ELSE 'unnamed' END AS if_absent,
               CASE state WHEN 'COMPLETED' THEN name ELSE 'unnamed' END AS if_blank
        FROM r""",
    "q39_submit_options": """
        SELECT event_id, CAST(3 AS INTEGER) AS n_options, 'again=' || replace(props, '"k"', 'k') AS app_name,
               event_type AS kind
        FROM events""",
    "q40_state_texts": f"""
        {_RECORDS},
        p AS (SELECT *, CASE WHEN remote THEN 's3://logs/' || id || '/stdout.gz'
                             ELSE '/var/logs/' || id || '/stdout.log' END AS out_loc,
                     CASE WHEN remote THEN 's3://logs/' || id || '/stderr.gz'
                          ELSE '/var/logs/' || id || '/stderr.log' END AS err_loc,
                     CASE WHEN name = '5-LOW' THEN 'pkg.StepError: low'
                          ELSE '(no exception summary in stderr; see stderr.gz for context)' END AS cause
              FROM r)
        SELECT id,
               CASE state WHEN 'COMPLETED' THEN 'stdout: ' || out_loc
                    ELSE 'spark-submit exit ' || coalesce(CAST(rc AS VARCHAR), 'None') || ': ' || cause || chr(10)
                         || 'stdout: ' || out_loc || chr(10) || 'stderr: ' || err_loc END AS details,
               CASE WHEN state = 'FAILED' THEN 'USER_ERROR: spark-submit exit ' || rc END AS reason,
               CAST(s AS BIGINT) AS started, f - s AS seconds,
               CASE WHEN remote THEN 's3://logs/' ELSE 's3://other/' END || vc || '/jobs/' || id
                 || '/containers/spark-' || id || '/spark-' || id || '-driver/stderr.gz' AS log_object
        FROM p""",
    "q41_name_collisions": f"""
        SELECT 'local_' || {_BASENAME} AS name, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1""",
    "q42_path_patterns": rf"""
        SELECT page_id, path FROM (SELECT page_id, {_KEY} AS path FROM pages)
        WHERE NOT starts_with(path, 'en/') AND NOT regexp_matches(path, '/[1-3].*\.html$')
          AND (contains(path, '.html') OR contains(path, '/5'))""",
    "q43_object_keys": rf"""
        WITH p AS (SELECT page_id, regexp_replace({_BASENAME}, '\.html$', '') AS name,
                          regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS section,
                          regexp_extract(url, '^([^?#]*)', 1) AS base FROM pages)
        SELECT page_id, name, 'local/ddl/configs/' || section || '/' || name AS key,
               CASE WHEN ends_with(base, '/') THEN base ELSE base || '/' END || 'stderr.gz' AS log
        FROM p""",
    "q44_text_lines": f"""
        WITH l AS (SELECT doc_id, unnest({_LINES}) AS raw FROM documents WHERE text <> ''),
             s AS (SELECT doc_id, regexp_replace(raw, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS line FROM l)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line = '') AS n_blank,
               CAST(sum(length(line)) AS BIGINT) AS n_chars,
               count(*) FILTER (regexp_matches(line, '^\\d{{2}}/\\d{{2}}/\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}'))
                 AS n_chatter,
               count(*) FILTER ({_IS_CAUSE}) AS n_cause
        FROM s GROUP BY doc_id""",
    "q45_vacuumed_rows": "SELECT o_orderkey, o_orderstatus, true AS only_live FROM orders",
    "q46_priority_sorted": """
        SELECT c_custkey, c_mktsegment, row_number() OVER (
          ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_custkey) AS place
        FROM customer""",
    "q47_finalised_runs": f"""
        {_LOG_LINES},
        m AS (SELECT user_id, day, arg_max(line, event_id) AS summary FROM l WHERE {_IS_CAUSE} GROUP BY ALL),
        e AS (
          SELECT user_id, CAST(ts AS DATE) AS day,
                 min(event_id) FILTER (event_type IN ('purchase', 'error')) AS end_at,
                 arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS ended,
                 min(event_id) FILTER (event_type = 'click') AS cancel_at,
                 arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'view')) AS reported
          FROM events GROUP BY ALL),
        s AS (
          SELECT user_id, day, end_at AS finished, coalesce(summary, '') AS summary,
                 CASE WHEN ended = 'purchase' THEN 0 WHEN ended = 'error' AND end_at % 2 = 1 THEN 1 END AS exit_code,
                 '/var/logs/' || user_id || '-' || day || '/' AS place,
                 CASE WHEN cancel_at IS NOT NULL AND end_at IS NULL THEN 'CANCEL_PENDING'
                      WHEN cancel_at < end_at THEN 'CANCELLED'
                      WHEN ended = 'purchase' THEN 'COMPLETED'
                      WHEN ended = 'error' THEN 'FAILED'
                      WHEN reported = 'signup' THEN 'SUBMITTED'
                      ELSE 'RUNNING' END AS state
          FROM e LEFT JOIN m USING (user_id, day))
        SELECT user_id, day, state, exit_code, finished, summary,
               CASE state WHEN 'COMPLETED' THEN 'stdout: ' || place || 'stdout.log'
                    WHEN 'CANCELLED' THEN 'cancelled. stdout: ' || place || 'stdout.log'
                    WHEN 'FAILED' THEN 'spark-submit exit ' || coalesce(CAST(exit_code AS VARCHAR), 'None') || ': '
                         || CASE WHEN summary = '' THEN '(no exception summary in stderr; see stderr.gz for context)'
                                 ELSE summary END || chr(10)
                         || 'stdout: ' || place || 'stdout.log' || chr(10) || 'stderr: ' || place || 'stderr.log'
               END AS details,
               CASE WHEN state = 'FAILED'
                    THEN 'USER_ERROR: spark-submit exit ' || coalesce(CAST(exit_code AS VARCHAR), 'None') END AS reason
        FROM s""",
    "q48_job_run_records": """
        WITH o AS (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'jr-' || o_orderkey) AS n FROM orders)
        SELECT 'jr-' || o_orderkey AS id, 'vc-' || o_custkey % 10 AS "virtualClusterId",
               CASE WHEN o_orderstatus = 'F' THEN 's3://logs' END AS log_uri, o_orderstatus AS option,
               o_orderstatus AS tag, CAST(epoch(o_orderdate) AS DOUBLE) AS "createdAt"
        FROM o WHERE o_custkey % 3 = 0 OR n = 1""",
    "q49_partition_delete": f"""
        {_TENANT}
        SELECT o_orderkey, o_custkey, o_orderstatus, c_nationkey,
               CAST((SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey = 6) AS INTEGER) AS nations,
               CAST((SELECT count(DISTINCT o_orderstatus) FROM orders
                     WHERE o_custkey IN (SELECT c_custkey FROM gone)) AS INTEGER) AS statuses,
               true AS others_untouched
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 6""",
    "q50_partition_upsert": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment,
               CAST(2 AS INTEGER) AS partitions, true AS old_files_untouched
        FROM customer
        UNION ALL
        SELECT -c_custkey - 1, c_name, c_nationkey, 'MOVED', 2, true FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "q51_clone_prefixes": """
        SELECT 'gold/supplier' AS tbl, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, true AS as_reported FROM supplier
        UNION ALL SELECT 'gold/nation', count(*), CAST(sum(n_nationkey) AS BIGINT), true FROM nation
        UNION ALL SELECT 'silver/customer', count(*), CAST(sum(c_custkey) AS BIGINT), true FROM customer
        WHERE c_nationkey IN (6, 11)""",
    "q52_clustered_items": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
               true AS prunes_l_orderkey, true AS prunes_l_partkey, true AS prunes_l_shipdate
        FROM lineitem""",
    "q53_packed_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
               true AS large_untouched, true AS fewer, true AS fits
        FROM orders""",
    "q54_stream_run_states": """
        WITH e AS (
          SELECT user_id, CAST(ts AS DATE) AS day, count(*) + count(*) FILTER (event_id % 10 = 0) AS n,
                 min(event_id) FILTER (event_type IN ('purchase', 'error')) AS end_at,
                 arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS ended,
                 min(event_id) FILTER (event_type = 'click') AS cancel_at,
                 arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'view')) AS reported
          FROM events GROUP BY ALL)
        SELECT user_id, day, n, end_at AS finished,
               CAST(CASE WHEN ended = 'purchase' THEN 0 WHEN ended = 'error' AND end_at % 2 = 1 THEN 1 END AS INTEGER) AS exit_code,
               CASE WHEN cancel_at IS NOT NULL AND end_at IS NULL THEN 'CANCEL_PENDING'
                    WHEN cancel_at < end_at THEN 'CANCELLED'
                    WHEN ended = 'purchase' THEN 'COMPLETED'
                    WHEN ended = 'error' THEN 'FAILED'
                    WHEN reported = 'signup' THEN 'SUBMITTED'
                    ELSE 'RUNNING' END AS state
        FROM e""",
    "q55_resumed_offboarding": f"""
        {_TENANT},
        c AS (
          SELECT 'customer' AS tbl, count(*) AS n_before, count(*) FILTER (c_nationkey = 6) AS n_deleted FROM customer
          UNION ALL
          SELECT 'orders', count(*), count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM gone_o)) FROM orders
          UNION ALL
          SELECT 'lineitem', count(*), count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM gone_o)) FROM lineitem)
        SELECT tbl, n_before, n_before - n_deleted AS n_after, n_deleted, true AS nothing_twice FROM c""",
    "q56_status_files": """
        SELECT 'jr-' || substr(o_orderpriority, 1, 1) || '-' || o_orderstatus || '-' || year(o_orderdate) AS id,
               'vc-' || o_orderstatus AS "virtualClusterId", o_orderpriority AS name,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS state,
               CAST(count(*) % 3 AS INTEGER) AS "exitCode",
               min(CAST(epoch(o_orderdate) AS DOUBLE)) AS "startedAt", max(CAST(epoch(o_orderdate) AS DOUBLE)) AS "finishedAt",
               CAST(NULL AS VARCHAR) AS "logUri",
               '/var/logs/jr-' || substr(o_orderpriority, 1, 1) || '-' || o_orderstatus || '-' || year(o_orderdate) || '/stdout.log'
                 AS "stdoutLocal"
        FROM orders GROUP BY o_orderpriority, o_orderstatus, year(o_orderdate)""",
    "q57_cluster_records": """
        SELECT o_orderkey, 'vc-' || c_nationkey AS "virtualClusterId", n_name AS cluster_name,
               CASE WHEN n_nationkey IS NOT NULL THEN 'RUNNING' END AS cluster_state, 'ns-' || n_regionkey AS namespace,
               CAST(n_nationkey * 1.5 AS DOUBLE) AS "createdAt", CAST(n_regionkey AS VARCHAR) AS region
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_nationkey = c_nationkey""",
    "q58_sync_by_ranges": """
        WITH s AS (SELECT 'documents/' || doc_id AS key, n_chars AS len, doc_id % 7 AS at FROM documents),
             t AS (SELECT 'documents/' || d.doc_id AS key, d.n_chars + l.toxic AS len, 5 AS at
                   FROM documents d JOIN labels l ON d.doc_id = l.doc_id
                   UNION ALL SELECT 'benchmark/' || item_id, length(text), 0 FROM benchmark)
        SELECT coalesce(s.key, t.key) AS key, s.len AS source_length, t.len AS target_length,
               CASE WHEN t.key IS NULL THEN 'copy_new' WHEN s.key IS NULL THEN 'stale'
                    WHEN s.len <> t.len OR s.at > t.at THEN 'copy_changed' ELSE 'same' END AS action
        FROM s FULL JOIN t ON s.key = t.key""",
    "q59_unknown_definition_fields": """
        WITH g AS (SELECT s_nationkey AS k, count(*) AS n, min(s_name) AS f, s_nationkey % 5 < 4 AS ok FROM supplier GROUP BY s_nationkey)
        SELECT 't' || k AS name, CASE WHEN ok THEN 't' || k END AS tbl, CASE WHEN ok THEN 2 END AS n_unknown,
               CASE WHEN ok THEN '{"name":"' || f || '","teams":[' || n || ',null]}' END AS owner,
               CASE WHEN NOT ok THEN NULL WHEN k % 2 = 0 THEN CAST(n AS VARCHAR) ELSE '"low"' END AS tier,
               (SELECT count(*) FROM g WHERE NOT ok) AS broken, true AS shaped
        FROM g""",
    "q60_retained_versions": """
        SELECT p_partkey, p_name, p_size, (SELECT count(*) FROM part WHERE p_size <= 10) AS n_leased,
               true AS leased_stays, true AS released_goes
        FROM part WHERE p_size <= 50""",
    "q61_merged_expectations": """
        SELECT 'non_empty' AS rule, count(*) > 0 AS ok, count(*) || ' rows' AS message, true AS steady FROM lineitem
        UNION ALL
        SELECT 'discounted', bool_and(l_discount <= 0.05), count(*) FILTER (NOT l_discount <= 0.05) || ' rows violate it', true FROM lineitem
        UNION ALL
        SELECT 'positive', bool_and(l_quantity > 0), count(*) FILTER (NOT l_quantity > 0) || ' rows violate it', true FROM lineitem
        UNION ALL
        SELECT 'line_unique', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), NULL, true FROM lineitem
        UNION ALL
        SELECT 'order_unique', count(*) = count(DISTINCT l_orderkey), NULL, true FROM lineitem""",
}
