"""SQL families: name -> (Spark SQL, DuckDB SQL); where one text serves both it is given once."""

from __future__ import annotations

BOTH = {
    # the shapes that users run most
    "select_all": "SELECT * FROM events",
    "agg_avg": "SELECT round(avg(value), 6) AS avg_value FROM events",
    "agg_global": "SELECT round(avg(l_quantity), 6) AS avg_quantity, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM lineitem",
    "where_tag": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "agg_group": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderpriority",
    "limit_rows": "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5",
    "agg_case_error_rate": "SELECT event_type, count(*) AS total, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share FROM events GROUP BY event_type",
    "agg_avg_max": "SELECT event_type, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM events GROUP BY event_type",
    "agg_multi_host": "SELECT user_id, round(avg(value), 6) AS a, max(value) AS b, min(value) AS c FROM events GROUP BY user_id",
    "agg_ohlc": "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS close, max(l_extendedprice) AS high, min(l_extendedprice) AS low, round(sum(l_quantity), 2) AS volume FROM lineitem GROUP BY l_returnflag",
    "agg_pipeline": "SELECT event_type, round(avg(value), 6) AS a, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type",
    # aggregates
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(value) AS vals FROM events GROUP BY event_type",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, CAST(sum(user_id) FILTER (WHERE value <= 50) AS BIGINT) AS low FROM events GROUP BY event_type",
    "agg_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60",
    "agg_moments": "SELECT event_type, round(stddev_samp(value), 5) AS s, round(stddev_pop(value), 5) AS sp, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp FROM events GROUP BY event_type",
    "agg_median": "SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY event_type",
    "agg_bool_bit": "SELECT event_type, bool_and(value > 1) AS a, bool_or(value > 99) AS o, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(event_id) AS bx FROM events GROUP BY event_type",
    "agg_regression": "SELECT event_type, round(corr(value, user_id), 5) AS c, round(covar_pop(value, user_id), 3) AS cp, round(covar_samp(value, user_id), 3) AS cs, round(regr_slope(value, user_id), 6) AS sl, round(regr_intercept(value, user_id), 4) AS ic, regr_count(value, user_id) AS rc, round(regr_r2(value, user_id), 6) AS r2, round(regr_avgx(value, user_id), 4) AS ax, round(regr_avgy(value, user_id), 4) AS ay FROM events GROUP BY event_type",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    # joins
    "join_inner": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey + 50",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey",
    "join_using": "SELECT user_id, a.n AS clicks, b.n AS views FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) b USING (user_id)",
    "join_natural": "SELECT user_id, n, m FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a NATURAL JOIN (SELECT user_id, max(value) AS m FROM events GROUP BY user_id) b",
    "join_residual": "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4",
    "join_lateral": "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x",
    # windows
    "win_rank": "SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)",
    "win_distribution": "SELECT event_id, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c, ntile(4) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS q FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)",
    "win_lag_lead": "SELECT event_id, lag(value) OVER w AS a, lead(value, 2, 0.0) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)",
    "win_running_sum": "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, count(*) OVER (PARTITION BY event_type) AS n FROM events",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM events",
    "win_interval_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    # sets, order, blocks
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "order_nulls": "SELECT event_id, CASE WHEN user_id > 20 THEN user_id END AS u FROM events ORDER BY u DESC NULLS LAST, event_id LIMIT 30",
    "topk": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "distinct_rows": "SELECT DISTINCT event_type, user_id FROM events",
    "cte_subquery": "WITH t AS (SELECT user_id, sum(value) AS s FROM events GROUP BY user_id) SELECT user_id, round(s, 4) AS s FROM t WHERE s > (SELECT avg(s) FROM t)",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t",
    "exists_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "values_block": "SELECT k, upper(v) AS v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)",
    # scalar functions
    "fn_string_case": "SELECT p_partkey, lower(p_name) AS a, upper(p_name) AS b, trim(p_name) AS c, lpad(p_brand, 12, '*') AS d, rpad(p_brand, 12, '-') AS e, repeat('ab', 2) AS f, reverse(p_brand) AS g, ltrim(p_name) AS h, rtrim(p_name) AS i FROM part",
    "fn_string_slice": "SELECT p_partkey, substr(p_name, 2, 4) AS a, left(p_name, 3) AS b, right(p_name, 3) AS c, split_part(p_name, ' ', 1) AS d, contains(p_name, 'a') AS e, translate(p_brand, 'B#', 'b_') AS f, replace(p_name, 'a', 'o') AS g FROM part",
    "fn_string_build": "SELECT p_partkey, concat(p_brand, '/', p_type) AS a, concat_ws('-', p_brand, NULL, p_type) AS b, p_brand || p_type AS c FROM part",
    "fn_like": "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_name ILIKE '%A%'",
    "fn_trig": "SELECT event_id, round(sin(value), 8) AS a, round(cos(value), 8) AS b, round(tan(value / 100), 8) AS c, round(asin(value / 1000), 8) AS d, round(acos(value / 1000), 8) AS e, round(atan(value), 8) AS f, round(atan2(value, 2), 8) AS g, round(sinh(value / 100), 8) AS h, round(cosh(value / 100), 8) AS i, round(tanh(value / 100), 8) AS j, round(degrees(value), 6) AS k, round(radians(value), 8) AS l FROM events",
    "fn_float": "SELECT event_id, isnan(value) AS a, value = 0 AS b FROM events",
    "fn_conditional": "SELECT event_id, coalesce(NULL, value) AS a, nullif(event_type, 'click') AS b, greatest(value, 50.0) AS c, least(value, 50.0) AS d, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS e FROM events",
    "fn_hash": "SELECT p_partkey, md5(p_name) AS a FROM part",
    "fn_cast": "SELECT event_id, CAST(user_id AS VARCHAR(20)) AS a, CAST(value AS DECIMAL(10, 2)) AS b, TRY_CAST(event_type AS BIGINT) AS c FROM events",
}

PAIRS = {
    "join_right_semi": ("SELECT n_nationkey, n_name FROM nation LEFT SEMI JOIN supplier ON s_nationkey = n_nationkey", "SELECT n_nationkey, n_name FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey"),
    "join_right_anti": ("SELECT n_nationkey, n_name FROM nation LEFT ANTI JOIN supplier ON s_nationkey = n_nationkey", "SELECT n_nationkey, n_name FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey"),
    "fn_string_measure": ("SELECT p_partkey, length(p_name) AS a, char_length(p_name) AS b, octet_length(p_name) AS c, bit_length(p_name) AS d, ascii(p_brand) AS e, chr(65) AS f, levenshtein(p_brand, 'Brand#11') AS g FROM part", "SELECT p_partkey, length(p_name) AS a, char_length(p_name) AS b, strlen(p_name) AS c, bit_length(p_name) AS d, ascii(p_brand) AS e, chr(65) AS f, levenshtein(p_brand, 'Brand#11') AS g FROM part"),
    "fn_regexp": ("SELECT p_partkey, regexp_like(p_brand, '[0-9]+$') AS a FROM part", "SELECT p_partkey, regexp_matches(p_brand, '[0-9]+$') AS a FROM part"),
    "fn_math": ("SELECT event_id, abs(value - 50) AS a, ceil(value) AS b, floor(value) AS c, round(value, 2) AS d, round(sqrt(value), 8) AS e, round(cbrt(value), 8) AS f, round(power(value, 2), 4) AS g, round(ln(value + 1), 8) AS h, round(log10(value + 1), 8) AS i, round(log2(value + 1), 8) AS j, sign(value - 50) AS k, round(exp(value / 100), 8) AS l, round(pi(), 8) AS m FROM events", "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS b, CAST(floor(value) AS BIGINT) AS c, round(value, 2) AS d, round(sqrt(value), 8) AS e, round(cbrt(value), 8) AS f, round(power(value, 2), 4) AS g, round(ln(value + 1), 8) AS h, round(log10(value + 1), 8) AS i, round(log2(value + 1), 8) AS j, CAST(sign(value - 50) AS DOUBLE) AS k, round(exp(value / 100), 8) AS l, round(pi(), 8) AS m FROM events"),
    "join_unnest": ("SELECT event_id, x FROM events LATERAL VIEW explode(array(user_id, event_id)) t AS x", "SELECT event_id, unnest([user_id, event_id]) AS x FROM events"),
    "percentile": ("SELECT event_type, round(percentile(value, 0.9), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p FROM events GROUP BY event_type"),
    "percentile_weighted": ("SELECT event_type, round(percentile(value, 0.5, 1), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p FROM events GROUP BY event_type"),
    "agg_approx": ("SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near, abs(percentile_approx(value, 0.5, 10000) - median(value)) < 2 AS mid FROM events GROUP BY event_type", "SELECT DISTINCT event_type, true AS near, true AS mid FROM events"),
    "agg_first_last": ("SELECT user_id, min_by(value, struct(ts, event_id)) AS f, max_by(value, struct(ts, event_id)) AS l FROM events GROUP BY user_id", "SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY user_id"),
    "agg_lists": ("SELECT event_type, array_join(transform(array_sort(collect_set(user_id)), x -> CAST(x AS STRING)), ',') AS users, listagg(DISTINCT CAST(user_id % 3 AS STRING), '|') WITHIN GROUP (ORDER BY CAST(user_id % 3 AS STRING)) AS mods FROM events GROUP BY event_type", "SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users, string_agg(DISTINCT CAST(user_id % 3 AS VARCHAR), '|' ORDER BY CAST(user_id % 3 AS VARCHAR)) AS mods FROM events GROUP BY event_type"),
    "agg_regr_sums": ("SELECT event_type, round(regr_sxx(value, user_id), 2) AS sxx, round(regr_syy(value, user_id), 2) AS syy, round(regr_sxy(value, user_id), 2) AS sxy FROM events GROUP BY event_type",) * 2,
    "win_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events"),
    "win_groups_frame": ("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events)", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events"),
    "fn_string_find": ("SELECT p_partkey, instr(p_name, 'a') AS a, position('e' IN p_name) AS b, startswith(p_name, 'a') AS c, endswith(p_name, 'e') AS d, overlay(p_brand PLACING 'XX' FROM 2 FOR 3) AS e, initcap(p_brand) AS f, hex(255) AS g, substring_index(p_brand, '#', 1) AS h, find_in_set('b', 'a,b,c') AS i FROM part", "SELECT p_partkey, instr(p_name, 'a') AS a, position('e' IN p_name) AS b, starts_with(p_name, 'a') AS c, ends_with(p_name, 'e') AS d, substr(p_brand, 1, 1) || 'XX' || substr(p_brand, 5) AS e, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS f, 'FF' AS g, split_part(p_brand, '#', 1) AS h, 2 AS i FROM part"),
    "fn_regexp_more": ("SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x') AS a, regexp_count(p_brand, '[0-9]') AS b, regexp_extract_all(p_brand, '([0-9])', 1) AS c, p_name RLIKE '^[a-m]' AS d FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS a, CAST(len(regexp_extract_all(p_brand, '[0-9]')) AS INTEGER) AS b, regexp_extract_all(p_brand, '([0-9])', 1) AS c, regexp_matches(p_name, '^[a-m]') AS d FROM part"),
    "fn_math_more": ("SELECT event_id, CAST(value AS BIGINT) AS a, factorial(CAST(event_id % 10 AS INT)) AS b, round(log(2.0, value + 1), 8) AS c, nanvl(value, 0.0) AS d, round(cot(value + 0.1), 6) AS e, round(asinh(value), 8) AS f, round(acosh(value + 1), 8) AS g, round(atanh(value / 1000), 8) AS h FROM events", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS a, CAST(factorial(CAST(event_id % 10 AS INT)) AS BIGINT) AS b, round(log2(value + 1), 8) AS c, value AS d, round(cot(value + 0.1), 6) AS e, round(asinh(value), 8) AS f, round(acosh(value + 1), 8) AS g, round(atanh(value / 1000), 8) AS h FROM events"),
    "fn_date_parts": ("SELECT event_id, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS m, extract(DAY FROM ts) AS d, extract(HOUR FROM ts) AS h, dayofweek(ts) - 1 AS w, date_trunc('DAY', ts) AS t, make_date(2024, 2, 3) AS f, to_date('2024-03-04') AS g FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(dayofweek(ts) AS INTEGER) AS w, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, make_date(2024, 2, 3) AS f, DATE '2024-03-04' AS g FROM events"),
    "fn_time_convert": ("SELECT event_id, CAST(timestamp_seconds(event_id) AS TIMESTAMP_NTZ) AS a, CAST(timestamp_millis(event_id) AS TIMESTAMP_NTZ) AS b, CAST(timestamp_micros(event_id) AS TIMESTAMP_NTZ) AS c, date_format(ts, 'yyyy/MM/dd HH:mm') AS d, from_unixtime(event_id, 'yyyy-MM-dd HH:mm:ss') AS e, unix_timestamp(CAST(ts AS TIMESTAMP)) AS f FROM events", "SELECT event_id, CAST(make_timestamp(event_id * 1000000) AS TIMESTAMP) AS a, make_timestamp(event_id * 1000) AS b, make_timestamp(event_id) AS c, strftime(ts, '%Y/%m/%d %H:%M') AS d, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS e, epoch_us(ts) // 1000000 AS f FROM events"),
    "fn_interval": ("SELECT event_id, ts + INTERVAL 90 MINUTES AS a, ts - INTERVAL 2 DAYS AS b, CAST(extract(DAY FROM ts - TIMESTAMP_NTZ '2024-01-01') AS INT) AS c FROM events", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 2 DAY AS b, CAST(epoch_us(ts) // 86400000000 - epoch_us(TIMESTAMP '2024-01-01') // 86400000000 AS INTEGER) AS c FROM events"),
    "fn_nvl": ("SELECT event_id, nvl(NULL, value) AS a, nvl2(value, 1, 2) AS b, ifnull(NULL, 3) AS c FROM events", "SELECT event_id, value AS a, 1 AS b, 3 AS c FROM events"),
    "fn_array_build": ("SELECT event_id, size(array(user_id, event_id, 7)) AS a, element_at(array(user_id, event_id), 2) AS b, slice(array(1, 2, 3, 4), 2, 2) AS c, sequence(1, 4) AS d, flatten(array(array(1), array(2, 3))) AS e, cardinality(array(1, 2)) AS f FROM events", "SELECT event_id, 3 AS a, event_id AS b, [2, 3] AS c, [1, 2, 3, 4] AS d, [1, 2, 3] AS e, 2 AS f FROM events"),
    "fn_array_edit": ("SELECT event_id, array_append(array(1, 2), 3) AS a, array_prepend(array(1, 2), 0) AS b, concat(array(1), array(2)) AS c, array_remove(array(1, 2, 1), 1) AS d, array_distinct(array(1, 2, 1)) AS e, array_sort(array(3, 1, 2)) AS f, array_repeat(5, 2) AS g, reverse(array(1, 2)) AS h, transform(array(1, 2, 1), x -> CASE WHEN x = 1 THEN 9 ELSE x END) AS i FROM events", "SELECT event_id, list_append([1, 2], 3) AS a, list_prepend(0, [1, 2]) AS b, [1, 2] AS c, [2] AS d, [1, 2] AS e, list_sort([3, 1, 2]) AS f, [5, 5] AS g, list_reverse([1, 2]) AS h, list_transform([1, 2, 1], lambda x: CASE WHEN x = 1 THEN 9 ELSE x END) AS i FROM events"),
    "fn_array_sets": ("SELECT event_id, array_contains(array(user_id, 3), 3) AS a, arrays_overlap(array(1, 2), array(2, 5)) AS b, array_position(array(4, 5), 5) AS c, array_union(array(1, 2), array(2, 3)) AS d, array_intersect(array(1, 2), array(2, 3)) AS e, array_except(array(1, 2), array(2)) AS f, array_join(array('a', 'b'), '-') AS g, split('a,b', ',') AS h FROM events", "SELECT event_id, true AS a, true AS b, CAST(2 AS BIGINT) AS c, [1, 2, 3] AS d, [2] AS e, [1] AS f, 'a-b' AS g, ['a', 'b'] AS h FROM events"),
    "fn_unnest": ("SELECT user_id, pos, x FROM (SELECT DISTINCT user_id FROM events) LATERAL VIEW posexplode(array(user_id, user_id + 1)) t AS pos, x", "SELECT user_id, unnest([0, 1]) AS pos, unnest([user_id, user_id + 1]) AS x FROM (SELECT DISTINCT user_id FROM events)"),
    "fn_map": ("SELECT event_id, element_at(map('a', user_id, 'b', event_id), 'b') AS a, map_keys(map('a', 1, 'b', 2)) AS b, map_values(map('a', 1, 'b', 2)) AS c FROM events", "SELECT event_id, event_id AS a, ['a', 'b'] AS b, [1, 2] AS c FROM events"),
    "fn_struct": ("SELECT event_id, named_struct('u', user_id, 'v', value).u AS a, struct(user_id, value).value AS b FROM events", "SELECT event_id, user_id AS a, value AS b FROM events"),
    "fn_sha": ("SELECT p_partkey, sha2(p_name, 256) AS a FROM part", "SELECT p_partkey, sha256(p_name) AS a FROM part"),
    "fn_typeof": ("SELECT DISTINCT typeof(value) AS a, typeof(user_id) AS b FROM events", "SELECT DISTINCT 'double' AS a, 'bigint' AS b FROM events"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS a, from_json(props, 'k BIGINT').k AS b, to_json(named_struct('k', user_id)) AS c FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, '{\"k\":' || user_id || '}' AS c FROM events"),
    "fn_gcd": ("WITH RECURSIVE g(k, a, b) AS (SELECT p_partkey, p_partkey, CAST(p_size AS BIGINT) FROM part WHERE p_partkey <= 50 UNION ALL SELECT k, b, a % b FROM g WHERE b <> 0) SELECT k, a AS gcd FROM g WHERE b = 0", "SELECT p_partkey AS k, gcd(p_partkey, p_size) AS gcd FROM part WHERE p_partkey <= 50"),
    "fn_now": ("SELECT count(*) AS n FROM events WHERE ts > now() - INTERVAL 1 HOUR", "SELECT count(*) AS n FROM events WHERE ts > CAST(now() AS TIMESTAMP) - INTERVAL 1 HOUR"),
}

FAMILIES: dict[str, tuple[str, str | None]] = {k: (v, v) for k, v in BOTH.items()} | PAIRS
