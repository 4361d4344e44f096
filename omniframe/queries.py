"""The engine's registered queries: text in the query language, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe import queries_functions
from omniframe.engine import star
from omniframe.operators import fulltext, graph
from omniframe.plans.catalog import Edge
from omniframe.streaming import live, views

#: name: (query, equivalent SQL)
TEXTS: dict[str, tuple[str, str | None]] = {
    "group_multi": (
        "SELECT l_returnflag, l_linestatus, math::fixed(math::sum(l_quantity), 2) AS sum_qty, math::fixed(math::mean(l_discount), 6) AS avg_disc, count() AS n FROM lineitem WHERE l_shipdate <= d'1998-09-02T00:00:00Z' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    ),
    "scan_where": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000"),
    "scan_record_id": ("SELECT o_orderkey, o_orderstatus FROM orders:7", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    "scan_record_range": ("SELECT o_orderkey, o_orderstatus FROM orders:10..=20", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 10 AND 20"),
    "scan_union_index": ("SELECT o_orderkey FROM orders WHERE o_custkey = 5 OR o_custkey = 7 OR o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 7) OR o_orderstatus = 'P'"),
    "scan_count": ("SELECT count() AS n FROM lineitem GROUP ALL", "SELECT count(*) AS n FROM lineitem"),
    "scan_index_count": ("SELECT count() AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP ALL", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "source_array": ("SELECT value * 2 AS x FROM [1, 2, 3]", "SELECT unnest([2, 4, 6])::BIGINT AS x"),
    "source_range": ("SELECT value AS x FROM 1..=5", "SELECT unnest(range(1, 6)) AS x"),
    "source_mock": ("SELECT id FROM |person:1..3|", "SELECT 'person:' || x AS id FROM (SELECT unnest([1, 2, 3]) AS x)"),
    "source_subquery": ("SELECT o_custkey, n FROM (SELECT o_custkey, count() AS n FROM orders GROUP BY o_custkey) WHERE n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "where_truthy": ("SELECT doc_id, toxic FROM labels WHERE toxic", "SELECT doc_id, toxic FROM labels WHERE toxic <> 0"),
    "where_in": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ['1-URGENT', '2-HIGH']", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "where_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ['1-URGENT', '2-HIGH']", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "where_range": ("SELECT o_orderkey FROM orders WHERE o_totalprice IN 1000..=50000 AND o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'F'"),
    "where_regex": ("SELECT c_custkey FROM customer WHERE c_name = /0{5}[0-9]7$/", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0{5}[0-9]7$')"),
    "contains_any": ("SELECT doc_id FROM documents WHERE string::words(text) CONTAINSANY ['the', 'der']", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(text, '\\s+'), ['the', 'der'])"),
    "contains_all": ("SELECT doc_id FROM documents WHERE string::words(text) CONTAINSALL ['the', 'and']", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(text, '\\s+'), ['the', 'and'])"),
    "contains_none": ("SELECT doc_id FROM documents WHERE string::words(text) CONTAINSNONE ['the', 'and']", "SELECT doc_id FROM documents WHERE NOT list_has_any(regexp_split_to_array(text, '\\s+'), ['the', 'and'])"),
    "contains_text": ("SELECT doc_id FROM documents WHERE text CONTAINS 'the and' AND lang INSIDE ['en', 'de']", "SELECT doc_id FROM documents WHERE contains(text, 'the and') AND lang IN ('en', 'de')"),
    "ternary_coalesce": ("SELECT event_id, value ?: 0 AS a, value ?? 0 AS b FROM events", "SELECT event_id, CASE WHEN value <> 0 THEN value ELSE 0 END AS a, coalesce(value, 0) AS b FROM events"),
    "if_else": ("SELECT o_orderkey, IF o_totalprice > 300000 THEN 'big' ELSE IF o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders"),
    "operators": ("SELECT l_orderkey, l_linenumber, l_partkey, math::fixed(l_quantity * l_extendedprice * (1 - l_discount) / 3, 4) AS a, l_partkey / 7 AS b, l_partkey % 7 AS c, l_linenumber ** 2 AS d, -l_partkey AS e, !(l_quantity > 10) AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice * (1 - l_discount) / 3, 4) AS a, l_partkey // 7 AS b, l_partkey % 7 AS c, CAST(l_linenumber * l_linenumber AS BIGINT) AS d, -l_partkey AS e, NOT (l_quantity > 10) AS f FROM lineitem"),
    "compare_none": ("SELECT event_id, missing < 5 AS a, missing = NONE AS b, value > missing AS c FROM events", "SELECT event_id, true AS a, true AS b, true AS c FROM events"),
    "project_value": ("SELECT VALUE o_totalprice FROM orders WHERE o_orderstatus = 'F'", "SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "omit": ("SELECT * OMIT l_tax, l_shipdate FROM lineitem", "SELECT * EXCLUDE (l_tax, l_shipdate) FROM lineitem"),
    "group_all": ("SELECT count() AS n, math::sum(l_quantity) AS q FROM lineitem GROUP ALL", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem"),
    "group_empty": ("SELECT count() AS n, math::sum(l_quantity) AS q FROM lineitem WHERE l_quantity < 0 GROUP ALL", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS q"),
    "group_expr": ("SELECT time::year(o_orderdate) AS y, count() AS n FROM orders GROUP BY y", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL"),
    "count_truthy": ("SELECT user_id, count(value > 100) AS n FROM events GROUP BY user_id", "SELECT user_id, count(*) FILTER (value > 100) AS n FROM events GROUP BY user_id"),
    "agg_composed": ("SELECT user_id, math::fixed(math::sum(value) + math::mean(value), 4) AS x, math::max(value) - math::min(value) AS spread FROM events GROUP BY user_id", "SELECT user_id, round(sum(value) + avg(value), 4) AS x, max(value) - min(value) AS spread FROM events GROUP BY user_id"),
    "stats": ("SELECT event_type, math::fixed(math::stddev(value), 6) AS s, math::fixed(math::variance(value), 4) AS v, math::fixed(math::median(value), 6) AS m FROM events GROUP BY event_type", "SELECT event_type, round(coalesce(stddev_samp(value), 0), 6) AS s, round(coalesce(var_samp(value), 0), 4) AS v, round(median(value), 6) AS m FROM events GROUP BY event_type"),
    "implicit_array_group": ("SELECT user_id, array::join(event_type, ',') AS types FROM events GROUP BY user_id", "SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS types FROM events GROUP BY user_id"),
    "array_group_len": ("SELECT o_custkey, array::len(array::group(o_orderkey)) AS n, array::first(o_orderkey) AS f FROM orders GROUP BY o_custkey", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY o_custkey"),
    "array_distinct_agg": ("SELECT o_custkey, array::join(array::sort(array::distinct(o_orderpriority)), '|') AS p FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS p FROM orders GROUP BY o_custkey"),
    "array_join_agg": ("SELECT o_custkey, array::join(o_orderstatus, '-') AS s FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderstatus, '-' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey"),
    "time_min_max": ("SELECT o_orderstatus, time::unix(time::min(o_orderdate)) AS a, time::unix(time::max(o_orderdate)) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(epoch(min(o_orderdate)) AS BIGINT) AS a, CAST(epoch(max(o_orderdate)) AS BIGINT) AS b FROM orders GROUP BY o_orderstatus"),
    "split_words": ("SELECT w, count() AS n FROM (SELECT doc_id, string::words(text) AS w FROM documents SPLIT w) WHERE w != NONE GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text, ' \n\t'), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w"),
    "order_multi": ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25"),
    "order_numeric": ("SELECT c_name FROM customer ORDER BY c_name NUMERIC DESC LIMIT 20", "SELECT c_name FROM customer ORDER BY c_name DESC LIMIT 20"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "start_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 START 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "order_rand": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY RAND()", "SELECT o_orderkey, o_custkey FROM orders"),
    "union_sources": ("SELECT (s_acctbal ?? c_acctbal) AS b FROM supplier, customer", "SELECT s_acctbal AS b FROM supplier UNION ALL SELECT c_acctbal FROM customer"),
    "link_1": ("SELECT o_orderkey, o_custkey.c_name AS name FROM orders", "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "link_3": ("SELECT o_orderkey, o_custkey.c_nationkey.n_regionkey.r_name AS region FROM orders", "SELECT o_orderkey, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "link_where_group": ("SELECT o_custkey.c_mktsegment AS seg, count() AS n, math::fixed(math::sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey.c_nationkey.n_name != 'FRANCE' GROUP BY seg", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS DISTINCT FROM 'FRANCE' GROUP BY seg"),
    "fetch_customer": ("SELECT o_orderkey, o_custkey.c_name AS name, o_custkey.c_acctbal AS bal FROM (SELECT o_orderkey, o_custkey FROM orders FETCH o_custkey)", "SELECT o_orderkey, c_name AS name, c_acctbal AS bal FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "graph_out": ("SELECT o_orderkey, array::join(->lineitem->part.p_brand, ',') AS brands FROM orders", "SELECT o_orderkey, coalesce(string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), '') AS brands FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    "graph_in": ("SELECT p_partkey, array::len(<-lineitem<-orders) AS n, math::fixed(math::sum(<-lineitem<-orders.o_totalprice), 2) AS total FROM part", "SELECT p_partkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM part LEFT JOIN (lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey GROUP BY p_partkey"),
    "graph_both": ("SELECT p_partkey, count(<->lineitem) AS n FROM part", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) + (SELECT count(*) FROM lineitem WHERE l_orderkey = p_partkey) AS n FROM part"),
    "graph_filter": ("SELECT o_orderkey, array::join(array::sort(->(lineitem WHERE l_quantity > 30)->part.p_size), ',') AS s, array::len(->(lineitem WHERE l_quantity > 30)) AS n FROM orders", "SELECT o_orderkey, coalesce(array_to_string(list_sort(list(p_size) FILTER (p_size IS NOT NULL)), ','), '') AS s, count(l_orderkey) AS n FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > 30) ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    "graph_filter_sum": ("SELECT o_orderkey, math::sum(->(lineitem WHERE l_quantity > 30)->part.p_size) AS s FROM orders", "SELECT o_orderkey, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS s FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > 30) ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    "graph_edge_fields": ("SELECT o_orderkey, math::fixed(math::sum(->lineitem.l_extendedprice), 2) AS total FROM orders", "SELECT o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "graph_two_hops": ("SELECT p_partkey, array::len(array::distinct(<-lineitem<-orders->lineitem->part)) AS n FROM part", "SELECT p_partkey, count(DISTINCT b.l_partkey) AS n FROM part LEFT JOIN (lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey) ON a.l_partkey = p_partkey GROUP BY p_partkey"),
    "edge_exists": ("SELECT o_orderkey FROM orders WHERE count(->lineitem) > 0", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "edge_missing": ("SELECT o_orderkey FROM orders WHERE count(->lineitem) = 0", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "edge_degree": ("SELECT o_orderkey, count(->lineitem) AS n FROM orders WHERE count(->lineitem) > 5", "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5"),
    "ref_back": ("SELECT c_custkey, count(<~orders) AS n FROM customer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT VALUE c_custkey FROM customer WHERE c_acctbal > 5000)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT VALUE o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "correlated_sub": ("SELECT c_custkey, (SELECT VALUE math::max(o_totalprice) FROM orders WHERE o_custkey = $parent.c_custkey GROUP ALL)[0] AS best FROM customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer"),
    "correlated_topk": ("SELECT c_custkey, (SELECT VALUE o_orderkey FROM orders WHERE o_custkey = $parent.c_custkey AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1)[0] AS first FROM customer", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS first FROM customer"),
    "scalar_sub": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT VALUE math::mean(o_totalprice) FROM orders GROUP ALL)[0] * 1.5", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5"),
    "json_path": ("SELECT event_id, <int>props.k AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "let_param": ("LET $least = 200000; SELECT o_orderkey FROM orders WHERE o_totalprice > $least", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "user_function": ("DEFINE FUNCTION fn::net($price: float, $off: float) -> float { RETURN $price * (1 - $off); }; SELECT l_orderkey, l_linenumber, math::fixed(fn::net(l_extendedprice, l_discount), 4) AS net FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"),
    "knn_filter": ("SELECT vec_id, math::fixed(vector::distance::knn(), 5) AS d FROM embeddings WHERE embedding <|10,EUCLIDEAN|> (SELECT VALUE embedding FROM embeddings:0)[0] AND label = 5", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 5) AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE label = 5 ORDER BY sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), vec_id LIMIT 10"),
    "matches_and": ("SELECT doc_id FROM documents WHERE text @@ 'the and'", "SELECT doc_id FROM documents WHERE list_has_all(list_transform(regexp_extract_all(text, '\\S+'), lambda x: lower(x)), ['the', 'and'])"),
    "matches_or": ("SELECT doc_id FROM documents WHERE text @OR@ 'idiot clown'", "SELECT doc_id FROM documents WHERE list_has_any(list_transform(regexp_extract_all(text, '\\S+'), lambda x: lower(x)), ['idiot', 'clown'])"),
    "analyzer_tokens": ("DEFINE ANALYZER simple TOKENIZERS class FILTERS lowercase; SELECT doc_id, array::len(search::analyze('simple', text)) AS n FROM documents", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}]+|[\\p{N}]+|[\\p{P}\\p{S}]')) AS n FROM documents"),
    # scalar families
    "fn_math": ("SELECT l_orderkey, l_linenumber, l_partkey, math::abs(l_partkey - 100) AS a, math::ceil(l_discount * 10) AS c, math::floor(l_discount * 10) AS f, math::fixed(math::sqrt(l_quantity), 6) AS s, math::fixed(math::ln(l_quantity), 6) AS l, math::fixed(math::log10(l_quantity), 6) AS l10, math::clamp(l_quantity, 10, 20) AS k, math::fixed(math::sin(l_quantity) + math::cos(l_quantity), 6) AS t, math::sign(l_partkey - 100) AS g, math::fixed(math::deg2rad(l_quantity), 6) AS r, math::lerp(0.0, 10.0, 0.5) AS p FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_partkey - 100) AS a, ceil(l_discount * 10) AS c, floor(l_discount * 10) AS f, round(sqrt(l_quantity), 6) AS s, round(ln(l_quantity), 6) AS l, round(log10(l_quantity), 6) AS l10, least(greatest(l_quantity, 10), 20)::DOUBLE AS k, round(sin(l_quantity) + cos(l_quantity), 6) AS t, CAST(sign(l_partkey - 100) AS BIGINT) AS g, round(radians(l_quantity), 6) AS r, 5.0::DOUBLE AS p FROM lineitem"),
    "fn_math_array": ("SELECT user_id, math::fixed(math::percentile(value, 90), 8) AS p90, math::fixed(math::interquartile(value), 8) AS iqr, math::fixed(math::trimean(value), 8) AS tri, math::spread(value) AS spread, math::fixed(math::midhinge(value), 8) AS hinge FROM (SELECT user_id, array::group(value) AS value FROM events GROUP BY user_id)", "SELECT user_id, round(quantile_cont(value, 0.9), 8) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr, round(((quantile_cont(value, 0.75) + quantile_cont(value, 0.25)) / 2 + quantile_cont(value, 0.5)) / 2, 8) AS tri, max(value) - min(value) AS spread, round((quantile_cont(value, 0.75) + quantile_cont(value, 0.25)) / 2, 8) AS hinge FROM events GROUP BY user_id"),
    "fn_string": ("SELECT c_custkey, string::uppercase(c_name) AS u, string::lowercase(c_mktsegment) AS l, string::len(c_name) AS n, string::slice(c_name, 0, 8) AS s, string::reverse(c_mktsegment) AS r, string::replace(c_name, '#', '-') AS p, string::starts_with(c_name, 'Cust') AS w, string::repeat(c_mktsegment, 2) AS d, string::concat(c_mktsegment, ':', c_custkey) AS k, string::split(c_name, '#')[1] AS f, string::distance::levenshtein(c_mktsegment, 'BUILDING') AS lev FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substr(c_name, 1, 8) AS s, reverse(c_mktsegment) AS r, replace(c_name, '#', '-') AS p, starts_with(c_name, 'Cust') AS w, repeat(c_mktsegment, 2) AS d, c_mktsegment || ':' || c_custkey AS k, split_part(c_name, '#', 2) AS f, levenshtein(c_mktsegment, 'BUILDING') AS lev FROM customer"),
    "fn_string_is": ("SELECT page_id, string::is_url(url) AS u, string::is_email('a@b.com') AS e, string::is_ipv4('1.2.3.4') AS i, string::is_alpha('abc') AS a, string::is_numeric('123') AS n, string::is_semver('1.2.3') AS v, string::is_uuid('x') AS x, string::is_hexadecimal('ff0') AS h FROM pages", "SELECT page_id, true AS u, true AS e, true AS i, true AS a, true AS n, true AS v, false AS x, true AS h FROM pages"),
    "fn_string_similarity": ("SELECT c_custkey, string::distance::damerau_levenshtein(c_mktsegment, 'MACHIENRY') AS d, math::fixed(string::similarity::jaro_winkler(c_mktsegment, 'MACHINERY'), 6) AS j FROM customer", "SELECT c_custkey, damerau_levenshtein(c_mktsegment, 'MACHIENRY') AS d, round(jaro_winkler_similarity(c_mktsegment, 'MACHINERY'), 6) AS j FROM customer"),
    "fn_time": ("SELECT event_id, time::year(ts) AS y, time::month(ts) AS m, time::day(ts) AS d, time::hour(ts) AS h, time::minute(ts) AS mi, time::wday(ts) AS w, time::week(ts) AS k, time::yday(ts) AS yd, time::unix(ts) AS u, time::unix(time::floor(ts, 1h)) AS f, time::unix(time::group(ts, 'month')) AS g, time::format(ts, '%Y/%m/%d %H:%M') AS t FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, isodow(ts) AS w, week(ts) AS k, dayofyear(ts) AS yd, CAST(floor(epoch(ts)) AS BIGINT) AS u, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS f, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS g, strftime(ts, '%Y/%m/%d %H:%M') AS t FROM events"),
    "fn_array": ("SELECT vec_id, array::len(embedding) AS n, math::fixed(array::max(embedding), 5) AS mx, array::len(array::windows(embedding, 4)) AS w, array::len(array::clump(embedding, 5)) AS c, array::len(array::filter(embedding, |$x| $x > 0)) AS pos, array::any(embedding, |$x| $x > 0.3) AS any, array::all(embedding, |$x| $x < 1) AS every, array::find_index(embedding, |$x| $x > 0) AS fi FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 5) AS mx, len(embedding) - 3 AS w, CAST(ceil(len(embedding) / 5.0) AS BIGINT) AS c, len(list_filter(embedding, lambda x: x > 0)) AS pos, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any, len(list_filter(embedding, lambda x: x >= 1)) = 0 AS every, list_position(list_transform(embedding, lambda x: x > 0), true) - 1 AS fi FROM embeddings"),
    "fn_array_words": ("SELECT doc_id, array::len(array::distinct(string::words(text))) AS d, array::first(string::words(text)) AS f, array::last(string::words(text)) AS l, array::join(array::slice(array::sort(array::distinct(string::words(text))), 0, 3), ' ') AS s, array::fold(string::words(text), 0, |$a, $w| $a + string::len($w)) AS chars FROM documents", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, len(list_distinct(w)) AS d, w[1] AS f, w[-1] AS l, array_to_string(list_sort(list_distinct(w))[1:3], ' ') AS s, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS chars FROM w"),
    "fn_set": ("SELECT doc_id, set::len(set::union(array::distinct(string::words(lang)), ['en', 'xx'])) AS u, set::len(set::intersect([lang], ['en', 'de'])) AS i, set::len(set::difference([lang], ['en'])) AS d, set::contains([lang], 'fr') AS c FROM documents", "SELECT doc_id, len(list_distinct(list_concat([lang], ['en', 'xx']))) AS u, CAST(lang IN ('en', 'de') AS BIGINT) AS i, CASE WHEN lang = 'en' THEN 0 ELSE 2 END::BIGINT AS d, lang = 'fr' AS c FROM documents"),
    "fn_vector": ("SELECT vec_id, math::fixed(vector::magnitude(embedding), 5) AS m, math::fixed(vector::dot(embedding, vector::scale(embedding, 2.0)), 5) AS d, math::fixed(vector::similarity::cosine(embedding, array::reverse(embedding)), 5) AS c, math::fixed(vector::distance::manhattan(embedding, array::reverse(embedding)), 5) AS h FROM embeddings", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS m, round(list_sum(list_transform(v, lambda x: x * x * 2)), 5) AS d, round(list_cosine_similarity(v, list_reverse(v)), 5) AS c, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: abs(p[1] - p[2]))), 5) AS h FROM e"),
    "fn_parse": ("SELECT page_id, parse::url::host(url) AS h, parse::url::path(url) AS p, parse::url::scheme(url) AS s, parse::url::query(url) AS q, parse::url::fragment(url) AS f, parse::url::port(url) AS o FROM pages", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^([a-z]+):', 1) AS s, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q, nullif(regexp_extract(url, '#(.*)$', 1), '') AS f, CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END::BIGINT AS o FROM pages"),
    "fn_type": ("SELECT event_id, type::of(value) AS a, type::is_string(event_type) AS b, type::is_int(user_id) AS c, <string>user_id AS d, <int>value AS e, type::is_datetime(ts) AS f, type::of([1]) AS g FROM events", "SELECT event_id, 'float' AS a, true AS b, true AS c, CAST(user_id AS VARCHAR) AS d, CAST(trunc(value) AS BIGINT) AS e, true AS f, 'array' AS g FROM events"),
    "fn_duration": ("SELECT event_id, duration::hours(1d3h) AS h, duration::secs(90m) AS s, duration::days(duration::from_hours(user_id)) AS d, time::unix(ts + 1h30m) AS t FROM events", "SELECT event_id, 27::BIGINT AS h, 5400::BIGINT AS s, user_id // 24 AS d, CAST(floor(epoch(ts)) + 5400 AS BIGINT) AS t FROM events"),
    "fn_crypto": ("SELECT c_custkey, crypto::md5(c_name) AS m, crypto::sha256(c_name) AS s, crypto::sha1(c_name) AS a FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS a FROM customer"),
    "fn_encoding": ("SELECT c_custkey, encoding::base64::encode(c_name) AS b, encoding::json::encode({ k: c_custkey, s: c_mktsegment }) AS j FROM customer", "SELECT c_custkey, rtrim(to_base64(encode(c_name)), '=') AS b, '{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS j FROM customer"),
    "fn_object": ("SELECT c_custkey, array::join(object::keys({ b: c_name, a: c_custkey }), ',') AS k, object::len({ b: 1, a: 2 }) AS n, { a: { b: c_custkey } }.a.b AS v FROM customer", "SELECT c_custkey, 'a,b' AS k, 2::BIGINT AS n, c_custkey AS v FROM customer"),
    "fn_geo": ("SELECT c_custkey, math::fixed(geo::distance((0.0, 0.0), (c_acctbal / 1000, 1.0)), 3) AS d FROM customer", "SELECT c_custkey, round(6371008.8 * 2 * asin(least(1, sqrt(pow(sin(radians(1.0) / 2), 2) + cos(radians(1.0)) * pow(sin(radians(c_acctbal / 1000) / 2), 2)))), 3) AS d FROM customer"),
    "method_chain": ("SELECT c_custkey, c_name.uppercase().slice(0, 4).len() AS n, [3, 1, 2].sort().map(|$x| $x * 10).first() AS f, c_acctbal.abs().floor() AS a FROM customer", "SELECT c_custkey, 4::BIGINT AS n, 10::BIGINT AS f, floor(abs(c_acctbal)) AS a FROM customer"),
    "closure_path": ("SELECT o_orderkey, math::sum([1, 2, 3, 4][WHERE $this > 2]) AS s, array::map([1, 2], |$x| $x + o_orderkey)[1] AS m FROM orders", "SELECT o_orderkey, 7::BIGINT AS s, o_orderkey + 2 AS m FROM orders"),
}

_METRICS = {
    "euclidean": "sqrt(list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "manhattan": "list_sum(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_cosine_similarity(a, b)",
    "minkowski 3": "pow(list_sum(list_transform(z, lambda p: pow(abs(p[1] - p[2]), 3))), 1.0 / 3)",
    "hamming": "len(list_filter(z, lambda p: p[1] <> p[2]))",
    "pearson": "1 - (len(z) * list_sum(list_transform(z, lambda p: p[1] * p[2])) - list_sum(a) * list_sum(b)) / sqrt((len(z) * list_sum(list_transform(a, lambda x: x * x)) - list_sum(a) * list_sum(a)) * (len(z) * list_sum(list_transform(b, lambda x: x * x)) - list_sum(b) * list_sum(b)))",
}
for _m, _sql in _METRICS.items():
    _show = "math::fixed(vector::distance::knn(), 5)"
    TEXTS[f"knn_{_m.split()[0]}"] = (
        f"SELECT vec_id, {_show} AS d FROM embeddings WHERE embedding <|10,{_m.upper()}|> (SELECT VALUE embedding FROM embeddings:0)[0]",
        f"WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS b FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, b, list_zip(list_transform(embedding, lambda x: x::DOUBLE), b) AS z FROM embeddings, q) SELECT vec_id, round(({_sql})::DOUBLE, 5) AS d FROM e ORDER BY ({_sql}), vec_id LIMIT 10",
    )

_BM25 = """WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\S+'), lambda x: lower(x)) AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, count(*) FILTER (list_contains(w, 'idiot')) AS d1, count(*) FILTER (list_contains(w, 'clown')) AS d2 FROM t),
f AS (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'idiot')) AS f1, len(list_filter(w, lambda x: x = 'clown')) AS f2 FROM t),
r AS (SELECT doc_id, greatest(0, ln((n - d1 + 0.5) / (d1 + 0.5))) * 2.2 * (1 + ln(f1)) / (1 + ln(f1) + 1.2 * (0.25 + 0.75 * size / mean)) + greatest(0, ln((n - d2 + 0.5) / (d2 + 0.5))) * 2.2 * (1 + ln(f2)) / (1 + ln(f2) + 1.2 * (0.25 + 0.75 * size / mean)) AS x FROM f, s WHERE f1 > 0 AND f2 > 0)
SELECT doc_id, round(x, 3) AS score FROM r"""
TEXTS["bm25"] = ("SELECT doc_id, math::fixed(search::score(1), 3) AS score FROM documents WHERE text @1@ 'idiot clown'", _BM25)

# hops up the tree k -> k div 2 over the parts' keys
_TREE = "SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1"
_WALK = f"""WITH RECURSIVE h AS ({_TREE}), w(start, node, depth, path) AS (
SELECT p_partkey, p_partkey, 0, [p_partkey] FROM part
UNION ALL SELECT start, h.b, depth + 1, list_append(path, h.b) FROM w JOIN h ON w.node = h.a WHERE depth < {{depth}})"""


def _hops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    hop = part.filter("p_partkey > 1").selectExpr("p_partkey AS _from", "p_partkey div 2 AS _to")
    return part, hop


def recurse_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurse(*_hops(spark, sf_dir), "collect")


def recurse_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurse(*_hops(spark, sf_dir), "default", 3, 3)


def recurse_dead_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurse(*_hops(spark, sf_dir), "default")


def recurse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.recurse(*_hops(spark, sf_dir), "path", inclusive=True)
    return out.select("start", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def recurse_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.recurse(*_hops(spark, sf_dir), "shortest", target=3)
    return out.select("start", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def recurse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels below each start, downwards."""
    starts, up = _hops(spark, sf_dir)
    out = graph.tree(starts, up.selectExpr("_to AS _from", "_from AS _to"), 2)
    return out.select("start", F.size("tree.children").alias("kids"), F.size(F.flatten("tree.children.children")).alias("grandkids"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = star(spark, sf_dir)
    words = e.sql("SELECT doc_id, search::score(1) AS score FROM documents WHERE text @1@ 'idiot clown'")
    long = e.sql("SELECT doc_id, n_chars AS size FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200")
    return words, long


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fulltext.rrf(list(_ranked(spark, sf_dir)), "doc_id", [("score", True), ("size", True)], 60, 20)
    return out.select("doc_id", F.round("rrf_score", 6).alias("rrf_score"))


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fulltext.linear(list(_ranked(spark, sf_dir)), "doc_id", ["score", "size"], [0.7, 0.3], "minmax", 20)
    return out.select("doc_id", F.round("linear_score", 3).alias("linear_score"))


def _written(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Statements on a copy of the tables; the last one reads."""
    return lambda spark, sf_dir: star(spark, sf_dir).sql(text)


WRITES: dict[str, tuple[str, str]] = {
    "dml_update": ("UPDATE customer SET c_acctbal += 100, c_name = string::uppercase(c_name) WHERE c_mktsegment = 'BUILDING' RETURN NONE; SELECT c_custkey, c_name, math::fixed(c_acctbal, 2) AS bal FROM customer", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS bal FROM customer"),
    "dml_delete": ("DELETE customer WHERE c_acctbal < 0; SELECT c_custkey, c_acctbal FROM customer", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, true)"),
    "dml_create": ("CREATE customer:-1 SET c_name = 'new', c_acctbal = 1.5; SELECT c_custkey, c_name, c_acctbal FROM customer", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5"),
    "dml_upsert": ("UPSERT customer:1 SET c_name = 'one'; UPSERT customer:-2 SET c_name = 'two'; SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'one' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -2, 'two'"),
    "dml_insert_select": ("INSERT INTO rich (SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 9000); SELECT id, c_name FROM rich", "SELECT 'rich:' || c_custkey AS id, c_name FROM customer WHERE c_acctbal > 9000"),
    "dml_insert_duplicate": ("INSERT INTO customer (SELECT c_custkey, 'again' AS c_name FROM customer:0..5) ON DUPLICATE KEY UPDATE c_name = $input.c_name; SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, CASE WHEN c_custkey BETWEEN 0 AND 4 THEN 'again' ELSE c_name END AS c_name FROM customer"),
    "dml_relate": ("RELATE ['person:a', 'person:b']->likes->['item:x', 'item:y', 'item:z'] SET w = 2; SELECT in, out, w FROM likes", "SELECT a AS \"in\", b AS out, 2::BIGINT AS w FROM (SELECT unnest(['person:a', 'person:b']) AS a), (SELECT unnest(['item:x', 'item:y', 'item:z']) AS b)"),
    "dml_transaction": ("BEGIN; DELETE nation; CANCEL; SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation"),
    "ddl_view": ("DEFINE TABLE by_seg AS SELECT c_mktsegment AS seg, count() AS n FROM customer GROUP BY seg; UPDATE customer SET c_mktsegment = 'ALL' WHERE c_custkey < 100; SELECT seg, n FROM by_seg", "SELECT CASE WHEN c_custkey < 100 THEN 'ALL' ELSE c_mktsegment END AS seg, count(*) AS n FROM customer GROUP BY ALL"),
    "control_flow": ("LET $out = []; FOR $i IN 1..=3 { CREATE step SET v = $i * 10; }; IF 1 < 2 { CREATE step SET v = 99 }; SELECT v FROM step", "SELECT unnest([10, 20, 30, 99])::BIGINT AS v"),
    "change_feed": ("DEFINE TABLE ev CHANGEFEED 1d; CREATE ev:1 SET v = 1; UPDATE ev:1 SET v = 2; DELETE ev:1; SELECT version, op, id FROM $changes", "SELECT * FROM (VALUES (1, 'CREATE', 'ev:1'), (2, 'UPDATE', 'ev:1'), (3, 'DELETE', 'ev:1')) AS t(version, op, id)"),
}


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star(spark, sf_dir)
    e.query(WRITES["change_feed"][0].rpartition(";")[0])
    return e.sql("SHOW CHANGES FOR TABLE ev SINCE 0 LIMIT 100").select("version", "op", "id")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events as a stream of files, and a folder of the stream's own."""
    import uuid

    from omniframe.sources import storage

    e = star(spark, sf_dir)
    home = f"{storage.base(e)}/stream-{uuid.uuid4().hex}"
    rows = e.catalog.tables["events"].df()
    rows.repartition(3, "event_id").write.parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    return stream, home


def view_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view kept up to date from micro-batches of events."""
    stream, home = _batches(spark, sf_dir)
    view = views.View(["event_type"], {"n": ("count", None), "total": ("sum", "value"), "mean": ("mean", "value"), "low": ("min", "value"), "high": ("max", "value"), "sd": ("stddev", "value")}, f"{home}/view")
    view.follow(stream, f"{home}/checkpoint").awaitTermination()
    out = view.read(spark)
    return out.select("event_type", "n", *[F.round(c, 3).alias(c) for c in ("total", "mean", "low", "high", "sd")])


def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live SELECT over the stream of events, appended to a table."""
    stream, home = _batches(spark, sf_dir)
    rows = live.stream(star(spark, sf_dir).catalog, stream, "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50")
    live.notify(rows, f"{home}/checkpoint", lambda batch, _: batch.write.mode("append").parquet(f"{home}/out")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{home}/out")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the stream, with a watermark wide enough for all rows."""
    stream, home = _batches(spark, sf_dir)
    counts = views.windowed(stream, "ts", "1 day", ["event_type"], "60 days")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{home}/out")).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def of_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: star(spark, sf_dir).sql(text)


TEXTS |= queries_functions.TEXTS
WRITES |= queries_functions.STATEMENTS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: of_text(text) for name, (text, _) in TEXTS.items()}
ORACLE: dict[str, str] = {name: sql for name, (_, sql) in TEXTS.items() if sql}
QUERIES |= {name: _written(text) for name, (text, _) in WRITES.items()}
QUERIES |= {f.__name__: f for f in (change_feed, recurse_collect, recurse_default, recurse_dead_end, recurse_path, recurse_shortest, recurse_tree, rrf, linear, view_incremental, live_filter, window_counts)}
ORACLE |= {name: sql for name, (_, sql) in WRITES.items()}
ORACLE |= {
    "recurse_collect": _WALK.format(depth=256) + " SELECT start, node, depth FROM w WHERE depth > 0",
    "recurse_default": _WALK.format(depth=3) + " SELECT start, node FROM w WHERE depth = 3",
    "recurse_dead_end": "SELECT p_partkey AS start, 1::BIGINT AS node FROM part WHERE p_partkey > 1",
    "recurse_path": _WALK.format(depth=256) + " SELECT start, array_to_string(path, '>') AS path FROM w WHERE node = 1 AND depth > 0",
    "recurse_shortest": _WALK.format(depth=256) + " SELECT start, array_to_string(path[2:], '>') AS path FROM w WHERE node = 3 AND depth > 0",
    "recurse_tree": f"WITH h AS ({_TREE}), k AS (SELECT b AS node, count(*) AS n FROM h GROUP BY b), g AS (SELECT y.b AS node, count(*) AS n FROM h x JOIN h y ON x.b = y.a GROUP BY y.b) SELECT p_partkey AS start, coalesce(k.n, 0)::INT AS kids, coalesce(g.n, 0)::INT AS grandkids FROM part LEFT JOIN k ON k.node = p_partkey LEFT JOIN g ON g.node = p_partkey",
    "rrf": f"WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY x DESC, doc_id) AS k FROM ({_BM25.replace('SELECT doc_id, round(x, 3) AS score FROM r', 'SELECT doc_id, x::FLOAT AS x FROM r')})), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents QUALIFY k <= 200) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + k)), 6) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / (60 + k)) DESC, doc_id LIMIT 20",
    "linear": f"WITH a AS (SELECT doc_id, x FROM ({_BM25.replace('SELECT doc_id, round(x, 3) AS score FROM r', 'SELECT doc_id, x FROM r')})), b AS (SELECT doc_id, n_chars AS x FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200), s AS (SELECT doc_id, 0.7 * CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) ELSE 1 END AS v FROM a UNION ALL SELECT doc_id, 0.3 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS v FROM b) SELECT doc_id, round(sum(v), 3) AS linear_score FROM s GROUP BY doc_id ORDER BY sum(v) DESC, doc_id LIMIT 20",
    "view_incremental": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 3) AS mean, round(min(value), 3) AS low, round(max(value), 3) AS high, round(stddev_samp(value), 3) AS sd FROM events GROUP BY event_type",
    "live_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50",
    "window_counts": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN says of a filtered scan: a scan with the filter pushed down and only the columns that are used."""
    e = star(spark, sf_dir)
    said = e.value("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
    ran = e.value("EXPLAIN ANALYZE SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
    found = [("pushed", "GreaterThan(o_totalprice,100000.0)" in said), ("pruned", "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in said), ("analyzed", "Scan parquet" in ran)]
    return spark.createDataFrame(found, "what string, said boolean")


def _many(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """The star with two more edge tables: line items from orders to suppliers, and orders from customers to orders."""
    e = star(spark, sf_dir)
    line, orders = (e.catalog.tables[t] for t in ("lineitem", "orders"))
    e.catalog.add("ships", line.load, edge=Edge("l_orderkey", "orders", "l_suppkey", "supplier"), order=line.order).info["plain_key"] = True
    e.catalog.add("placed", orders.load, key="o_orderkey", edge=Edge("o_custkey", "customer", "o_orderkey", "orders")).info["plain_key"] = True
    return e


def of_many(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _many(spark, sf_dir).sql(text)


#: Walks through several edge tables.
MANY: dict[str, tuple[str, str]] = {
    "graph_many_tables": (
        "SELECT o_orderkey, array::join(->(lineitem, ships)->?, ',') AS ends FROM orders",
        "WITH w AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p, string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(p || ',' || s, '') AS ends FROM orders LEFT JOIN w ON l_orderkey = o_orderkey",
    ),
    "graph_any_table": ("SELECT o_orderkey, count(->?) AS n, math::sum(->?->?.s_nationkey) AS s FROM orders", "SELECT o_orderkey, 2 * count(l_orderkey) AS n, coalesce(sum(s_nationkey), 0)::BIGINT AS s FROM orders LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "graph_named_end": ("SELECT o_orderkey, array::len(->(lineitem, ships)->supplier) AS n FROM orders", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "graph_step_order": (
        "SELECT o_orderkey, array::join(->(lineitem ORDER BY l_quantity DESC LIMIT 2 START 1).l_quantity, ',') AS q FROM orders",
        "SELECT o_orderkey, coalesce(array_to_string(list(l_quantity ORDER BY l_quantity DESC)[2:3], ','), '') AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    ),
    "graph_two_edges": (
        "SELECT c_custkey, math::sum(->placed->orders->(lineitem, ships)->part.p_size) AS s FROM customer",
        "SELECT c_custkey, coalesce(sum(p_size), 0)::BIGINT AS s FROM customer LEFT JOIN (orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) ON o_custkey = c_custkey GROUP BY c_custkey",
    ),
}
QUERIES |= {name: of_many(text) for name, (text, _) in MANY.items()}
ORACLE |= {name: sql for name, (_, sql) in MANY.items()}
QUERIES["explain_plan"] = explain_plan
QUERIES["clause_only"] = lambda spark, sf_dir: spark.createDataFrame([star(spark, sf_dir).value("SELECT n_nationkey, n_name FROM ONLY nation:1")], "n_nationkey long, n_name string")
ORACLE["clause_only"] = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey = 1"
ORACLE["explain_plan"] = "SELECT unnest(['pushed', 'pruned', 'analyzed']) AS what, true AS said"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_multi"](spark, sf_dir)
