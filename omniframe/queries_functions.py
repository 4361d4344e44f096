"""Registered queries that run the scalar functions over whole tables, with DuckDB SQL for the same values.

Each entry is a table, its key, and pairs of an expression of the query language and SQL; a pair makes one column of both.
"""

from __future__ import annotations

K, N, B, S, M = "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name"


def joined(a: str) -> str:
    return f"array::join({a}, ',')"


def listed(a: str) -> str:
    return f"array_to_string({a}, ',')"


def lists(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    return [(joined(a), listed(b)) for a, b in pairs]


def near(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    """Numbers that are compared to six decimals."""
    return [(f"math::fixed({a}, 6)", f"round(({b})::DOUBLE, 6)") for a, b in pairs]


_CUSTOMER = ("customer", K)
GROUPS: dict[str, tuple[tuple[str, str], list[tuple[str, str]]]] = {
    "fn_array_build": (_CUSTOMER, lists(
        (f"array::add([1, {K} % 5], 2)", f"CASE WHEN {K} % 5 = 2 THEN [1, 2] ELSE [1, {K} % 5, 2] END"),
        (f"array::append([{K}], {N})", f"[{K}, {N}]"), (f"array::push([{K}], {N})", f"[{K}, {N}]"), (f"array::prepend([{K}], {N})", f"[{N}, {K}]"),
        (f"array::concat([{K}], [{N}, 1])", f"[{K}, {N}, 1]"), (f"array::fill([{K}, {N}, 1], 9)", "[9, 9, 9]"), (f"array::fill([{K}, {N}, 1], 9, 1, 2)", f"[{K}, 9, 1]"),
        (f"array::flatten([[{K}], [{N}, 1]])", f"[{K}, {N}, 1]"), (f"array::insert([{K}, {N}], 5, 1)", f"[{K}, 5, {N}]"), (f"array::range({K}, 3)", f"[{K}, {K} + 1, {K} + 2]"),
        (f"array::remove([{K}, {N}, 1], 1)", f"[{K}, 1]"), (f"array::repeat({K}, 3)", f"[{K}, {K}, {K}]"), (f"array::sequence({K} % 4 + 1)", f"range({K} % 4 + 1)"),
        (f"array::swap([{K}, {N}, 1], 0, 2)", f"[1, {N}, {K}]"), (f"array::flatten(array::transpose([[{K}, 1], [{N}, 2]]))", f"[{K}, {N}, 1, 2]"),
        (f"array::flatten(array::combine([{K}, {N}], [1, 2]))", f"[{K}, 1, {K}, 2, {N}, 1, {N}, 2]"),
    )),
    "fn_array_compare": (_CUSTOMER, lists(
        (f"array::boolean_and([{K} % 2 = 0, true], [true, {N} % 2 = 0])", f"[{K} % 2 = 0, {N} % 2 = 0]"), (f"array::boolean_or([{K} % 2 = 0, false], [false, {N} % 2 = 0])", f"[{K} % 2 = 0, {N} % 2 = 0]"),
        (f"array::boolean_xor([{K} % 2 = 0, true], [true, {N} % 2 = 0])", f"[{K} % 2 <> 0, {N} % 2 <> 0]"), (f"array::boolean_not([{K} % 2 = 0])", f"[{K} % 2 <> 0]"),
        (f"array::logical_and([{K} % 2 = 0], [{N} % 2 = 0])", f"[{K} % 2 = 0 AND {N} % 2 = 0]"), (f"array::logical_or([{K} % 2 = 0], [{N} % 2 = 0])", f"[{K} % 2 = 0 OR {N} % 2 = 0]"),
        (f"array::logical_xor([{K} % 2 = 0, true], [false, {K} % 2 = 1])", f"CASE WHEN {K} % 2 = 0 THEN [true, true] ELSE [false, false] END"),
        (f"array::matches([{K} % 3, 1], 1)", f"[{K} % 3 = 1, true]"), (f"array::complement([{K} % 3, 1, 2], [1])", f"list_filter([{K} % 3, 1, 2], lambda x: x <> 1)"),
        (f"array::difference([{K} % 3, 1], [1, 5])", f"CASE WHEN {K} % 3 = 1 THEN [1, 5] ELSE [{K} % 3, 5] END"),
        (f"array::intersect([{K} % 4, 1, 2], [1, 2, 3])", f"CASE {K} % 4 WHEN 2 THEN [2, 1] WHEN 3 THEN [3, 1, 2] ELSE [1, 2] END"),
        (f"array::union([{K} % 3, 1], [2, 1])", f"CASE {K} % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [1, 2] ELSE [2, 1] END"),
        (f"array::filter_index([{K} % 3, 1, 1], 1)", f"CASE WHEN {K} % 3 = 1 THEN [0, 1, 2] ELSE [1, 2] END"),
        (f"array::sort::asc([{K}, {N}, 5])", f"list_sort([{K}, {N}, 5])"), (f"array::sort::desc([{K}, {N}, 5])", f"list_reverse_sort([{K}, {N}, 5])"),
        (f"array::sort_natural(['x' + <string>{K}, 'x7'])", f"CASE WHEN {K} <= 7 THEN ['x' || {K}, 'x7'] ELSE ['x7', 'x' || {K}] END"),
        (f"array::sort_natural_lexical(['x' + <string>{K}, 'x7'])", f"CASE WHEN {K} <= 7 THEN ['x' || {K}, 'x7'] ELSE ['x7', 'x' || {K}] END"),
        (f"array::sort_lexical(['x' + <string>{K}, 'x7'])", f"list_sort(['x' || {K}, 'x7'])"),
    )),
    "fn_array_pick": (_CUSTOMER, [
        (f"array::at([{K}, {N}, 7], {K} % 3)", f"[{K}, {N}, 7][1 + {K} % 3]"), (f"array::min([{K}, {N}])", f"least({K}, {N})"), (f"array::pop([{K}, {N}])", N),
        (f"array::is_empty(array::filter([{K}], |$x| $x > 50))", f"{K} <= 50"), (f"math::sum(array::shuffle([{K}, {N}]))", f"CAST({K} + {N} AS BIGINT)"),
        (f"array::every([{K}, {N}], |$x| $x > 2)", f"{K} > 2 AND {N} > 2"), (f"array::some([{K}, {N}], |$x| $x > 20)", f"{K} > 20 OR {N} > 20"), (f"array::includes([{K}, {N}], 5)", f"{K} = 5 OR {N} = 5"),
        (f"array::index_of([{K}, {N}, 5], 5)", f"CASE WHEN {K} = 5 THEN 0 WHEN {N} = 5 THEN 1 ELSE 2 END"), (f"array::find([{K}, {N}, 1000], |$x| $x > 12)", f"CASE WHEN {K} > 12 THEN {K} WHEN {N} > 12 THEN {N} ELSE 1000 END"),
        (f"array::reduce([{K}, {N}, 2], |$a, $x| $a + $x)", f"CAST({K} + {N} + 2 AS BIGINT)"),
    ]),
    "fn_sets": (_CUSTOMER, lists(
        (f"set::add([1, 5], {K} % 6)", f"list_sort(list_distinct([1, 5, {K} % 6]))"), (f"set::complement([1, 2, 3], [{K} % 3])", f"list_filter([1, 2, 3], lambda x: x <> {K} % 3)"),
        (f"set::flatten([[{K}], [0]])", f"list_sort(list_distinct([{K}, 0]))"), (f"set::remove([1, 2, 3], {K} % 4)", f"list_filter([1, 2, 3], lambda x: x <> {K} % 4)"),
        ("set::slice([1, 2, 3, 4], 1, 3)", "[2, 3]"), (f"set::filter([1, 2, 3], |$x| $x > {K} % 3)", f"list_filter([1, 2, 3], lambda x: x > {K} % 3)"), (f"set::map([1, 2, 3], |$x| $x * {K})", f"list_sort(list_distinct([{K}, 2 * {K}, 3 * {K}]))"),
    ) + [
        (f"set::at([1, 5, 9], {K} % 3)", f"[1, 5, 9][1 + {K} % 3]::BIGINT"), (f"set::first([{K}, {K} + 1])", K), (f"set::last([{K}, {K} + 1])", f"{K} + 1"), (f"set::is_empty([{K}])", "false"),
        (f"set::join([1, {K} + 1], '-')", f"'1-' || ({K} + 1)"), (f"set::max([1, {K}])", f"greatest(1, {K})"), (f"set::min([9, {K}])", f"least(9, {K})"),
        (f"set::all([1, {K}], |$x| $x < 9)", f"{K} < 9"), (f"set::any([1, {K}], |$x| $x > 9)", f"{K} > 9"), (f"set::find([1, {K} + 9], |$x| $x > 8)", f"CASE WHEN {K} + 9 > 8 THEN {K} + 9 END"),
        (f"set::fold([1, 2], {K}, |$a, $x| $a + $x)", f"{K} + 3"), (f"set::reduce([1, 2], |$a, $x| $a + $x)", "3::BIGINT"),
    ]),
    "fn_trigonometry": (_CUSTOMER, near(
        (f"math::acos({K} % 10 / 10.0)", f"acos({K} % 10 / 10.0)"), (f"math::asin({K} % 10 / 10.0)", f"asin({K} % 10 / 10.0)"), (f"math::atan({B})", f"atan({B})"), (f"math::acot({K} + 0.5)", f"atan(1 / ({K} + 0.5))"),
        (f"math::cot({K} + 0.5)", f"1 / tan({K} + 0.5)"), (f"math::tan({K} + 0.5)", f"tan({K} + 0.5)"), (f"math::rad2deg({B} / 1000)", f"degrees({B} / 1000)"),
        (f"math::log({K} + 2.0, 3)", f"ln({K} + 2) / ln(3)"), (f"math::log2({K} + 1.0)", f"log2({K} + 1)"), (f"math::pow({B} / 100, 2)", f"pow({B} / 100, 2)"), (f"math::product([{B}, 2.0, 0.5])", B),
        (f"math::lerpangle({K} % 90, 90.0, 0.5)", f"{K} % 90 + 0.5 * (90 - {K} % 90)"), (f"math::nearestrank([{K}, {N}, 5, 7], 50)", f"list_sort([{K}, {N}, 5, 7])[3]"), (f"math::mode([{K} % 3, 2, 2, 1])", "2"),
        (f"math::round({B})", f"round({B})"),
    ) + lists((f"math::top([{K}, {N}, 5], 2)", f"list_reverse_sort([{K}, {N}, 5])[1:2]"), (f"math::bottom([{K}, {N}, 5], 2)", f"list_sort([{K}, {N}, 5])[1:2]"))),
    "fn_durations": (_CUSTOMER, [
        (f"duration::mins(duration::from_secs({K}))", f"{K} // 60"), (f"duration::millis(duration::from_micros({K} * 1000))", K), (f"duration::micros(duration::from_micros({K}))", K),
        (f"duration::nanos(duration::from_nanos({K} * 1000))", f"{K} * 1000"), (f"duration::secs(duration::from_millis({K} * 1000))", K), (f"duration::mins(duration::from_mins({K}))", K),
        (f"duration::weeks(duration::from_days({K}))", f"{K} // 7"), (f"duration::days(duration::from_weeks({K}))", f"{K} * 7"), (f"duration::years(duration::from_days({K} * 10))", f"{K} * 10 // 365"),
        (f"duration::secs(type::duration('1h30m'))", "5400::BIGINT"),
    ]),
    "fn_text": (_CUSTOMER, [
        (f"string::capitalize(string::lowercase({S}))", f"upper({S}[1]) || lower({S}[2:])"), (f"string::contains({S}, 'IL')", f"contains({S}, 'IL')"), (f"string::ends_with({S}, 'E')", f"ends_with({S}, 'E')"),
        (f"string::join('-', {S}, {M})", f"{S} || '-' || {M}"), (f"string::matches({M}, '[0-4]5$')", f"regexp_matches({M}, '[0-4]5$')"), (f"string::slug({M})", f"replace(lower({M}), '#', '-')"),
        (f"string::trim('  ' + {S} + ' ')", S), (f"string::distance::hamming({S}, string::reverse({S}))", f"hamming({S}, reverse({S}))"), (f"string::distance::osa({S}, string::slice({S}, 1))", "1::BIGINT"),
        (f"string::html::encode('<' + {S} + '>')", f"'&lt;' || {S} || '&gt;'"), (f"string::html::sanitize('a<script>x</script>' + {S})", f"'a' || {S}"),
        (f"parse::email::host('u@' + string::lowercase({S}) + '.com')", f"lower({S}) || '.com'"), (f"parse::email::user(string::lowercase({S}) + '@x.com')", f"lower({S})"),
        (f"parse::url::domain('http://' + string::lowercase({S}) + '.org/x')", f"lower({S}) || '.org'"), (f"type::string_lossy(encoding::base64::decode(encoding::base64::encode({M})))", M),
        (f"bytes::len(encoding::cbor::encode({M}))", f"1 + len({M})"), (f"bytes::len(<bytes>{M})", f"octet_length(encode({M}))"),
    ] + near(
        (f"string::distance::normalized_levenshtein({S}, {M})", f"1 - levenshtein({S}, {M})::DOUBLE / greatest(len({S}), len({M}))"),
        (f"string::similarity::jaro({S}, {M})", f"jaro_similarity({S}, {M})"),
        (f"string::distance::normalized_damerau_levenshtein({S}, string::slice({S}, 1))", f"1 - 1.0::DOUBLE / len({S})"), (f"string::similarity::sorensen_dice({S}, {S})", "1"),
    )),
    "fn_text_checks": (_CUSTOMER, [
        (f"string::is_alphanum({M})", f"regexp_matches({M}, '^[A-Za-z0-9]+$')"), (f"string::is_alphanum({S})", f"regexp_matches({S}, '^[A-Za-z0-9]+$')"), (f"string::is_ascii({M} + 'é')", "false"), (f"string::is_ascii({M})", "true"),
        (f"string::is_datetime('2024-01-0' + <string>({K} % 10) + 'T00:00:00Z')", f"{K} % 10 > 0"), (f"string::is_domain(string::lowercase({S}) + '.com')", "true"), (f"string::is_domain({M})", "false"),
        (f"string::is_ip('1.2.3.' + <string>{K})", f"{K} < 256"), (f"string::is_ipv4('1.2.3.' + <string>{K})", f"{K} < 256"), (f"string::is_ipv6('fe80::' + <string>({K} % 10))", "true"),
        (f"string::is_latitude(<string>{K})", f"{K} <= 90"), (f"string::is_longitude(<string>{K})", f"{K} <= 180"), (f"string::is_ulid('01ARZ3NDEKTSV4RRFFQ69G5FA' + <string>({K} % 10))", "true"), (f"string::is_ulid({M})", "false"),
        (f"string::is_record('a:' + {S})", "true"), (f"string::is_record({S})", "false"), (f"string::semver::compare('1.' + <string>{K} + '.0', '1.50.0')", f"CASE WHEN {K} < 50 THEN -1 WHEN {K} = 50 THEN 0 ELSE 1 END"),
        (f"string::semver::major('7.' + <string>{K} + '.3')", "7::BIGINT"), (f"string::semver::minor('7.' + <string>{K} + '.3')", K), (f"string::semver::patch('7.1.' + <string>{K})", K),
        (f"string::semver::inc::major('7.' + <string>{K} + '.3')", "'8.0.0'"), (f"string::semver::inc::minor('7.' + <string>{K} + '.3')", f"'7.' || ({K} + 1) || '.0'"), (f"string::semver::inc::patch('7.' + <string>{K} + '.3')", f"'7.' || {K} || '.4'"),
        (f"string::semver::set::major('7.' + <string>{K} + '.3', 9)", f"'9.' || {K} || '.3'"), (f"string::semver::set::minor('7.2.3', {K})", f"'7.' || {K} || '.3'"), (f"string::semver::set::patch('7.2.3', {K})", f"'7.2.' || {K}"),
    ]),
    "fn_times": (("events", "event_id"), [
        ("time::second(ts)", "second(ts)"), ("time::micros(ts)", "epoch_us(ts)"), ("time::millis(ts)", "epoch_us(ts) // 1000"), ("time::nano(ts)", "epoch_us(ts) * 1000"), ("time::is_leap_year(ts)", "year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)"),
        ("time::unix(time::ceil(ts, 1h))", "(epoch_us(ts) + 3599999999) // 3600000000 * 3600"), ("time::unix(time::round(ts, 1h))", "(epoch_us(ts) + 1800000000) // 3600000000 * 3600"),
        ("time::unix(time::from_secs(user_id))", "user_id::BIGINT"), ("time::unix(time::from_unix(user_id))", "user_id::BIGINT"), ("time::millis(time::from_millis(user_id))", "user_id::BIGINT"), ("time::micros(time::from_micros(user_id))", "user_id::BIGINT"),
        ("time::nano(time::from_nanos(user_id * 1000))", "user_id * 1000"), ("time::year(time::set_year(ts, 2020))", "2020::BIGINT"), ("time::unix(time::set_day(ts, 7))", "CAST(floor(epoch(ts + to_days(7 - day(ts)::INT))) AS BIGINT)"),
        ("time::unix(time::set_hour(ts, 5))", "CAST(floor(epoch(ts + to_hours(5 - hour(ts)))) AS BIGINT)"), ("time::unix(time::set_minute(ts, 7))", "CAST(floor(epoch(ts + to_minutes(7 - minute(ts)))) AS BIGINT)"),
        ("time::unix(time::set_second(ts, 9))", "CAST(floor(epoch(ts + to_seconds(9 - second(ts)))) AS BIGINT)"), ("time::nano(time::set_nanosecond(ts, 5000)) % 1000000000", "5000::BIGINT"), ("time::month(time::set_month(time::set_day(ts, 1), 2))", "2::BIGINT"),
        ("time::unix(time::from_ulid('01ARZ3NDEKTSV4RRFFQ69G5FAV'))", "1469922850::BIGINT"), ("time::unix(time::from_uuid('018f9a6e-1111-7111-8111-123456789012'))", "CAST(floor(('0x018f9a6e1111'::BIGINT) / 1000) AS BIGINT)"),
        ("time::now() > ts", "now()::TIMESTAMP > ts"), ("time::timezone() != NONE", "true"),
    ]),
    "fn_types": (_CUSTOMER, [
        (f"type::bool('true')", "true"), (f"type::int('5' + <string>({K} % 10))", f"50 + {K} % 10"), (f"type::float(<string>{K})", f"{K}::DOUBLE"), (f"type::number(<string>{K})", f"{K}::DOUBLE"), (f"type::string({K})", f"{K}::VARCHAR"),
        (f"type::decimal({K}) = {K}", "true"), (f"time::unix(type::datetime('1970-01-02T00:00:00Z'))", "86400::BIGINT"), (f"array::len(type::array({K}))", "1::BIGINT"), (f"array::join(type::set([3, 1, 3]), ',')", "'1,3'"), (f"bytes::len(type::bytes({M}))", f"len({M})"),
        (f"type::record('p', <string>{K})", f"'p:' || {K}"), (f"record::id(type::record('p', <string>{K}))", f"{K}::VARCHAR"), (f"record::table(type::record('p', <string>{K}))", "'p'"), (f"record::tb(type::record('p', <string>{K}))", "'p'"),
        (f"meta::id(type::record('p', <string>{K}))", f"{K}::VARCHAR"), (f"meta::tb(type::record('p', <string>{K}))", "'p'"), (f"type::uuid('018F9A6E-1111-7111-8111-123456789012')", "'018f9a6e-1111-7111-8111-123456789012'"),
        (f"type::is_array([{K}])", "true"), (f"type::is_bool({K} > 1)", "true"), (f"type::is_bytes(<bytes>{M})", "true"), (f"type::is_decimal(1dec)", "true"), (f"type::is_duration(1h)", "true"), (f"type::is_float({B})", "true"), (f"type::is_float({K})", "false"),
        (f"type::is_none(NONE)", "true"), (f"type::is_null({K})", "false"), (f"type::is_number({B})", "true"), (f"type::is_object({{ a: {K} }})", "true"), (f"type::is_point((1.0, 2.0))", "true"), (f"type::is_record(person:1)", "true"),
        (f"type::is_uuid(rand::uuid())", "true"), (f"type::is_collection({K})", "false"), (f"type::is_line({K})", "false"), (f"type::is_polygon({K})", "false"), (f"type::is_multipoint({K})", "false"), (f"type::is_multiline({K})", "false"),
        (f"type::is_multipolygon({K})", "false"), (f"type::is_geometry((1.0, 2.0))", "true"), (f"type::is_range({K})", "false"), (f"type::is_set({K})", "false"), (f"type::field('{M}')", M), (f"not({K} > 5)", f"{K} <= 5"), (f"type::point([{K}, 2]) = ({K}, 2.0)", "true"),
    ]),
    "fn_vectors": (_CUSTOMER, lists(
        (f"vector::add([{K}, {N}], [1, 2])", f"[{K} + 1, {N} + 2]"), (f"vector::subtract([{K}, {N}], [1, 2])", f"[{K} - 1, {N} - 2]"), (f"vector::multiply([{K}, {N}], [1, 2])", f"[{K}, {N} * 2]"),
        (f"vector::cross([{K}, {N}, 1], [1, 2, 3])", f"[{N} * 3 - 2, 1 - {K} * 3, {K} * 2 - {N}]"),
    ) + near(
        (f"vector::angle([{K}, 1], [1, {N} + 1])", f"acos(({K} + {N} + 1) / (sqrt({K} * {K} + 1) * sqrt(1 + ({N} + 1) * ({N} + 1))))"), (f"math::sum(vector::divide([{K}, {N}], [2, 4]))", f"{K} / 2 + {N} / 4"),
        (f"math::sum(vector::normalize([{K}, {N} + 1]))", f"({K} + {N} + 1) / sqrt({K} * {K} + ({N} + 1) * ({N} + 1))"), (f"math::sum(vector::project([{K}, {N}], [1, 2]))", f"3 * ({K} + 2 * {N}) / 5"),
        (f"vector::distance::chebyshev([{K}, {N}], [1, 2])", f"greatest(abs({K} - 1), abs({N} - 2))"), (f"vector::distance::euclidean([{K}, {N}], [1, 2])", f"sqrt(({K} - 1) * ({K} - 1) + ({N} - 2) * ({N} - 2))"),
        (f"vector::distance::minkowski([{K}, {N}], [1, 2], 3)", f"pow(pow(abs({K} - 1), 3) + pow(abs({N} - 2), 3), 1 / 3.0)"),
        (f"vector::similarity::jaccard([{K} % 3, 1], [1, 2])", f"CASE {K} % 3 WHEN 0 THEN 1 / 3.0 WHEN 1 THEN 0.5 ELSE 1 END"),
        (f"vector::similarity::pearson([{K}, {N}, 100000], [1, 2, 3])", f"(100000 - {K}) / (sqrt(2) * sqrt(pow({K} - ({K} + {N} + 100000) / 3, 2) + pow({N} - ({K} + {N} + 100000) / 3, 2) + pow(100000 - ({K} + {N} + 100000) / 3, 2)))"),
    )),
    "fn_objects": (_CUSTOMER, [
        (f"vector::distance::hamming([{K}, {N}], [1, 2])", f"({K} <> 1)::BIGINT + ({N} <> 2)::BIGINT"),
        (f"array::join(object::values({{ b: {K}, a: {N} }}), ',')", f"{N} || ',' || {K}"), (f"array::len(object::entries({{ b: {K}, a: {N} }}))", "2::BIGINT"), (f"object::extend({{ a: 1 }}, {{ b: {K} }}).b", K),
        (f"object::remove({{ a: 1, b: {K} }}, 'a').b", K), (f"object::from_entries([['a', {K}]]).a", K), (f"object::is_empty({{ a: {K} }})", "false"), (f"{{ a: {K}, b: 2 }}.{{ a }}.a", K), (f"{{ a: {{ b: {K} }} }}.a?.b", K),
        (f"value::diff({{ a: 1 }}, {{ a: {K} + 1 }})", f"CASE WHEN {K} = 0 THEN '[]' ELSE '[{{\"op\":\"replace\",\"path\":\"/a\",\"value\":' || ({K} + 1) || '}}]' END"), ("schema::table::exists('nation')", "true"), ("schema::table::exists('nowhere')", "false"),
    ]),
    "fn_chance": (_CUSTOMER, [
        ("rand::int(1, 5) >= 1", "true"), ("rand::float(0, 1) < 1", "true"), ("rand::bool() OR true", "true"), ("rand::enum(7, 7)", "7::BIGINT"), ("string::len(rand::string(7))", "7::BIGINT"), ("string::len(rand::id(9))", "9::BIGINT"),
        ("string::is_ulid(rand::ulid())", "true"), ("string::is_uuid(rand::uuid::v4())", "true"), ("string::is_uuid(rand::uuid::v7())", "true"), ("time::unix(rand::time(0, 100)) <= 100", "true"), ("duration::secs(rand::duration(1s, 1s))", "1::BIGINT"), ("rand() < 1", "true"),
    ]),
    "fn_slow_hashes": (("nation", "n_nationkey"), [
        ("crypto::pbkdf2::compare(crypto::pbkdf2::generate(n_name), n_name)", "true"), ("crypto::pbkdf2::compare(crypto::pbkdf2::generate(n_name), 'other')", "false"), ("crypto::scrypt::compare(crypto::scrypt::generate(n_name), n_name)", "true"),
        ("string::len(crypto::sha512(n_name))", "128::BIGINT"), ("string::len(crypto::blake3(n_name))", "64::BIGINT"), ("crypto::joaat(n_name) >= 0", "true"),
    ]),
    "fn_places": (_CUSTOMER, near(
        (f"geo::bearing((0.0, 0.0), ({N} + 1.0, 1.0))", f"degrees(atan2(sin(radians({N} + 1)) * cos(radians(1)), sin(radians(1))))"),
    ) + [
        (f"geo::is_valid(({N} + 1.0, 7.0))", "true"), (f"string::len(geo::hash::encode(({N} + 1.0, 7.0), 6))", "6::BIGINT"), (f"math::fixed(geo::hash::decode(geo::hash::encode(({N} + 1.0, 7.0), 12)).x, 3)", f"round({N} + 1.0::DOUBLE, 3)"),
        (f"math::fixed(geo::centroid({{ type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] }}).x, 3)", "1.0::DOUBLE"), (f"geo::area({{ type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] }}) > 40000000000", "true"),
    ]),
    "operators_rest": (_CUSTOMER, [
        (f"{K} == {K}", "true"), (f"{K} >= 5", f"{K} >= 5"), (f"[1, {N}] CONTAINSNOT 5", f"{N} <> 5"), (f"[{N}] ANYINSIDE [1, 2, 3]", f"{N} IN (1, 2, 3)"), (f"[{N}] NONEINSIDE [1, 2, 3]", f"{N} NOT IN (1, 2, 3)"),
        (f"{N} IN 3>..7", f"{N} > 3 AND {N} < 7"), (f"{N} IN 3>..=7", f"{N} > 3 AND {N} <= 7"), ("(1.0, 1.0) OUTSIDE { type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] }", "false"),
        ("{ type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] } INTERSECTS { type: 'Polygon', coordinates: [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]] }", "true"),
        (f"[{K}, {N}, 3][0]", K), (f"[{K}, {N}, 3][$]", "3::BIGINT"), (f"array::len([{K}, [{N}]]...)", "2::BIGINT"), (f"{M}.lowercase()", f"lower({M})"), (f"[{N}, 2].every(|$x| $x > 1)", f"{N} > 1"),
    ]),
}

TEXTS: dict[str, tuple[str, str]] = {
    name: (
        f"SELECT {key}, " + ", ".join(f"{a} AS v{i}" for i, (a, _) in enumerate(pairs)) + f" FROM {table}",
        f"SELECT {key}, " + ", ".join(f"{b} AS v{i}" for i, (_, b) in enumerate(pairs)) + f" FROM {table}",
    )
    for name, ((table, key), pairs) in GROUPS.items()
}

_NATION = "SELECT n_nationkey, n_name FROM nation"
#: Clauses and statements; the last statement reads.
STATEMENTS: dict[str, tuple[str, str]] = {
    "clause_timeout": ("SELECT c_custkey, c_name FROM customer TIMEOUT 5m", "SELECT c_custkey, c_name FROM customer"),
    "clause_tempfiles": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice TEMPFILES", "SELECT o_orderkey, o_totalprice FROM orders"),
    "clause_noindex": ("SELECT o_orderkey FROM orders WITH NOINDEX WHERE o_custkey = 5", "SELECT o_orderkey FROM orders WHERE o_custkey = 5"),
    "clause_collate": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment COLLATE DESC, c_custkey LIMIT 30", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 30"),
    "clause_fields": ("SELECT type::fields(['c_custkey', 'c_acctbal']) FROM customer", "SELECT c_custkey, c_acctbal FROM customer"),
    "statement_commit": (f"BEGIN; DELETE nation WHERE n_nationkey > 10; COMMIT; {_NATION}", f"{_NATION} WHERE n_nationkey <= 10"),
    "statement_sleep": (f"SLEEP 1ms; {_NATION}", _NATION), "statement_use": (f"USE NS a DB b; {_NATION}", _NATION), "statement_option": (f"OPTION IMPORT; {_NATION}", _NATION),
    "statement_session": ("USE NS a DB b; SELECT n_nationkey, session::ns() AS ns, session::db() AS db FROM nation", "SELECT n_nationkey, 'a' AS ns, 'b' AS db FROM nation"),
    "statement_continue": ("FOR $i IN 1..=5 { IF $i = 2 { CONTINUE; }; IF $i = 4 { BREAK; }; CREATE step SET v = $i; }; SELECT v FROM step", "SELECT unnest([1, 3])::BIGINT AS v"),
    "statement_remove": ("DEFINE PARAM $limit VALUE 5; DEFINE FUNCTION fn::twice($x: int) { RETURN $x * 2; }; REMOVE PARAM $limit; SELECT n_nationkey, fn::twice(n_nationkey) AS v FROM nation", "SELECT n_nationkey, n_nationkey * 2 AS v FROM nation"),
    "statement_index": ("DEFINE INDEX by_name ON nation FIELDS n_name UNIQUE; REBUILD INDEX by_name ON nation; INFO FOR INDEX by_name ON nation", "SELECT 'index' AS kind, 'by_name' AS name, 'ready: nation(n_name)' AS detail"),
    "statement_info_ns": ("USE NS a DB b; INFO FOR NS", "SELECT 'databases' AS kind, 'b' AS name, '' AS detail"), "statement_info_root": ("USE NS a DB b; INFO FOR ROOT", "SELECT 'namespaces' AS kind, 'a' AS name, '' AS detail"),
    "statement_sequence": ("DEFINE SEQUENCE s START 5; CREATE x SET v = sequence::nextval('s'); CREATE x SET v = sequence::nextval('s'); SELECT v FROM x", "SELECT unnest([5, 6])::BIGINT AS v"),
    "assign_extend": ("UPDATE nation SET tags = ['a', 'b']; UPDATE nation SET tags +?= 'b', n_regionkey -= 1 RETURN NONE; SELECT n_nationkey, array::join(tags, ',') AS t, n_regionkey FROM nation", "SELECT n_nationkey, 'a,b' AS t, n_regionkey - 1 AS n_regionkey FROM nation"),
    "search_highlight": (
        "SELECT doc_id, string::replace(string::replace(search::highlight('<b>', '</b>', 1), '<b>', ''), '</b>', '') = text AS same, array::len(string::split(search::highlight('<b>', '</b>', 1), '<b>')) - 1 AS n FROM documents WHERE text @1@ 'idiot'",
        "SELECT doc_id, true AS same, len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: lower(x) = 'idiot')) AS n FROM documents WHERE list_contains(list_transform(regexp_extract_all(text, '\\S+'), lambda x: lower(x)), 'idiot')",
    ),
    "knn_jaccard": ("SELECT c_custkey, math::fixed(1 - vector::similarity::jaccard([c_nationkey, 1, 2], [1, 2, 3]), 6) AS d FROM customer", "SELECT c_custkey, round(CASE WHEN c_nationkey IN (1, 2) THEN 1 / 3.0 WHEN c_nationkey = 3 THEN 0 ELSE 0.5 END::DOUBLE, 6) AS d FROM customer"),
}
