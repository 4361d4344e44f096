"""Functions that are a Spark SQL expression of their arguments.

Each entry maps a name to a template ({0}, {1} … are the arguments' SQL), or to
one template per number of arguments. All of them stay in the JVM.
Timestamps are in UTC; durations are day-time intervals.
"""

from __future__ import annotations

_MICROS = "(unix_micros(cast({0} as timestamp)))"


def _step(what: str) -> str:
    """A timestamp moved to a multiple of an interval; a zero interval leaves it."""
    d = "(cast(extract(SECOND FROM {1}) * 1000000 as bigint) + extract(MINUTE FROM {1}) * 60000000L + extract(HOUR FROM {1}) * 3600000000L + extract(DAY FROM {1}) * 86400000000L)"
    shift = {"floor": "0", "ceil": f"{d} - 1", "round": f"{d} div 2"}[what]
    return f"(CASE WHEN {d} = 0 THEN {{0}} ELSE timestamp_micros((({_MICROS} + {shift}) - pmod({_MICROS} + {shift}, {d}))) END)"


_TICKS = "(cast(extract(SECOND FROM {0}) * 1000000 as bigint) + extract(MINUTE FROM {0}) * 60000000L + extract(HOUR FROM {0}) * 3600000000L + extract(DAY FROM {0}) * 86400000000L)"


def _span(unit: int) -> str:
    """Whole units (of so many microseconds) of a duration."""
    return f"({_TICKS} div {unit}L)"


def _norm(i: str, n: str) -> str:
    """A slice bound: negative from the end, inside 0..n."""
    return f"least(greatest(if({i} < 0, {n} + {i}, {i}), 0), {n})"


def _made(year="year({0})", month="month({0})", day="day({0})", hour="hour({0})", minute="minute({0})", sec="extract(SECOND FROM {0})") -> str:
    return f"make_timestamp({year}, {month}, {day}, {hour}, {minute}, cast({sec} as decimal(8,6)))"


_SORTED = "array_sort({0})"
_N = "size({0})"
_PCT = "(CASE WHEN size({{0}}) = 0 THEN double('NaN') ELSE (element_at(array_sort({{0}}), cast(floor((size({{0}}) - 1) * {p} / 100D) as int) + 1) + ((size({{0}}) - 1) * {p} / 100D - floor((size({{0}}) - 1) * {p} / 100D)) * (element_at(array_sort({{0}}), cast(ceil((size({{0}}) - 1) * {p} / 100D) as int) + 1) - element_at(array_sort({{0}}), cast(floor((size({{0}}) - 1) * {p} / 100D) as int) + 1))) END)"
_P25, _P50, _P75 = (_PCT.format(p=p) for p in (25, 50, 75))
_SUM = "aggregate({0}, 0D, (acc, x) -> acc + x)"
_MEAN = f"(CASE WHEN {_N} = 0 THEN double('NaN') ELSE {_SUM} / {_N} END)"
_VAR = f"(CASE WHEN {_N} = 0 THEN double('NaN') WHEN {_N} = 1 THEN 0D ELSE aggregate(transform({{0}}, v -> (v - {_SUM} / {_N}) * (v - {_SUM} / {_N})), 0D, (acc, x) -> acc + x) / ({_N} - 1) END)"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (acc, x) -> acc + x)"
_NORM0 = "sqrt(aggregate({0}, 0D, (acc, x) -> acc + double(x) * double(x)))"
_NORM1 = "sqrt(aggregate({1}, 0D, (acc, x) -> acc + double(x) * double(x)))"
_AVG0 = "(aggregate({0}, 0D, (acc, x) -> acc + double(x)) / size({0}))"
_AVG1 = "(aggregate({1}, 0D, (acc, x) -> acc + double(x)) / size({1}))"
_RAD = "6371008.8D"
_LAT0, _LON0, _LAT1, _LON1 = "radians({0}.y)", "radians({0}.x)", "radians({1}.y)", "radians({1}.x)"
_URL_HOST = "parse_url({0}, 'HOST')"
_SEMVER = r"^[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$"
_V4 = r"((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_V6 = r"(([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(([0-9a-fA-F]{{1,4}}:){{0,6}}[0-9a-fA-F]{{1,4}})?::(([0-9a-fA-F]{{1,4}}:){{0,6}}[0-9a-fA-F]{{1,4}})?)"
_EMAIL = r"^[A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$"
_EMAIL = _EMAIL.replace("''", "\\'")
_DOMAIN = r"^([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,63}}$"


def _like(pattern: str, x: str = "{0}") -> str:
    return f"coalesce({x} rlike '{pattern}', false)"


def _part(k: int) -> str:
    return f"cast(split_part(regexp_extract({{0}}, '^[0-9]+.[0-9]+.[0-9]+', 0), '.', {k}) as bigint)"


_MAJOR, _MINOR, _PATCH = _part(1), _part(2), _part(3)

SCALAR: dict[str, str | dict[int, str]] = {
    # arrays
    "array::add": "if(array_contains({0}, {1}), {0}, array_append({0}, {1}))",
    "array::append": "array_append({0}, {1})",
    "array::push": "array_append({0}, {1})",
    "array::prepend": "array_prepend({0}, {1})",
    "array::at": "try_element_at({0}, cast(if({1} >= 0, {1} + 1, {1}) as int))",
    "array::boolean_and": "zip_with({0}, {1}, (x, y) -> coalesce(boolean(x), false) and coalesce(boolean(y), false))",
    "array::boolean_or": "zip_with({0}, {1}, (x, y) -> coalesce(boolean(x), false) or coalesce(boolean(y), false))",
    "array::boolean_xor": "zip_with({0}, {1}, (x, y) -> coalesce(boolean(x), false) <> coalesce(boolean(y), false))",
    "array::boolean_not": "transform({0}, x -> not coalesce(boolean(x), false))",
    "array::logical_and": "zip_with({0}, {1}, (x, y) -> if(coalesce(boolean(x), false), y, x))",
    "array::logical_or": "zip_with({0}, {1}, (x, y) -> if(coalesce(boolean(x), false), x, y))",
    "array::clump": "if(size({0}) = 0, slice(array({0}), 1, 0), transform(sequence(0, (size({0}) - 1) div cast({1} as int)), i -> slice({0}, cast(i * {1} as int) + 1, cast({1} as int))))",
    "array::combine": "flatten(transform({0}, x -> transform({1}, y -> array(x, y))))",
    "array::complement": "filter({0}, x -> not array_contains({1}, x))",
    "array::concat": "concat({*})",
    "array::distinct": "array_distinct({0})",
    "array::first": "get({0}, 0)",
    "array::last": "try_element_at({0}, -1)",
    "array::flatten": "flatten({0})",
    "array::group": "array_distinct(flatten({0}))",
    "array::insert": {2: "array_append({0}, {1})", 3: "if(abs({2}) > size({0}), {0}, array_insert({0}, cast(if({2} >= 0, {2} + 1, {2}) as int), {1}))"},
    "array::is_empty": "(size({0}) = 0)",
    "array::join": "array_join(transform({0}, x -> string(x)), {1})",
    "array::len": "bigint(size({0}))",
    "array::matches": "transform({0}, x -> x <=> {1})",
    "array::max": "array_max({0})",
    "array::min": "array_min({0})",
    "array::pop": "try_element_at({0}, -1)",
    "array::range": {2: "if({1} <= 0, cast(array() as array<bigint>), sequence(bigint({0}), bigint({0}) + {1} - 1))"},
    "array::remove": "filter({0}, (x, i) -> i <> if({1} < 0, size({0}) + {1}, {1}))",
    "array::repeat": "array_repeat({0}, cast({1} as int))",
    "array::reverse": "reverse({0})",
    "array::sequence": {1: "if({0} <= 0, cast(array() as array<bigint>), sequence(0L, bigint({0}) - 1))", 2: "if({1} <= 0, cast(array() as array<bigint>), sequence(bigint({0}), bigint({0}) + {1} - 1))"},
    "array::shuffle": "shuffle({0})",
    "array::slice": {1: "{0}", 2: f"slice({{0}}, cast({_norm('{1}', _N)} as int) + 1, size({{0}}))", 3: f"slice({{0}}, cast({_norm('{1}', _N)} as int) + 1, cast(greatest({_norm('{2}', _N)} - {_norm('{1}', _N)}, 0) as int))"},
    "array::sort": {1: _SORTED},
    "array::sort::asc": _SORTED,
    "array::sort::desc": "sort_array({0}, false)",
    "array::swap": "transform({0}, (x, i) -> if(i = {1}, element_at({0}, cast({2} as int) + 1), if(i = {2}, element_at({0}, cast({1} as int) + 1), x)))",
    "array::transpose": "if(size({0}) = 0, {0}, transform(sequence(0, array_max(transform({0}, r -> size(r))) - 1), i -> transform({0}, r -> get(r, i))))",
    "array::union": "array_union({0}, {1})",
    "array::windows": "if(size({0}) < {1}, slice(array({0}), 1, 0), transform(sequence(0, size({0}) - cast({1} as int)), i -> slice({0}, i + 1, cast({1} as int))))",
    "array::fill": {2: "transform({0}, x -> {1})", 3: "transform({0}, (x, i) -> if(i >= {2}, {1}, x))", 4: "transform({0}, (x, i) -> if(i >= {2} and i < {3}, {1}, x))"},
    # multiset operations: each element is numbered among its equals first
    "array::intersect": "transform(array_intersect(transform({0}, (x, i) -> struct(x as v, size(filter(slice({0}, 1, i), y -> y <=> x)) as k)), transform({1}, (x, i) -> struct(x as v, size(filter(slice({1}, 1, i), y -> y <=> x)) as k))), s -> s.v)",
    "array::difference": "transform(concat(array_except(transform({0}, (x, i) -> struct(x as v, size(filter(slice({0}, 1, i), y -> y <=> x)) as k)), transform({1}, (x, i) -> struct(x as v, size(filter(slice({1}, 1, i), y -> y <=> x)) as k))), array_except(transform({1}, (x, i) -> struct(x as v, size(filter(slice({1}, 1, i), y -> y <=> x)) as k)), transform({0}, (x, i) -> struct(x as v, size(filter(slice({0}, 1, i), y -> y <=> x)) as k)))), s -> s.v)",
    # sets: sorted distinct arrays
    "set::add": "array_sort(array_union({0}, array({1})))",
    "set::at": "try_element_at({0}, cast(if({1} >= 0, {1} + 1, {1}) as int))",
    "set::complement": "array_sort(array_except({0}, {1}))",
    "set::contains": "coalesce(array_contains({0}, {1}), false)",
    "set::difference": "array_sort(array_union(array_except({0}, {1}), array_except({1}, {0})))",
    "set::first": "get({0}, 0)",
    "set::last": "try_element_at({0}, -1)",
    "set::flatten": "array_sort(array_distinct(flatten({0})))",
    "set::intersect": "array_sort(array_intersect({0}, {1}))",
    "set::is_empty": "(size({0}) = 0)",
    "set::join": "array_join(transform({0}, x -> string(x)), {1})",
    "set::len": "bigint(size({0}))",
    "set::max": "array_max({0})",
    "set::min": "array_min({0})",
    "set::remove": "array_remove({0}, {1})",
    "set::slice": {1: "{0}", 2: f"slice({{0}}, cast({_norm('{1}', _N)} as int) + 1, size({{0}}))", 3: f"slice({{0}}, cast({_norm('{1}', _N)} as int) + 1, cast(greatest({_norm('{2}', _N)} - {_norm('{1}', _N)}, 0) as int))"},
    "set::union": "array_sort(array_union({0}, {1}))",
    # bytes, hashes, encodings
    "bytes::len": "bigint(octet_length({0}))",
    "crypto::md5": "md5({0})",
    "crypto::sha1": "sha1({0})",
    "crypto::sha256": "sha2({0}, 256)",
    "crypto::sha512": "sha2({0}, 512)",
    "encoding::base64::encode": {1: "rtrim('=', base64(binary({0})))", 2: "if({1}, base64(binary({0})), rtrim('=', base64(binary({0}))))"},
    "encoding::base64::decode": "unbase64(rpad({0}, cast(ceil(length({0}) / 4D) * 4 as int), '='))",
    "encoding::json::decode": "parse_json({0})",
    # durations
    "duration::nanos": f"({_span(1)} * 1000)",
    "duration::micros": _span(1),
    "duration::millis": _span(1000),
    "duration::secs": _span(10**6),
    "duration::mins": _span(60 * 10**6),
    "duration::hours": _span(3600 * 10**6),
    "duration::days": _span(86400 * 10**6),
    "duration::weeks": _span(7 * 86400 * 10**6),
    "duration::years": _span(365 * 86400 * 10**6),
    "duration::from_nanos": "make_dt_interval(0, 0, 0, cast({0} / 1000000000D as decimal(18,6)))",
    "duration::from_micros": "make_dt_interval(0, 0, 0, cast({0} / 1000000D as decimal(18,6)))",
    "duration::from_millis": "make_dt_interval(0, 0, 0, cast({0} / 1000D as decimal(18,6)))",
    "duration::from_secs": "make_dt_interval(0, 0, 0, cast({0} as decimal(18,6)))",
    "duration::from_mins": "make_dt_interval(0, 0, cast({0} as int), 0)",
    "duration::from_hours": "make_dt_interval(0, cast({0} as int), 0, 0)",
    "duration::from_days": "make_dt_interval(cast({0} as int), 0, 0, 0)",
    "duration::from_weeks": "make_dt_interval(cast({0} * 7 as int), 0, 0, 0)",
    # geometry: points are structs (x longitude, y latitude)
    "geo::distance": f"({_RAD} * 2 * asin(least(1D, sqrt(pow(sin(({_LAT1} - {_LAT0}) / 2), 2) + cos({_LAT0}) * cos({_LAT1}) * pow(sin(({_LON1} - {_LON0}) / 2), 2)))))",
    "geo::bearing": f"(pmod(degrees(atan2(sin({_LON1} - {_LON0}) * cos({_LAT1}), cos({_LAT0}) * sin({_LAT1}) - sin({_LAT0}) * cos({_LAT1}) * cos({_LON1} - {_LON0}))) + 180D, 360D) - 180D)",
    # numbers
    "math::abs": "abs({0})",
    "math::acos": "acos({0})",
    "math::acot": "atan(1D / {0})",
    "math::asin": "asin({0})",
    "math::atan": "atan({0})",
    "math::bottom": "slice(array_sort({0}), 1, cast({1} as int))",
    "math::top": "slice(sort_array({0}, false), 1, cast({1} as int))",
    "math::ceil": "ceil({0})",
    "math::clamp": "least(greatest({0}, {1}), {2})",
    "math::cos": "cos({0})",
    "math::cot": "cot({0})",
    "math::deg2rad": "radians({0})",
    "math::rad2deg": "degrees({0})",
    "math::fixed": "round({0}, cast({1} as int))",
    "math::floor": "floor({0})",
    "math::interquartile": f"({_P75} - {_P25})",
    "math::midhinge": f"(({_P75} + {_P25}) / 2)",
    "math::trimean": f"((({_P75} + {_P25}) / 2 + {_P50}) * 0.5D)",
    "math::median": f"(CASE WHEN size({{0}}) = 0 THEN null ELSE {_P50} END)",
    "math::percentile": _PCT.format(p="{1}"),
    "math::nearestrank": "(CASE WHEN size({0}) = 0 THEN double('NaN') ELSE double(element_at(array_sort({0}), cast(least(floor(size({0}) * {1} / 100D), size({0}) - 1) as int) + 1)) END)",
    "math::lerp": "({0} + {2} * ({1} - {0}))",
    "math::lerpangle": "({0} + {2} * if(pmod({1} - {0}, 360D) > 180, 360 - pmod({1} - {0}, 360D), pmod({1} - {0}, 360D)))",
    "math::ln": "(CASE WHEN {0} < 0 THEN double('NaN') WHEN {0} = 0 THEN double('-Infinity') ELSE ln({0}) END)",
    "math::log": "(ln({0}) / ln({1}))",
    "math::log10": "(CASE WHEN {0} < 0 THEN double('NaN') WHEN {0} = 0 THEN double('-Infinity') ELSE log10({0}) END)",
    "math::log2": "(CASE WHEN {0} < 0 THEN double('NaN') WHEN {0} = 0 THEN double('-Infinity') ELSE log2({0}) END)",
    "math::max": "(CASE WHEN size({0}) = 0 THEN double('-Infinity') ELSE array_max({0}) END)",
    "math::min": "(CASE WHEN size({0}) = 0 THEN double('Infinity') ELSE array_min({0}) END)",
    "math::mean": _MEAN,
    "math::mode": "(CASE WHEN size({0}) = 0 THEN double('NaN') ELSE double(array_max(transform(array_distinct({0}), v -> struct(size(filter({0}, y -> y = v)) as n, v as v))).v) END)",
    "math::pow": "pow({0}, {1})",
    "math::product": "aggregate({0}, 1D, (acc, x) -> acc * x)",
    "math::round": "round({0})",
    "math::sign": "bigint(signum({0}))",
    "math::sin": "sin({0})",
    "math::spread": "(CASE WHEN size({0}) = 0 THEN double('NaN') ELSE array_max({0}) - array_min({0}) END)",
    "math::sqrt": "(CASE WHEN {0} < 0 THEN double('NaN') ELSE sqrt({0}) END)",
    "math::stddev": f"sqrt({_VAR})",
    "math::variance": _VAR,
    "math::sum": "aggregate({0}, 0D, (acc, x) -> acc + x)",
    "math::tan": "tan({0})",
    # objects held as maps
    "object::entries": "transform(array_sort(map_keys({0})), k -> struct(k as key, element_at({0}, k) as value))",
    "object::extend": "map_concat(map_filter({0}, (k, v) -> not map_contains_key({1}, k)), {1})",
    "object::from_entries": "map_from_entries({0})",
    "object::is_empty": "(size({0}) = 0)",
    "object::keys": "array_sort(map_keys({0}))",
    "object::len": "bigint(size({0}))",
    "object::remove": "map_filter({0}, (k, v) -> k <> {1})",
    "object::values": "transform(array_sort(map_keys({0})), k -> element_at({0}, k))",
    # parsing
    "parse::email::host": f"if({_like(_EMAIL)}, regexp_extract({{0}}, '@(.*)$', 1), null)",
    "parse::email::user": f"if({_like(_EMAIL)}, regexp_extract({{0}}, '^(.*)@', 1), null)",
    "parse::url::domain": f"if({_URL_HOST.replace('parse_url', 'try_parse_url')} rlike '^{_V4}$', null, try_parse_url({{0}}, 'HOST'))",
    "parse::url::host": "try_parse_url({0}, 'HOST')",
    "parse::url::fragment": "try_parse_url({0}, 'REF')",
    "parse::url::path": "if(try_parse_url({0}, 'PATH') = '', '/', try_parse_url({0}, 'PATH'))",
    "parse::url::port": "coalesce(try_cast(regexp_extract(try_parse_url({0}, 'AUTHORITY'), ':([0-9]+)$', 1) as bigint), CASE try_parse_url({0}, 'PROTOCOL') WHEN 'http' THEN 80L WHEN 'https' THEN 443L WHEN 'ftp' THEN 21L WHEN 'ws' THEN 80L WHEN 'wss' THEN 443L END)",
    "parse::url::query": "try_parse_url({0}, 'QUERY')",
    "parse::url::scheme": "try_parse_url({0}, 'PROTOCOL')",
    # chance
    "rand": "rand()",
    "rand::bool": "(rand() < 0.5D)",
    "rand::float": {0: "rand()", 2: "(least({0}, {1}) + rand() * abs({1} - {0}))"},
    "rand::int": {0: "cast(floor(rand() * 9007199254740992D) as bigint)", 2: "cast(floor(least({0}, {1}) + rand() * (abs({1} - {0}) + 1)) as bigint)"},
    "rand::enum": "get(shuffle(array({*})), 0)",
    "rand::string": {0: "randstr(32)", 1: "randstr(cast({0} as int))", 2: "substr(randstr(cast({1} as int)), 1, cast({0} + floor(rand() * ({1} - {0} + 1)) as int))"},
    "rand::id": {0: "randstr(20)", 1: "randstr(cast({0} as int))", 2: "substr(randstr(cast({1} as int)), 1, cast({0} + floor(rand() * ({1} - {0} + 1)) as int))"},
    "rand::time": {0: "timestamp_seconds(cast(floor(rand() * 2147483647D) as bigint))", 2: "timestamp_seconds(cast({0} + rand() * ({1} - {0}) as bigint))"},
    "rand::duration": "make_dt_interval(0, 0, 0, cast((extract(SECOND FROM {0}) + extract(MINUTE FROM {0}) * 60 + extract(HOUR FROM {0}) * 3600 + extract(DAY FROM {0}) * 86400) + rand() * ((extract(SECOND FROM {1}) + extract(MINUTE FROM {1}) * 60 + extract(HOUR FROM {1}) * 3600 + extract(DAY FROM {1}) * 86400) - (extract(SECOND FROM {0}) + extract(MINUTE FROM {0}) * 60 + extract(HOUR FROM {0}) * 3600 + extract(DAY FROM {0}) * 86400)) as decimal(18,6)))",
    "rand::uuid": {0: "uuid()"},
    "rand::uuid::v4": "uuid()",
    # record ids are strings table:key
    "record::id": "substr({0}, instr({0}, ':') + 1)",
    "meta::id": "substr({0}, instr({0}, ':') + 1)",
    "record::table": "split_part({0}, ':', 1)",
    "record::tb": "split_part({0}, ':', 1)",
    "meta::tb": "split_part({0}, ':', 1)",
    # strings
    "string::capitalize": "array_join(transform(split({0}, '(?<=\\\\s)|(?=\\\\s)'), w -> concat(upper(substr(w, 1, 1)), substr(w, 2))), '')",
    "string::concat": "concat({*s})",
    "string::contains": "contains({0}, {1})",
    "string::starts_with": "startswith({0}, {1})",
    "string::ends_with": "endswith({0}, {1})",
    "string::join": "concat_ws({*s})",
    "string::len": "bigint(char_length({0}))",
    "string::lowercase": "lower({0})",
    "string::uppercase": "upper({0})",
    "string::matches": "coalesce({0} rlike {1}, false)",
    "string::repeat": "repeat({0}, cast({1} as int))",
    "string::replace": "replace({0}, {1}, {2})",
    "string::reverse": "reverse({0})",
    "string::slice": {1: "{0}", 2: f"substr({{0}}, cast({_norm('{1}', 'char_length({0})')} as int) + 1)", 3: f"substr({{0}}, cast({_norm('{1}', 'char_length({0})')} as int) + 1, cast(greatest({_norm('{2}', 'char_length({0})')} - {_norm('{1}', 'char_length({0})')}, 0) as int))"},
    "string::split": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)",
    "string::trim": "regexp_replace({0}, '^\\\\s+|\\\\s+$', '')",
    "string::words": "filter(split({0}, '[ \\\\t\\\\n\\\\f\\\\r]+'), w -> w <> '')",
    "string::distance::levenshtein": "bigint(levenshtein({0}, {1}))",
    "string::distance::normalized_levenshtein": "(CASE WHEN greatest(char_length({0}), char_length({1})) = 0 THEN 1D ELSE 1D - levenshtein({0}, {1}) / double(greatest(char_length({0}), char_length({1}))) END)",
    "string::distance::hamming": "if(char_length({0}) <> char_length({1}), bigint(raise_error('strings differ in length')), bigint(aggregate(zip_with(split({0}, ''), split({1}, ''), (x, y) -> if(x = y, 0, 1)), 0, (acc, x) -> acc + x)))",
    "string::is_alphanum": _like(r"^[\\p{{L}}\\p{{N}}]+$"),
    "string::is_alpha": _like(r"^\\p{{L}}+$"),
    "string::is_ascii": _like(r"^[\\x00-\\x7F]*$"),
    "string::is_numeric": _like(r"^\\p{{N}}+$"),
    "string::is_hexadecimal": _like("^[0-9A-Fa-f]+$"),
    "string::is_datetime": {1: "(try_cast({0} as timestamp) is not null)", 2: "(try_to_timestamp({0}, {1}) is not null)"},
    "string::is_domain": _like(_DOMAIN),
    "string::is_email": _like(_EMAIL),
    "string::is_ip": _like(f"^({_V4}|{_V6})$"),
    "string::is_ipv4": _like(f"^{_V4}$"),
    "string::is_ipv6": _like(f"^{_V6}$"),
    "string::is_latitude": _like(r"^[-+]?([1-8]?[0-9](\\.[0-9]+)?|90(\\.0+)?)$"),
    "string::is_longitude": _like(r"^[-+]?(180(\\.0+)?|((1[0-7][0-9])|([1-9]?[0-9]))(\\.[0-9]+)?)$"),
    "string::is_semver": _like(_SEMVER),
    "string::is_url": "(try_parse_url({0}, 'PROTOCOL') is not null)",
    "string::is_ulid": _like("^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{{25}}$"),
    "string::is_uuid": _like("^[0-9a-fA-F]{{8}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{12}}$"),
    "string::is_record": {1: _like("^[A-Za-z_][A-Za-z0-9_]*:[^:].*$"), 2: "coalesce(startswith({0}, concat({1}, ':')), false)"},
    "string::semver::major": _MAJOR,
    "string::semver::minor": _MINOR,
    "string::semver::patch": _PATCH,
    "string::semver::compare": "bigint(CASE WHEN transform(split({0}, '\\\\.'), x -> bigint(x)) < transform(split({1}, '\\\\.'), x -> bigint(x)) THEN -1 WHEN {0} = {1} THEN 0 ELSE 1 END)",
    "string::semver::inc::major": f"concat_ws('.', {_MAJOR} + 1, 0, 0)",
    "string::semver::inc::minor": f"concat_ws('.', {_MAJOR}, {_MINOR} + 1, 0)",
    "string::semver::inc::patch": f"concat_ws('.', {_MAJOR}, {_MINOR}, {_PATCH} + 1)",
    "string::semver::set::major": f"concat_ws('.', {{1}}, {_MINOR}, {_PATCH})",
    "string::semver::set::minor": f"concat_ws('.', {_MAJOR}, {{1}}, {_PATCH})",
    "string::semver::set::patch": f"concat_ws('.', {_MAJOR}, {_MINOR}, {{1}})",
    # times
    "time::ceil": _step("ceil"),
    "time::floor": _step("floor"),
    "time::round": _step("round"),
    "time::group": "date_trunc({1}, {0})",
    "time::max": "array_max({0})",
    "time::min": "array_min({0})",
    "time::now": "current_timestamp()",
    "time::timezone": "current_timezone()",
    "time::from_nanos": "timestamp_micros(bigint({0}) div 1000)",
    "time::from_micros": "timestamp_micros(bigint({0}))",
    "time::from_millis": "timestamp_millis(bigint({0}))",
    "time::from_secs": "timestamp_seconds(bigint({0}))",
    "time::from_unix": "timestamp_seconds(bigint({0}))",
    "time::from_uuid": "timestamp_millis(bigint(conv(substr(replace({0}, '-', ''), 1, 12), 16, 10)))",
    "time::set_year": _made(year="{1}"),
    "time::set_month": _made(month="{1}"),
    "time::set_day": _made(day="{1}"),
    "time::set_hour": _made(hour="{1}"),
    "time::set_minute": _made(minute="{1}"),
    "time::set_second": _made(sec="{1} + (extract(SECOND FROM {0}) - floor(extract(SECOND FROM {0})))"),
    "time::set_nanosecond": _made(sec="floor(extract(SECOND FROM {0})) + {1} / 1000000000D"),
    # types
    "type::array": "array({0})",
    "type::bool": "boolean({0})",
    "type::bytes": "binary({0})",
    "type::datetime": "timestamp({0})",
    "type::decimal": "cast({0} as decimal(38,18))",
    "type::float": "double({0})",
    "type::int": "bigint({0})",
    "type::number": "double({0})",
    "type::string": "string({0})",
    "type::string_lossy": "decode({0}, 'UTF-8')",
    "type::set": "array_sort(array_distinct({0}))",
    "type::uuid": "lower({0})",
    "type::point": "named_struct('x', double(get({0}, 0)), 'y', double(get({0}, 1)))",
    "type::record": {1: "string({0})", 2: "concat({0}, ':', {1})"},
    # vectors
    "vector::add": "zip_with({0}, {1}, (x, y) -> x + y)",
    "vector::subtract": "zip_with({0}, {1}, (x, y) -> x - y)",
    "vector::multiply": "zip_with({0}, {1}, (x, y) -> x * y)",
    "vector::divide": "zip_with({0}, {1}, (x, y) -> if(y = 0, double('NaN'), double(x) / y))",
    "vector::angle": f"acos({_DOT} / ({_NORM0} * {_NORM1}))",
    "vector::cross": "array(get({0}, 1) * get({1}, 2) - get({0}, 2) * get({1}, 1), get({0}, 2) * get({1}, 0) - get({0}, 0) * get({1}, 2), get({0}, 0) * get({1}, 1) - get({0}, 1) * get({1}, 0))",
    "vector::dot": _DOT,
    "vector::magnitude": _NORM0,
    "vector::normalize": f"transform({{0}}, x -> double(x) / {_NORM0.replace('(acc, x) -> acc + double(x) * double(x)', '(acc, z) -> acc + double(z) * double(z)')})",
    "vector::project": f"transform({{1}}, z -> z * {_DOT} / aggregate({{1}}, 0D, (acc, x) -> acc + double(x) * double(x)))",
    "vector::scale": "transform({0}, x -> x * {1})",
    "vector::distance::chebyshev": "array_max(zip_with({0}, {1}, (x, y) -> abs(double(x) - double(y))))",
    "vector::distance::euclidean": "sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (acc, x) -> acc + x))",
    "vector::distance::hamming": "bigint(size(filter(zip_with({0}, {1}, (x, y) -> x <> y), d -> d)))",
    "vector::distance::manhattan": "aggregate(zip_with({0}, {1}, (x, y) -> abs(double(x) - double(y))), 0D, (acc, x) -> acc + x)",
    "vector::distance::minkowski": "pow(aggregate(zip_with({0}, {1}, (x, y) -> pow(abs(double(x) - double(y)), {2})), 0D, (acc, x) -> acc + x), 1D / {2})",
    "vector::distance::cosine": f"(1D - {_DOT} / ({_NORM0} * {_NORM1}))",
    "vector::similarity::cosine": f"({_DOT} / ({_NORM0} * {_NORM1}))",
    "vector::similarity::jaccard": "(size(array_intersect({0}, {1})) / double(size(array_union({0}, {1}))))",
    "vector::similarity::pearson": f"(aggregate(zip_with({{0}}, {{1}}, (x, y) -> (double(x) - {_AVG0}) * (double(y) - {_AVG1})), 0D, (acc, x) -> acc + x) / sqrt(aggregate(transform({{0}}, x -> pow(double(x) - {_AVG0}, 2)), 0D, (acc, x) -> acc + x) * aggregate(transform({{1}}, x -> pow(double(x) - {_AVG1}, 2)), 0D, (acc, x) -> acc + x)))",
}
#: Parts of a time; without an argument, of the current time.
TIME_PARTS = {
    "day": "bigint(day({0}))", "hour": "bigint(hour({0}))", "minute": "bigint(minute({0}))", "second": "bigint(second({0}))",
    "month": "bigint(month({0}))", "year": "bigint(year({0}))", "week": "bigint(weekofyear({0}))", "yday": "bigint(dayofyear({0}))",
    "wday": "bigint(weekday({0}) + 1)", "unix": "unix_seconds({0})", "millis": "unix_millis({0})", "micros": "unix_micros({0})",
    "nano": "(unix_micros({0}) * 1000)", "is_leap_year": "(year({0}) % 4 = 0 and (year({0}) % 100 <> 0 or year({0}) % 400 = 0))",
}
for _name, _sql in TIME_PARTS.items():
    SCALAR[f"time::{_name}"] = {0: _sql.format("current_timestamp()"), 1: _sql}
