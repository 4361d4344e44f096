"""Values that the language's functions and operators give."""

import datetime as dt
import math

import pytest

CASES = [
    ("5 / 4", 1), ("5.0 / 4", 1.25), ("7 % 3", 1), ("2 ** 10", 1024), ("1 + 2 * 3", 7), ("'a' + 'b'", "ab"), ("[1] + [2]", [1, 2]), ("[1, 2, 2] - 2", [1]),
    ("NONE < 5", True), ("NULL = NONE", True), ("1 = '1'", False), ("1 < 'a'", True), ("true < 1", True), ("!0", True), ("!''", True), ("![1]", False),
    ("0 ?: 5", 5), ("NONE ?? 5", 5), ("3 IN [1, 2, 3]", True), ("3 NOT IN [1, 2, 3]", False), ("5 IN 1..5", False), ("5 IN 1..=5", True),
    ("[1, 2] CONTAINSALL [1]", True), ("[1, 2] CONTAINSANY [5, 2]", True), ("[1, 2] CONTAINSNONE [5]", True), ("[1] ALLINSIDE [1, 2]", True), ("'abc' CONTAINS 'b'", True),
    ("[1, 1] *= 1", True), ("[1, 2] ?= 2", True), ("'abc' = /b/", True), ("IF 1 > 2 THEN 'a' ELSE 'b' END", "b"), ("<int>'5'", 5), ("<string>5", "5"), ("<array>1..4", [1, 2, 3]),
    # arrays
    ("array::add([1, 2], 2)", [1, 2]), ("array::append([1], 2)", [1, 2]), ("array::at([1, 2, 3], -1)", 3), ("array::boolean_and([true, false], [true, true])", [True, False]),
    ("array::clump([1, 2, 3, 4, 5], 2)", [[1, 2], [3, 4], [5]]), ("array::combine([1, 2], [3])", [[1, 3], [2, 3]]), ("array::complement([1, 2, 2, 3], [3])", [1, 2, 2]),
    ("array::difference([1, 1, 2], [1, 3])", [1, 2, 3]), ("array::distinct([1, 2, 1])", [1, 2]), ("array::fill([1, 2, 3], 0)", [0, 0, 0]), ("array::flatten([[1], [2]])", [1, 2]),
    ("array::insert([1, 3], 2, 1)", [1, 2, 3]), ("array::intersect([1, 1, 2], [1, 1, 5])", [1, 1]), ("array::join([1, 2], '-')", "1-2"), ("array::logical_and([true, false], [false, true])", [False, False]),
    ("array::matches([1, 2], 2)", [False, True]), ("array::max([1, 5, 2])", 5), ("array::pop([1, 2])", 2), ("array::prepend([2], 1)", [1, 2]), ("array::range(1, 3)", [1, 2, 3]),
    ("array::remove([1, 2, 3], 1)", [1, 3]), ("array::remove([1, 2, 3], -1)", [1, 2]), ("array::reverse([1, 2])", [2, 1]), ("array::slice([1, 2, 3, 4], 1, 3)", [2, 3]), ("array::slice([1, 2, 3, 4], -2)", [3, 4]),
    ("array::sort([3, 1, 2], 'desc')", [3, 2, 1]), ("array::sort_natural(['a10', 'a2'])", ["a2", "a10"]), ("array::swap([1, 2, 3], 0, 2)", [3, 2, 1]), ("array::transpose([[1, 2], [3, 4]])", [[1, 3], [2, 4]]),
    ("array::union([1, 2], [2, 3])", [1, 2, 3]), ("array::windows([1, 2, 3], 2)", [[1, 2], [2, 3]]), ("array::all([1, 2], |$x| $x > 0)", True), ("array::any([0, 0])", False),
    ("array::filter([1, 2, 3], |$x| $x > 1)", [2, 3]), ("array::filter_index([5, 6, 5], 5)", [0, 2]), ("array::find([1, 2, 3], |$x| $x > 1)", 2), ("array::find_index([1, 2, 3], 3)", 2),
    ("array::fold([1, 2, 3], 10, |$a, $x| $a + $x)", 16), ("array::map([1, 2], |$x, $i| $x * 10 + $i)", [10, 21]), ("array::reduce([1, 2, 3], |$a, $b| $a * $b)", 6), ("array::reduce([5], |$a, $b| $a * $b)", 5),
    ("array::sequence(3)", [0, 1, 2]), ("array::repeat(7, 2)", [7, 7]), ("array::len([1, 2])", 2), ("array::is_empty([])", True), ("count([1, 0, 2])", 2), ("count(5)", 1), ("array::group([[1], [1, 2]])", [1, 2]),
    # sets
    ("set::union([1], [3, 2])", [1, 2, 3]), ("set::difference([1, 2], [2, 3])", [1, 3]), ("set::intersect([3, 2], [2, 3])", [2, 3]), ("set::contains([1], 1)", True), ("set::map([1, 2], |$x| $x % 1)", [0]),
    # numbers
    ("math::abs(-5)", 5), ("math::ceil(1.2)", 2), ("math::floor(1.8)", 1), ("math::round(2.5)", 3), ("math::fixed(3.14159, 2)", 3.14), ("math::clamp(15, 0, 10)", 10), ("math::sqrt(16)", 4.0), ("math::pow(2, 3)", 8),
    ("math::sum([1, 2, 3])", 6), ("math::mean([1, 2])", 1.5), ("math::median([3, 1, 2])", 2.0), ("math::mode([1, 1, 2, 2])", 2.0), ("math::percentile([1, 2, 3, 4], 50)", 2.5), ("math::nearestrank([1, 2, 3, 4], 50)", 3.0),
    ("math::interquartile([1, 2, 3, 4, 5])", 2.0), ("math::spread([1, 5])", 4.0), ("math::stddev([5])", 0.0), ("math::variance([1, 2, 3])", 1.0), ("math::top([1, 3, 2], 2)", [3, 2]), ("math::bottom([1, 3, 2], 2)", [1, 2]),
    ("math::product([2, 3])", 6), ("math::sign(-3)", -1), ("math::lerp(0, 10, 0.5)", 5.0), ("math::rad2deg(math::pi)", 180.0), ("math::log(8, 2)", 3.0), ("math::max([])", -math.inf), ("math::min([])", math.inf),
    # strings
    ("string::capitalize('hello wORLD')", "Hello WORLD"), ("string::concat('a', 1)", "a1"), ("string::join('-', 'a', 'b')", "a-b"), ("string::len('héé')", 3), ("string::slice('hello', 1, 3)", "el"), ("string::slice('hello', -3)", "llo"),
    ("string::split('a,b', ',')", ["a", "b"]), ("string::trim('  a ')", "a"), ("string::words(' a  b ')", ["a", "b"]), ("string::replace('aXb', 'X', '-')", "a-b"), ("string::replace('a1b2', /[0-9]/, '')", "ab"), ("string::repeat('ab', 2)", "abab"),
    ("string::distance::levenshtein('kitten', 'sitting')", 3), ("string::distance::hamming('abc', 'abd')", 1), ("string::distance::osa('ca', 'abc')", 3), ("string::distance::damerau_levenshtein('ca', 'abc')", 2), ("string::similarity::sorensen_dice('night', 'nacht')", 0.25),
    ("string::is_email('a@b.co')", True), ("string::is_email('nope')", False), ("string::is_ipv4('256.1.1.1')", False), ("string::is_ipv6('2001:db8::1')", True), ("string::is_uuid('018f9a6e-1111-7111-8111-123456789012')", True), ("string::is_semver('1.2.3-a')", True),
    ("string::is_latitude('91')", False), ("string::is_longitude('-180')", True), ("string::is_domain('a.example.com')", True), ("string::is_datetime('2024-01-01T00:00:00Z')", True), ("string::semver::compare('1.10.0', '1.9.0')", 1), ("string::semver::inc::minor('1.2.3')", "1.3.0"), ("string::semver::set::patch('1.2.3', 9)", "1.2.9"),
    ("string::slug('Héllo, World!')", "hello-world"), ("string::html::encode('<a>')", "&lt;a&gt;"), ("string::html::sanitize('a<script>x</script>b')", "ab"), ("string::is_record('a:1')", True),
    # times and durations
    ("time::year(d'2024-02-03T04:05:06Z')", 2024), ("time::wday(d'2024-02-04T00:00:00Z')", 7), ("time::week(d'2024-01-01T00:00:00Z')", 1), ("time::yday(d'2024-03-01T00:00:00Z')", 61), ("time::is_leap_year(d'2024-01-01T00:00:00Z')", True),
    ("time::floor(d'2024-02-03T04:45:06Z', 1h)", dt.datetime(2024, 2, 3, 4)), ("time::ceil(d'2024-02-03T04:05:06Z', 1h)", dt.datetime(2024, 2, 3, 5)), ("time::round(d'2024-02-03T04:30:00Z', 1h)", dt.datetime(2024, 2, 3, 5)),
    ("time::group(d'2024-02-03T04:05:06Z', 'month')", dt.datetime(2024, 2, 1)), ("time::format(d'2024-02-03T04:05:06Z', '%Y-%m-%d')", "2024-02-03"), ("time::from_unix(0)", dt.datetime(1970, 1, 1)), ("time::set_year(d'2024-02-03T00:00:00Z', 2020)", dt.datetime(2020, 2, 3)),
    ("time::unix(d'1970-01-02T00:00:00Z')", 86400), ("d'2024-01-01T00:00:00Z' + 1d", dt.datetime(2024, 1, 2)), ("duration::hours(1d2h)", 26), ("duration::from_mins(90)", dt.timedelta(minutes=90)), ("duration::millis(1s500ms)", 1500), ("<duration>'1h30m'", dt.timedelta(minutes=90)), ("duration::weeks(15d)", 2),
    # objects, types, encodings, hashes, parsing
    ("object::keys({ b: 1, a: 2 })", ["a", "b"]), ("object::values({ b: 1, a: 2 })", [2, 1]), ("object::len({ a: 1 })", 1), ("object::extend({ a: 1 }, { a: 2, b: 3 }).a", 2), ("object::remove({ a: 1, b: 2 }, 'a').b", 2), ("object::from_entries([['a', 1]]).a", 1),
    ("type::of(5)", "int"), ("type::of(1.5)", "float"), ("type::of('a')", "string"), ("type::of(1h)", "duration"), ("type::is_array([1])", True), ("type::is_none(NONE)", True), ("type::is_number(1)", True), ("type::is_point((1.0, 2.0))", True), ("type::record('a', 5)", "a:5"), ("type::int('7')", 7),
    ("record::id(person:5)", "5"), ("record::table(person:5)", "person"), ("crypto::md5('a')", "0cc175b9c0f1b6a831c399e269772661"), ("crypto::joaat('a')", 3392050242), ("crypto::blake3('')", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), ("encoding::cbor::decode(encoding::cbor::encode({ a: [1, -2], b: 1.5, c: 'é', d: true }))", '{"a":[1,-2],"b":1.5,"c":"é","d":true}'), ("encoding::base64::encode('hi')", "aGk"), ("<string>encoding::base64::decode('aGk')", "hi"),
    ("encoding::json::encode({ a: 1 })", '{"a":1}'), ("parse::email::user('x@y.com')", "x"), ("parse::url::path('http://a.com')", "/"), ("parse::url::port('https://a.com/x')", 443), ("parse::url::query('http://a.com/?q=1')", "q=1"), ("bytes::len(<bytes>'abc')", 3),
    # vectors, geometry
    ("vector::add([1, 2], [3, 4])", [4, 6]), ("vector::dot([1, 2], [3, 4])", 11.0), ("vector::cross([1, 0, 0], [0, 1, 0])", [0, 0, 1]), ("vector::magnitude([3, 4])", 5.0), ("vector::distance::euclidean([0, 0], [3, 4])", 5.0), ("vector::distance::chebyshev([1, 5], [2, 1])", 4.0),
    ("vector::distance::hamming([1, 2], [1, 3])", 1), ("vector::similarity::jaccard([1, 2], [2, 3])", 1 / 3), ("vector::scale([1, 2], 3)", [3, 6]), ("vector::normalize([3, 4])", [0.6, 0.8]), ("geo::hash::encode((-5.6, 42.6), 5)", "ezs42"), ("geo::hash::encode({ type: 'Point', coordinates: [-5.6, 42.6] }, 5)", "ezs42"), ("math::round(geo::area({ type: 'Polygon', coordinates: [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]] }) / 100000000)", 124.0), ("geo::centroid({ type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] }).x", 1.0), ("{ type: 'Polygon', coordinates: [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]] } CONTAINS (1.0, 1.0)", True), ("geo::bearing((0.0, 0.0), (0.0, 1.0))", 0.0),
    # paths, methods, closures
    ("[1, 2, 3][WHERE $this > 1]", [2, 3]), ("{ a: [{ b: 1 }, { b: 2 }] }.a.b", [1, 2]), ("[1, 2, 3][$]", 3), ("[[1], [2]]…".replace("…", "..."), [1, 2]), ("'abc'.uppercase()", "ABC"), ("[1, 2].map(|$x| $x + 1).len()", 2), ("{ a: 1, b: 2 }.{ a }.a", 1), ("5.chain(|$x| $x + 1)", 6),
    ("value::diff({ a: 1 }, { a: 2 })", '[{"op":"replace","path":"/a","value":2}]'), ("{ LET $a = 2; RETURN $a * 2; }", 4), ("[1, 2, 3][1..]", [2, 3]),
]


def same(a, b):
    if isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9)
    if isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def one(engine, text):
    try:
        return engine.value(f"RETURN {text}")
    except Exception as x:  # noqa: BLE001
        return x


def test_values(engine):
    """Twenty cases are the fields of one object, so that they share a plan."""
    wrong = []
    for k in range(0, len(CASES), 20):
        part = CASES[k : k + 20]
        fields = ", ".join(f"c{i}: ({text})" if text[0] != "{" else f"c{i}: {text}" for i, (text, _) in enumerate(part))
        try:
            got = engine.value(f"RETURN {{ {fields} }}")
            values = [got[f"c{i}"] for i in range(len(part))]
        except Exception:  # noqa: BLE001
            values = [one(engine, text) for text, _ in part]
        wrong += [(text, v, want) for (text, want), v in zip(part, values) if isinstance(v, Exception) or not same(v, want)]
    assert not wrong, "\n".join(map(str, wrong))


def test_long_decimals(engine):
    assert engine.value("RETURN 123456789012345678901234567890dec + 1dec") == 123456789012345678901234567891
    assert float(engine.value("RETURN 1.5dec * 2dec")) == 3.0


def test_empty_numbers_are_nan(engine):
    assert math.isnan(engine.value("RETURN math::mean([])"))
    assert math.isnan(engine.value("RETURN 1 / 0"))
    assert engine.value("RETURN 1.0 / 0") == math.inf


@pytest.mark.parametrize("text", ["fn::nope()", "nope::x(1)", "vector::similarity::spearman([1], [2])", "array::windows([1], 0)", "http::get('http://x')"])
def test_refused(engine, text):
    with pytest.raises(ValueError):
        engine.value(f"RETURN {text}")


def test_geohashes_of_columns_are_those_of_rows():
    import pandas as pd

    from omniframe.functions.python_udfs import geohash_of, geohashes, vectorised

    xs = [k * 7.3 - 180 for k in range(50)] + [0.0, -0.0, 180.0, -180.0, 5.625, 500.0, None, float("nan"), float("inf")]
    ys = [k * 3.7 - 90 for k in range(50)] + [0.0, -0.0, 90.0, -90.0, 2.8125, 1.0, 1.0, 1.0, -1.0]
    for size in (0, 1, 6, 12, 20):
        columns = pd.Series(xs, dtype="float64"), pd.Series(ys, dtype="float64"), pd.Series([size] * len(xs))
        assert geohashes(*columns).tolist() == vectorised(geohash_of)(*columns).tolist()


def test_equal_shapes_are_worked_out_once():
    import pandas as pd

    from omniframe.functions.python_udfs import ONCE_EACH, once_each

    calls: list[str] = []
    assert once_each(lambda s: calls.append(s) or len(s))(pd.Series(["ab", "c", "ab", None, "ab"])).tolist()[:3] == [2, 1, 2]
    assert calls == ["ab", "c"] and {"geo_area", "geo_centroid"} <= ONCE_EACH and "pbkdf2" not in ONCE_EACH


def test_a_point_is_valid_without_python(engine):
    engine.query("CREATE p:a SET x = 1.0; CREATE p:b SET x = math::inf")
    got = engine.sql("SELECT id, geo::is_valid((x, 7.0)) AS v FROM p")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.v for r in got.collect()} == {"p:a": True, "p:b": False}
