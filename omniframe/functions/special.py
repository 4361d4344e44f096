"""Functions that depend on their arguments' types, take closures, or need Python.

Each is a builder (call node, scope) -> Val. Those that Spark has no
expression for are Arrow-batched pandas UDFs (``python_udfs``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from omniframe.functions import python_udfs
from omniframe.plans import ast as A
from omniframe.plans import compiler as C
from omniframe.plans.compiler import QueryError, Scope, arrow, bind, compile, element, lit, sequence_of, typed
from omniframe.plans.values import Val, equal, text, truthy

SPECIAL: dict[str, Callable[[A.Call, Scope], Val]] = {}


def special(*names: str) -> Callable:
    def keep(f: Callable[[A.Call, Scope], Val]) -> Callable[[A.Call, Scope], Val]:
        for n in names:
            SPECIAL[n] = f
        return f

    return keep


def first(n: A.Call, scope: Scope) -> Val:
    if not n.args:
        raise QueryError(f"{n.name} wants an argument")
    a = n.args[0]
    if isinstance(a, A.Range) and a.begin is not None and a.end is not None:
        return sequence_of(a, scope)
    return compile(a, scope)


def closure(a: A.Node, scope: Scope) -> A.Closure | None:
    if isinstance(a, A.Closure):
        return a
    if isinstance(a, A.Param):
        v = scope.params.get(a.name)
        return v if isinstance(v, A.Closure) else None
    return None


def test(n: A.Call, scope: Scope, k: int = 1) -> str:
    """The lambda of a condition: a closure, a value to equal, or truth itself."""
    v = first(n, scope)
    kind = element(v)
    if len(n.args) <= k:
        x = Val("x", kind)
        return f"x -> {truthy(x)}"
    f = closure(n.args[k], scope)
    if f is not None:
        names, body = bind(f, scope, [kind, T.LongType()])
        return arrow(names, truthy(body))
    return f"x -> {equal(Val('x', kind), compile(n.args[k], scope))}"


@special("array::all", "array::every", "set::all")
def _all(n: A.Call, scope: Scope) -> Val:
    return Val(f"coalesce(forall({first(n, scope).sql}, {test(n, scope)}), false)", T.BooleanType())


@special("array::any", "array::some", "array::includes", "set::any")
def _any(n: A.Call, scope: Scope) -> Val:
    return Val(f"coalesce(exists({first(n, scope).sql}, {test(n, scope)}), false)", T.BooleanType())


@special("array::filter", "set::filter")
def _filter(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    return Val(f"filter({v.sql}, {test(n, scope)})", v.type)


@special("array::find", "set::find")
def _find(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    return Val(f"get(filter({v.sql}, {test(n, scope)}), 0)", element(v))


def _indexes(n: A.Call, scope: Scope) -> str:
    v = first(n, scope)
    flags = f"transform({v.sql}, {test(n, scope)})"
    return f"transform(filter(transform({flags}, (f, i) -> struct(f, bigint(i) as i)), s -> s.f), s -> s.i)"


@special("array::logical_xor")
def _logical_xor(n: A.Call, scope: Scope) -> Val:
    """The truthy one of each pair; of two that are not, the first; of two that are, false."""
    a, b = (compile(x, scope) for x in n.args)
    kind = element(a)
    neither = "false" if kind == T.BooleanType() else f"CAST(NULL AS {kind.simpleString()})"
    return typed(scope, f"zip_with({a.sql}, {b.sql}, (x, y) -> if(not coalesce(boolean(y), false), x, if(not coalesce(boolean(x), false), y, {neither})))")


@special("array::filter_index")
def _filter_index(n: A.Call, scope: Scope) -> Val:
    return Val(_indexes(n, scope), T.ArrayType(T.LongType()))


@special("array::find_index", "array::index_of")
def _find_index(n: A.Call, scope: Scope) -> Val:
    return Val(f"get({_indexes(n, scope)}, 0)", T.LongType())


@special("array::map", "set::map")
def _map(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    names, body = bind(closure(n.args[1], scope), scope, [element(v), T.LongType()])
    sql = f"transform({v.sql}, {arrow(names, body.sql)})"
    return typed(scope, f"array_sort(array_distinct({sql}))" if n.name[0] == "s" else sql)


@special("array::fold", "set::fold")
def _fold(n: A.Call, scope: Scope) -> Val:
    v, init = first(n, scope), compile(n.args[1], scope)
    f = closure(n.args[2], scope)
    names, body = bind(A.Closure(f.params[:2], f.body), scope, [init.type, element(v)])
    if body.type != init.type and init.literal:  # the first value takes the type of the later ones
        init = Val(f"cast({init.sql} as {body.type.simpleString()})", body.type, True)
        names, body = bind(A.Closure(f.params[:2], f.body), scope, [init.type, element(v)])
    return Val(f"aggregate({v.sql}, {init.sql}, {arrow(names, body.sql)})", init.type)


@special("array::reduce", "set::reduce")
def _reduce(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    f = closure(n.args[1], scope)
    names, body = bind(A.Closure(f.params[:2], f.body), scope, [element(v), element(v)])
    rest = f"slice({v.sql}, 2, greatest(size({v.sql}) - 1, 0))"
    return Val(f"if(size({v.sql}) = 0, NULL, aggregate({rest}, element_at({v.sql}, 1), {arrow(names, f'cast({body.sql} as {element(v).simpleString()})')}))", element(v))


@special("array::sort", "array::sort_lexical", "array::sort_natural", "array::sort_natural_lexical")
def _sort(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    down = False
    if len(n.args) > 1:
        order = n.args[1].value if isinstance(n.args[1], A.Lit) else "asc"
        down = order is False or str(order).lower() == "desc"
    if n.name == "array::sort":
        return Val(f"sort_array({v.sql}, {str(not down).lower()})", v.type)
    key = sort_key("x", "lexical" in n.name, "natural" in n.name)
    sql = f"transform(array_sort(transform({v.sql}, x -> struct({key} as k, x as v))), s -> s.v)"
    return Val(f"reverse({sql})" if down else sql, v.type)


def sort_key(x: str, lexical: bool, natural: bool) -> str:
    """Text that sorts as the language orders: ignoring case and accents, numbers by value."""
    s = f"string({x})"
    if lexical:
        s = f"lower(translate({s}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'))"
    if natural:
        s = f"array_join(transform(regexp_extract_all({s}, '([0-9]+|[^0-9]+)', 1), p -> if(p rlike '^[0-9]', lpad(p, 24, '0'), p)), '')"
    return s


@special("count")
def _count(n: A.Call, scope: Scope) -> Val:
    if not n.args:
        return lit(1)
    arg = n.args[0]
    if isinstance(arg, A.Idiom) and arg.parts and arg.parts[-1].kind == "graph" and all(p.kind == "graph" for p in arg.parts):
        return scope.top.hooks.degree(arg, scope)
    v = compile(arg, scope)
    if v.family == "array":
        return Val(f"bigint(size(filter({v.sql}, x -> {truthy(Val('x', element(v)))})))", T.LongType())
    return Val(f"if({truthy(v)}, 1L, 0L)", T.LongType())


@special("array::len")
def _array_len(n: A.Call, scope: Scope) -> Val:
    walked = n.args[0] if len(n.args) == 1 else None
    distinct = isinstance(walked, A.Call) and walked.name == "array::distinct" and len(walked.args) == 1
    if distinct:
        walked = walked.args[0]
    if isinstance(walked, A.Idiom) and walked.start is None and walked.parts and all(p.kind == "graph" for p in walked.parts):
        last = walked.parts[-1].value
        if last.limit is None and last.start is None:
            return scope.top.hooks.size(walked.parts, distinct)
    v = first(n, scope)
    return C.typed(scope, C.call_sql(n.name, [v]), v.literal)


@special("not")
def _not(n: A.Call, scope: Scope) -> Val:
    return Val(f"(NOT {truthy(first(n, scope))})", T.BooleanType())


@special("array::add")
def _array_add(n: A.Call, scope: Scope) -> Val:
    v, x = first(n, scope), compile(n.args[1], scope)
    if x.family == "array" and x.type == v.type:
        return Val(f"aggregate({x.sql}, {v.sql}, (acc, y) -> if(array_contains(acc, y), acc, array_append(acc, y)))", v.type)
    return Val(f"if(array_contains({v.sql}, {x.sql}), {v.sql}, array_append({v.sql}, {x.sql}))", v.type)


@special("string::replace")
def _replace(n: A.Call, scope: Scope) -> Val:
    s, a, b = (compile(x, scope) for x in n.args)
    f = "regexp_replace" if a.tag == "regex" else "replace"
    return Val(f"{f}({s.sql}, {a.sql}, {b.sql})", T.StringType(), s.literal)


#: Codes of the language's time formats and Spark's patterns.
CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "z": "xx", "Z": "z", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy"}


@special("time::format")
def _time_format(n: A.Call, scope: Scope) -> Val:
    v, fmt = first(n, scope), n.args[1]
    if not isinstance(fmt, A.Lit):
        raise QueryError("time::format wants a literal format")
    out, k, raw = "", 0, str(fmt.value)
    while k < len(raw):
        c = raw[k]
        if c == "%" and k + 1 < len(raw):
            code = raw[k + 1 : k + 3] if raw[k + 1 : k + 3] in CODES else raw[k + 1]
            k += 1 + len(code)
            if code == "%":
                out += "%"
            elif code in CODES:
                out += CODES[code]
            else:
                raise QueryError(f"no time format %{code}")
            continue
        out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        k += 1
    return Val(f"date_format({v.sql}, {text(out)})", T.StringType(), v.literal)


@special("time::group")
def _time_group(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    return Val(f"date_trunc({compile(n.args[1], scope).sql}, {v.sql})", T.TimestampType(), v.literal)


@special("type::of", "value::type_of")
def _type_of(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    name = kind_of(v)
    return Val(f"if({v.sql} IS NULL, 'none', {text(name)})", T.StringType(), v.literal) if v.family != "none" else lit("none")


def kind_of(v: Val) -> str:
    if v.tag == "range":
        return "range"
    if v.tag == "regex":
        return "regex"
    if v.link:
        return "record"
    if v.family == "number":
        return "decimal" if isinstance(v.type, T.DecimalType) else "int" if isinstance(v.type, C.WHOLE) else "float"
    if isinstance(v.type, T.StructType) and v.type.names == ["x", "y"]:
        return "geometry"
    return v.family


KIND_TESTS = "array bool bytes datetime decimal duration float int number object range record set string uuid geometry point line polygon multipoint multiline multipolygon collection none null".split()
SHAPES = {"line": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multiline": "MultiLineString", "multipolygon": "MultiPolygon", "collection": "GeometryCollection"}


def _is(kind: str) -> Callable[[A.Call, Scope], Val]:
    def build(n: A.Call, scope: Scope) -> Val:
        v = first(n, scope)
        own = kind_of(v)
        if kind in ("none", "null"):
            return Val("true" if own == "none" else f"({v.sql} IS NULL)", T.BooleanType())
        is_shape = isinstance(v.type, T.StructType) and v.type.names[:1] == ["type"] and "coordinates" in v.type.names
        if kind == "point":
            hit = own == "geometry"
        elif kind in SHAPES:
            return Val(f"coalesce({v.sql}.type = '{SHAPES[kind]}', false)" if is_shape else "false", T.BooleanType())
        elif kind == "geometry":
            hit = own == "geometry" or is_shape
        elif kind == "number":
            hit = v.family == "number"
        elif kind == "uuid":
            return Val(f"coalesce({v.sql} rlike '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$', false)" if v.family == "string" else "false", T.BooleanType())
        elif kind == "record":
            if len(n.args) > 1 and v.family == "string":
                return Val(f"coalesce(startswith({v.sql}, concat({compile(n.args[1], scope).sql}, ':')), false)", T.BooleanType())
            hit = own == "record"
        elif kind == "set":
            return Val(f"coalesce({v.sql} = array_sort(array_distinct({v.sql})), false)" if v.family == "array" else "false", T.BooleanType())
        else:
            hit = own == kind
        return Val(f"({v.sql} IS NOT NULL)" if hit else "false", T.BooleanType(), v.literal)

    return build


for _k in KIND_TESTS:
    SPECIAL[f"type::is_{_k}"] = _is(_k)


@special("type::field")
def _field(n: A.Call, scope: Scope) -> Val:
    from omniframe.plans.parser import parse_expr

    return compile(parse_expr(n.args[0].value), scope)


@special("type::fields")
def _fields(n: A.Call, scope: Scope) -> Val:
    return compile(A.Array([A.Call("type::field", [a]) for a in n.args[0].items]), scope)


@special("type::duration")
def _duration(n: A.Call, scope: Scope) -> Val:
    return C.duration_of(first(n, scope), scope)


@special("type::range")
def _to_range(n: A.Call, scope: Scope) -> Val:
    if isinstance(n.args[0], A.Range):
        return compile(n.args[0], scope)
    v = compile(n.args[0], scope)
    return typed(scope, f"named_struct('begin', get({v.sql}, 0), 'end', get({v.sql}, 1), 'skip', false, 'inclusive', false)")


@special("type::array")
def _to_array(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    return v if v.family == "array" else typed(scope, f"array({v.sql})")


@special("type::geometry", "type::file", "type::table")
def _as_is(n: A.Call, scope: Scope) -> Val:
    if n.name == "type::file":
        return typed(scope, f"named_struct('bucket', {first(n, scope).sql}, 'key', {compile(n.args[1], scope).sql})")
    return first(n, scope)


@special("file::bucket", "file::key")
def _file_part(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    which = n.name.split("::")[1]
    if isinstance(v.type, T.StructType):
        return Val(f"{v.sql}.{which}", T.StringType())
    group = 1 if which == "bucket" else 2
    return Val(f"regexp_extract({v.sql}, '^([^:/]*):?(/.*)$', {group})", T.StringType())


@special("file::put", "file::put_if_not_exists", "file::get", "file::head", "file::delete", "file::copy", "file::copy_if_not_exists", "file::rename", "file::rename_if_not_exists", "file::exists", "file::list")
def _file(n: A.Call, scope: Scope) -> Val:
    """Object-store calls on f"bucket:/key"; they run on the driver, once, when the query is planned."""
    from omniframe.plans.planner import constant
    from omniframe.sources.storage import Bucket

    args = [constant(a, scope.catalog, scope.params) if not (isinstance(a, A.Lit) and a.kind == "file") else a.value for a in n.args]
    what = n.name.split("::")[1]
    name, _, key = (str(args[0]) + ("" if what == "list" or ":" in str(args[0]) else ":")).partition(":")
    made = scope.catalog.objects.get("BUCKET", {}).get(name)
    if made is None:
        raise QueryError(f"there is no bucket {name}")
    b = Bucket(scope.spark, str(made["backend"]))
    absent = what.endswith("_if_not_exists")
    what = what.removesuffix("_if_not_exists")
    if what == "put":
        b.put(key, args[1] if isinstance(args[1], (bytes, bytearray, str)) else str(args[1]), absent)
        return lit(None)
    if what in ("copy", "rename"):
        getattr(b, what)(key, str(args[1]).partition(":")[2] or str(args[1]), absent)
        return lit(None)
    if what == "list":
        return lit([x["key"] for x in b.list()])
    out = getattr(b, what)(key)
    return lit(bytes(out) if isinstance(out, (bytes, bytearray)) else out)


@special("type::bool")
def _bool(n: A.Call, scope: Scope) -> Val:
    return compile(A.Cast("bool", n.args[0]), scope)


@special("math::sum", "math::mean", "math::product", "math::min", "math::max", "math::median", "math::mode", "math::stddev", "math::variance", "math::percentile", "math::nearestrank", "math::interquartile", "math::midhinge", "math::trimean", "math::spread")
def _over_numbers(n: A.Call, scope: Scope) -> Val:
    """Statistics of an array of numbers; NULLs are left out."""
    v = first(n, scope)
    if v.family != "array":
        v = typed(scope, f"array({v.sql})")
    whole = isinstance(element(v), C.WHOLE)
    clean = f"filter(cast({v.sql} as array<double>), z -> z IS NOT NULL)"
    args = [Val(clean, T.ArrayType(T.DoubleType())), *[compile(a, scope) for a in n.args[1:]]]
    sql = C.call_sql(n.name, args)
    if whole and n.name in ("math::sum", "math::product"):
        return Val(f"bigint({sql})", T.LongType())
    return typed(scope, sql)


@special("math::abs", "math::round", "math::fixed", "math::ceil", "math::floor")
def _keeps_type(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    if n.name in ("math::ceil", "math::floor", "math::round") and isinstance(v.type, C.WHOLE):
        return v
    sql = C.call_sql(n.name, [v, *[compile(a, scope) for a in n.args[1:]]])
    return Val(f"double({sql})" if v.type == T.DoubleType() else sql, v.type if v.type == T.DoubleType() else C.infer(scope, sql), v.literal)


@special("math::pow")
def _pow(n: A.Call, scope: Scope) -> Val:
    return compile(A.Bin("**", *n.args), scope)


@special("vector::add", "vector::subtract", "vector::multiply", "vector::divide", "vector::scale", "vector::cross", "vector::dot", "vector::angle", "vector::normalize", "vector::project", "vector::magnitude", "vector::distance::chebyshev", "vector::distance::euclidean", "vector::distance::hamming", "vector::distance::manhattan", "vector::distance::minkowski", "vector::distance::cosine", "vector::similarity::cosine", "vector::similarity::jaccard", "vector::similarity::pearson")
def _vector(n: A.Call, scope: Scope) -> Val:
    """Vectors are widened to doubles before any arithmetic."""
    args = []
    for a in n.args:
        v = compile(a, scope)
        if v.family == "array" and isinstance(element(v), (T.FloatType, T.DecimalType)):
            v = Val(f"cast({v.sql} as array<double>)", T.ArrayType(T.DoubleType()), v.literal)
        args.append(v)
    return typed(scope, C.call_sql(n.name, args))


@special("vector::distance::knn")
def _knn(n: A.Call, scope: Scope) -> Val:
    if scope.top.df is None or "_knn" not in scope.top.df.columns:
        return lit(None)
    return Val("`_knn`", T.DoubleType())


@special("vector::distance::mahalanobis", "vector::similarity::spearman")
def _unimplemented(n: A.Call, scope: Scope) -> Val:
    raise QueryError(f"{n.name} is not implemented")


@special("object::keys", "object::values", "object::entries", "object::len", "object::is_empty", "object::remove", "object::extend", "object::from_entries")
def _object(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    what = n.name.split("::")[1]
    if isinstance(v.type, T.StructType):
        names = sorted(v.type.names)
        if what == "keys":
            return Val(f"array({', '.join(map(text, names))})", T.ArrayType(T.StringType()))
        if what == "len":
            return lit(len(names))
        if what == "is_empty":
            return lit(not names)
        if what in ("values", "entries"):
            same = len({v.type[k].dataType for k in names}) == 1
            item = lambda k: f"{v.sql}.`{k}`" if same else f"string({v.sql}.`{k}`)"
            if what == "values":
                return typed(scope, f"array({', '.join(item(k) for k in names)})")
            pair = lambda k: f"struct({text(k)} as key, {item(k)} as value)"
            return typed(scope, f"array({', '.join(pair(k) for k in names)})")
        if what == "remove":
            gone = [n.args[1].value] if isinstance(n.args[1], A.Lit) else [i.value for i in n.args[1].items]
            kept = [k for k in v.type.names if k not in gone]
            return typed(scope, "named_struct(" + ", ".join(f"{text(k)}, {v.sql}.`{k}`" for k in kept) + ")")
        if what == "extend":
            o = compile(n.args[1], scope)
            fields = {k: f"{v.sql}.`{k}`" for k in v.type.names} | {k: f"{o.sql}.`{k}`" for k in o.type.names}
            return typed(scope, "named_struct(" + ", ".join(f"{text(k)}, {s}" for k, s in fields.items()) + ")")
    if what == "from_entries" and isinstance(n.args[0], A.Array):
        pairs = [(compile(i.items[0], scope).sql, compile(i.items[1], scope)) for i in n.args[0].items]
        return typed(scope, "map(" + ", ".join(f"{k}, {x.sql}" for k, x in pairs) + ")")
    if what == "remove" and len(n.args) > 1 and isinstance(n.args[1], A.Array):
        return Val(f"map_filter({v.sql}, (k, v) -> not array_contains({compile(n.args[1], scope).sql}, k))", v.type)
    return typed(scope, C.call_sql(n.name, [v, *[compile(a, scope) for a in n.args[1:]]]))


@special("encoding::json::encode")
def _to_json(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    if v.family in ("object", "array"):
        return Val(f"to_json({v.sql})", T.StringType())
    if v.family == "string":
        return Val(f"substr(to_json(array({v.sql})), 2, length(to_json(array({v.sql}))) - 2)", T.StringType())
    return Val(f"string({v.sql})", T.StringType())


@special("rand::int", "rand::float", "rand::time", "rand::duration")
def _rand(n: A.Call, scope: Scope) -> Val:
    args = n.args
    if len(args) == 1 and isinstance(args[0], A.Range):
        args = [args[0].begin, args[0].end]
    return typed(scope, C.call_sql(n.name, [compile(a, scope) for a in args]))


@special("rand::ulid", "rand::uuid::v7")
def _rand_id(n: A.Call, scope: Scope) -> Val:
    ms = f"unix_millis({first(n, scope).sql})" if n.args else "unix_millis(current_timestamp())"
    if n.name.endswith("v7"):
        h = f"lower(lpad(hex({ms}), 12, '0'))"
        r = "replace(uuid(), '-', '')"
        return Val(f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), concat('7', substr({r}, 14, 3)), substr({r}, 17, 4), substr({r}, 21, 12))", T.StringType())
    return python_udfs.call("ulid", scope, [Val(ms, T.LongType())])


@special("rand::uuid")
def _uuid(n: A.Call, scope: Scope) -> Val:
    return _rand_id(A.Call("rand::uuid::v7", n.args), scope) if n.args else Val("uuid()", T.StringType())


@special("session::ac", "session::db", "session::id", "session::ip", "session::ns", "session::origin", "session::rd", "session::token")
def _session(n: A.Call, scope: Scope) -> Val:
    return lit(scope.catalog.session.get(n.name.split("::")[1]))


@special("schema::table::exists")
def _table_exists(n: A.Call, scope: Scope) -> Val:
    return lit(n.args[0].value in scope.catalog.tables)


@special("record::exists", "record::is_edge")
def _record(n: A.Call, scope: Scope) -> Val:
    v = first(n, scope)
    if n.name.endswith("is_edge"):
        t = scope.catalog.tables.get(v.link or "")
        return lit(bool(t and t.edge))
    return scope.top.hooks.exists(v, scope)


@special("search::analyze")
def _analyze(n: A.Call, scope: Scope) -> Val:
    from omniframe.operators import fulltext

    return Val(fulltext.analyze_sql(scope.catalog, n.args[0].value, compile(n.args[1], scope).sql), T.ArrayType(T.StringType()))


@special("search::score", "search::highlight", "search::offsets", "search::rrf", "search::linear")
def _search(n: A.Call, scope: Scope) -> Val:
    return scope.top.hooks.search(n, scope)


@special("sleep")
def _sleep(n: A.Call, scope: Scope) -> Val:
    import time

    from omniframe.plans.lexer import nanos

    a = n.args[0]
    time.sleep((a.value if isinstance(a.value, int) else nanos(a.value)) / 1e9)
    return lit(None)


@special("sequence::nextval")
def _nextval(n: A.Call, scope: Scope) -> Val:
    s = scope.catalog.objects.setdefault("SEQUENCE", {}).setdefault(n.args[0].value, {"start": 0})
    s["now"] = s.get("now", int(s.get("start") or 0) - 1) + 1
    return lit(s["now"])


@special("array::clump", "array::windows")
def _pieces(n: A.Call, scope: Scope) -> Val:
    size = n.args[1]
    if isinstance(size, A.Lit) and size.value < 1:
        raise QueryError(f"{n.name} wants a size of one or more")
    v = first(n, scope)
    return typed(scope, C.call_sql(n.name, [v, compile(size, scope)]))


@special("array::range")
def _array_range(n: A.Call, scope: Scope) -> Val:
    if isinstance(n.args[0], A.Range):
        return sequence_of(n.args[0], scope)
    return typed(scope, C.call_sql("array::range", [compile(a, scope) for a in n.args]))


def point(v: Val, scope: Scope) -> Val:
    """A point object (type, coordinates) as a point; other values as they are."""
    if isinstance(v.type, T.StructType) and "coordinates" in v.type.names and isinstance(v.type["coordinates"].dataType, T.ArrayType) and not isinstance(v.type["coordinates"].dataType.elementType, T.ArrayType):
        c = f"{v.sql}.coordinates"
        return typed(scope, f"named_struct('x', double(get({c}, 0)), 'y', double(get({c}, 1)))", v.literal)
    return v


@special("geo::distance", "geo::bearing")
def _between(n: A.Call, scope: Scope) -> Val:
    args = [point(compile(a, scope), scope) for a in n.args]
    if any(not isinstance(a.type, T.StructType) or a.type.names != ["x", "y"] for a in args):
        return lit(None)
    return typed(scope, C.call_sql(n.name, args))


@special("geo::hash::encode")
def _geohash(n: A.Call, scope: Scope) -> Val:
    v = point(compile(n.args[0], scope), scope)
    if not isinstance(v.type, T.StructType) or v.type.names != ["x", "y"]:
        return lit(None)
    return python_udfs.call("geohash", scope, [v, *[compile(a, scope) for a in n.args[1:]]])


@special("api::invoke", "api::req::body", "api::res::body", "api::timeout", "api::res::status", "api::res::header", "api::res::headers", "http::head", "http::get", "http::put", "http::post", "http::patch", "http::delete")
def _outside(n: A.Call, scope: Scope) -> Val:
    raise QueryError(f"{n.name} reaches outside the engine and is not part of it")


def _udf(name: str) -> Callable[[A.Call, Scope], Val]:
    def build(n: A.Call, scope: Scope) -> Val:
        return python_udfs.call(name, scope, [compile(a, scope) for a in n.args])

    return build


for _name, _function in python_udfs.NAMES.items():
    SPECIAL.setdefault(_name, _udf(_function))
