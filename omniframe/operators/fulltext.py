"""Analyzers, term matching and BM25, as column expressions.

Tokens are an array column; corpus statistics (number of texts, mean length, texts a
term) are one aggregate over the table, so scoring needs one pass for the
statistics and one for the rows, and no shuffle of postings. ``postings`` builds
the inverted index as a table for repeated use.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omniframe.plans.catalog import Catalog
from omniframe.plans.values import quote, text

K1, B = 1.2, 0.75
DEFAULT = {"tokenizers": [("blank", [])], "filters": [("lowercase", [])]}
#: Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
PATTERNS = {"blank": r"\\S+", "class": r"[\\p{L}]+|[\\p{N}]+|[\\p{P}\\p{S}]", "punct": r"[\\p{P}]|[^\\s\\p{P}]+", "camel": r"[A-Z]?[^A-Z\\s]+|[A-Z]+(?![^A-Z\\s])"}


def stem_english(w: str) -> str:
    """SQL that takes common English endings off a word."""
    return f"regexp_replace(regexp_replace({w}, '(?<=[a-z]{{3}})(ies)$', 'i'), '(?<=[a-z]{{3}})(ing|edly|ed|ly|es|s)$', '')"


def analyze_sql(catalog: Catalog, analyzer: str | None, sql: str) -> str:
    """The analyzer's tokens of a text, as an array expression."""
    a: dict[str, Any] = catalog.analyzers.get(analyzer or "", DEFAULT)
    out = f"array({sql})"
    for name, _ in a.get("tokenizers") or [("blank", [])]:
        out = f"flatten(transform({out}, t -> regexp_extract_all(t, {text('(' + PATTERNS[name].replace(chr(92) * 2, chr(92)) + ')')}, 1)))"
    for name, args in a.get("filters") or []:
        if name in ("lowercase", "uppercase"):
            out = f"transform({out}, t -> {name[:-4]}(t))"
        elif name == "ascii":
            out = f"transform({out}, t -> translate(t, '{ACCENTED}', '{PLAIN}'))"
        elif name in ("edgengram", "ngram"):
            lo, hi = (int(x) for x in args)
            if name == "edgengram":
                out = f"flatten(transform({out}, t -> if(char_length(t) < {lo}, array(), transform(sequence({lo}, least({hi}, char_length(t))), n -> substr(t, 1, n)))))"
            else:
                out = f"flatten(transform({out}, t -> flatten(transform(sequence(1, greatest(char_length(t), 1)), i -> transform(filter(sequence({lo}, {hi}), n -> i + n - 1 <= char_length(t)), n -> substr(t, i, n))))))"
        elif name == "snowball":
            out = f"transform({out}, t -> {stem_english('t')})"
    return f"filter({out}, t -> t <> '')"


def query_terms(catalog: Catalog, analyzer: str | None, query: str) -> list[str]:
    got = catalog.spark.range(1).selectExpr(f"array_distinct({analyze_sql(catalog, analyzer, text(query))}) AS t").first()
    return list(got.t)


def matches_sql(tokens: str, terms: list[str], how: str = "AND") -> str:
    if not terms:
        return "false"
    return "(" + f" {how} ".join(f"array_contains({tokens}, {text(t)})" for t in terms) + ")"


def equals(term: str):  # noqa: ANN201
    return lambda x: x == F.lit(term)


def simple(catalog: Catalog, analyzer: str | None) -> str | None:
    """The pattern of an analyzer whose tokens stand in the lower-case text as they are: one tokenizer, and lowercase alone."""
    a: dict[str, Any] = catalog.analyzers.get(analyzer or "", DEFAULT)
    kinds, filters = a.get("tokenizers") or [("blank", [])], [name for name, _ in a.get("filters") or []]
    return PATTERNS[kinds[0][0]].replace("\\\\", "\\") if len(kinds) == 1 and kinds[0][0] in ("blank", "class") and filters == ["lowercase"] else None


def token_columns(df: DataFrame, catalog: Catalog, analyzer: str | None, field: str, name: str, terms: list[str]) -> DataFrame:
    """df with the text's tokens (``name``) and their number (``name_n``).

    Where it is enough to, only texts that hold one of the terms are cut into tokens, and the tokens of the others are counted alone.
    """
    pattern, col = simple(catalog, analyzer), quote(field)
    if pattern is None or not terms:
        return tokens_column(df, catalog, analyzer, field, name).withColumn(f"{name}_n", F.size(name))
    holds = " OR ".join(f"contains(lower({col}), {text(t)})" for t in terms)
    df = df.withColumn(name, F.expr(f"CASE WHEN {holds} THEN {analyze_sql(catalog, analyzer, col)} ELSE cast(array() as array<string>) END"))
    return df.withColumn(f"{name}_n", F.expr(f"coalesce(regexp_count({col}, {text(pattern)}), 0)"))


def with_scores(df: DataFrame, tokens: str, terms: list[str], column: str, k1: float = K1, b: float = B) -> DataFrame:
    """df with the BM25 score of its ``tokens`` column, rounded to single precision as the statistics of a whole table give it."""
    length = f"{tokens}_n"
    stats = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(length).alias("_mean"), *[F.count_if(F.array_contains(tokens, t)).alias(f"_df{i}") for i, t in enumerate(terms)])
    # one row; Spark broadcasts it
    both = df.crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    size = F.col(length).cast("double")
    for i, t in enumerate(terms):
        n, d = F.col("_n").cast("double"), F.col(f"_df{i}").cast("double")
        idf = F.greatest(F.lit(0.0), F.log((n - d + 0.5) / (d + 0.5)))
        tf = F.size(F.filter(F.col(tokens), equals(t))).cast("double")
        grown = F.when(tf > 0, 1 + F.log(F.when(tf > 0, tf))).otherwise(0.0)
        total = total + F.when(tf > 0, idf * (k1 + 1) * grown / (grown + k1 * (1 - b + b * size / F.col("_mean")))).otherwise(0.0)
    return both.withColumn(column, total.cast("float").cast("double")).drop("_n", "_mean", *[f"_df{i}" for i in range(len(terms))])


def postings(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(term, key, tf, length): the inverted index of a token column, combined before its shuffle."""
    rows = df.select(F.col(key), F.size(tokens).alias("length"), F.explode(tokens).alias("term"))
    return rows.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def highlight_sql(sql: str, terms: list[str], before: str, after: str) -> str:
    alt = "|".join(sorted((t.replace("\\", "\\\\") for t in terms), key=len, reverse=True))
    return f"regexp_replace({sql}, {text('(?i)(?<![\\p{L}\\p{N}])(' + alt + ')(?![\\p{L}\\p{N}])')}, {text(before + '$1' + after)})"


def offsets_sql(sql: str, terms: list[str]) -> str:
    """Begin and end of every matching blank-separated token, in characters."""
    words = f"split({sql}, ' ')"
    spans = f"transform({words}, (w, i) -> named_struct('s', cast(aggregate(slice({words}, 1, i), 0, (acc, x) -> acc + char_length(x) + 1) as bigint), 'w', w))"
    inside = ", ".join(text(t.lower()) for t in terms)
    return f"transform(filter({spans}, t -> lower(regexp_replace(t.w, '^[^\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+$', '')) IN ({inside})), t -> named_struct('s', t.s, 'e', t.s + char_length(t.w)))"


def rrf(lists: list[DataFrame], key: str, order: list[tuple[str, bool]], k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: sum of 1 / (k + rank), ranks from 1, ties by key."""
    from pyspark.sql import Window

    parts = None
    for df, (col, descending) in zip(lists, order):
        c = F.col(col).desc() if descending else F.col(col).asc()
        one = df.select(F.col(key), (1.0 / (k + F.row_number().over(Window.orderBy(c, F.col(key))))).alias("rrf_score"))
        parts = one if parts is None else parts.unionByName(one)
    out = parts.groupBy(key).agg(F.sum("rrf_score").alias("rrf_score"))
    return out.orderBy(F.col("rrf_score").desc(), F.col(key)).limit(limit) if limit else out


def linear(lists: list[DataFrame], key: str, cols: list[str], weights: list[float], norm: str = "minmax", limit: int | None = None) -> DataFrame:
    """Weighted sum of scores that are first scaled by list (minmax or zscore)."""
    parts = None
    for df, c, w in zip(lists, cols, weights):
        s = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.avg(c).alias("_mu"), F.stddev_pop(c).alias("_sd"))
        x = F.col(c)
        scaled = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0) if norm == "minmax" else F.when(F.col("_sd") > 0, (x - F.col("_mu")) / F.col("_sd")).otherwise(0.0)
        one = df.crossJoin(F.broadcast(s)).select(F.col(key), (scaled * w).alias("linear_score"))
        parts = one if parts is None else parts.unionByName(one)
    out = parts.groupBy(key).agg(F.sum("linear_score").alias("linear_score"))
    return out.orderBy(F.col("linear_score").desc(), F.col(key)).limit(limit) if limit else out


def tokens_column(df: DataFrame, catalog: Catalog, analyzer: str | None, field: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(f"coalesce({analyze_sql(catalog, analyzer, quote(field))}, array())"))
