"""Canonical digest lookup of licence texts and notices.

Text is brought to one canonical form: lower case, punctuation and white space as single
spaces, copyright lines and the numbers of list items dropped, equivalent spellings
replaced. The digest of a whole
text is hash-joined to the digests of known licences; the digests of its lines are
intersected with the known ones. The known table is fixed (a few hundred rows) and
broadcast; a text never leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayloom.llm.licence_texts import notices, texts

#: Equivalent spellings, replaced in this order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("organis", "organiz"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("https", "http"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic marks and the plain ones they become.
MARKS, PLAIN = "‘’“”–— ", "''\"\"-- "
COPYRIGHT = (
    r"(^|\n)[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|:|<|[0-9])|\(c\)[ \t]*[0-9]|©)[^\n]*"
    r"(?:\n[ \t*#/;-]*all rights reserved\.?[ \t]*)?"
)
#: The number or letter in front of a list item; bullets are punctuation anyway.
ITEM = r"(^|\n)[ \t*#/;-]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
#: What becomes a space; letters beyond ASCII stay, and so do line ends for now.
SIGNS = r"[^0-9a-z\n\x{80}-\x{10ffff}]+"


def _spelled(c: Column) -> Column:
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _lines_kept(text: Column) -> Column:
    text = F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + PLAIN)
    for dropped in (COPYRIGHT, ITEM):
        text = F.regexp_replace(text, dropped, "\n")
    return F.regexp_replace(text, SIGNS, " ")


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; null counts as empty."""
    return _spelled(F.trim(F.regexp_replace(_lines_kept(text), r"[ \n]+", " ")))


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(_lines_kept(text), "\n"), lambda x: _spelled(F.trim(x)))


def known(spark: SparkSession) -> DataFrame:
    """``(digest, licence)`` of all known texts, with and without title, and of all notices."""
    df = spark.createDataFrame(texts() + notices(), "licence string, text string")
    return df.groupBy(F.md5(canonical(F.col("text"))).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``canonical_md5``, ``licence`` of the whole text or null, and
    ``notices``, the licences that its lines name, sorted and joined by commas.

    Empty and null texts have the digest of the empty string and no licence. Repeated
    rows and null keys are kept; an empty table gives no rows; other columns, whatever
    their names, are not read. ``licences`` is a fixed table ``(digest, licence)``.
    """
    licences = known(docs.sparkSession) if licences is None else licences
    pairs = sorted((r["digest"], r["licence"]) for r in licences.collect())  # fixed table, a few hundred rows
    digests = F.array(*[F.lit(d) for d, _ in pairs])
    names = F.map_from_arrays(digests, F.array(*[F.lit(n) for _, n in pairs]))
    lines = F.transform(canonical_lines(F.col("_text")), lambda x: F.md5(x))
    named = F.transform(F.array_intersect(lines, digests), lambda d: F.element_at(names, d))
    whole = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).select(
        "_key", F.md5(canonical(F.col("_text"))).alias("canonical_md5"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notices"),
    )
    table = docs.sparkSession.createDataFrame(pairs, "digest string, licence string")
    return whole.join(F.broadcast(table), F.col("canonical_md5") == F.col("digest"), "left").select(
        F.col("_key").alias(key), "canonical_md5", "licence", "notices"
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_spelled(c: str) -> str:
    for a, b in SPELLINGS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``scan``."""
    rows = [*texts(), *notices()]
    values = ", ".join(f"({_sql_text(x)}, {_sql_text(t)})" for x, t in rows)
    end = "chr(10)"

    def kept(c: str) -> str:
        low = f"translate(coalesce({c}, ''), {_sql_text(UPPER + MARKS)}, {_sql_text(LOWER + PLAIN)})"
        for dropped in (COPYRIGHT, ITEM):
            low = f"regexp_replace({low}, {_sql_text(dropped)}, {end}, 'g')"
        return f"regexp_replace({low}, {_sql_text(SIGNS)}, ' ', 'g')"

    def whole(c: str) -> str:
        return _sql_spelled(f"trim(regexp_replace({kept(c)}, '[ \\n]+', ' ', 'g'), ' ')")

    line = _sql_spelled("trim(x, ' ')")
    return f"""
WITH raw(licence, body) AS (VALUES {values}),
known AS (SELECT md5({whole('body')}) AS digest, min(licence) AS licence FROM raw GROUP BY 1),
named AS (SELECT list(digest) AS ds, map_from_entries(list((digest, licence))) AS m FROM known),
docs AS (
  SELECT doc_id, md5({whole('text')}) AS canonical_md5,
         list_transform(string_split({kept('text')}, {end}), lambda x: md5({line})) AS lines
  FROM {table})
SELECT doc_id, canonical_md5, licence,
       array_to_string(list_sort(list_distinct(list_transform(list_filter(lines, lambda d: list_contains(ds, d)),
         lambda d: m[d]))), ',') AS notices
FROM docs CROSS JOIN named LEFT JOIN known ON canonical_md5 = digest
"""
