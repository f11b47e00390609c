"""Licence scan by canonical digest: whole texts, and whole lines, that equal a known licence text.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, blanks), and the SHA-256 of the
result is hash-joined to the digests of the known texts. Everything is built from SQL functions. The table of
known texts is a fixed list, so its side of the join is small by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN

# Spellings taken as equal, the left one replaced by the right one.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
)
# A line that gives a notice, not one of prose that begins with the word.
COPYRIGHT_LINES = r"(^|\n)[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|\[|<|by )|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4}|\[|<))[^\n]*"
#: ASCII characters other than letters, digits and the newline.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_lines(text: Column) -> Column:
    """Normalised text that still has its lines: lower case A-Z, no copyright lines, one blank between words."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    signs = ("copyright", "(c)", "\u00a9")
    marked = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in signs])
    # The lambda binds the lower-cased text, so it is made once.
    out = F.get(F.transform(F.array(out), lambda t: F.when(marked(t), F.regexp_replace(t, COPYRIGHT_LINES, "$1")).otherwise(t)), 0)
    out = F.regexp_replace(out, MARKS, " ")
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


def one_line(text: Column) -> Column:
    """Normalised lines as one line."""
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``license_id, digest`` of the known texts, or of a table ``license_id, known``, under the same normalisation."""
    if known is None:
        known = spark.createDataFrame(list(KNOWN), "license_id string, known string")
    return known.select("license_id", F.sha2(one_line(normal_lines(F.col("known"))), 256).alias("digest")).distinct()


def license_matches(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, scope, line_no, license_id, digest``, one row per match; an empty table gives no rows.

    ``scope`` is ``document`` where the whole text equals a known text (``line_no`` 0), or ``line`` where a whole
    line does (``line_no`` counts from 1 in the text without copyright lines' content). Null and empty texts
    match nothing; null ids are kept; repeated rows match each for itself; other columns are not read. A text that two
    known licences share matches both. ``known`` (``license_id, known``) takes the place of the fixed list.
    """
    digests_of = known_digests(docs.sparkSession, known)
    if known is None:  # a fixed list; a caller's table may have any size
        longest = F.lit(2 * max(len(text) for _, text in KNOWN))
        digests_of = F.broadcast(digests_of)
    else:
        longest = F.lit(2**31 - 1)
    text = docs["text"].cast("string")
    rows = docs.where(text.isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), normal_lines(text).alias("lines"))
    # One pass a text: its trimmed lines, and before them the whole text as one line. Blanks between words are single
    # by now. The generator keeps empty arrays, as else a filter would normalise every text once more.
    trimmed = rows.select("doc_id", F.transform(F.split("lines", "\n"), lambda u: F.trim(u)).alias("units"))
    whole = F.array_join(F.filter("units", lambda u: u != ""), " ")
    each = trimmed.select("doc_id", F.posexplode_outer(F.concat(F.array(whole), F.col("units"))).alias("line_no", "unit"))
    units = each.where((F.col("unit") != "") & (F.length("unit") <= longest))
    scope = F.when(F.col("line_no") == 0, "document").otherwise("line").alias("scope")
    units = units.select("doc_id", scope, F.col("line_no").cast("long").alias("line_no"), "unit")
    digests = units.select("doc_id", "scope", "line_no", F.sha2("unit", 256).alias("digest"))
    return digests.join(digests_of, "digest").select("doc_id", "scope", "line_no", "license_id", "digest")


def oracle_sql() -> str:
    """The same matches in DuckDB SQL."""

    def lines(text: str) -> str:
        out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"regexp_replace({out}, '{COPYRIGHT_LINES}', '\\1', 'g')"
        out = f"regexp_replace({out}, '{MARKS}', ' ', 'g')"
        for other, usual in SPELLINGS:
            out = f"replace({out}, '{other}', '{usual}')"
        return out

    def one(text: str) -> str:
        return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'), ' ')"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256({one(lines("known"))}) AS digest FROM (VALUES {values}) AS t(license_id, known)),
rows_ AS (SELECT doc_id, {lines("text")} AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'document' AS scope, 0::BIGINT AS line_no, {one("lines")} AS unit FROM rows_
  UNION ALL
  SELECT doc_id, 'line', line_no::BIGINT, {one("unit")} FROM (
    SELECT doc_id, unnest(string_split(lines, chr(10))) AS unit, generate_subscripts(string_split(lines, chr(10)), 1) AS line_no FROM rows_))
SELECT doc_id, scope, line_no, license_id, digest FROM (SELECT *, sha256(unit) AS digest FROM units WHERE unit <> '') JOIN known USING (digest)
"""
