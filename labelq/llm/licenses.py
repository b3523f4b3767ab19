"""License scan by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent
spellings unified, everything but letters and digits turned into single spaces.  The SHA-256 of the
canonical whole text is hash-joined to the digests of known licences.  The same digest of each single
line finds one-line notices inside a document.  The registry is broadcast; ``registry`` refuses
more than MAX_LICENSES rows, so its size is proven.

Defined results: null, empty and all-copyright texts have the canonical form '' and match nothing;
repeated rows are scanned one by one; a null doc_id stays null; empty tables give empty results;
extra columns are ignored; two licences with one canonical form resolve to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.common import read

MAX_LICENSES = 5000

# Known licence texts and notices.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
            "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
            "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
            "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
           "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
           "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
           "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
           "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
           "SOFTWARE.",
}

# A line that matches this after lower-casing is a copyright line.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|©|\(c\)|all rights reserved)[^\n]*"
# Equivalent spellings, as (pattern over the canonical form, replacement).
SPELLINGS = (
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("per cent", "percent"),
    ("https", "http"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical form of ``text`` with its line breaks kept: one canonical line per line with letters or digits."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    for variant, usual in SPELLINGS:
        t = F.replace(t, F.lit(variant), F.lit(usual))
    return F.coalesce(F.btrim(t, F.lit(" \n")), F.lit(""))


def canonical(lines: Column) -> Column:
    """The canonical whole text of the result of ``canonical_lines``."""
    return F.replace(lines, F.lit("\n"), F.lit(" "))


def registry(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """Known licences as (digest, license_id); the smallest id per digest."""
    known = KNOWN if known is None else known
    if len(known) > MAX_LICENSES:
        raise ValueError(f"{len(known)} licences; at most {MAX_LICENSES} are broadcast")
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, body string")
    rows = rows.select("license_id", canonical(canonical_lines(F.col("body"))).alias("body")).where("body <> ''")
    return rows.groupBy(F.sha2("body", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest (null for an empty canonical text), license_id of the whole text, and the
    sorted distinct licence ids of single lines (``notices``)."""
    entries = known.select("digest", "license_id").take(MAX_LICENSES + 1)
    if len(entries) > MAX_LICENSES:
        raise ValueError(f"more than {MAX_LICENSES} known digests")
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    body = canonical(F.col("_lines"))
    rows = rows.select("doc_id", "_lines", F.when(body != "", F.sha2(body, 256)).alias("digest"))
    rows = rows.join(F.broadcast(known.select("digest", "license_id")), "digest", "left")
    if not entries:
        return rows.select("doc_id", "digest", "license_id", F.array().cast("array<string>").alias("notices"))
    name = F.create_map(*[F.lit(x) for e in entries for x in (e["digest"], e["license_id"])])
    lines = F.transform(F.split("_lines", "\n"), lambda x: F.sha2(x, 256))
    hit = F.array_intersect(lines, F.array(*[F.lit(e["digest"]) for e in entries]))
    ids = F.array_sort(F.array_distinct(F.transform(hit, lambda d: F.element_at(name, d))))
    return rows.select("doc_id", "digest", "license_id", ids.alias("notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license_id, notices (comma separated) and n_notices of every document."""
    out = license_scan(read(spark, sf_dir, "documents"), registry(spark))
    return out.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"),
                      F.size("notices").cast("long").alias("n_notices"))


def _canonical_sql(col: str) -> str:
    t = f"regexp_replace(lower({col}), '{COPYRIGHT_LINE}', '\\1', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' *\\n[ \\n]*', chr(10), 'g')"
    for variant, usual in SPELLINGS:
        t = f"replace({t}, '{variant}', '{usual}')"
    return f"coalesce(trim({t}, ' ' || chr(10)), '')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(replace({_canonical_sql('body')}, chr(10), ' ')) AS digest
    FROM (VALUES {values}) AS v(license_id, body)) GROUP BY digest),
canon AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
hits AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM (
    SELECT DISTINCT c.doc_id, k.license_id
    FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canon) c
    JOIN known k ON sha256(c.line) = k.digest) GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN lines <> '' THEN sha256(replace(lines, chr(10), ' ')) END AS digest,
  k.license_id, coalesce(h.notices, '') AS notices, coalesce(h.n_notices, 0) AS n_notices
FROM canon c LEFT JOIN known k ON lines <> '' AND sha256(replace(lines, chr(10), ' ')) = k.digest
LEFT JOIN hits h ON h.doc_id = c.doc_id"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": oracle()}
