"""URL, title and job-text queries over the pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.functions import urls as U
from formweave.functions.text import collapse
from formweave.operators import extract as X
from formweave.plans.common import table

# the given hosts are no job boards, so an own ordered rule table exercises first match
HOST_RULES = [("blog", r"(?i)^blog\."), ("mobile", r"(?i)^m\."), ("com", r"(?i)\.example\.com$"), ("lever", r"(?i)\.example\.net$")]


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    pages = table(spark, d, "pages").withColumn("host", U.url_host(url))
    return pages.select(
        "page_id", U.canonical_url(url).alias("canonical"), "host", U.ats_of_host(F.col("host"), HOST_RULES).alias("board"),
        U.ats_of_host(F.col("host")).alias("ats"),
    )


def page_boards(spark: SparkSession, d: str) -> DataFrame:
    """Pages, distinct canonical URLs and hosts per board: canonical URLs are made distinct before counting."""
    urls = page_urls(spark, d)
    per_url = urls.groupBy("board", "host", "canonical").agg(F.count("*").alias("n"))
    per_host = per_url.groupBy("board", "host").agg(F.sum("n").alias("n"), F.count("*").alias("urls"))
    return per_host.groupBy("board").agg(
        F.sum("n").alias("pages"), F.sum("urls").alias("urls"), F.count("*").alias("hosts")
    )


def _title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.replace(raw, F.lit("&amp;"), F.lit("&"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles as they are, and as job titles with the host in front or behind."""
    pages = table(spark, d, "pages").withColumn("host", U.url_host(F.col("url"))).withColumn("t", collapse(_title(F.col("html"))))
    shapes = F.array(
        F.struct(F.lit("plain").alias("shape"), F.col("t").alias("title")),
        F.struct(F.lit("board").alias("shape"), F.concat(F.lit("Job Application for Nurse at "), F.col("host"), F.lit(" - Careers")).alias("title")),
        F.struct(F.lit("at").alias("shape"), F.concat(F.lit("Head writer at "), F.col("host")).alias("title")),
        F.struct(F.lit("role_last").alias("shape"), F.concat(F.col("host"), F.lit(" | Data Analyst")).alias("title")),
        F.struct(F.lit("unclear").alias("shape"), F.concat(F.col("host"), F.lit(" – Team")).alias("title")),
    )
    rows = pages.select("page_id", "host", F.inline(shapes)).withColumn("ats", U.ats_of_host(F.col("host"), HOST_RULES))
    return rows.withColumn("c", U.parse_job_title(F.col("title"), F.col("ats"))).select(
        "page_id", "shape", "c.company", "c.role"
    )


def answer_templates(spark: SparkSession, d: str) -> DataFrame:
    """Template answers filled from the page; an unknown company leaves none."""
    pages = table(spark, d, "pages").withColumn("host", U.url_host(F.col("url")))
    company = F.when(F.col("host").startswith("blog."), F.lit(None)).otherwise(F.col("host"))
    text = F.concat(F.lit("Dear {Company}, costs $1 for {role} no. "), F.col("page_id"))
    return pages.select("page_id", U.substitute_template(text, company, F.lit("a\\b")).alias("answer"))


def page_job_texts(spark: SparkSession, d: str) -> DataFrame:
    """The longest text block of each page, whole pages parsed."""
    return X.job_descriptions(X.page_nodes(table(spark, d, "pages")))


QUERIES = {f.__name__: f for f in (page_urls, page_boards, page_titles, answer_templates, page_job_texts)}

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_BOARD = f"""CASE WHEN {_HOST} LIKE 'blog.%' THEN 'blog' WHEN {_HOST} LIKE 'm.%' THEN 'mobile'
   WHEN {_HOST} LIKE '%.example.com' THEN 'com' WHEN {_HOST} LIKE '%.example.net' THEN 'lever' ELSE 'generic' END"""
_URLS = f"""u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical, {_HOST} AS host, {_BOARD} AS board, html
                 FROM pages)"""
_ROLES = (r"(?i)\b(engineer|developer|manager|director|analyst|designer|scientist|consultant|lead|intern|architect"
          r"|specialist|officer|head|vp|president|recruiter|marketer|accountant|nurse|teacher|writer|associate"
          r"|coordinator|administrator)\b")
_NOISE = r"(?i)\s*[-–—|·]\s*(careers?|jobs?|job board|apply|application|hiring)\s*$"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '{_NOISE}', ''), '\s+', ' ', 'g'))"


ORACLES = {
    "page_urls": f"WITH {_URLS} SELECT page_id, canonical, host, board, 'generic' AS ats FROM u",
    "page_boards": f"""WITH {_URLS}
SELECT board, count(*) AS pages, count(DISTINCT canonical) AS urls, count(DISTINCT host) AS hosts FROM u GROUP BY board""",
    "page_titles": rf"""WITH {_URLS},
t AS (SELECT page_id, host, board,
        trim(regexp_replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS t
      FROM u),
parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\s+[-–—|·]\s+'), lambda p: {_clean('p')}),
                                lambda p: p <> '') AS p FROM t),
plain AS (SELECT page_id, 'plain' AS shape, CASE
    WHEN regexp_matches(t, '(?i)^job application for (.+) at (.+)$') THEN 'board'
    WHEN regexp_matches(t, '(?i)^(.+?)\s+at\s+(.+)$')
         AND regexp_matches(regexp_extract(t, '(?i)^(.+?)\s+at\s+(.+)$', 1), '{_ROLES}') THEN 'at'
    WHEN len(p) >= 2 AND regexp_matches(p[1], '{_ROLES}') AND NOT regexp_matches(array_to_string(p[2:], ', '), '{_ROLES}') THEN 'ab'
    WHEN len(p) >= 2 AND regexp_matches(array_to_string(p[2:], ', '), '{_ROLES}') AND NOT regexp_matches(p[1], '{_ROLES}') THEN 'ba'
    WHEN len(p) >= 2 AND board = 'lever' THEN 'ba' WHEN len(p) >= 2 THEN 'ab'
    WHEN regexp_matches(t, '{_ROLES}') THEN 'one' END AS how, t, p FROM parts)
SELECT page_id, shape,
  CASE how WHEN 'at' THEN {_clean(r"regexp_extract(t, '(?i)^(.+?)\s+at\s+(.+)$', 2)")}
           WHEN 'ab' THEN array_to_string(p[2:], ', ') WHEN 'ba' THEN p[1] END AS company,
  CASE how WHEN 'at' THEN {_clean(r"regexp_extract(t, '(?i)^(.+?)\s+at\s+(.+)$', 1)")}
           WHEN 'ab' THEN p[1] WHEN 'ba' THEN array_to_string(p[2:], ', ') WHEN 'one' THEN {_clean('t')} END AS role
FROM plain
UNION ALL SELECT page_id, 'board', host, 'Nurse' FROM t
UNION ALL SELECT page_id, 'at', host, 'Head writer' FROM t
UNION ALL SELECT page_id, 'role_last', host, 'Data Analyst' FROM t
UNION ALL SELECT page_id, 'unclear', CASE WHEN board = 'lever' THEN host ELSE 'Team' END,
                 CASE WHEN board = 'lever' THEN 'Team' ELSE host END FROM t""",
    "answer_templates": f"""WITH {_URLS}
SELECT page_id, CASE WHEN host NOT LIKE 'blog.%' THEN 'Dear ' || host || ', costs $1 for a\\b no. ' || page_id END AS answer FROM u""",
    "page_job_texts": r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
u AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM s)
SELECT CAST(page_id AS VARCHAR) AS page_id, left(t, 6000) AS jd_text FROM u WHERE length(t) >= 200""",
}
