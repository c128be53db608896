"""URL keys, host classification, page titles and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formweave.functions.text import WORD_END, WORD_START, WS, collapse
from formweave.rules import hosts

# Words that mark a role and the trailing noise of titles.
ROLE_WORDS = (
    rf"(?i){WORD_START}(engineer|developer|manager|director|analyst|designer|scientist|consultant|lead|intern"
    r"|architect|specialist|officer|head|vp|president|recruiter|marketer|accountant|nurse|teacher"
    rf"|writer|associate|coordinator|administrator){WORD_END}"
)
TITLE_NOISE = rf"(?i){WS}*[-–—|·]{WS}*(careers?|jobs?|job board|apply|application|hiring){WS}*$"
URL_TOKENS = r"(?i)apply|application|careers?|jobs?|vacanc|position|opening|recruit"
# end of fixed values

_AUTHORITY = r"(?i)^(https?|ftp|wss?)://(?:[^/?#@]*@)?([^/?#:]+|\[[^\]]*\])(?::(\d*))?([^?#]*)"
_DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


_DOTS = r"(?i)^(\.|%2e){1,2}$"
_UNSAFE = "[^\\x21-\\x7e]|[\"<>`{}]"


def _escaped(path: Column) -> Column:
    """Blanks, quotes, braces and all but ASCII as percent-encoded UTF-8."""
    one = lambda c: F.when(c.rlike(_UNSAFE), F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")).otherwise(c)
    return F.when(path.rlike(_UNSAFE), F.array_join(F.transform(F.split(path, ""), one), "")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """'.' and '..' segments resolved."""
    parts = F.split(path, "/")
    is_last = lambda i: i == F.size(parts) - 1

    def step(done: Column, part: Column) -> Column:
        name = part["name"]
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        rest = F.when(F.length(F.regexp_replace(name, "(?i)%2e", ".")) == 2, up).otherwise(done)
        closed = F.when(part["last"], F.array_append(rest, F.lit(""))).otherwise(rest)
        return F.when(name.rlike(_DOTS), closed).otherwise(F.array_append(done, name))

    named = F.transform(parts, lambda p, i: F.struct(p.alias("name"), is_last(i).alias("last")))
    # the part before the first slash is empty and always stays
    folded = F.aggregate(F.slice(named, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.array_join(folded, "/")).otherwise(path)


def _url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    part = lambda i: F.regexp_extract(F.trim(url), _AUTHORITY, i)
    return F.lower(part(1)), F.lower(part(2)), part(3), part(4)


def canonical_url(url: Column) -> Column:
    """Scheme, host, non-default port and path in normal form; what does not parse stays as it is."""
    scheme, host, port, path = _url_parts(F.translate(url, "\t\n\r", ""))
    ports = F.create_map(*[F.lit(x) for kv in _DEFAULT_PORT.items() for x in kv])
    shown_port = F.when((port == "") | (port == F.element_at(ports, scheme)), F.lit("")).otherwise(
        F.concat(F.lit(":"), port)
    )
    shown_path = F.when(path == "", F.lit("/")).otherwise(_escaped(_without_dots(path)))
    return F.when(scheme == "", url).otherwise(
        F.concat(scheme, F.lit("://"), host, shown_port, shown_path)
    )


def url_host(url: Column) -> Column:
    """Host name without port, '' when the URL does not parse."""
    return _url_parts(url)[1]


def ats_of_host(host: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """First host rule that matches, else 'generic'."""
    chain = F
    for name, pattern in rules or hosts.ATS_HOSTS:
        chain = chain.when(host.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit("generic"))


def detect_ats(url: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return ats_of_host(url_host(url), rules)


def parse_job_title(title: Column, ats: Column) -> Column:
    """struct(company, role) guessed from a page title; unknown members are null."""
    t = collapse(title)
    clean = lambda c: collapse(F.regexp_replace(c, TITLE_NOISE, ""))
    pair = lambda role, company: F.struct(company.alias("company"), role.alias("role"))
    null = F.lit(None).cast("string")

    board = r"(?i)^job application for (.+) at (.+)$"
    at = rf"(?i)^(.+?){WS}+at{WS}+(.+)$"
    sides = F.filter(
        F.transform(F.split(t, rf"{WS}+[-–—|·]{WS}+"), clean), lambda p: p != ""
    )
    a = F.get(sides, F.lit(0))
    b = F.array_join(F.slice(sides, 2, F.greatest(F.size(sides) - 1, F.lit(0))), ", ")
    a_role, b_role = a.rlike(ROLE_WORDS), b.rlike(ROLE_WORDS)
    return (
        F.when(t == "", pair(null, null))
        .when(t.rlike(board), pair(clean(F.regexp_extract(t, board, 1)), clean(F.regexp_extract(t, board, 2))))
        .when(
            t.rlike(at) & F.regexp_extract(t, at, 1).rlike(ROLE_WORDS),
            pair(clean(F.regexp_extract(t, at, 1)), clean(F.regexp_extract(t, at, 2))),
        )
        .when((F.size(sides) >= 2) & a_role & ~b_role, pair(a, b))
        .when((F.size(sides) >= 2) & b_role & ~a_role, pair(b, a))
        .when((F.size(sides) >= 2) & (ats == "lever"), pair(b, a))
        .when(F.size(sides) >= 2, pair(a, b))
        .when(t.rlike(ROLE_WORDS), pair(clean(t), null))
        .otherwise(pair(null, null))
    )


def has_placeholders(text: Column) -> Column:
    return text.rlike(r"(?i)\{(company|role)\}")


def substitute_template(text: Column, company: Column, role: Column) -> Column:
    """Fill {company} and {role}; null as soon as one that is used has no value.

    Splitting on one placeholder and joining with its value keeps `$` and `\\`
    of the value literal, and a value is never itself expanded: the two
    placeholders are cut in one pass each over disjoint text.
    """
    join = lambda parts, by: F.call_function("array_join", parts, by)
    known = lambda v: F.nullif(v, F.lit(""))
    wants = lambda name: text.rlike(rf"(?i)\{{{name}\}}")
    by_company = F.split(text, r"(?i)\{company\}")
    filled = F.transform(
        by_company, lambda piece: join(F.split(piece, r"(?i)\{role\}"), F.coalesce(role, F.lit("")))
    )
    out = join(filled, F.coalesce(company, F.lit("")))
    return (
        F.when(wants("company") & known(company).isNull(), F.lit(None))
        .when(wants("role") & known(role).isNull(), F.lit(None))
        .otherwise(out)
    )
