"""Route and URL expressions over issue columns and the parsed payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import payload as P
from issuequarry.functions.text import html_escape, strip

# Link patterns of the two trackers and of URLs in running text.
GITHUB_LINK = r"(?iU)^https://github\.com/([^/]+)/([^/]+)/issues/(\d+)(?:[?#/].*)?$"
JIRA_LINK = r"(?iU)^https://([A-Za-z0-9-]+)\.atlassian\.net/browse/([A-Za-z0-9][A-Za-z0-9_-]*-\d+)(?:[?#/].*)?$"
TEXT_URL = r"(?U)https?://[^\s<>]+"
URL_TAIL = r"[.,);]+$"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:@\[\]]+)"


def _some(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _before(col: Column, mark: str) -> Column:
    return F.substring_index(col, mark, 1)


def _after(col: Column, mark: str) -> Column:
    """Text behind the first mark, null without one."""
    return F.when(col.contains(mark), F.substr(col, F.instr(col, mark) + F.lit(1)))


def _digits(col: Column) -> Column:
    return F.when(col.rlike(r"(?U)^\d+$"), col)


def repo_slug(repo: Column, v: Column) -> Column:
    """First usable repository name: the column, the repository object, the plain field."""
    return F.coalesce(
        _some(repo),
        _some(P.string_only(v, "$.repository.full_name")),
        _some(P.string_only(v, "$.repository.name")),
        _some(P.string_only(v, "$.repo")),
    )


def issue_number(external_key: Column, v: Column) -> Column:
    tail = F.when(external_key.contains("#"), strip(F.substring_index(external_key, "#", -1)))

    def number_at(path: str) -> Column:
        return F.when(P.kind(v, path) == "BIGINT", P.text(v, path)).otherwise(_digits(P.string_only(v, path)))

    nested = F.when(P.truthy(v, "$.issue.number").isNotNull(), number_at("$.issue.number")).otherwise(
        number_at("$.issue.id")
    )
    from_payload = F.when(P.is_object(v, "$.issue"), nested).otherwise(number_at("$.number"))
    return F.coalesce(_digits(tail), from_payload)


def jira_site(v: Column) -> Column:
    """First label of the first usable host, else the site field, else a default."""
    hosts = [
        _some(F.regexp_extract(P.string_only(v, path), _HOST, 1))
        for path in ("$.issue.self", "$.issue.url", "$.issue.fields.self", "$.self")
    ]
    return F.coalesce(
        _before(F.lower(F.coalesce(*hosts)), "."), _some(P.string_only(v, "$.site")), F.lit("sandbox")
    )


def with_route(df: DataFrame) -> DataFrame:
    """Add ``parts``, the canonical route and its parts; null for issues that have none.

    Expects source, external_key, repo, project and the variant ``payload``.
    The shared pieces get columns of their own, so that each is computed once
    and the generated code stays small.
    """
    v, key = F.col("payload"), F.col("external_key")
    pieces = df.withColumns({
        "_slug": repo_slug(F.col("repo"), v), "_number": issue_number(key, v), "_site": jira_site(v),
        "_key": _some(key), "_src": F.lower("source"),
    })
    slug, number, site, key = F.col("_slug"), F.col("_number"), F.col("_site"), F.col("_key")
    github = (F.col("_src") == "github") & number.isNotNull()
    jira = (F.col("_src") == "jira") & key.isNotNull()
    owner = F.when(slug.contains("/"), _before(slug, "/")).otherwise(F.lit("sandbox"))
    split = pieces.withColumns({
        "_owner": F.when(github, owner), "_name": F.when(github, F.coalesce(_after(slug, "/"), slug, F.lit("unknown"))),
        "_proj": F.when(jira, F.coalesce(_some(F.col("project")), _before(key, "-"))),
        "_kind": F.when(github, F.lit("github")).when(jira, F.lit("jira")),
    })
    is_github, is_jira = F.col("_kind") == "github", F.col("_kind") == "jira"
    route = F.when(
        is_github, F.concat(F.lit("/gh/"), F.col("_owner"), F.lit("/"), F.col("_name"), F.lit("/issues/"), number)
    ).when(is_jira, F.concat(F.lit("/jira/"), site, F.lit("/"), F.col("_proj"), F.lit("/"), key))
    parts = F.struct(
        F.col("_kind").alias("source"), route.alias("route"), F.col("_owner").alias("owner"), F.col("_name").alias("repo"),
        F.when(is_github, number).alias("number"), F.when(is_jira, site).alias("site"),
        F.col("_proj").alias("project"), F.when(is_jira, key).alias("key"),
    )
    made = F.when(F.col("_kind").isNotNull(), parts)
    # Exploding one element keeps later predicates on the route from being pushed
    # down as copies of all the expressions above.
    return split.select(*df.columns, F.explode(F.array(made)).alias("parts"))


def origin_url(parts: Column) -> Column:
    """Public URL of the tracker for route parts."""

    def part(name: str, default: str) -> Column:
        return F.coalesce(_some(parts[name]), F.lit(default))

    github = F.concat(
        F.lit("https://github.com/"), part("owner", "sandbox"), F.lit("/"), part("repo", "unknown"),
        F.lit("/issues/"), part("number", "0"),
    )
    jira = F.concat(
        F.lit("https://"), part("site", "sandbox"), F.lit(".atlassian.net/browse/"), part("key", "ISSUE-0")
    )
    return F.when(parts["source"] == "github", github).when(parts["source"] == "jira", jira)


def result_url(
    v: Column, issue_id: Column, source: Column, external_key: Column, repo: Column, project: Column
) -> Column:
    """URL shown with a search hit: the payload's own link first, then one built from columns."""
    stated = F.when(
        P.is_object(v, "$.issue"),
        F.coalesce(P.truthy(v, "$.issue.html_url"), P.truthy(v, "$.issue.url"), P.truthy(v, "$.issue.self")),
    ).otherwise(F.coalesce(P.truthy(v, "$.html_url"), P.truthy(v, "$.self")))
    some_repo, some_project, some_key = _some(repo), _some(project), _some(external_key)
    id_text = F.when(issue_id >= 0, issue_id.cast("string"))
    by_id = F.concat(F.lit("https://github.com/"), some_repo, F.lit("/issues/"), id_text)
    by_key = F.concat(
        F.lit("https://github.com/"), some_repo, F.lit("/issues/"), _digits(_after(some_key, "#"))
    )
    prefix = F.when(external_key.contains("-"), _some(_before(external_key, "-")))
    foreign = F.coalesce(F.lower(prefix) != F.lower(some_project), F.lit(False)) & id_text.isNotNull()
    jira_key = F.when(foreign, id_text).otherwise(F.coalesce(some_key, issue_id.cast("string")))
    browse = F.concat(F.lit("https://"), some_project, F.lit(".atlassian.net/browse/"), jira_key)
    github_first = F.when(
        (F.lower(source) == "github") & some_key.isNotNull(), F.coalesce(by_key, by_id)
    )
    return F.coalesce(stated, github_first, browse, by_id)


def rewrite_link(url: Column) -> Column:
    """Tracker URL to internal route, null for every other URL."""

    def gh(i: int) -> Column:
        return F.regexp_extract(url, GITHUB_LINK, i)

    def ji(i: int) -> Column:
        return F.regexp_extract(url, JIRA_LINK, i)

    github = F.concat(F.lit("/gh/"), gh(1), F.lit("/"), gh(2), F.lit("/issues/"), gh(3))
    jira = F.concat(F.lit("/jira/"), ji(1), F.lit("/"), _before(ji(2), "-"), F.lit("/"), ji(2))
    return F.when(url.rlike(GITHUB_LINK), github).when(url.rlike(JIRA_LINK), jira)


def text_urls(col: Column) -> Column:
    """URLs found in running text, trailing punctuation dropped."""
    return F.transform(
        F.regexp_extract_all(col, F.lit(TEXT_URL), F.lit(0)), lambda u: F.regexp_replace(u, URL_TAIL, "")
    )


def _anchor(url: Column) -> Column:
    shown = F.regexp_replace(url, URL_TAIL, "")
    tail = F.substr(url, F.length(shown) + F.lit(1))
    internal = rewrite_link(shown)
    rel = F.when(internal.isNotNull(), F.lit("")).otherwise(F.lit(' rel="nofollow noopener noreferrer"'))
    return F.concat(
        F.lit('<a href="'), html_escape(F.coalesce(internal, shown)), F.lit('"'), rel, F.lit(">"),
        html_escape(shown), F.lit("</a>"), html_escape(tail),
    )


def linkify(col: Column) -> Column:
    """Escape text and turn its URLs into anchors.

    Text between URLs and the URLs themselves are cut out by the same pattern,
    so the two arrays zip back to the whole text.
    """
    between = F.split(col, TEXT_URL, -1)
    urls = F.regexp_extract_all(col, F.lit(TEXT_URL), F.lit(0))
    pieces = F.zip_with(
        between, urls, lambda t, u: F.concat(html_escape(t), F.coalesce(_anchor(u), F.lit("")))
    )
    return F.replace(F.array_join(pieces, ""), F.lit("\n"), F.lit("<br />\n"))


_LINE_BREAK = r"\r\n|[\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\s\x1c-\x1f]"


def render_body(col: Column) -> Column:
    """Paragraphs split on blank lines, each escaped and linked."""
    lines = F.regexp_replace(col, _LINE_BREAK, "\n")
    lines = F.regexp_replace(lines, rf"(?U)^{_SPACE}*\n|\n{_SPACE}*$", "")
    lines = F.when(lines.rlike(rf"(?U)^{_SPACE}*$"), F.lit("")).otherwise(lines)
    paragraphs = F.split(lines, rf"(?U)\n{_SPACE}*\n", -1)
    html = F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), linkify(p), F.lit("</p>")))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("")).otherwise(F.array_join(html, ""))


def parse_route(route: Column) -> Column:
    """Route text to source, candidate keys and parts; null when it is no known route."""
    seg = F.filter(F.split(route, "/"), lambda s: s != "")

    def at(i: int) -> Column:
        return F.try_element_at(seg, F.lit(i))

    none = F.lit(None).cast("string")
    github = F.struct(
        F.lit("github").alias("source"), at(2).alias("owner"), at(3).alias("repo"), at(5).alias("number"),
        none.alias("site"), none.alias("project"), none.alias("key"),
        F.array(
            F.concat(at(2), F.lit("/"), at(3), F.lit("#"), at(5)), F.concat(at(3), F.lit("#"), at(5))
        ).alias("external_keys"),
    )
    jira = F.struct(
        F.lit("jira").alias("source"), none.alias("owner"), none.alias("repo"), none.alias("number"),
        at(2).alias("site"), at(3).alias("project"), at(4).alias("key"),
        F.array(at(4)).alias("external_keys"),
    )
    return F.when((F.size(seg) >= 5) & (at(1) == "gh") & (at(4) == "issues"), github).when(
        (F.size(seg) >= 4) & (at(1) == "jira"), jira
    )
