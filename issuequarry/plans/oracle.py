"""Equivalent SQL for the queries, over the same tables, in another engine's dialect.

Payload-derived values are written out by language, independently of the JSON
code under test. Approximate searches and the stemmed index have no SQL twin.
"""

from __future__ import annotations

_CTES = {
    "docs": """
  SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'github' ELSE 'jira' END AS tracker,
         split_part(text, chr(10), 1) AS title, text AS body, lang, source AS origin, upper(source) AS proj,
         CASE doc_id % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' ELSE 'Closed' END AS status,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id % 525600) AS created_at
  FROM documents""",
    "issues": """
  SELECT id, tracker AS source, lang, origin, proj, title, body, status, created_at,
         CASE WHEN tracker = 'jira' THEN proj || '-' || id WHEN lang = 'de' THEN CAST(id AS VARCHAR)
              WHEN lang = 'es' THEN origin || '#' || id ELSE 'org/' || origin || '#' || id END AS external_key,
         CASE WHEN tracker = 'jira' OR lang = 'de' THEN NULL WHEN lang = 'es' THEN origin
              ELSE 'org/' || origin END AS repo,
         CASE WHEN tracker = 'jira' AND lang <> 'es' THEN proj END AS project
  FROM docs""",
    "parts": """
  SELECT id, CASE WHEN source = 'jira' THEN 'jira' WHEN NOT (lang = 'de' AND id = 0) THEN 'github' END AS route_source,
         CASE WHEN source = 'github' AND lang = 'es' THEN 'sandbox' WHEN source = 'github' THEN 'org' END AS owner,
         CASE WHEN source = 'github' THEN origin END AS route_repo,
         CASE WHEN source = 'github' THEN CAST(id AS VARCHAR) END AS number,
         CASE WHEN source = 'jira' THEN CASE lang WHEN 'en' THEN 'ensite' WHEN 'fr' THEN 'frsite'
              WHEN 'de' THEN 'de' ELSE 'sandbox' END END AS site,
         CASE WHEN source = 'jira' THEN proj END AS route_project,
         CASE WHEN source = 'jira' THEN external_key END AS key
  FROM issues""",
    "routed": """
  SELECT i.*, route_source, CASE WHEN route_source IS NOT NULL THEN owner END AS owner,
         CASE WHEN route_source IS NOT NULL THEN route_repo END AS route_repo,
         CASE WHEN route_source IS NOT NULL THEN number END AS number, site, route_project, key,
         CASE WHEN route_source = 'github' THEN '/gh/' || owner || '/' || route_repo || '/issues/' || number
              WHEN route_source = 'jira' THEN '/jira/' || site || '/' || route_project || '/' || key END AS route,
         CASE WHEN route_source = 'github' THEN 'https://github.com/' || owner || '/' || route_repo || '/issues/' || number
              WHEN route_source = 'jira' THEN 'https://' || site || '.atlassian.net/browse/' || key END AS origin_url,
         CASE WHEN i.source = 'github' THEN CASE lang
                WHEN 'en' THEN 'https://github.com/org/' || origin || '/issues/' || i.id
                WHEN 'de' THEN NULL ELSE 'https://github.com/' || repo || '/issues/' || i.id END
              ELSE CASE lang WHEN 'en' THEN 'https://ENsite.atlassian.net/rest/api/2/issue/1'
                WHEN 'de' THEN 'https://user@de.example.org:8443/browse/x'
                WHEN 'fr' THEN 'https://' || proj || '.atlassian.net/browse/' || external_key END END AS url,
         CASE lang WHEN 'en' THEN 'High' WHEN 'fr' THEN 'Medium' WHEN 'de' THEN 'Low' END AS priority,
         CASE lang WHEN 'en' THEN 'Synthetic. Seed: 42. Generated: 2024-05-01T00:00:00Z. Source: '
              WHEN 'fr' THEN 'Synthetic. Seed: demo. Source: '
              WHEN 'de' THEN 'Synthetic. Seed: g7. Generated: 2024-02-02. Source: '
              ELSE 'Synthetic. Generated: 2024-03-03. Source: ' END || i.source || '.' AS determinism
  FROM issues i JOIN parts p ON p.id = i.id""",
    "vectors": """
  SELECT vec_id AS issue_id, CAST(embedding AS DOUBLE[]) AS embedding, 'm' || (label % 2) AS model,
         TIMESTAMP '2024-06-01' + to_minutes(vec_id % 525600) AS updated_at
  FROM embeddings""",
    "tags": """
  SELECT doc_id AS issue_id, 'quality-' || quality AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic-' || toxic FROM labels""",
    "alltags": """
  SELECT id, array_to_string(list_sort(list_distinct(list(label))), '|') AS labels FROM (
    SELECT issue_id AS id, label FROM tags
    UNION ALL SELECT id, unnest(['lang-' || lang, 'needs-triage', origin]) FROM docs)
  GROUP BY id""",
    "queries": """
  SELECT item_id AS query_id, text, embedding, model, 0.5 AS alpha
  FROM benchmark b JOIN vectors v ON v.issue_id = b.item_id""",
    "truth": """
  SELECT vec_id AS id, CASE WHEN vec_id <> original THEN original END AS duplicate_of
  FROM embeddings JOIN (SELECT label, min(vec_id) AS original FROM embeddings GROUP BY label) USING (label)""",
    "dists": """
  SELECT a.issue_id AS query_id, b.issue_id, a.model, round(list_distance(a.embedding, b.embedding), 12) AS distance
  FROM vectors a JOIN vectors b ON a.model = b.model""",
    "dots": """
  SELECT a.issue_id, b.issue_id AS neighbor_id, a.model = b.model AS same,
         round(list_inner_product(a.embedding, b.embedding), 12) AS similarity
  FROM vectors a JOIN vectors b ON a.issue_id <> b.issue_id""",
    "duptop": """
  SELECT id, duplicate_of, neighbor_id, similarity, rank FROM (
    SELECT issue_id, neighbor_id, similarity,
           row_number() OVER (PARTITION BY issue_id ORDER BY similarity DESC, neighbor_id) AS rank FROM dots) n
  JOIN truth ON id = issue_id WHERE rank <= 5""",
    "dupscore": """
  SELECT t.id, t.duplicate_of, max(CASE WHEN d.neighbor_id = t.duplicate_of THEN 1 ELSE 0 END) AS hit,
         coalesce(max(g.gain), 0) AS ndcg
  FROM truth t LEFT JOIN duptop d ON d.id = t.id
  LEFT JOIN (SELECT h.id, avg(1 / log2(o.rank + 1)) AS gain FROM duptop h JOIN duptop o
             ON h.id = o.id AND h.similarity = o.similarity WHERE h.neighbor_id = h.duplicate_of GROUP BY h.id) g
    ON g.id = t.id
  GROUP BY t.id, t.duplicate_of""",
    "near": """
  SELECT q.query_id, v.issue_id, distance, row_number() OVER (PARTITION BY q.query_id ORDER BY distance, v.issue_id) AS rank
  FROM (SELECT q.query_id, v.issue_id, round(list_distance(q.embedding, v.embedding), 12) AS distance
        FROM queries q JOIN vectors v ON v.model = q.model) v JOIN queries q ON q.query_id = v.query_id""",
    "words": """
  SELECT issue_id, word AS term, pos FROM (
    SELECT id AS issue_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (
      SELECT id, TOKENS(title || ' ' || body) AS w FROM docs))
  WHERE word NOT IN (SELECT unnest(string_split(STOPS, ' ')))""",
    "terms": """
  SELECT query_id, word AS term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (
    SELECT DISTINCT query_id, unnest(TOKENS(text)) AS word FROM queries)
  WHERE word NOT IN (SELECT unnest(string_split(STOPS, ' ')))""",
    "matches": """
  SELECT query_id, issue_id, n_terms FROM terms
  JOIN (SELECT DISTINCT issue_id, term FROM words) USING (term)
  GROUP BY query_id, issue_id, n_terms HAVING count(*) = n_terms""",
    "occurrences": """
  SELECT query_id, issue_id, n_terms, term, pos,
         row_number() OVER (PARTITION BY query_id, issue_id ORDER BY pos) AS place
  FROM matches JOIN terms USING (query_id, n_terms) JOIN words USING (issue_id, term)""",
    "latest": """
  SELECT o.query_id, o.issue_id, o.place, o.pos, o.n_terms,
         max(CASE WHEN o.term = t.term THEN o.place END) OVER (
           PARTITION BY o.query_id, o.issue_id, t.term ORDER BY o.place) AS last_at
  FROM occurrences o JOIN terms t ON t.query_id = o.query_id""",
    "ends": """
  SELECT query_id, issue_id, place, pos, min(last_at) AS begin_at FROM latest
  GROUP BY query_id, issue_id, place, pos, n_terms HAVING count(last_at) = n_terms""",
    "covers": """
  SELECT query_id, issue_id, begin_at, min(place) AS place, min(pos) AS pos FROM ends GROUP BY query_id, issue_id, begin_at""",
    "ranked": """
  SELECT c.query_id, c.issue_id, round(sum(0.1::DOUBLE / (1 + (c.pos - b.pos) - (c.place - c.begin_at))), 12) AS text_score
  FROM covers c JOIN occurrences b ON b.query_id = c.query_id AND b.issue_id = c.issue_id AND b.place = c.begin_at
  GROUP BY c.query_id, c.issue_id""",
    "texttop": """
  SELECT query_id, issue_id, text_score, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, issue_id) AS rank
  FROM ranked""",
    "jobs": """
  SELECT CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id END AS issue_id,
         event_type = 'error' AS force, event_id AS seq
  FROM events""",
    "approvals": """
  SELECT event_id AS approval_id, event_type AS kind,
         CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id END AS issue_id,
         CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'user' || user_id END AS assignee,
         CASE WHEN event_type IN ('error', 'click') THEN props END AS comment,
         CASE event_type WHEN 'signup' THEN 'jira' WHEN 'click' THEN 'github' END AS asked
  FROM events""",
    "sent": """
  SELECT d.*, 2 * id AS arrival, 'open' AS state, coalesce(l.toxic = 1, false) AS forged
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.id
  UNION ALL SELECT d.*, 2 * id + 1, 'closed', l.toxic = 1 FROM docs d JOIN labels l ON l.doc_id = d.id WHERE quality = 1""",
    "routes": """
  SELECT route, min(id) AS first_id FROM routed WHERE route IS NOT NULL GROUP BY route""",
    "requested": """
  SELECT route FROM routed WHERE route IS NOT NULL
  UNION ALL SELECT 'gh/none/page/issues/' || page_id FROM pages""",
    "linked": """
  SELECT id, origin, proj, tracker, body || chr(10) || chr(10) || 'See ' || CASE WHEN tracker = 'github'
           THEN 'https://github.com/org/' || origin || '/issues/' || id
           ELSE 'https://sandbox.atlassian.net/browse/' || proj || '-' || id || '?x=1' END
         || '). And https://example.com/docs/' || id || '.' AS text, body
  FROM docs""",
    "maskin": """
  SELECT id AS doc_id, lang, origin, body || chr(10) || 'Failed with ' || upper(origin[1]) || origin[2:] || 'Error in `run ' || id
         || '` at https://example.com/' || id || ' see ./src/' || origin || '.py or org/' || origin || ' ' || proj || '-' || id
         || ' since v1.2.3 on 2024-01-02T03:04:05Z' AS text
  FROM docs""",
    "github_rows": """
  SELECT id AS doc_id,
         CASE lang WHEN 'en' THEN 'org/' || origin || '#' || CASE WHEN id = 0 THEN 1 ELSE id END
              WHEN 'fr' THEN 'org/' || origin || '#' || (id + 1)
              WHEN 'de' THEN CASE WHEN id = 0 THEN 'None' ELSE 'org/' || origin || '#' || id END
              ELSE CAST(id + 1 AS VARCHAR) END AS external_key,
         CASE WHEN lang = 'de' THEN '' ELSE title END AS title,
         CASE WHEN lang IN ('de', 'es') THEN '' ELSE body END AS body,
         CASE WHEN lang <> 'es' THEN 'org/' || origin END AS repo, CAST(NULL AS VARCHAR) AS project,
         CASE WHEN lang <> 'de' THEN 'open' END AS status,
         CASE lang WHEN 'en' THEN created_at WHEN 'fr' THEN created_at - INTERVAL '330 minutes'
              ELSE TIMESTAMP '2025-01-01' END AS created_at
  FROM docs""",
    "jira_rows": """
  SELECT id AS doc_id, CASE WHEN lang = 'fr' THEN CAST(id AS VARCHAR) ELSE proj || '-' || id END AS external_key, title,
         CASE WHEN lang = 'de' THEN '' ELSE body END AS body, CAST(NULL AS VARCHAR) AS repo,
         CASE WHEN lang <> 'es' THEN proj END AS project, CASE WHEN lang <> 'de' THEN 'To Do' END AS status,
         CASE lang WHEN 'en' THEN created_at - INTERVAL '330 minutes' WHEN 'es' THEN TIMESTAMP '2025-01-01'
              ELSE created_at END AS created_at
  FROM docs""",
    "arrived": """
  SELECT s.tracker AS source, s.arrival, external_key, n.title, n.body,
         CASE WHEN n.status IS NOT NULL THEN s.state END AS status, n.created_at
  FROM sent s JOIN (SELECT 'github' AS source, * FROM github_rows UNION ALL SELECT 'jira', * FROM jira_rows) n
    ON n.source = s.tracker AND n.doc_id = s.id
  WHERE NOT s.forged AND NOT (s.tracker = 'github' AND s.lang = 'es')""",
    "ingested": """
  SELECT source, external_key, arg_max(title, arrival) AS title, arg_max(body, arrival) AS body,
         max_by(status, arrival) AS status, arg_max(created_at, arrival) AS created_at, min(arrival) AS first_arrival
  FROM arrived GROUP BY source, external_key""",
    "upserted": """
  SELECT i.id, i.source, external_key, title, body,
         CASE WHEN quality IS NULL THEN status WHEN quality = 1 THEN 'Resolved' ELSE 'Reopened' END AS status, created_at
  FROM issues i LEFT JOIN labels l ON l.doc_id = i.id
  UNION ALL
  SELECT (SELECT max(id) FROM issues) + row_number() OVER (ORDER BY conv_id), 'jira', 'CHAT-' || conv_id, role, text, 'Open',
         TIMESTAMP '2025-01-01'
  FROM (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)""",
}

_NEEDS = {
    "issues": ["docs"], "parts": ["issues"], "routed": ["issues", "parts"], "alltags": ["docs", "tags"],
    "queries": ["vectors"], "dists": ["vectors"], "dots": ["vectors"], "duptop": ["dots", "truth"],
    "dupscore": ["truth", "duptop"], "near": ["queries", "vectors"], "words": ["docs"], "terms": ["queries"],
    "matches": ["terms", "words"], "occurrences": ["matches", "terms", "words"], "latest": ["occurrences", "terms"],
    "ends": ["latest"], "covers": ["ends"], "ranked": ["covers", "occurrences"], "texttop": ["ranked"],
    "sent": ["docs"], "routes": ["routed"], "requested": ["routed"], "linked": ["docs"], "maskin": ["docs"], "entities": ["maskin"],
    "github_rows": ["docs"], "jira_rows": ["docs"], "arrived": ["sent", "github_rows", "jira_rows"],
    "ingested": ["arrived"], "upserted": ["issues"],
}

_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def _stops() -> str:
    from issuequarry.functions.text import ENGLISH_STOP_WORDS

    return "'" + " ".join(ENGLISH_STOP_WORDS) + "'"


def _sql(body: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for below in _NEEDS.get(name, []):
            add(below)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    ctes = _CTES | {"entities": _entities()}
    parts = ",\n".join(f"{name} AS ({ctes[name]})" for name in order)
    text = f"WITH {parts}\n{body}" if order else body
    for content in ("title || ' ' || body", "text"):
        text = text.replace(f"TOKENS({content})", _tokens(content))
    return text.replace("STOPS", _stops())


def _tokens(content: str) -> str:
    """Token classes in the order in which they are tried, worded for an engine that needs no possessive groups."""
    sign = r"[\p{L}\p{N}]"
    word, label, name = rf"\p{{N}}*\p{{L}}{sign}*", rf"{sign}+(?:[-_]+{sign}+)*", rf"{sign}+(?:[._-]+{sign}+)*"
    host = rf"{label}(?:\.{label})*\.\p{{L}}{{2}}{sign}*(?:[-_]+{sign}+)*(?::\p{{N}}+)?"
    classes = (
        r"</?\p{L}[^<>]*>", rf"&(?:#\p{{N}}+|#x[0-9a-f]+|\p{{L}}{sign}*);", r"\p{L}+://", f"{name}@{host}",
        rf"{host}/[!#-;=?-\[\]_a-z~]*", host, rf"(?:~|\.{{1,2}})?/{name}(?:/{name})*", f"{name}(?:/{name})+",
        r"-?\p{N}+\.\p{N}+e[+-]?\p{N}+", f"{word}(?:-{word})*", r"-?\p{N}+(?:\.\p{N}+)*",
    )
    found = f"regexp_extract_all(lower({content}), '{'|'.join(classes)}')"
    parts = (
        "CASE WHEN x LIKE '<%' OR x LIKE '&%' OR x LIKE '%://' THEN CAST([] AS VARCHAR[]) "
        f"WHEN regexp_matches(x, '^{host}/') THEN [x, split_part(x, '/', 1), substr(x, strpos(x, '/'))] "
        r"WHEN regexp_full_match(x, '[\p{L}\p{N}-]+') AND regexp_matches(x, '[\p{L}\p{N}]-\p{N}*\p{L}') "
        "THEN list_concat([x], string_split(x, '-')) ELSE [x] END"
    )
    return f"flatten(list_transform({found}, lambda x: {parts}))"


def _escaped(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        f"'\"', '&quot;'), chr(39), '&#x27;')"
    )


def _paragraphs(x: str) -> str:
    """Markup of text without URLs."""
    inner = f"regexp_replace(regexp_replace({x}, '^\\s*\\n', ''), '\\n\\s*$', '')"
    inner = f"CASE WHEN trim({x}, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN '' ELSE {inner} END"
    split = f"regexp_replace({_escaped(inner)}, '\\n\\s*\\n', '</p><p>', 'g')"
    return f"CASE WHEN {x} = '' THEN '' ELSE replace('<p>' || {split} || '</p>', chr(10), '<br />' || chr(10)) END"


#: The protected kinds in order of priority, worded for an engine without lookahead: a traceback takes the blank line behind
#: it along, which is cut off again. Letters and numbers of any script are word characters, bounds are those of ASCII words.
_WORD = r"\p{L}\p{N}_"
_PROTECTED = (
    ("fence", "(?s:```.*?```|~~~.*?~~~)"),
    ("traceback", r"(?s:Traceback \(most recent call last\):.+?(?:\n\n|\z))"),
    ("inline_code", "`[^`]+`"),
    ("url", r"(?i)https?://[^\s\p{Z}]+"),
    ("path", rf"(?:\.{{1,2}}/|/)[{_WORD}@~./-]+"),
    ("repo", rf"\b[{_WORD}.-]+/[{_WORD}.-]+\b"),
    ("issue_key", r"\b[A-Z][A-Z0-9]+-\d+\b"),
    ("id", r"(?i)\b(?:id:?\s*#?\d{3,}|#\d{3,}|\d{5,})\b"),
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?\b"),
    ("version", rf"\bv?\d+\.\d+(?:\.\d+)?(?:-[{_WORD}.-]+)?\b"),
    ("error", r"\b[A-Z][A-Za-z0-9]+Error\b"),
)


def _entities() -> str:
    """Protected spans: matches are laid out by the lengths of what lies between them, kinds accepted one after another."""
    parts = ["t AS MATERIALIZED (SELECT doc_id, text FROM maskin)"]
    for k, (kind, pattern) in enumerate(_PROTECTED):
        quoted = "'" + pattern.replace("'", "''") + "'"
        cut = "CASE WHEN ends_with(h, chr(10) || chr(10)) THEN 2 ELSE 0 END" if kind == "traceback" else "0"
        parts.append(f"""
h{k} AS (SELECT doc_id, generate_subscripts(hs, 1) AS nth, unnest(hs) AS h, unnest(bs[1 : len(hs)]) AS b FROM (
  SELECT doc_id, regexp_extract_all(text, {quoted}) AS hs, string_split_regex(text, {quoted}) AS bs FROM t WHERE regexp_matches(text, {quoted}))),
p{k} AS (SELECT doc_id, h, sum(length(b) + length(h)) OVER (PARTITION BY doc_id ORDER BY nth) AS e FROM h{k}),
m{k} AS (SELECT doc_id, '{kind}' AS kind, CAST(e - length(h) AS BIGINT) AS s, CAST(e - {cut} AS BIGINT) AS e FROM p{k}),
a{k} AS MATERIALIZED (SELECT * FROM m{k}{f" WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} x WHERE x.doc_id = m{k}.doc_id AND x.s < m{k}.e AND m{k}.s < x.e) UNION ALL SELECT * FROM a{k - 1}" if k else ""})""")
    last = len(_PROTECTED) - 1
    return f"""WITH {",".join(parts)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, kind, text[s + 1 : e] AS value, s AS start, e AS "end"
FROM a{last} JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    top_pairs = (
        "SELECT query_id, issue_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, issue_id) AS rank "
        "FROM dists WHERE query_id <> issue_id"
    )
    archive_key = (
        "CASE WHEN lang = 'de' THEN tracker WHEN lang = 'fr' THEN 'rec-' || id WHEN tracker = 'github' THEN "
        "CASE WHEN lang = 'en' THEN 'org/' || origin ELSE 'sandbox' END || '#' || id "
        "WHEN lang = 'en' THEN proj || '-' || id ELSE 'rec-' || id END"
    )
    archive_status = "CASE WHEN lang = 'en' THEN 'Closed' WHEN tracker = 'github' THEN 'Open' ELSE 'To Do' END"
    normal = f"doc_id, external_key, title, body, repo, project, status, {_STAMP} AS created_at, title = '' AS blank_title"
    summary = (
        f"r.id, route_source AS source, route, origin_url, title, status, priority, labels, repo, project, {_STAMP} AS created_at"
    )
    shown = "title, route, url"
    event = "CASE lang WHEN 'en' THEN 'issues' WHEN 'fr' THEN 'issue_comment' WHEN 'de' THEN 'pull_request' ELSE 'push' END"
    gate = "CASE WHEN tracker = 'github' THEN " + event + " END"
    dup = "SELECT count(*) AS count, round({}, 6) AS {} FROM dupscore {}"
    labelled = "WHERE duplicate_of IS NOT NULL"
    job_first = "(SELECT issue_id, min(seq) AS first_seq FROM jobs GROUP BY issue_id) f"
    pipe = "array_to_string([{}], '|')"
    github_ok = "i.source = 'github' AND coalesce(asked, i.source) = 'github'"
    jira_ok = "i.source = 'jira' AND coalesce(asked, i.source) = 'jira'"
    actions = []
    for kind, seq, name, method, path, payload, wanted in (
        ("github", 1, "add_labels", "POST", "'/repos/' || repo || '/issues/' || id || '/labels'",
         "'{\"labels\":[\"' || kind || '\"]}'", "kind <> 'view'"),
        ("github", 2, "assign", "POST", "'/repos/' || repo || '/issues/' || id || '/assignees'",
         "'{\"assignees\":[\"' || assignee || '\"]}'", "assignee IS NOT NULL"),
        ("github", 3, "comment", "POST", "'/repos/' || repo || '/issues/' || id || '/comments'",
         "'{\"body\":' || CAST(to_json(comment) AS VARCHAR) || '}'", "comment IS NOT NULL"),
        ("jira", 1, "assign", "PUT", "'/rest/api/3/issue/' || external_key || '/assignee'",
         "'{\"accountId\":\"' || assignee || '\"}'", "assignee IS NOT NULL"),
        ("jira", 2, "comment", "POST", "'/rest/api/3/issue/' || external_key || '/comment'",
         "'{\"body\":' || CAST(to_json(comment) AS VARCHAR) || '}'", "comment IS NOT NULL"),
    ):
        actions.append(
            f"SELECT approval_id, CAST({seq} AS BIGINT) AS seq, '{name}' AS action, '{method}' AS method, {path} AS path, "
            f"{payload} AS payload FROM judged WHERE status = 'ok' AND source = '{kind}' AND {wanted}"
        )
    url_list = "regexp_extract_all(text, 'https?://[^\\s<>]+')"
    tracker_link = (
        "CASE WHEN regexp_matches(url, '(?i)^https://github\\.com/[^/]+/[^/]+/issues/[0-9]+([?#/].*)?$') THEN "
        "'/gh/' || regexp_extract(url, '(?i)^https://github\\.com/([^/]+/[^/]+/issues/[0-9]+)', 1) "
        "WHEN regexp_matches(url, '(?i)^https://[a-z0-9-]+\\.atlassian\\.net/browse/[a-z0-9][a-z0-9_-]*-[0-9]+([?#/].*)?$') THEN "
        "'/jira/' || regexp_extract(url, '(?i)^https://([a-z0-9-]+)\\.', 1) || '/' || "
        "split_part(regexp_extract(url, '(?i)/browse/([a-z0-9][a-z0-9_-]*-[0-9]+)', 1), '-', 1) || '/' || "
        "regexp_extract(url, '(?i)/browse/([a-z0-9][a-z0-9_-]*-[0-9]+)', 1) END"
    )
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rel = ' rel="nofollow noopener noreferrer"'
    twins = {
        "scan_ndjson": _sql("SELECT id, source, external_key, title, body, status FROM issues", "issues"),
        "scan_labelled_pairs": _sql(
            "SELECT d.id, title, body, duplicate_of FROM docs d LEFT JOIN truth t ON t.id = d.id", "docs", "truth"),
        "stream_deliveries": _sql(f"SELECT tracker AS source, arrival, {gate} AS event FROM sent", "sent"),
        "load_guard": _sql(
            "SELECT source, count(*) AS issues, CAST(0 AS BIGINT) AS loaded FROM issues GROUP BY source", "issues"),
        "load_counts": _sql(
            "SELECT source, count(*) AS inserted, CAST(2 * count(DISTINCT k) AS BIGINT) AS labels, count(DISTINCT k) AS ids, "
            f"CAST(0 AS BIGINT) AS stale_vectors FROM (SELECT tracker AS source, {archive_key} AS k FROM docs) GROUP BY source",
            "docs"),
        "sink_ndjson_or_parquet": _sql(
            "SELECT format, source, count(*) AS rows, CAST(sum(length(title) + length(body)) AS BIGINT) AS characters "
            "FROM issues, (SELECT unnest(['parquet', 'json']) AS format) GROUP BY format, source", "issues"),
        "upsert_issues": _sql(
            f"SELECT id, source, external_key, title, body, status, {_STAMP} AS created_at FROM upserted", "upserted"),
        "assign_issue_ids": _sql("SELECT source, external_key, id FROM upserted", "upserted"),
        "upsert_vectors": _sql(
            "SELECT issue_id, CASE WHEN doc_id IS NULL THEN model ELSE 'm3' END AS model, "
            "strftime(updated_at + CASE WHEN doc_id IS NULL THEN INTERVAL '0 days' ELSE INTERVAL '2 days' END, '%Y-%m-%d %H:%M:%S') "
            "AS updated_at, round(CASE WHEN doc_id IS NULL THEN embedding[1] ELSE embedding[-1] END, 6) AS first "
            "FROM vectors LEFT JOIN labels ON doc_id = issue_id", "vectors"),
        "replace_labels": _sql(
            "SELECT issue_id, label, 'triage' AS source, count(*) AS copies FROM tags JOIN labels ON doc_id = issue_id "
            "WHERE quality <> 1 GROUP BY issue_id, label UNION ALL "
            "SELECT id, label, 'import', count(*) FROM (SELECT id, unnest([lang, lang, origin]) AS label FROM docs "
            "JOIN labels ON doc_id = id WHERE quality = 1 AND toxic <> 1) GROUP BY id, label", "docs", "tags"),
        "similar_refresh": _sql(
            "SELECT issue_id, CAST(-1 AS BIGINT) AS neighbor_id, CAST(0.5 AS DOUBLE) AS score FROM vectors "
            "WHERE issue_id NOT IN (SELECT doc_id FROM labels) UNION ALL "
            "SELECT query_id, issue_id, round(CAST(CAST(1 - distance AS FLOAT) AS DOUBLE), 4) FROM ("
            "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, issue_id) AS rank FROM dists "
            "WHERE query_id <> issue_id AND query_id IN (SELECT doc_id FROM labels) "
            "AND issue_id IN (SELECT doc_id FROM documents)) WHERE rank <= 5", "dists"),
        "cascade_orphans": _sql(
            "SELECT issue_id, 'vectors' AS child FROM vectors WHERE issue_id IN (SELECT id FROM docs JOIN labels ON doc_id = id) "
            "UNION ALL SELECT issue_id, 'labels' FROM tags WHERE issue_id IN (SELECT id FROM docs)", "vectors", "tags", "docs"),
        "normalize_github": _sql(f"SELECT {normal} FROM github_rows", "github_rows"),
        "normalize_jira": _sql(f"SELECT {normal} FROM jira_rows", "jira_rows"),
        "normalize_archive": _sql(
            f"SELECT id AS doc_id, tracker AS source, {archive_key} AS external_key, title, body, "
            "CASE WHEN tracker = 'github' AND lang <> 'es' THEN 'org/' || origin END AS repo, "
            "CASE WHEN tracker = 'jira' AND lang <> 'es' THEN proj END AS project, "
            f"{archive_status} AS status, {_STAMP} AS created_at, lang || '| shared | ' AS labels FROM docs", "docs"),
        "current_status": _sql(f"SELECT id, {archive_status} AS status FROM docs", "docs"),
        "coerce_timestamps": _sql(
            "SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S') AS strict, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), "
            "'2025-01-01 00:00:00') AS defaulted FROM (SELECT id, CASE lang WHEN 'fr' THEN created_at - INTERVAL '330 minutes' "
            "WHEN 'es' THEN NULL ELSE created_at END AS t FROM docs)", "docs"),
        "event_filter": _sql(
            f"SELECT tracker AS source, {gate} AS event, count(*) AS deliveries, CAST(sum(arrival) AS BIGINT) AS arrivals "
            "FROM sent WHERE tracker = 'jira' OR lang <> 'es' GROUP BY 1, 2", "sent"),
        "authentic_deliveries": _sql("SELECT tracker AS source, arrival, NOT forged AS authentic FROM sent", "sent"),
        "embedding_text": _sql(
            f"SELECT id, trim(title || chr(10) || chr(10) || body, {white}) AS text FROM docs", "docs"),
        "vector_quality": _sql(
            "SELECT model, count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS bad_dimension, "
            "CAST(0 AS BIGINT) AS with_nulls, round(min(sqrt(list_inner_product(embedding, embedding))), 6) AS min_norm, "
            "round(max(sqrt(list_inner_product(embedding, embedding))), 6) AS max_norm FROM vectors GROUP BY model", "vectors"),
        "vectors_join_issues": _sql(
            "SELECT issue_id, model, source, external_key, title FROM vectors JOIN issues ON id = issue_id", "vectors", "issues"),
        "issues_left_labels": _sql(
            "SELECT id, external_key, coalesce(array_to_string(list_sort(list(label) FILTER (label IS NOT NULL)), '|'), '') AS labels "
            "FROM issues LEFT JOIN (SELECT DISTINCT * FROM tags) t ON issue_id = id AND label IN ('quality-1', 'toxic-1') "
            "GROUP BY id, external_key", "issues", "tags"),
        "hybrid_candidate_union": _sql(
            "SELECT query_id, issue_id, coalesce(v.s, 0) AS vector_score, coalesce(t.s, 0) AS text_score FROM "
            "(SELECT model AS query_id, issue_id, round(embedding[1], 6) AS s FROM vectors) v FULL JOIN "
            "(SELECT 'm' || quality AS query_id, doc_id AS issue_id, CAST(toxic + 0.5 AS DOUBLE) AS s FROM labels) t "
            "USING (query_id, issue_id)", "vectors"),
        "missing_vectors": _sql(
            "SELECT id, external_key FROM issues WHERE id NOT IN (SELECT issue_id FROM vectors)", "issues", "vectors"),
        "keys_semi_lookup": _sql(
            "SELECT id, source, external_key, title FROM issues WHERE id IN (SELECT conv_id FROM conversations)", "issues"),
        "approvals_join_issues": _sql(
            "SELECT approval_id, issue_id, source AS issue_source, external_key, "
            "CASE WHEN id IS NULL THEN 'issue_not_found' ELSE 'ok' END AS lookup "
            "FROM approvals LEFT JOIN issues ON id = issue_id", "approvals", "issues"),
        "issue_latest_vector": _sql(
            "SELECT id AS issue_id, coalesce(model, 'hashing-384') AS model, CASE WHEN model IS NULL THEN 'computed' ELSE 'stored' END "
            "AS origin, CAST(CASE WHEN model IS NULL THEN 384 ELSE 64 END AS BIGINT) AS dim, round(embedding[1], 6) AS first "
            "FROM issues LEFT JOIN vectors ON issue_id = id", "issues", "vectors"),
        "labels_array": _sql(
            "SELECT issue_id, array_to_string(list_sort(list_distinct(list(label))), '|') AS labels FROM tags GROUP BY issue_id", "tags"),
        "embedding_coverage": _sql(
            "SELECT (SELECT count(*) FROM issues) AS issues, (SELECT count(*) FROM issues WHERE id NOT IN "
            "(SELECT issue_id FROM vectors)) AS missing, (SELECT count(*) FROM vectors) AS vectors, "
            "(SELECT count(DISTINCT model) FROM vectors) AS models", "issues", "vectors"),
        "distinct_routes": _sql("SELECT route, first_id FROM routes", "routes"),
        "dup_hit_rate": _sql(dup.format("avg(hit)", "hit_rate", labelled), "dupscore"),
        "dup_precision_at_k": _sql(dup.format("avg(hit / 5.0::DOUBLE)", "p_at_k", ""), "dupscore"),
        "dup_ndcg": _sql(dup.format("avg(ndcg)", "ndcg", labelled), "dupscore"),
        "vector_search": _sql(
            f"SELECT query_id, issue_id, rank, round(distance, 6) AS distance, "
            f"round(greatest(1 - greatest(distance, 0), 0), 6) AS score, {shown} FROM (SELECT query_id, issue_id, distance, "
            "row_number() OVER (PARTITION BY query_id ORDER BY distance, issue_id) AS rank FROM near "
            "WHERE issue_id IN (SELECT id FROM issues)) JOIN routed ON id = issue_id WHERE rank <= 10", "near", "routed"),
        "knn_graph": _sql(
            "SELECT query_id AS issue_id, issue_id AS neighbor_id, rank, round(distance, 6) AS distance, "
            f"round(1 - distance, 6) AS score FROM ({top_pairs}) WHERE rank <= 5", "dists"),
        "all_pairs_similarity": _sql(
            "SELECT issue_id, neighbor_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER "
            "(PARTITION BY issue_id ORDER BY similarity DESC, neighbor_id) AS rank FROM dots WHERE same) WHERE rank <= 5", "dots"),
        "embed_corpus": _sql(
            "SELECT id AS issue_id, CAST(384 AS BIGINT) AS dim, CAST(CASE WHEN regexp_matches(body, '[\\p{L}\\p{N}]') THEN 1 ELSE 0 END "
            "AS DOUBLE) AS norm FROM docs", "docs"),
        "rerank_candidates": _sql(
            "SELECT query_id, issue_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank, "
            f"round(distance, 6) AS distance FROM ({top_pairs}) WHERE rank <= 5", "dists"),
        "text_index": _sql(
            "SELECT term, issue_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM words "
            "GROUP BY term, issue_id", "words"),
        "text_match": _sql("SELECT query_id, issue_id, n_terms FROM matches", "matches"),
        "text_rank_topk": _sql(
            "SELECT query_id, issue_id, rank, round(text_score, 6) AS text_score FROM texttop WHERE rank <= 10", "texttop"),
        "hybrid_search": _sql(
            "SELECT query_id, issue_id, rank, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score, "
            f"round(score, 6) AS score, {shown} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, issue_id) "
            "AS rank FROM (SELECT query_id, issue_id, v AS vector_score, t AS text_score, round(v * alpha + t * (1 - alpha), 12) AS score "
            "FROM (SELECT query_id, issue_id, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM "
            "(SELECT query_id, issue_id, 1 / (1 + distance) AS v FROM near WHERE rank <= 10) FULL JOIN "
            "(SELECT query_id, issue_id, text_score AS t FROM texttop WHERE rank <= 10) USING (query_id, issue_id)) c "
            "JOIN (SELECT query_id, CAST(alpha AS DOUBLE) AS alpha FROM queries) a USING (query_id) "
            "WHERE issue_id IN (SELECT id FROM issues))) JOIN routed ON id = issue_id WHERE rank <= 10",
            "near", "texttop", "routed"),
        "search_params": (
            "SELECT query_id, k, alpha, CASE WHEN length(text) >= 2 AND k BETWEEN 1 AND 50 AND alpha BETWEEN 0 AND 1 THEN 'ok' "
            "ELSE 'invalid' END AS status FROM (SELECT conv_id || ':' || turn AS query_id, text, "
            "CAST(CASE WHEN turn > 0 THEN turn * 20 ELSE 10 END AS BIGINT) AS k, "
            "CAST(CASE WHEN role <> 'user' THEN turn / 2.0 ELSE 0.5 END AS DOUBLE) AS alpha FROM conversations)"),
        "triage_propose": _sql(
            "SELECT id AS issue_id, 'needs-triage' AS labels, '' AS assignee_candidates, "
            "'Similar issues suggest investigating related regressions.' AS summary, coalesce(similar_ids, '') AS similar_ids "
            "FROM issues LEFT JOIN (SELECT query_id, string_agg(CAST(issue_id AS VARCHAR), ',' ORDER BY rank) AS similar_ids "
            "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, issue_id) AS rank FROM dists "
            "WHERE issue_id IN (SELECT id FROM issues)) WHERE rank <= 5 GROUP BY query_id) ON query_id = id", "dists", "issues"),
        "writeback_plan": _sql(
            ", judged AS (SELECT a.*, i.id, i.source, repo, external_key, CASE WHEN i.id IS NULL THEN 'issue not found' "
            f"WHEN {github_ok} AND (repo IS NULL OR i.id = 0) THEN 'missing repo or number' "
            f"WHEN ({github_ok}) OR ({jira_ok}) THEN 'ok' ELSE 'source mismatch' END AS status "
            "FROM approvals a LEFT JOIN issues i ON i.id = a.issue_id) "
            "SELECT j.approval_id, issue_id, status, seq, action, method, path, payload FROM judged j LEFT JOIN ("
            + " UNION ALL ".join(actions) + ") p ON p.approval_id = j.approval_id", "approvals", "issues"),
        "canonical_routes": _sql(
            "SELECT id, route_source, route, owner, route_repo, number, site, route_project, key FROM routed", "routed"),
        "origin_urls": _sql("SELECT id, route, origin_url FROM routed", "routed"),
        "result_urls": _sql("SELECT id, url FROM routed", "routed"),
        "issue_labels": _sql("SELECT id, labels FROM alltags WHERE id IN (SELECT id FROM docs)", "alltags", "docs"),
        "issue_priority": _sql("SELECT id, priority FROM routed", "routed"),
        "comments_exploded": _sql(
            "SELECT id, CAST(pos - 1 AS BIGINT) AS pos, lang AS author, line AS body, "
            "strftime(created_at - INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT id, lang, created_at, "
            "unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM docs)", "docs"),
        "provenance_banner": _sql("SELECT id, determinism FROM routed", "routed"),
        "render_bodies": _sql(
            f"SELECT id, {_paragraphs('body')} || '<p>See <a href=\"' || CASE WHEN tracker = 'github' THEN "
            "'/gh/org/' || origin || '/issues/' || id || '\">https://github.com/org/' || origin || '/issues/' || id "
            "ELSE '/jira/sandbox/' || proj || '/' || proj || '-' || id || '\">https://sandbox.atlassian.net/browse/' || proj || '-' || id "
            f"|| '?x=1' END || '</a>). And <a href=\"https://example.com/docs/' || id || '\"{rel}>https://example.com/docs/' || id "
            "|| '</a>.</p>' AS body_html FROM docs", "docs"),
        "link_rewrites": _sql(
            f"SELECT id, pos, url, coalesce(l.route, url) AS href, l.route IS NOT NULL AS internal, first_id AS target_id FROM ("
            f"SELECT id, pos, url, {tracker_link} AS route FROM (SELECT id, CAST(pos - 1 AS BIGINT) AS pos, rtrim(u, '.,);') AS url FROM ("
            f"SELECT id, unnest({url_list}) AS u, generate_subscripts({url_list}, 1) AS pos FROM linked))) l "
            "LEFT JOIN routes r ON r.route = l.route", "linked", "routes"),
        "viewer_records": _sql(
            f"SELECT {summary}, body, {_paragraphs('body')} AS body_html, determinism, CAST(len(lines) AS BIGINT) AS comments, "
            "CAST(length(body) - len(lines) + 1 AS BIGINT) AS comment_characters, "
            f"(SELECT string_agg({_paragraphs('line')}, '' ORDER BY place) FROM (SELECT unnest(lines) AS line, "
            "unnest(range(len(lines))) AS place)) AS comment_html "
            "FROM (SELECT *, string_split(body, chr(10)) AS lines FROM routed) r JOIN alltags a ON a.id = r.id "
            "WHERE route IS NOT NULL", "routed", "alltags"),
        "viewer_summaries": _sql(
            f"SELECT {summary} FROM routed r JOIN alltags a ON a.id = r.id WHERE route IS NOT NULL", "routed", "alltags"),
        "parse_routes": _sql(
            "SELECT route, 'github' AS source, s[1] AS owner, s[2] AS repo, s[4] AS number, NULL AS site, NULL AS project, NULL AS key, "
            + pipe.format("s[1] || '/' || s[2] || '#' || s[4], s[2] || '#' || s[4]") + " AS external_keys FROM "
            "(SELECT route, string_split(regexp_replace(route, '^/?gh/', ''), '/') AS s FROM requested WHERE route NOT LIKE '/jira/%') "
            "UNION ALL SELECT route, 'jira', NULL, NULL, NULL, s[1], s[2], s[3], s[3] FROM "
            "(SELECT route, string_split(replace(route, '/jira/', ''), '/') AS s FROM requested WHERE route LIKE '/jira/%')", "requested"),
        "issues_by_route": _sql(
            "SELECT q.route, f.id, CASE WHEN f.id IS NULL THEN 'route not found' ELSE 'ok' END AS lookup, r.route AS canonical_route, "
            "title, labels, priority, determinism FROM (SELECT DISTINCT route FROM requested) q LEFT JOIN ("
            "SELECT route, min(id) AS id FROM routed WHERE route IS NOT NULL AND NOT (source = 'github' AND lang = 'de') GROUP BY route) f "
            "ON f.route = q.route LEFT JOIN routed r ON r.id = f.id LEFT JOIN alltags a ON a.id = f.id", "requested", "routed", "alltags"),
        "viewer_search": _sql(
            f"SELECT {summary} FROM (SELECT * FROM routed WHERE status IN ('Open', 'Closed') "
            "AND id IN (SELECT id FROM docs WHERE lang IN ('en', 'fr')) ORDER BY created_at DESC, id DESC LIMIT 50) r "
            "JOIN (SELECT id, array_to_string(list_sort(list_distinct(list(label))), '|') AS labels FROM ("
            "SELECT issue_id AS id, label FROM tags WHERE label IN ('quality-1', 'toxic-1') UNION ALL "
            "SELECT id, unnest(['lang-' || lang, 'needs-triage', origin]) FROM docs) GROUP BY id) a ON a.id = r.id "
            "WHERE route IS NOT NULL", "routed", "tags", "docs"),
        "viewer_search_text": _sql(
            f"SELECT {summary} FROM (SELECT * FROM routed WHERE id IN (SELECT issue_id FROM words WHERE term = 'les') "
            "AND id IN (SELECT issue_id FROM words WHERE term = 'des') ORDER BY created_at DESC, id DESC LIMIT 200) r "
            "JOIN alltags a ON a.id = r.id WHERE route IS NOT NULL", "routed", "alltags", "words"),
        "in_link_counts": _sql(
            "SELECT first_id AS target_id, count(*) AS in_links FROM ("
            f"SELECT {tracker_link} AS route FROM (SELECT rtrim(unnest({url_list}), '.,);') AS url FROM linked)) l "
            "JOIN routes r ON r.route = l.route GROUP BY first_id", "linked", "routes"),
        "locked_entities": _sql('SELECT doc_id, idx, kind, value, start, "end" FROM entities', "entities"),
        "entity_stats": _sql(
            "SELECT kind, count(*) AS spans, count(DISTINCT value) AS distinct_values FROM entities GROUP BY kind", "entities"),
        "mask_corpus": _sql(
            "SELECT m.doc_id, CASE WHEN n IS NULL THEN text ELSE masked || text[last + 1 :] END AS masked, coalesce(n, 0) AS n_spans "
            "FROM maskin m LEFT JOIN (SELECT doc_id, count(*) AS n, max(\"end\") AS last, "
            "string_agg(gap || chr(63743) || idx || chr(63742), '' ORDER BY idx) AS masked FROM ("
            "SELECT e.doc_id, idx, \"end\", text[lag(\"end\", 1, 0) OVER (PARTITION BY e.doc_id ORDER BY idx) + 1 : start] AS gap "
            "FROM entities e JOIN maskin x ON x.doc_id = e.doc_id) GROUP BY doc_id) g ON g.doc_id = m.doc_id", "entities"),
        "unmask_corpus": _sql("SELECT doc_id, text AS restored, true AS same FROM maskin", "maskin"),
        "token_counts": (
            "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+')) AS BIGINT) AS tokens FROM documents"),
        "protected_terms": _sql(
            "SELECT doc_id, replace(replace(text, lang, chr(63741) || '0' || chr(63740)), origin, chr(63741) || '1' || chr(63740)) "
            "AS guarded, text AS restored FROM maskin", "maskin"),
        "stream_ingest": _sql(
            "SELECT row_number() OVER (ORDER BY first_arrival) AS id, source, external_key, title, body, status, "
            f"{_STAMP} AS created_at FROM ingested", "ingested"),
        "rejected_deliveries": _sql(
            "SELECT tracker AS source, arrival, CAST(NULL AS VARCHAR) AS body_md5 FROM sent WHERE forged UNION ALL "
            "SELECT 'github', 1000000000000 + 2 * page_id, md5(html) FROM pages UNION ALL "
            "SELECT 'GitHub', 1000000000001 + 2 * page_id, md5('{\"issue\": {\"id\": ' || page_id || '}}') FROM pages", "sent"),
        "embed_jobs": _sql(
            "SELECT row_number() OVER (ORDER BY first_arrival) AS issue_id, false AS force FROM ingested", "ingested"),
        "stream_embed": _sql(
            "SELECT issue_id, CASE WHEN NOT known THEN 'issue_missing' WHEN forced OR NOT stored THEN 'embedded' ELSE 'exists' END "
            "AS status FROM (SELECT issue_id, bool_or(force) AS forced, issue_id IN (SELECT doc_id FROM documents) AS known, "
            "issue_id IN (SELECT vec_id FROM embeddings) AS stored FROM jobs GROUP BY issue_id)", "jobs"),
        "stream_embed_status": _sql(
            "SELECT j.issue_id, force, seq, CASE WHEN j.issue_id NOT IN (SELECT doc_id FROM documents) THEN 'issue_missing' "
            "WHEN force THEN 'embedded' WHEN j.issue_id IN (SELECT vec_id FROM embeddings) OR seq > first_seq THEN 'exists' "
            f"ELSE 'embedded' END AS status FROM jobs j JOIN {job_first} ON f.issue_id = j.issue_id", "jobs"),
        "dead_letter": "SELECT '{\"page\": ' || page_id AS value FROM pages",
    }
    # The stored indexes answer as the searches that read the tables do.
    twins["vector_search_stored"] = twins["vector_search"]
    return twins
