"""The given tables read as an issue tracker's data.

Every view is a projection or an equi-join of whole tables, so it grows with
them. The language of a document decides which optional parts its payload has,
which exercises the fallbacks of the projections. The SQL twins of these views
are in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.functions.instants import run_timestamp

RUN_ISO = "2025-01-01T00:00:00"
SECRET = "secret"
JIRA_BASE_URL = "https://tracker.example.net"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_ts() -> Column:
    return run_timestamp(RUN_ISO)


def stamp(col: str) -> Column:
    """Text form of a timestamp, the same in every engine."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def _lang(*pairs: tuple[str, Column | str]) -> Column:
    """Value by language; languages not named get null."""
    out = None
    for lang, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        out = (F if out is None else out).when(F.col("lang") == lang, value)
    return out


def _typed(df: DataFrame) -> DataFrame:
    doc, src = F.col("doc_id"), F.col("source")
    github = doc % 2 == 0
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 525600 as int), 0)")
    status = F.element_at(F.array(F.lit("Open"), F.lit("In Progress"), F.lit("Closed")), (doc % 3 + 1).cast("int"))
    return df.select(
        doc.alias("id"), F.when(github, "github").otherwise("jira").alias("tracker"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang",
        src.alias("origin"), F.upper(src).alias("proj"), status.alias("status"), created.alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _iso(suffix: Column) -> Column:
    return F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), suffix)


def _raw_json(with_comments: bool) -> Column:
    idt = F.col("id").cast("string")
    github = F.col("tracker") == "github"
    org = F.concat(F.lit("org/"), F.col("origin"))
    site = _lang(
        ("en", "https://ENsite.atlassian.net/rest/api/2/issue/1"), ("de", "https://user@de.example.org:8443/browse/x")
    )
    fields = F.struct(F.when(F.col("lang") == "de", F.parse_json(F.lit('{"value":" Low "}'))).alias("priority"))
    issue = F.struct(
        F.when(github, F.col("id")).alias("number"),
        F.when(~github, F.concat("proj", F.lit("-"), idt)).alias("key"),
        F.when(github & (F.col("lang") == "en"), F.concat(F.lit("https://github.com/"), org, F.lit("/issues/"), idt))
        .alias("html_url"),
        F.when(~github & (F.col("lang") == "en"), site).alias("self"),
        F.when(~github & (F.col("lang") == "de"), site).alias("url"),
        fields.alias("fields"),
    )
    generation = F.when(
        F.col("lang") == "de", F.struct(F.lit("g7").alias("seed"), F.lit("2024-02-02").alias("timestamp"))
    )
    listed = F.array(
        F.to_variant_object(F.struct(F.concat(F.lit("lang-"), "lang").alias("name"))),
        F.parse_json(F.lit('" needs-triage "')),
        F.to_variant_object(F.struct(F.col("origin").alias("label"))),
        F.parse_json(F.lit('""')),
    )
    parts = [
        issue.alias("issue"),
        F.when(github & (F.col("lang") == "de"), F.struct(org.alias("full_name"))).alias("repository"),
        F.when(~github & (F.col("lang") == "fr"), F.lit("frsite")).alias("site"),
        F.coalesce(_lang(
            ("en", F.parse_json(F.lit('{"name":"High"}'))), ("fr", F.parse_json(F.lit('" Medium "')))
        )).alias("priority"),
        listed.alias("labels"),
        _lang(("en", F.parse_json(F.lit("42"))), ("fr", F.parse_json(F.lit('"demo"')))).alias("seed"),
        generation.alias("generation"),
        _lang(("en", "2024-05-01T00:00:00Z")).alias("generatedAt"),
        _lang(("es", "2024-03-03")).alias("createdAt"),
    ]
    if with_comments:
        parts.append(F.transform(F.split("body", "\n"), lambda line: F.struct(
            F.struct(F.col("lang").alias("login")).alias("user"), line.alias("body"),
            _iso(F.lit("+02:00")).alias("created"),
        )).alias("comments"))
    return F.to_json(F.struct(*parts))


def issues(spark: SparkSession, sf_dir: str, with_comments: bool = False) -> DataFrame:
    """The issues table; with comments, every line of the text is one."""
    github, lang = F.col("tracker") == "github", F.col("lang")
    idt = F.col("id").cast("string")
    slug = F.when(lang == "es", F.col("origin")).otherwise(F.concat(F.lit("org/"), F.col("origin")))
    key = F.when(github & (lang == "de"), idt).when(github, F.concat(slug, F.lit("#"), idt)).otherwise(
        F.concat("proj", F.lit("-"), idt)
    )
    return documents(spark, sf_dir).select(
        "id", F.col("tracker").alias("source"), key.alias("external_key"), "title", "body",
        F.when(github & (lang != "de"), slug).alias("repo"),
        F.when(~github & (lang != "es"), F.col("proj")).alias("project"),
        "status", "created_at", _raw_json(with_comments).alias("raw_json"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 0, cast(vec_id % 525600 as int), 0)")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("issue_id"), "embedding",
        F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), stamped.alias("updated_at"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(
        F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string"))
    )
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("issue_id"), F.explode(names).alias("label"), F.lit("triage").alias("source"),
        F.lit(False).alias("approved"), run_ts().alias("ts"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts, each with the vector of the same id."""
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"),
    )
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return texts.join(v, "query_id").withColumn("alpha", F.lit(0.5))


def github_payloads(spark: SparkSession, sf_dir: str, state: Column | str = "open") -> DataFrame:
    """One repository-tracker payload per document (id, lang, body)."""
    lang = F.col("lang")
    state = F.lit(state) if isinstance(state, str) else state
    full = F.struct(F.concat(F.lit("org/"), "origin").alias("full_name"))
    plain = F.struct(
        (F.col("id") + 1).alias("id"), F.when(lang != "fr", F.col("id")).alias("number"), F.col("title").alias("title"),
        F.when(lang != "es", F.col("body")).alias("body"), state.alias("state"),
        F.when(lang != "es", _iso(F.when(lang == "en", "Z").otherwise("+05:30"))).alias("created_at"),
    )
    pull = F.struct(F.col("id").alias("number"), F.struct("title", "body").alias("pull_request"), full.alias("repository"))
    body = (
        F.when(lang == "es", F.to_json(plain)).when(lang == "de", F.to_json(pull))
        .otherwise(F.to_json(F.struct(plain.alias("issue"), full.alias("repository"))))
    )
    return documents(spark, sf_dir).withColumn("payload_body", body)


def jira_payloads(spark: SparkSession, sf_dir: str, state: Column | str = "To Do") -> DataFrame:
    lang = F.col("lang")
    state = F.lit(state) if isinstance(state, str) else state
    fields = F.struct(
        F.col("title").alias("summary"), F.when(lang != "de", F.col("body")).alias("description"),
        F.when(lang != "es", F.struct(F.col("proj").alias("key"))).alias("project"),
        F.when(lang != "de", F.struct(state.alias("name"))).alias("status"),
        _iso(F.when(lang == "en", ".000+0530").when(lang == "fr", "z").when(lang == "de", "").otherwise(" later"))
        .alias("created"),
    )
    issue = F.struct(
        F.col("id").cast("string").alias("id"),
        F.when(lang != "fr", F.concat("proj", F.lit("-"), F.col("id").cast("string"))).alias("key"), fields.alias("fields"),
    )
    body = F.when(lang == "es", F.to_json(issue)).otherwise(F.to_json(F.struct(issue.alias("issue"))))
    return documents(spark, sf_dir).withColumn("payload_body", body)


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive line per document (id, flavor, value)."""
    lang = F.col("lang")
    number = _lang(
        ("en", F.parse_json(F.col("id").cast("string"))),
        ("fr", F.parse_json(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"')))),
        ("es", F.parse_json(F.col("id").cast("string"))),
    )
    to = "array<struct<to:string>>"
    transitions = _lang(
        ("en", F.array(F.struct(F.lit("Open").alias("to")), F.struct(F.lit("Closed").alias("to")))),
        ("fr", F.array().cast(to)), ("de", F.array(F.struct(F.lit("").alias("to")))),
    )
    record = F.struct(
        F.when(lang != "de", F.concat(F.lit("rec-"), F.col("id").cast("string"))).alias("id"), number.alias("number"),
        F.when(lang != "es", F.concat(F.lit("org/"), "origin")).alias("repo"),
        F.when(lang != "es", F.col("proj")).alias("projectKey"), "title", "body",
        _iso(F.lit("Z")).alias("createdAt"), transitions.alias("transitions"),
        F.array(lang, F.lit(" shared "), F.lit(" ")).alias("labels"),
    )
    return documents(spark, sf_dir).select("id", "lang", F.col("tracker").alias("flavor"), F.to_json(record).alias("value"))


def _signature(body: Column) -> Column:
    """HMAC-SHA256 composed of hash built-ins: a second way to sign, for made-up secrets only."""
    block = SECRET.encode().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, digest), 256))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries: one per document, a second one for those of good quality.

    Deliveries of documents labelled toxic carry a wrong signature.
    """
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    github = F.col("tracker") == "github"
    event = _lang(("en", "issues"), ("fr", "issue_comment"), ("de", "pull_request"), ("es", "push"))

    def sent(state: str, late: int) -> DataFrame:
        g = github_payloads(spark, sf_dir, state).filter(github)
        j = jira_payloads(spark, sf_dir, state).filter(~github)
        return g.unionByName(j).withColumn("arrival", F.col("id") * 2 + late)

    first = sent("open", 0).join(verdicts, "id", "left")
    second = sent("closed", 1).join(verdicts.filter("quality = 1"), "id")
    both = first.unionByName(second)
    forged = F.coalesce(F.col("toxic") == 1, F.lit(False))
    body = F.col("payload_body")
    headers = F.when(github, F.create_map(
        F.lit("X-GitHub-Event"), event,
        F.lit("X-Hub-Signature-256"), F.when(forged, F.lit("sha256=bad")).otherwise(_signature(body)),
    )).otherwise(F.create_map(
        F.lit("X-Atlassian-Webhook-Identifier"), F.when(forged, F.lit("wrong")).otherwise(F.lit(SECRET)),
    ))
    return both.select(F.col("tracker").alias("source"), headers.alias("headers"), body.alias("body"), "arrival")


def stray_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries per page that hold no issue: its markup, rightly signed, and a payload of an unknown source."""
    page, pages = F.col("page_id"), table(spark, sf_dir, "pages").select("page_id", "html")
    headers = F.create_map(F.lit("X-GitHub-Event"), F.lit("issues"), F.lit("X-Hub-Signature-256"), _signature(F.col("body")))
    at = F.lit(10**12) + page * 2
    markup = pages.select(F.lit("github").alias("source"), F.col("html").alias("body"), at.alias("arrival"))
    payload = F.concat(F.lit('{"issue": {"id": '), page.cast("string"), F.lit("}}"))
    unknown = pages.select(F.lit("GitHub").alias("source"), payload.alias("body"), (at + 1).alias("arrival"))
    return markup.unionByName(unknown).select("source", headers.alias("headers"), "body", "arrival")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding jobs in event order: view events name the issue in their properties."""
    named = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", named).otherwise(F.col("event_id")).alias("issue_id"),
        (F.col("event_type") == "error").alias("force"), F.col("event_id").alias("seq"),
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("approval_id"),
        F.when(kind == "view", F.get_json_object("props", "$.k").cast("bigint")).otherwise(F.col("event_id")).alias("issue_id"),
        F.when(kind == "view", F.array().cast("array<string>")).otherwise(F.array(kind)).alias("labels"),
        F.when(kind.isin("purchase", "signup", "view"), F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("assignee"),
        F.when(kind.isin("error", "click"), F.col("props")).alias("comment"),
        F.when(kind == "signup", "jira").when(kind == "click", "github").alias("source"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates: the lowest id of a cluster is the original of all its others."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    originals = e.groupBy("label").agg(F.min("vec_id").alias("original"))
    return e.join(originals, "label").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") != F.col("original"), F.col("original")).alias("duplicate_of")
    )


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, each followed by links to itself and to its page's URL."""
    idt = F.col("id").cast("string")
    link = F.when(
        F.col("tracker") == "github", F.concat(F.lit("https://github.com/org/"), "origin", F.lit("/issues/"), idt)
    ).otherwise(F.concat(F.lit("https://sandbox.atlassian.net/browse/"), "proj", F.lit("-"), idt, F.lit("?x=1")))
    text = F.concat(F.col("body"), F.lit("\n\nSee "), link, F.lit("). And https://example.com/docs/"), idt, F.lit("."))
    return documents(spark, sf_dir).select("id", text.alias("body"))


def masked_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, each followed by protected things made from its own columns."""
    idt = F.col("id").cast("string")
    tail = F.concat(
        F.lit("\nFailed with "), F.initcap("origin"), F.lit("Error in `run "), idt, F.lit("` at https://example.com/"), idt,
        F.lit(" see ./src/"), F.col("origin"), F.lit(".py or org/"), F.col("origin"), F.lit(" "), F.col("proj"), F.lit("-"), idt,
        F.lit(" since v1.2.3 on 2024-01-02T03:04:05Z"),
    )
    return documents(spark, sf_dir).select(
        F.col("id").alias("doc_id"), F.concat("body", tail).alias("text"), F.array("lang", "origin").alias("terms")
    )

