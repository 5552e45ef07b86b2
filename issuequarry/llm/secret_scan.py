"""Secret scans with multipart credential linking, in SQL functions only.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak candidates are reported only
where the parts of a credential meet: an identifier (a user, client or key name) or an endpoint (an address with a
scheme or a port) with a secret (a short assigned value, or a long run of letters and digits). Parts meet when at most
``REACH`` characters lie between them and no blank line does, which is the scope of one configuration block or one
paragraph. An address with a name and a password in it holds all its parts and needs no partner. A weak candidate that
overlaps a strong one, or a secret that overlaps an identifier or endpoint, is no candidate of its own.

Each text is read once, row by row, for the places of all patterns; from then on only these narrow rows travel.
Positions are running sums over one document's matches. The interval join meets on (document, scope, stretch of
``BIN`` characters): a part covers the stretches it can reach, so one long document is spread over many keys, the rows
of a key are bounded by what fits into a stretch, and a semi join emits each candidate once at most.

Defined results: a null or empty text has no spans. Repeated rows and null ids are rows of their own. Very long texts
are read row by row; their matches become rows. An empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuequarry.llm.common import texts_of
from issuequarry.session import checkpointed

#: Characters that may lie between the parts of one credential, and the stretch of text that is one key of the join.
REACH = 200
BIN = 512
#: Least characters of a strong assigned value, and of a weak one.
STRONG_VALUE, WEAK_VALUE = 6, 4

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ASSIGN, _ACCESS, _HEX, _IDENTIFIER, _SECRET, _ENDPOINT, _GAP = range(7)


def _either(words: str) -> str:
    """A pattern whose ASCII letters match in either case, in every engine alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
_SCHEMES = "https?|ftps?|sftp|ssh|git|ldaps?|amqps?|redis|mongodb|mysql|postgres|postgresql|jdbc:[a-z]{2,12}"

#: One pattern per kind, and blank lines last. Runs of hex digits and access names are whole runs, so their least
#: length may stand in the pattern; an assignment is taken whole and judged afterwards.
PATTERNS = (
    f"({_either('password|passwd|secret|token|api_?key')}){_SET}({_VALUE}+)",
    "AKIA[A-Z0-9]{16,}",
    "[0-9a-f]{24,}",
    f"{_either('(user|username|login|account|account_?id|client_?id|access_?id|access_?key_?id|key_?id)')}{_SET}[A-Za-z0-9+/_.@=-]{{3,}}|A(SIA|IDA|ROA)[A-Z0-9]{{12,}}",
    f"{_either('(pass|pwd|auth|credential|private_?key)')}{_SET}{_VALUE}{{{WEAK_VALUE},}}|[A-Za-z0-9+/_=-]{{16,}}",
    f"({_SCHEMES})://[A-Za-z0-9._~%@:/?&=+-]+|[A-Za-z0-9-]{{1,63}}([.][A-Za-z0-9-]{{1,63}}){{1,8}}:[0-9]{{2,5}}",
    r"\n[\x20\t\r]*\n",
)
#: How a weak secret begins that has a name.
_KEYED = f"^{_either('(pass|pwd|auth|credential|private)')}"
#: An address that holds a name and a password.
_COMPLETE = "://[^/@:]+:[^/@]+@"
#: Overlaps are settled in this order: strong kinds, identifiers, endpoints, secrets.
_RANK = {_ASSIGN: 0, _ACCESS: 0, _HEX: 0, _IDENTIFIER: 1, _ENDPOINT: 2, _SECRET: 3}


def _fits(kind: int, hit: Column) -> Column:
    """What a match is: 2 strong or complete, 1 a weak candidate, 0 nothing."""
    if kind == _ASSIGN:
        size = F.length(F.regexp_extract(hit, PATTERNS[_ASSIGN], 2))
        return F.when(size >= STRONG_VALUE, 2).when(size >= WEAK_VALUE, 1).otherwise(0)
    if kind == _SECRET:
        keyed = hit.rlike("[:=].") & hit.rlike(_KEYED)
        mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
        return F.when(keyed | mixed, 1).otherwise(0)
    if kind == _ENDPOINT:
        return F.when(hit.rlike(_COMPLETE), 2).otherwise(1)
    return F.lit(1 if kind == _IDENTIFIER else 2)


def _possible(text: Column, kind: int) -> Column:
    """A cheap condition that every text with a match of this kind meets, read off the pattern."""
    sets = text.contains(":") | text.contains("=")
    return {
        _ASSIGN: sets,
        _ACCESS: text.contains("AKIA"),
        _IDENTIFIER: sets | text.contains("ASIA") | text.contains("AIDA") | text.contains("AROA"),
        _SECRET: sets | text.rlike("[0-9]"),
        _ENDPOINT: text.contains(":"),
    }.get(kind, F.lit(True))


def _hits(text: Column, kind: int) -> Column:
    """The matches of one kind: their number, the characters before each since the last one, their size and what they are."""
    pattern = F.lit(PATTERNS[kind])
    pieces = F.array(F.split(text, PATTERNS[kind], -1))
    one = F.element_at(F.transform(pieces, lambda between: F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda hit, at: F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), F.length(F.get(between, at)).alias("before"),
            F.length(hit).alias("size"), _fits(kind, hit).cast("int").alias("fit"),
        ),
    )), 1)
    none = F.array().cast("array<struct<kind:int,at:int,before:int,size:int,fit:int>>")
    return F.when(_possible(text, kind) & text.rlike(PATTERNS[kind]), one).otherwise(none)


def found(docs: DataFrame) -> DataFrame:
    """key, doc_id and the matches of every row. Blank lines are looked up only where weak candidates may need them."""
    text = F.coalesce("text", F.lit(""))
    base = texts_of(docs).select(F.monotonically_increasing_id().alias("key"), "doc_id", text.alias("text"))
    hits = base.select("key", "doc_id", "text", *[_hits(F.col("text"), kind).alias(name) for kind, name in enumerate(KINDS)])
    strong, weak = F.concat(*KINDS[:3]), F.concat(*KINDS[3:])
    gaps = F.when((F.size("secret") > 0) | (F.size("identifier") > 0) | (F.size("endpoint") > 0) | (F.size("assign") > 0), _hits(F.col("text"), _GAP))
    return hits.select("key", "doc_id", F.concat(strong, weak, F.coalesce(gaps, F.array().cast(hits.schema["assign"].dataType))).alias("hits"))


def located(matches: DataFrame) -> DataFrame:
    """Parts with their places: key, kind, start, end, fit, scope. Failing matches and overlapped candidates are gone."""
    rows = matches.select("key", F.explode("hits").alias("h")).select("key", "h.*")
    run = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.col("size")).over(run)
    placed = rows.select("key", "kind", "fit", end.alias("end"), "size").select(
        "key", "fit", (F.col("end") - F.col("size")).alias("start"), "end",
        # An assigned value too short for a strong match is a weak secret.
        F.when((F.col("kind") == _ASSIGN) & (F.col("fit") == 1), _SECRET).otherwise(F.col("kind")).alias("kind"),
    ).filter("fit > 0")
    rank = F.lit(9)
    for kind, value in _RANK.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    ranked = placed.withColumn("rank", rank)
    before = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = [F.coalesce(F.max(F.when(F.col("rank") < r, F.col("end"))).over(before), F.lit(-1)) for r in (1, 2, 3)]
    starts = [F.min(F.when(F.col("rank") < r, F.col("start"))).over(after) for r in (1, 2, 3)]
    seen = ranked.select(
        "*", F.count(F.when(F.col("kind") == _GAP, 1)).over(before).alias("scope"),
        *[x.alias(f"end{r}") for r, x in enumerate(ends, 1)], *[x.alias(f"start{r}") for r, x in enumerate(starts, 1)],
    )
    overlapped = F.lit(False)
    for r in (1, 2, 3):
        higher = (F.col(f"end{r}") > F.col("start")) | F.coalesce(F.col(f"start{r}") < F.col("end"), F.lit(False))
        overlapped = overlapped | ((F.col("rank") == r) & higher)
    return seen.filter((F.col("kind") != _GAP) & ~overlapped).select("key", "kind", "start", "end", "fit", "scope")


def _stretches(low: Column, high: Column) -> Column:
    """The stretches of ``BIN`` characters that the places from ``low`` to ``high`` lie in."""
    return F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))


def linked(parts: DataFrame) -> DataFrame:
    """Weak candidates with a complementary part in reach: key, kind, start, end.

    Secrets are completed by identifiers and endpoints, and these by secrets; strong parts complete weak ones too.
    """
    is_secret = F.col("kind").isin(_ASSIGN, _HEX, _SECRET)
    weak = (F.col("kind") > _HEX) & (F.col("fit") == 1)
    asking = parts.filter(weak).select(
        "key", "kind", "start", "end", "scope", (~is_secret).alias("wants"), _stretches(F.col("start"), F.col("end")).alias("bin"),
    )
    reach = F.lit(REACH)
    giving = parts.select(
        "key", "scope", is_secret.alias("wants"), F.col("start").alias("low"), F.col("end").alias("high"),
        _stretches(F.col("start") - reach, F.col("end") + reach).alias("bin"),
    )
    a, g = asking.alias("a"), giving.alias("g")
    same = [F.col(f"a.{c}") == F.col(f"g.{c}") for c in ("key", "scope", "wants", "bin")]
    near = (F.col("g.low") <= F.col("a.end") + reach) & (F.col("a.start") <= F.col("g.high") + reach)
    met = a.join(g, [*same, near], "left_semi")
    return met.select("key", "kind", "start", "end").distinct()


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its spans (kind number, start, end; code points, end exclusive) by start, then kind."""
    matches = checkpointed(found(docs), "secret-matches")
    parts = checkpointed(located(matches.filter(F.size("hits") > 0)), "secret-parts")
    sure = parts.filter("fit = 2").select("key", "kind", "start", "end")
    spans = sure.unionByName(linked(parts)).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    ).withColumnRenamed("key", "_key")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return matches.select("key", "doc_id").join(spans, F.col("key") == F.col("_key"), "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans")
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(rows: DataFrame) -> DataFrame:
    """Counts of the strong kinds, the hash of their spans, and all spans as text."""
    def of_kind(kind: int) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] <= _HEX)
    counted = [F.size(of_kind(kind)).cast("bigint").alias(f"n_{KINDS[kind]}") for kind in (_ASSIGN, _ACCESS, _HEX)]
    return rows.select("doc_id", *counted, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB twin of ``digest(secrets(documents))``; links are looked up document by document."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    pats = [quoted(p) for p in PATTERNS]
    fits = {
        _ASSIGN: f"CASE WHEN length(regexp_extract(h, {pats[_ASSIGN]}, 2)) >= {STRONG_VALUE} THEN 2 "
                 f"WHEN length(regexp_extract(h, {pats[_ASSIGN]}, 2)) >= {WEAK_VALUE} THEN 1 ELSE 0 END",
        _SECRET: f"CASE WHEN regexp_matches(h, '[:=].') AND regexp_matches(h, '{_KEYED}') "
                 "OR regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Za-z]') THEN 1 ELSE 0 END",
        _ENDPOINT: f"CASE WHEN regexp_matches(h, '{_COMPLETE}') THEN 2 ELSE 1 END",
        _IDENTIFIER: "1",
    }
    each = " UNION ALL ".join(
        f"SELECT r, {kind} AS kind, pos, length(b) AS before, length(h) AS size, {fits.get(kind, '2')} AS fit FROM ("
        f"SELECT r, generate_subscripts(hs, 1) AS pos, unnest(hs) AS h, unnest(bs[1 : len(hs)]) AS b FROM ("
        f"SELECT r, regexp_extract_all(text, {p}) AS hs, string_split_regex(text, {p}) AS bs FROM t WHERE regexp_matches(text, {p})))"
        for kind, p in enumerate(pats)
    )
    rank = "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RANK.items()) + " ELSE 9 END"
    windows = ", ".join(
        f"max(CASE WHEN rank < {r} THEN e END) OVER a AS e{r}, min(CASE WHEN rank < {r} THEN s END) OVER b AS s{r}" for r in (1, 2, 3)
    )
    overlap = " OR ".join(f"rank = {r} AND (coalesce(e{r}, -1) > s OR coalesce(s{r} < e, false))" for r in (1, 2, 3))
    names = "[" + ", ".join(quoted(k) for k in KINDS) + "]"

    def spans(which: str) -> str:
        return f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e){which}, '')"

    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({each}),
p AS (SELECT r, kind, fit, size, sum(before + size) OVER (PARTITION BY r, kind ORDER BY pos) AS e FROM m),
q AS (SELECT r, CASE WHEN kind = {_ASSIGN} AND fit = 1 THEN {_SECRET} ELSE kind END AS kind, fit, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e
  FROM p WHERE fit > 0),
k AS (SELECT *, {rank} AS rank FROM q),
w AS (SELECT *, count(*) FILTER (kind = {_GAP}) OVER a AS scope, {windows} FROM k
  WINDOW a AS (PARTITION BY r ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY r ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS MATERIALIZED (SELECT r, kind, s, e, fit, scope, kind IN ({_ASSIGN}, {_HEX}, {_SECRET}) AS secret FROM w
  WHERE kind <> {_GAP} AND NOT ({overlap})),
f AS (SELECT r, kind, s, e FROM c WHERE fit = 2 UNION ALL
  SELECT DISTINCT r, kind, s, e FROM c WHERE fit = 1 AND kind > {_HEX} AND EXISTS (
    SELECT 1 FROM c g WHERE g.r = c.r AND g.scope = c.scope AND g.secret <> c.secret AND g.s <= c.e + {REACH} AND c.s <= g.e + {REACH}))
SELECT any_value(doc_id) AS doc_id,
  count(*) FILTER (kind = {_ASSIGN}) AS n_assign, count(*) FILTER (kind = {_ACCESS}) AS n_access, count(*) FILTER (kind = {_HEX}) AS n_hex,
  sha256({spans(f" FILTER (kind <= {_HEX})")}) AS base_sha256, {spans(" FILTER (kind IS NOT NULL)")} AS spans
FROM t LEFT JOIN f USING (r) GROUP BY r
"""
