"""Secret scans: strong secrets by their shape, and multipart credentials whose weak parts occur together.

Strong kinds are ``assign`` (a keyword given a value of 6 or more signs), ``access`` (an access key id) and ``hex``
(24 or more hexadecimal digits). Weak kinds are candidates only, with names in any case, with words in front
and in quotes: ``weak_access`` (an account name) is reported where a secret stands within ``SCOPE`` code
points, or a bare token and an endpoint do; ``weak_secret`` and ``bare`` (20 or more signs of high entropy without a label) where an
access identifier does and so does an endpoint (an address or a named host). A part is never its own complement: an
``access_key`` names an identifier, and a key is a secret only as a secret, private, account, shared or signing key. Strong parts count as the
complementary part too. Parts meet their neighbours by running ends and starts in a document, which is
an interval join that writes no pairs. The SQL statement keeps the narrower weak kinds of before, and measures from start to
start: it fixes the strong spans, and the linked ones only where both rules agree.

Positions are code points, ends exclusive: a text is split at the matches of a kind, and lengths of what is
between them and of the matches add up. Only DataFrame functions are used. Null texts are empty texts.
Every row is scanned for itself, also rows that repeat an id or have none; equal starts are in the order of
the kinds. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import is_small, saved, table, text_of

#: Code points between the end of a part and the start of the next that belongs to it.
SCOPE = 200

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Any case, and words in front of a name: DB_PASS, aws_secret_access_key, spring.datasource.username. No group is
#: repeated and up to 64 signs are looked at, so a run of any number of words takes linear time and no deep stack; of a
#: longer run the span holds the last words.
_NAME = r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9][A-Za-z0-9_.-]{0,62}[_.-])?"
#: Kind, pattern, group whose length counts, least length of it. Strong kinds first.
PATTERNS = [
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + _VALUE, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("weak_access", _NAME + r"(user|user[_-]?name|user[_-]?id|login|account|account[_-]?(?:name|id)|client[_-]?id|access[_-]?key[_-]?id|key[_-]?id|(?<!secret[_-]?)access[_-]?key)" + _VALUE, 2, 3),
    ("weak_secret", _NAME + r"(pwd|pass|pass[_-]?phrase|(?:secret|private|account|shared|signing)[_-]?(?:access[_-]?)?key|auth|credentials?)" + _VALUE, 2, 6),
    ("endpoint", _NAME + r"""(?:(?:host|host[_-]?name|server|endpoint)(?:["']?\x20*[:=]|/)\x20*["']?|[a-z][a-z0-9+.-]{0,30}://)([A-Za-z0-9.-]+)""", 1, 3),
    ("bare", r"(?<![A-Za-z0-9+/_=-])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
]
#: Weak kinds as the SQL statement has them: narrower, without name prefixes, other cases, quoted endpoint keys and bare tokens.
STATEMENT_PATTERNS = PATTERNS[:3] + [
    ("weak_access", r"\b(user|username|login|account|client_id|access_key_id|key_id)" + _VALUE, 2, 3),
    ("weak_secret", r"\b(pwd|pass|key|auth|credential)" + _VALUE, 2, 6),
    ("endpoint", r"\b(host|server|endpoint|[a-z][a-z0-9+.-]*:/)[:=/]\x20*([A-Za-z0-9.-]+)", 2, 3),
]
#: Least entropy of a bare token, in bits a sign.
ENTROPY = 3.5
KINDS = [kind for kind, *_ in PATTERNS]
STRONG = KINDS[:3]

_SPANS = "array<struct<start: bigint, kind: int, stop: bigint>>"


def _spans(number: int) -> Column:
    """Spans of a kind in ``_text``, in order."""
    _, pattern, group, least = PATTERNS[number]
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    few = f"length(x.`2`) < {least}"
    if KINDS[number] == "bare":
        share = "((length(x.`2`) - length(replace(x.`2`, c, ''))) / length(x.`2`))"
        few += f" OR aggregate(array_distinct(split(x.`2`, '')), 0D, (e, c) -> e - CASE WHEN c = '' THEN 0D ELSE {share} * log2({share}) END) < {ENTROPY}"
    return F.expr(f"""
      transform(array(split(_text, {quoted}, -1)), between -> CASE WHEN size(between) = 1 THEN cast(array() AS {_SPANS}) ELSE
        aggregate(
          arrays_zip(slice(between, 1, size(between) - 1), regexp_extract_all(_text, {quoted}, 0), regexp_extract_all(_text, {quoted}, {group})),
          cast(named_struct('at', 0L, 'spans', array()) AS struct<at: bigint, spans: {_SPANS}>),
          (s, x) -> named_struct(
            'at', s.at + length(x.`0`) + length(x.`1`),
            'spans', CASE WHEN {few} THEN s.spans ELSE
              array_append(s.spans, named_struct('start', s.at + length(x.`0`), 'kind', {number}, 'stop', s.at + length(x.`0`) + length(x.`1`))) END),
          s -> s.spans) END)[0]""")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def found_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, doc_id, strong and weak spans of every document, written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("doc_id"), text_of(text).alias("_text"))
    spans = [_spans(n).alias(kind) for n, kind in enumerate(KINDS)]
    rows = rows.select("_row", "doc_id", *spans)
    joined = lambda kinds: F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))) for k in kinds])
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in STRONG]
    return saved(rows.select("_row", "doc_id", *counts, joined(STRONG).alias("strong"), joined(KINDS[3:]).alias("weak")))


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_row and the weak spans that complementary parts stand by."""
    parts = found.where(F.size("weak") > 0).select("_row", F.explode(F.concat("strong", "weak")).alias("part")).select("_row", "part.*")
    # Running values over the parts that start no later, and over those that start no earlier.
    until = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    is_kind = lambda *kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    sides = {"id": ("access", "weak_access"), "secret": ("assign", "hex", "weak_secret"), "place": ("endpoint",), "bare": ("bare",)}
    # A bare token within a part of another kind is that part's value.
    of_others = F.max(F.when(~is_kind("bare"), F.col("stop"))).over(until)
    parts = parts.select("*", of_others.alias("_others")).where(~is_kind("bare") | F.col("_others").isNull() | (F.col("_others") <= F.col("start"))).drop("_others")
    last = [F.max(F.when(is_kind(*kinds), F.col("stop"))).over(until).alias(f"{side}_stop") for side, kinds in sides.items()]
    next_ = [F.min(F.when(is_kind(*kinds), F.col("start"))).over(since).alias(f"{side}_start") for side, kinds in sides.items()]
    met = parts.select("*", *last, *next_)
    by = {side: F.coalesce(F.col(f"{side}_stop") >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.col(f"{side}_start") <= F.col("stop") + scope, F.lit(False)) for side in sides}
    kept = met.where((is_kind("weak_access") & (by["secret"] | by["bare"] & by["place"])) | (is_kind("weak_secret", "bare") & by["id"] & by["place"]))
    return kept.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("linked"))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, strong (spans), linked (spans of weak parts that belong together)."""
    found = found_parts(docs, key, text)
    linked = saved(linked_parts(found, scope))
    out = found.join(F.broadcast(linked) if is_small(linked) else linked, "_row", "left")
    return out.select("doc_id", *[f"n_{k}" for k in STRONG], "strong", F.coalesce("linked", F.expr(f"cast(array() AS {_SPANS})")).alias("linked"))


QUERY = "op1_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in STRONG],
        F.sha2(_listed(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("strong", "linked")).alias("spans"),
    )


def _statement() -> str:
    """The same spans in DuckDB, one row per match; repeated rows are told apart by a row number."""
    kinds = []
    for number, (kind, pattern, group, least) in enumerate(STATEMENT_PATTERNS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"""
          SELECT row_id, {number} AS no, '{kind}' AS kind,
                 list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start_at,
                 length(hits[i]) AS width, length(vals[i]) AS size
          FROM (SELECT row_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i
                FROM (SELECT row_id, string_split_regex(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}, 0) AS hits,
                             regexp_extract_all(text, {quoted}, {group}) AS vals FROM texts))
          WHERE length(vals[i]) >= {least}""")
    strong = "'" + "', '".join(STRONG) + "'"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (SELECT row_id, no, kind, start_at::BIGINT AS start_at, kind || ':' || start_at::BIGINT || ':' || (start_at + width)::BIGINT AS span FROM ({" UNION ALL ".join(kinds)})),
    met AS (
      SELECT *, bool_or(kind IN ('access', 'weak_access')) OVER near AS id, bool_or(kind IN ('assign', 'hex', 'weak_secret')) OVER near AS secret,
             bool_or(kind = 'endpoint') OVER near AS place
      FROM parts WINDOW near AS (PARTITION BY row_id ORDER BY start_at RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
    kept AS (SELECT * FROM met WHERE kind IN ({strong}) OR (kind = 'weak_access' AND secret) OR (kind = 'weak_secret' AND id AND place))
    SELECT any_value(t.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           sha256(coalesce(string_agg(span, ',' ORDER BY start_at, no) FILTER (kind IN ({strong})), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start_at, no), '') AS spans
    FROM texts t LEFT JOIN kept k ON t.row_id = k.row_id GROUP BY t.row_id
    """


STATEMENT = _statement()
