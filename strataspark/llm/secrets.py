"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# kind, pattern, group with the value, least length of the value, a quick test
KINDS = [
    ("assign", ASSIGN, 2, 6, rf"""({KEYWORDS})["']?\x20*[:=]"""),
    ("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
    ("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40, "gh[oprsu]_"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
]
BASE_KINDS = 3
BLOCK = 256
PLACEHOLDER = "(?i)example|changeme|placeholder|dummy|sample|your_|redacted|xxxx"


def _found(text: Column, rank: int) -> Column:
    """Array of ``(start, rank, end, value)`` of one kind.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the
    matches, so their lengths add up to the places, in code points. The sums run in blocks of ``BLOCK`` matches
    from where the block begins, so the work follows the number of matches and not its square.
    """
    kind, pattern, group, least, quick = KINDS[rank]
    if kind == "hex":  # a run that is long enough holds no other match, so short runs need not be listed
        pattern = "[0-9a-f]{24,}"
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    one = F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v"))
    ddl = "array<struct<start:int,rank:int,end:int,value:string>>"
    length = lambda x: F.length(x["b"]) + F.coalesce(F.length(x["w"]), F.lit(0))

    def blocks(rows):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK))
        parts = F.transform(firsts, lambda k: F.slice(rows, k, BLOCK))
        return F.transform(parts, lambda b: F.struct(b.alias("rows"), F.aggregate(b, F.lit(0), lambda n, x: n + length(x)).alias("n")))

    def step(s, x):
        start = s["at"] + F.length(x["b"])
        end = s["at"] + length(x)
        hit = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    def hits(parts):
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["n"])))
        own = lambda z: F.aggregate(z["s"]["rows"], F.struct(z["at"].alias("at"), F.array().cast(ddl).alias("out")), step, lambda s: s["out"])
        return F.flatten(F.transform(F.filter(F.arrays_zip(parts.alias("s"), begins.alias("at")), lambda z: z["s"].isNotNull()), own))

    spans = _let(one, lambda rows: _let(blocks(rows), hits))
    return F.when(text.rlike(quick), spans).otherwise(F.array().cast(ddl))


def _let(value: Column, of) -> Column:
    """``of(value)``, with ``value`` computed once however often it stands inside lambdas."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    owner_col: str = "source",
    wide_owners: int = 3,
) -> DataFrame:
    """One row per input row with its secrets and what the corpus says about their values.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_shared, n_owned, n_live, live_spans``.
    The first kinds are the base ones and the further kinds (GitHub and JSON web tokens) add spans.
    A value held by ``wide_owners`` or more distinct owners, or as many distinct repositories,
    is a widely copied example (``n_shared``); the others are owner-specific (``n_owned``), and
    look live (``n_live``, ``live_spans``) unless they read as a placeholder or have
    under six distinct characters.

    Null text is empty: no span, the digest of the empty string. A null owner or
    repository is one owner or repository of its own. A repeated row is answered
    row by row, and adds no owner. Matches are those of the whole text; a span
    is in code points, its end exclusive. Other columns are not looked at.

    Only hashes of values are aggregated, in two steps (value and owner, then value), so
    one value in a third of all documents leaves a row for each task and owner, and the
    class joins back to the rows that hold a candidate, splittable by adaptive execution. The work in a text
    follows the number of its matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(repo_col), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col), F.lit("")).alias("owner"),
        text.alias("whole"),
        *[_found(text, k).alias(f"f{k}") for k in range(len(KINDS))],
    )
    base = F.array_sort(F.concat(*[F.col(f"f{k}") for k in range(BASE_KINDS)]))
    every = F.array_sort(F.concat(*[F.col(f"f{k}") for k in range(len(KINDS))]))
    scanned = materialise(
        found.select(
            "doc_id", "repo", "owner",
            *[F.size(f"f{k}").cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)],
            F.sha2(_joined(base), 256).alias("base_sha256"),
            F.when(F.size(every) > 0, F.unhex(F.sha2("whole", 256))).alias("row_key"),
            F.transform(every, lambda s: F.struct(
                s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("value_hash"),
                (~s["value"].rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 6)).alias("plausible"),
            )).alias("found"),
        ),
        "secret-spans",
    )
    key = ["doc_id", "repo", "owner", "row_key"]
    held = scanned.filter(F.size("found") > 0).select(*key, F.explode("found").alias("x")).select(*key, "x.*")

    def holders(c: str, n: str) -> DataFrame:
        return held.groupBy("value_hash", c).agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias(n))

    classes = holders("owner", "owners").select("value_hash", (F.col("owners") >= wide_owners).alias("shared"))
    if repo_col != owner_col:
        repos = holders("repo", "repos").withColumnRenamed("value_hash", "__hash")
        both = classes.join(repos, classes["value_hash"] == repos["__hash"])
        classes = both.select("value_hash", (F.col("shared") | (F.col("repos") >= wide_owners)).alias("shared"))
    mark = F.struct("start", "rank", "end")
    judged = (
        held.join(classes, "value_hash")
        .groupBy(*key)
        .agg(
            F.collect_set(F.when(F.col("shared"), mark)).alias("shared"),
            F.collect_set(F.when(~F.col("shared"), mark)).alias("owned"),
            F.array_sort(F.collect_set(F.when(~F.col("shared") & F.col("plausible"), mark))).alias("live"),
        )
        .select(
            *[F.col(k).alias(f"j_{k}") for k in key],
            F.size("shared").alias("n_shared"), F.size("owned").alias("n_owned"), F.size("live").alias("n_live"), _joined(F.col("live")).alias("live_spans"),
        )
    )
    same = [scanned[k].eqNullSafe(judged[f"j_{k}"]) for k in key]
    return scanned.join(judged, same, "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(F.col("found")).alias("spans"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_owned", "n_live")],
        F.coalesce("live_spans", F.lit("")).alias("live_spans"),
    )


def secret_sql(wide_owners: int = 3) -> str:
    """The same scan in DuckDB SQL."""
    parts = []
    for rank, (kind, pattern, group, least, _) in enumerate(KINDS):
        p = ("[0-9a-f]{24,}" if kind == "hex" else pattern).replace("'", "''")
        parts.append(rf"""
SELECT doc_id, source, i, {rank} AS rank, '{kind}' AS kind, w[i] AS hit, v[i] AS val, {least} AS least,
       list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
FROM (SELECT doc_id, source, b, w, v, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, source, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {group}) AS v FROM d))""")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
hits AS (SELECT doc_id, source, rank, kind, val, s, s + length(hit) AS e, kind || ':' || s || ':' || (s + length(hit)) AS span FROM raw WHERE length(val) >= least),
cls AS (SELECT val, count(DISTINCT source) >= {wide_owners} AS shared FROM hits GROUP BY val),
j AS (SELECT h.*, c.shared, NOT c.shared AND NOT regexp_matches(val, '{PLACEHOLDER}') AND len(list_distinct(string_split(val, ''))) >= 6 AS live FROM hits h JOIN cls c USING (val)),
per AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {BASE_KINDS}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans,
         count(*) FILTER (shared) AS n_shared, count(*) FILTER (NOT shared) AS n_owned, count(*) FILTER (live) AS n_live,
         string_agg(span, ',' ORDER BY s, rank) FILTER (live) AS live_spans
  FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_shared, 0) AS n_shared,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN per USING (doc_id)
"""
