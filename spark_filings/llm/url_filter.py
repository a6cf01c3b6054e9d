"""URL filter: hashed host-suffix and path-prefix expressions against rules.

Each URL is expanded into the suffixes of its host and the directory prefixes
of its path.  The short prefix of each expression's SHA-256 is equi-joined with
the rules; a match is then confirmed by the full digest and by the rest of the
rule's path, and the longest rule decides.

Only built-in expressions run.  Repeated (id, url) rows are aggregated before
anything is expanded and come back as often as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, column, table

#: Hex digits of a digest that the equi-join compares.
PREFIX_DIGITS = 8

#: Up to so many rule rows are broadcast; beyond it both sides are shuffled and salted.
BROADCAST_RULES = 100_000
SALTS = 16

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty if there is no host part."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _directory(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def _expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """host-suffix + directory prefix, as no rule is deeper than `labels` and `depth`."""
    parts = F.split(host, r"\.", -1)
    n = F.least(F.size(parts), F.lit(labels))
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    steps = F.split(path, "/", -1)
    m = F.least(F.size(steps) - 1, F.lit(depth))
    none = F.array().cast("array<string>")
    dirs = F.when(m < 1, none).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")))
    )
    dirs = F.array_union(F.array(F.lit("")), dirs)
    return F.flatten(F.transform(hosts, lambda h: F.transform(dirs, lambda d: F.concat(h, F.lit("\n"), d))))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rows: int = BROADCAST_RULES,
) -> DataFrame:
    """Return (id_col, host, path, rule, verdict), a row for each row of `pages`.

    `rules` has (host, path, verdict).  A rule fits its host and all subdomains
    if the url's path starts with the rule's path.  The longest rule (host and
    path together) wins; among equally long ones the longer host, then `allow`.
    A url that no rule fits gets `default`: the lookup found nothing against it.

    Null url, or one without `://`: host and path are empty, rule is null and
    the verdict is `default`.  A null id stays null.  Rules with a null host or
    path are ignored, as are other columns of either table.  An empty table
    gives an empty result; no rules give `default` throughout.
    """
    listed = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv")).where("_rh is not null and _rp is not null").distinct()
    # No expression deeper than the deepest rule can match, so URLs are expanded no further.
    labels, depth, n_rules = listed.agg(
        F.max(F.size(F.split("_rh", r"\.", -1))), F.max(F.size(F.split("_rp", "/", -1))), F.count("*")
    ).first()
    keyed = listed.withColumn("_digest", F.sha2(F.concat("_rh", F.lit("\n"), _directory(F.col("_rp"))), 256))
    keyed = keyed.withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))

    rows = pages.select(column(id_col).alias("_id"), column(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_host", F.coalesce(url_host(F.col("_url")), F.lit(""))).withColumn("_path", F.coalesce(url_path(F.col("_url")), F.lit("")))
    terms = rows.withColumn("_term", F.explode_outer(_expressions(F.col("_host"), F.col("_path"), labels or 1, max((depth or 1) - 1, 1))))
    terms = terms.withColumn("_full", F.sha2("_term", 256)).withColumn("_key", F.substring("_full", 1, PREFIX_DIGITS)).drop("_term")
    confirmed = (F.col("_full") == F.col("_digest")) & F.col("_path").startswith(F.col("_rp"))
    if n_rules <= broadcast_rows:
        hits = terms.join(F.broadcast(keyed), (F.col("_key") == F.col("_short")) & confirmed, "left")
    else:
        # A frequent host makes a hot key; its rows are dealt over SALTS copies of the rules.
        salted = terms.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)))
        copies = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = salted.join(copies, (F.col("_key") == F.col("_short")) & (F.col("_salt") == F.col("_copy")) & confirmed, "left")
    best = F.max(
        F.when(
            F.col("_rh").isNotNull(),
            F.struct(
                (F.length("_rh") + F.length("_rp")).alias("size"),
                F.length("_rh").alias("host_size"),
                (F.col("_rv") == "allow").alias("allows"),
                F.concat("_rh", "_rp").alias("rule"),
                F.col("_rv").alias("verdict"),
            ),
        )
    )
    judged = hits.groupBy("_id", "_url").agg(F.first("_copies").alias("_copies"), F.first("_host").alias("_host"), F.first("_path").alias("_path"), best.alias("_best"))
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"),
    ).drop("_copy")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": OP10_SQL}
