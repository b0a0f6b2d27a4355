"""URL rules by expression digests (operator 8), DataFrame functions only.

Each url is expanded into host-suffix + path-prefix expressions of the shapes
(labels, path length) that rules have; expression and rule are joined on the
first 32 bits of their SHA-256 digests, the full digests confirm the match, and
the longest rule decides.

Scale.  A url gives at most as many expressions as the rules have shapes.  With
a rule table under the session's broadcast threshold nothing is shuffled before
the last step, where one row a page moves (the partial aggregate has already
merged its expressions); a larger table is joined by shuffle on the digest
prefix, where the skew join splits a frequent expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm.spark import ascii_lower, packed

PREFIX_HEX = 8
BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, "host/path") as a DataFrame with columns verdict, rule."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    empty = F.array().cast("array<struct<verdict:string,rule:string>>")
    one = spark.sql("select 1 as x")
    return one.select(F.inline(F.array(*rows) if rows else empty))


def _prepared(rules: DataFrame) -> DataFrame:
    host = ascii_lower(F.regexp_extract("rule", r"(?s)^([^/]*)", 1))
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    labels, text = F.size(F.split(host, r"\.")), F.concat(host, path)
    return rules.where("rule is not null and verdict in ('block', 'allow') and rule not like '/%' and rule <> ''").select(
        "verdict", "rule", labels.alias("labels"), F.length(path).alias("path_length"),
        F.length(text).alias("rule_length"), F.sha2(text, 256).alias("rule_digest")).withColumn(
        "prefix", F.substring("rule_digest", 1, PREFIX_HEX))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """pages plus host, path, rule (null where none fits) and verdict.

    A rule (columns verdict, rule = "host/path") fits its host and all
    subdomains where the url's path starts with the rule's path.  The longest
    rule wins; at a tie the one with more host labels, then block over allow,
    then the greater string.  Without a rule the verdict is ``default``.  A null
    url, or one without ``://``, has empty host and path and fits no rule; so
    has an empty host.  Repeated rows give a row each; other columns are kept as
    they are, one that has an output's name is replaced.  Rules that are null, empty,
    without a host or with another verdict are ignored.  pages must be a
    deterministic plan, such as a table scan: rows are told apart by position."""
    rules = _prepared(rules)
    # distinct shapes: at most (most labels) x (longest rule path), whatever the number of rules
    shapes = rules.agg(F.sort_array(F.collect_set(F.struct("labels", "path_length"))).alias("x")).first().x
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = packed(pages.select(*[f"`{c}`" for c in kept]))
    # numbered in a step of its own: in one select with explode every expression would get a number
    rows = pages.select(F.monotonically_increasing_id().alias("id"), row, host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    expressions = [
        F.when((F.col("host") != "") & (n >= s.labels) & (F.length("path") >= s.path_length),
               F.concat(F.array_join(F.slice(labels, n - s.labels + 1, s.labels), "."),
                        F.substring("path", 1, s.path_length)))
        for s in shapes]
    none = F.lit(None).cast("string")
    if not expressions:
        return rows.select("row.*", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.select("id", "row", "host", "path",
                       F.explode_outer(F.array_compact(F.array(*expressions))).alias("expression"))
    rows = rows.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    hits = rows.join(rules, "prefix", "left").withColumn("hit", F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct("rule_length", "labels", (F.col("verdict") == BLOCK).alias("blocks"), "rule", "verdict")))
    best = hits.groupBy("id").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"),
                                  F.max("hit").alias("hit"))
    return best.select("row.*", "host", "path", F.col("hit.rule").alias("rule"),
                       F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
