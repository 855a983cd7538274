"""Operator 3: URL prefix rules by a sort-merge range join.

A host's labels in reverse order make subdomains neighbours: all hosts under
``example.com`` have keys that begin with ``com.example.``, so a rule's host is an interval
of keys, and two such intervals are nested or apart.  URLs and rules are dealt into ranges
of keys and sorted; one sweep through a range keeps the stack of rules whose interval holds
the current key, and looks for the longest rule whose path begins the URL's path.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm.storage import share_of

#: Rules of the registered query: host, path, verdict (fixed values).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT = "allow"
#: Keys that range limits are taken from, ranges at most, and the URLs that a task should have (all only steer the balance:
#: a range with more URLs gets more tasks, without an upper bound).
SAMPLE, MAX_RANGES, TASK_ROWS = 20_000, 512, 100_000


def lowered(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or end; then up to ``?``, ``#`` or end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def host_key(host: Column) -> Column:
    """``blog.example.com`` as ``com.example.blog.``; an empty host as an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit(".")))


def _limits(keys: DataFrame, rows: int, tasks: int) -> tuple[list[str], list[int]]:
    """Keys that split the URLs into ranges, and the parts that each range is dealt into.

    Both come from a sample chosen by a hash; any values give right results.  Limits lie
    between different keys, so a range with one very frequent key gets more parts.
    """
    n = min(MAX_RANGES, tasks)
    if n < 2:
        return [], [1]
    picked = keys.where(share_of(F.xxhash64("page_id", "key"), SAMPLE / max(1, rows))).select("key").limit(2 * SAMPLE).collect()
    some = sorted(r["key"] for r in picked)
    if not some:  # one range, dealt by hash over all tasks
        return [], [tasks]
    limits = sorted({some[len(some) * k // n] for k in range(1, n)})
    held = [0] * (len(limits) + 1)
    for key in some:
        held[bisect_right(limits, key)] += 1
    return limits, [max(1, round(h * tasks / max(1, len(some)))) for h in held]


def _range_of(key: Column, limits: list[str]) -> Column:
    """Number of limits at or before the key, by binary search through nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < limits[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(limits))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a range in order of (bucket, key, rules first): adds the rule and verdict to each URL.

    The columns of URLs pass through as they are, so an id keeps its type and value.
    """
    stack: list[tuple[str, str, dict[str, tuple[str, str]], list[int]]] = []  # start key, host, {path: (rule, verdict)}, path lengths
    current = None
    for batch in batches:
        found: list[tuple[str, str] | None] = []
        for bucket, key, is_url, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "is_url", "host", "path", "verdict")), strict=True):
            if bucket != current:
                stack, current = [], bucket
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                known = stack[-1][2]
                if path not in known or verdict < known[path][1]:
                    known[path] = (host + path, verdict)
                    if len(path) not in stack[-1][3]:
                        stack[-1][3].append(len(path))
                        stack[-1][3].sort(reverse=True)
                continue
            best = None
            for _, rule_host, known, sizes in reversed(stack):  # the longest host first: it wins a tie
                for n in sizes:
                    if best is not None and len(rule_host) + n <= len(best[0]):
                        break
                    if n <= len(path) and (met := known.get(path[:n])):
                        best = met
                        break
            found.append(best)
        urls = batch.filter(batch.column("is_url"))
        kind = urls.schema.field("path").type
        rule, verdict = pa.array([f and f[0] for f in found], kind), pa.array([f[1] if f else DEFAULT for f in found], kind)
        yield pa.RecordBatch.from_arrays([urls.column("page_id"), urls.column("host"), urls.column("path"), rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host + path; null if none fits), verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path begins
    with the rule's; the one whose host and path are longest together wins, then the longer
    host.  Equal rules with different verdicts count as the lesser verdict (allow).  Rules
    of a null or empty host, or a null path, fit nothing.  A null URL, or one without
    ``://``, has an empty host and path and the default verdict.  A URL of any length is
    judged whole.  Repeated rows give repeated results, a null page_id stays null, and ids of
    any type come back unchanged.  An empty table gives an empty result; extra columns are ignored.
    """
    read = pages.select("page_id", F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = read.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.col("path")))
    rows = urls.count()
    spark = pages.sparkSession
    cores = min(spark.sparkContext.defaultParallelism, rows // 1_000)  # small tables still use all cores
    limits, parts = _limits(urls, rows, max(1, cores, -(-rows // TASK_ROWS)))
    begin = [sum(parts[:k]) for k in range(len(parts) + 1)]
    begins = lambda r: F.element_at(F.array(*[F.lit(b) for b in begin]), r + 1)
    usable = rules.where("host <> '' and path is not null").select(lowered(F.col("host")).alias("host"), "path", "verdict").withColumn("key", host_key(F.col("host")))
    # A rule goes to every part of every range that its interval [key, key with the last dot raised) reaches into.
    first = _range_of(F.col("key"), limits)
    last = _range_of(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")), limits)
    spread = usable.select(F.explode(F.sequence(begins(first), begins(last + 1) - 1)).alias("bucket"), "key", F.lit(False).alias("is_url"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict")
    own = _range_of(F.col("key"), limits)
    part = F.pmod(F.xxhash64("page_id", "path"), (begins(own + 1) - begins(own)).cast("long")).cast("int")
    events = urls.select((begins(own) + part).alias("bucket"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit("").alias("verdict")).unionByName(spread)
    kind = pages.schema["page_id"].dataType.simpleString()
    # A bucket is a partition of its own: none shares its task with another or is left without rows by a hash.
    ordered = events.repartitionById(begin[-1], F.col("bucket")).sortWithinPartitions("bucket", "key", "is_url")
    return ordered.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f USING (page_id)
"""
