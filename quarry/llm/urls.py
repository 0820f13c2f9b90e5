"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys. Among the corpus's complete key universe the unlisted keys that pass it are known, so
level 1 encodes those, level 2 the listed keys that pass level 1, and so on until a level lets no wrong key pass.
Over that universe membership is then exact, and it is a column expression: no join, no Python. Level 0 is sized by how
often the universe exceeds the list, so that about as many wrong keys pass it as there are listed ones; then no level has
more keys than the list, whatever the size of the corpus.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._base import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one level at most (4 MB), as it is sent with the plan; lists that need more are joined instead.
MOST_BITS = 1 << 25


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]

    def passes(self, key: Column) -> Column:
        if not self.words:
            return F.lit(False)
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        at = positions(key, self.bits, self.hashes, self.seed)
        return reduce(Column.__and__, [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in at])


class TooLong(ValueError):
    """A level would need more than MOST_BITS."""


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """The bits of a key: two hashes, and multiples of the second one added to the first."""
    first, second = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    step = F.shiftright(second, 8).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(first, 8) + step * F.lit(i), F.lit(bits).cast("long")) for i in range(hashes)]


def level_of(keys: DataFrame, seed: int, hashes: int = 4) -> Level:
    """A Bloom filter over `key` that lets about 1 in 2**hashes other keys pass; its words are built on the executors."""
    n = keys.count()
    if not n:
        return Level(64, 1, seed, [])
    bits = max(64, 1 << math.ceil(math.log2(n * hashes / math.log(2))))
    if bits > MOST_BITS:
        raise TooLong(f"{n} keys need {bits} bits")
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect()
    dense = [0] * (bits // 64)
    for r in words:
        dense[r["w"]] = r["v"]
    return Level(bits, hashes, seed, dense)


def build_cascade(listed: DataFrame, universe: DataFrame, universe_keys: int | None = None, most_levels: int = 64) -> list[Level]:
    """Levels over `key` columns. The universe may repeat keys; only its keys that pass level 0 are shuffled.

    universe_keys: about how many keys the universe has (repeats counted, if that is cheaper); counted here if not given.
    """
    listed = listed.where("key is not null").distinct()
    many = universe.count() if universe_keys is None else universe_keys
    levels = [level_of(listed, 0, max(4, math.ceil(math.log2(max(1, many) / max(1, listed.count())))))]
    passed = checkpointed(universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    inside, outside = listed, passed
    while not outside.isEmpty():
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not settle")
        levels.append(level_of(outside, len(levels)))
        inside, outside = outside, checkpointed(inside.where(levels[-1].passes(F.col("key"))))
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    if not levels:
        return F.lit(False)
    return levels[0].passes(key) & ~is_listed(key, levels[1:]) if len(levels) > 1 else levels[0].passes(key)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All rule keys that would fit: the host and its parent domains, each with the path's prefixes of these lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of each row of df.

    rules: host, path, action (allow or block); of equal rules block wins. A rule fits its host and all subdomains where
    the path starts with the rule's; of the fitting rules the longest (as host + path) decides. Where none fits, the url is
    in no list, rule is null and the verdict is the default. Null urls and urls without :// have an empty host and path.
    Repeated rows are judged each; extra columns are left out; empty tables and empty rule lists are fine. Lists that need
    more than MOST_BITS (about a million rules) are joined.
    """
    host, path = host_and_path(F.col(url))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), "action").where("key is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    pages = df.select(F.col(key).alias("k"), host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    try:
        listed = build_cascade(rules.select("key"), pages.select(F.explode("keys").alias("key")), pages.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0])
        blocked = build_cascade(rules.where("action = 'block'").select("key"), rules.select("key"))
    except TooLong:
        return joined(pages, rules, key, default)
    fitting = F.filter("keys", lambda k: is_listed(k, listed))
    longest = F.reduce(fitting, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))
    judged = pages.select("k", "host", "path", longest.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), default).when(is_listed(F.col("rule"), blocked), "block").otherwise("allow")
    return judged.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def joined(pages: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """The same verdicts for lists that are too long to send with the plan: distinct keys meet the rules in a join, and the
    rules found come back to distinct hosts and paths."""
    distinct = pages.groupBy("host", "path").agg(F.first("keys").alias("keys"))
    listed = rules.groupBy("key").agg(F.max(F.col("action") == "block").alias("block"))
    found = distinct.select("host", "path", F.explode("keys").alias("key")).join(listed, "key")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "block")).alias("b"))
    judged = pages.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("b").isNull(), default).when(F.col("b.block"), "block").otherwise("allow")
    return judged.select(F.col("k").alias(key), "host", "path", F.col("b.key").alias("rule"), verdict.alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])))


#: The rules that the query judges by (fixed values).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


OP3_SQL = rf"""
WITH rules(host, path, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
f AS (SELECT u.page_id, u.host, u.path, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
             arg_max(rules.action, length(rules.host || rules.path)) AS action
      FROM u LEFT JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
      GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f
"""
