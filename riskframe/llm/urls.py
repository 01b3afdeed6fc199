"""URL filters by a Bloom filter cascade (operator 9, DataFrame functions only).

Keys are the corpus's addresses, host and path; listed are those that stand on a list of addresses and
those whose host stands on a list of hosts or lies below one.  The first level of the cascade is a
Bloom filter of the listed keys; the other keys of the corpus that it passes are encoded in the second
level, the listed keys which that passes in the third, and so on until nothing passes wrongly.  The
universe is complete - every address of the corpus - so the answer is exact for every row without a
join: the first level that stops a key decides.

Rules (host, path) come before the lists: a rule fits its host and all subdomains if the URL's path
starts with the rule's path; the longest that fits wins.

The cascade is cut into parts by a hash of the key, of about PART listed keys each; a filter is one
array of 64-bit words a part and level (``bits_per_key`` bits a key, some 5 MB), made in a task of its
own.  At most AT_ONCE parts travel to the tasks together: with more, the rows are judged in several
passes, one for each group of parts, so that memory stays bounded however long the lists are.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; empty lists allow everything that no rule blocks; null listed keys are ignored; equal rows
stay; an empty table gives an empty table; other columns, and carried ones with the names of the
results' own (``host``, ``path``, ``rule``, ``verdict``, where the carried one gets ``_in`` behind its
name), do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The production list: hosts of sites that the corpus does not want.
#: Characters below which a page is thin: addresses of thin pages are listed.
THIN = 2000
#: Listed keys of a part of the cascade, and parts that a pass takes.
PART, AT_ONCE = 4_000_000, 16
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, on, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried last, so it ends outermost
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(on + start)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def parents(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits)) for k in range(hashes)]


class Cascade:
    """Levels of Bloom filters over a complete universe of keys, cut into parts."""

    def __init__(self, hashes: int = 5, bits_per_key: int = 10, part: int = PART):
        self.hashes, self.bits_per_key, self.part = hashes, bits_per_key, part
        self.levels: list[tuple[DataFrame, int]] = []
        self.parts = 1

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(self.parts))

    def fit(self, flagged: DataFrame) -> Cascade:
        """flagged: (key, listed), every key of the universe once. Writes a table with a row a part for each level."""
        inside, outside = flagged.where("listed").select("key"), flagged.where("NOT listed").select("key")
        self.parts = inside.count() // self.part + 1
        while n := inside.count():
            level, bits = len(self.levels), 64 * (n // self.parts * self.bits_per_key // 64 + 1)
            ones = inside.select(self.part_of(F.col("key")).alias("part"), F.explode(F.array(*_places(F.col("key"), level, self.hashes, bits))).alias("at"))
            words = ones.groupBy("part", F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
            every = flagged.sparkSession.range(self.parts * (bits // 64)).select((F.col("id") % self.parts).alias("part"), F.floor(F.col("id") / self.parts).alias("word"))
            full = every.join(words, ["part", "word"], "left").select("part", "word", F.coalesce("bits", F.lit(0)).alias("bits"))
            array = full.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
            self.levels.append((store.keep(array), bits))
            inside, outside = store.keep(outside.where(self._hit(F.col("key"), level))), inside
        return self

    def _hit(self, key: Column, level: int, parts: range | None = None) -> Column:
        """Whether a level passes a key of the given parts."""
        table, bits = self.levels[level]
        answer = F.lit(False)
        for part in parts or range(self.parts):
            words, hit = table.where(F.col("part") == part).select("words").scalar(), F.lit(True)
            for at in _places(key, level, self.hashes, bits):
                word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
                hit &= word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
            answer = hit if self.parts == 1 else F.when(self.part_of(key) == part, hit).otherwise(answer)
        return answer

    def contains(self, key: Column, parts: range | None = None) -> Column:
        """Exact for keys of the universe. Level 0 stops keys that aren't listed, level 1 those that are, and so on."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._hit(key, level, parts), answer).otherwise(F.lit(level % 2 == 1))
        return answer

    def mark(self, rows: DataFrame, key: Column, name: str, at_once: int = AT_ONCE) -> DataFrame:
        """rows with a boolean ``name``; with more parts than ``at_once`` in passes, each written."""
        groups = [range(k, min(k + at_once, self.parts)) for k in range(0, self.parts, at_once)]
        if len(groups) == 1:
            return rows.withColumn(name, self.contains(key))
        passes = [store.keep(rows.where(self.part_of(key).between(g.start, g.stop - 1)).withColumn(name, self.contains(key, g))) for g in groups]
        out = passes[0]
        for more in passes[1:]:
            out = out.union(more)
        return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, url: str = "url", carry: tuple[str, ...] = ("page_id",), addresses: DataFrame | None = None, cascade: Cascade | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``carry`` columns, host, path, rule and verdict of every row.

    listed: a column ``key`` of hosts; addresses: a column ``key`` of hosts with their paths.
    """
    names = [c + "_in" if c in ("host", "path", "rule", "verdict") else c for c in carry]
    parsed = pages.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    key = F.concat("host", "path")
    low = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    universe = store.keep(parsed.where("host <> ''").select(key.alias("key"), "host").distinct())
    wanted = listed.where("key IS NOT NULL").select(low("key").alias("at"))
    hosts = universe.select("host").distinct()
    covered = hosts.select("host", F.explode(parents(F.col("host"))).alias("at")).join(wanted, "at", "left_semi").select("host").distinct()
    found = universe.join(covered, "host", "left_semi").select("key")
    if addresses is not None:
        found = found.union(universe.join(addresses.where("key IS NOT NULL").select("key"), "key", "left_semi").select("key"))
    every = universe.select("key", F.lit(False).alias("listed")).union(found.select("key", F.lit(True).alias("listed")))
    flagged = store.keep(every.groupBy("key").agg(F.max("listed").alias("listed")))
    made = (cascade or Cascade()).fit(flagged)
    judged = made.mark(parsed, key, "on_list", at_once)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    stops = (F.col("host") != "") & F.col("on_list")
    return judged.select(*(F.col(f"_c{k}").alias(n) for k, n in enumerate(names)), "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(stops, "block").otherwise("allow")).alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, the list of hosts, and the addresses at which thin pages were seen."""
    pages = store.table(spark, sf_dir, "pages")
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    thin = pages.where((F.length("html") < THIN) & (host_of(F.col("url")) != "")).select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    return judge_urls(pages, listed, addresses=thin)


_FITS = "CASE " + " ".join(
    f"WHEN (host = '{on}' OR host LIKE '%.{on}') AND starts_with(path, '{start}') THEN {{{k}}}" for k, (_, on, start) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2]))
)
SQL_OP9 = rf"""
WITH parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path, html FROM pages),
thin AS (SELECT DISTINCT host || path AS address FROM parsed WHERE host <> '' AND length(html) < {THIN})
SELECT page_id, host, path, {_FITS.format(*(f"'{on + start}'" for _, on, start in RULES))} END AS rule,
    {_FITS.format(*(f"'{what}'" for what, _, _ in RULES))} WHEN {" OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in LISTED)} OR host || path IN (SELECT address FROM thin) THEN 'block' ELSE 'allow' END AS verdict
FROM parsed
"""
