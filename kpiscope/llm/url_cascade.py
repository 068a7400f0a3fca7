"""URL rules and host lists by cascades of Bloom filters.  Built-in functions only.

A cascade holds a key set exactly with respect to a universe of keys. Its first level is a
Bloom filter of the listed keys; the second encodes those keys of the universe, not listed,
that the first lets through; the third the listed keys that the second lets through; and so
on until a level lets nothing wrong through. A key of the universe is listed exactly if the
first level that rejects it has an even number (counting from one), so membership needs no
join: a level is one binary literal (several for very long lists), met once in an expression however many hashes it has. The first level has so
many bits a key that it lets through about as many keys of the universe as are listed, so levels
are bounded by the list, however large the corpus is.

The universe is every key that a url of the corpus can ask for: each suffix of its host at a
label boundary, with each prefix of its path that is as long as some listed path.

Rows without a url, or with no ``://``, have an empty host and path and fit no rule. Two rules
that fit and are equally long cannot differ, unless one's host is longer; the longer host wins.
Repeated urls give repeated rows; an empty table gives no rows (and cascades of one level);
input columns other than the url and the key are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.llm.common import require_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A literal holds the bits of at most about this many keys (3 to 8 MB); a longer list is split by the
#: keys' hashes, with a literal for each part, of which a lookup touches one.
MAX_KEYS = 2_000_000
#: Words of 64 bits that come to the driver in one row.
ROW_WORDS = 1 << 12
#: Levels after the first see about as many keys as they hold and let half of a percent through.
LATER_BITS = 12


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and each of its parents, the longest first; none for an empty host."""
    labels = F.split(host, r"\.")
    every = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Each host suffix with each path prefix of the lengths; only those the path has."""
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in sorted(set(lengths))]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


#: The 64-bit words with one bit set, as signed integers, and such bytes.
ONE_BIT = [1 << i for i in range(63)] + [-(1 << 63)]
BITS = [1 << i for i in range(8)]
HALF = (1 << 31) - 1


def places(key: Column, salt: int, hashes: int, bits: int) -> Column:
    """The key's bit places: sums of two hashes."""
    one, two = (F.xxhash64(key, F.lit(salt + i)).bitwiseAND(F.lit(HALF)) for i in (0, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(one + i * two, F.lit(bits)))


@dataclass(frozen=True)
class Level:
    parts: tuple[bytes, ...]  # the bits of each part of the keys, lowest bit of a byte first
    salt: int
    hashes: int

    def passes(self, key: Column) -> Column:
        """Whether all the key's bits are set; the first that is not ends the search."""
        raw, part = F.lit(bytearray(self.parts[0])), part_of(key, self.salt, len(self.parts))
        for i, more in enumerate(self.parts[1:], 1):
            raw = F.when(part == i, F.lit(bytearray(more))).otherwise(raw)

        def is_set(p: Column) -> Column:
            byte = F.ascii(F.decode(F.substring(raw, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            return F.get(F.lit(BITS), p.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(byte) != 0

        return F.forall(places(key, self.salt, self.hashes, 8 * len(self.parts[0])), is_set)


def part_of(key: Column, salt: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt + 2)), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")


def build_level(keys: DataFrame, n_keys: int, salt: int, bits_per_key: int) -> Level:
    """A Bloom filter of the column ``key``: bit places are or-ed per 64-bit word, so the
    driver gets at most one number a word, ``ROW_WORDS`` a row, and ``n_keys`` bounds the words."""
    parts = max(1, -(-n_keys // MAX_KEYS))
    words, hashes = max(1, -(-n_keys * bits_per_key // (64 * parts))), max(1, round(bits_per_key * math.log(2)))
    key, powers = F.col("key"), F.lit(ONE_BIT)
    got = (
        keys.select(part_of(key, salt, parts).alias("part"), F.explode(places(key, salt, hashes, 64 * words)).alias("p"))
        .groupBy("part", F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.get(powers, F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .groupBy("part", F.floor(F.col("word") / ROW_WORDS))
        .agg(F.collect_list("word").alias("words"), F.collect_list("bits").alias("bits"))
    )
    raw = [bytearray(8 * words) for _ in range(parts)]
    for r in got.select("part", "words", "bits").toLocalIterator():
        for word, bits in zip(r["words"], r["bits"]):
            struct.pack_into("<q", raw[r["part"]], 8 * word, bits)
    return Level(tuple(map(bytes, raw)), salt, hashes)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def first_bits(listed: int, universe: int) -> int:
    """Bits a key of the first level, such that of the universe it lets through about as many
    keys as are listed: with them the later levels grow with the list, not with the corpus."""
    return max(LATER_BITS, math.ceil(math.log2(max(2, universe / max(1, listed))) / math.log(2)))


def build_cascade(listed: DataFrame, universe: DataFrame, size: int | None = None, max_levels: int = 64) -> Cascade:
    """A cascade of the listed keys over the universe; both have the column ``key``.

    ``size`` is the number of the universe's keys, or more (counted if not given). The universe is
    scanned once more, through the first level: what that lets through is made distinct; later
    levels see only that. Nulls in either are ignored.
    """
    if size is None:
        size = universe.count()
    held = [listed.select("key").where("key is not null").distinct().persist()]
    try:
        n = held[0].count()
        levels = [build_level(held[0], n, 0, first_bits(n, size))]
        passed = universe.select("key").where(F.col("key").isNotNull() & levels[0].passes(F.col("key"))).distinct()
        wrong, right = passed.join(held[0], "key", "left_anti"), held[0]
        while len(levels) < max_levels:
            wrong = wrong.persist()
            held.append(wrong)
            n_wrong = wrong.count()
            if not n_wrong:
                return Cascade(tuple(levels))
            level = build_level(wrong, n_wrong, 1000 * len(levels), LATER_BITS)
            levels.append(level)
            wrong, right = right.where(level.passes(F.col("key"))), wrong
        raise RuntimeError(f"more than {max_levels} levels")
    finally:
        for df in held:
            df.unpersist()


def values(spark: SparkSession, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of literals, made by the JVM; for lists of some thousands (longer ones are tables)."""
    if not keys:
        return spark.range(0).select(F.lit("").alias(name))
    return spark.range(1).select(F.explode(F.lit(list(keys))).alias(name))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] | DataFrame, blocked_hosts: Sequence[str] | DataFrame,
    url: str = "url", keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Each url's host, path, rule and verdict.

    The longest fitting rule decides; where none fits, a url is blocked if its host or a
    parent of it is in ``blocked_hosts``. Both lists may be tables: rules with the columns
    (verdict, host, path), hosts with the column host; null hosts are ignored, a null path is empty.
    Three cascades over the urls' keys answer: all rules, the blocking rules among them, and the
    blocked hosts. The only shuffles are those of the few keys that pass a first level.
    """
    require_columns(pages, [url, *keep])
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        require_columns(rules, ["verdict", "host", "path"])
        path = F.coalesce("path", F.lit(""))
        rule_rows = rules.where("host is not null").select(F.concat("host", path).alias("key"), F.length(path).alias("n"), (F.col("verdict") == "block").alias("block"))
        all_rules, blocking_rules = rule_rows.select("key"), rule_rows.where("block").select("key")
        lengths = sorted(r["n"] for r in rule_rows.select("n").distinct().collect())  # at most one for each length of a path
        twice = rule_rows.groupBy("key").count().where("count > 1").limit(1).count()
    else:
        all_rules, blocking_rules = values(spark, [str(r) for r in rules], "key"), values(spark, [str(r) for r in rules if r.verdict == "block"], "key")
        lengths = sorted({len(r.path) for r in rules})
        twice = len({str(r) for r in rules}) < len(rules)
    if twice:
        raise ValueError("a rule is listed twice")
    sites = blocked_hosts if isinstance(blocked_hosts, DataFrame) else values(spark, blocked_hosts, "host")
    sites = sites.select(F.translate("host", UPPER, LOWER).alias("key"))

    hosts = pages.select(url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    rule_keys, host_keys = candidate_keys(F.col("host"), F.col("path"), lengths), host_suffixes(F.col("host"))
    sizes = hosts.agg(F.coalesce(F.sum(F.size(rule_keys)), F.lit(0)), F.coalesce(F.sum(F.size(host_keys)), F.lit(0))).first()
    by_rule, by_site = hosts.select(F.explode(rule_keys).alias("key")), hosts.select(F.explode(host_keys).alias("key"))
    known = build_cascade(all_rules, by_rule, sizes[0])
    blocking = build_cascade(blocking_rules, by_rule, sizes[0])
    listed = build_cascade(sites, by_site, sizes[1])

    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    out = pages.select(*kept, url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    fits = F.filter(candidate_keys(F.col("host"), F.col("path"), lengths), known.contains)
    # Suffixes come longest first, so among equally long keys the one with the longer host is first.
    longest = F.array_sort(fits, lambda a, b: F.length(b) - F.length(a))
    out = out.withColumn("rule", F.get(longest, F.lit(0)))
    by_host = F.exists(host_suffixes(F.col("host")), listed.contains)
    block = F.when(F.col("rule").isNotNull(), blocking.contains(F.col("rule"))).otherwise(by_host)
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule",
        F.when(block, "block").otherwise("allow").alias("verdict"),
    )
