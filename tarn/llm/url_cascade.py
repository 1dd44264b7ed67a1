"""URL filter lists as cascades of Bloom filters; DataFrame functions only.

The keys of a URL are its host's suffixes, each with a prefix of its path, of
the lengths that rules have. A cascade says for every key of the corpus exactly
whether it is listed: its first filter holds the listed keys, the second the
corpus keys that the first lets through by mistake, the third the listed keys
that the second lets through, and so on until no mistake is left. Reading it
takes no join: the filters are literals in the query. The first filter's error
rate is chosen so that it lets through fewer keys than are listed, which makes
the size of all filters follow the list and only the logarithm of the corpus.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import saved

# A level above this is refused: filters travel with the query to every task.
MOST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys of a URL that could be rules, the longest first."""
    parts = F.split(host, r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))
    by_length = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(by_length, lambda s: s["key"])


@dataclass(frozen=True)
class Bloom:
    """One level: ``hashes`` bits for each key among ``bits``, as 64-bit words."""

    level: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()

    @classmethod
    def build(cls, keys: DataFrame, level: int, n: int, error: float) -> Bloom:
        """The filter of the ``n`` rows of ``keys`` (column key).

        Only its words come to the driver: at most ``bits / 64`` of them.
        """
        hashes = max(1, round(-math.log2(error)))
        bits = 64 * math.ceil(n * hashes / math.log(2) / 64)
        if bits > 8 * MOST_BYTES:
            raise ValueError(f"{n} keys need a filter of {bits // 8} bytes; split the list")
        empty = cls(level, bits, hashes)
        places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("place"))
        word = F.floor(F.col("place") / 64)
        rows = (
            places.groupBy(word.alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("set"))
            .collect()
        )
        words = [0] * (bits // 64)
        for row in rows:
            words[row["word"]] = row["set"]
        return cls(level, bits, hashes, tuple(words))

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(100 * self.level + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # One text literal, read once, instead of an expression for each word.
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in self.places(key)]
        found = tests[0]
        for test in tests[1:]:
            found = found & test
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...] = ()

    @classmethod
    def build(cls, listed: DataFrame, corpus: DataFrame) -> Cascade:
        """A cascade exact for all keys of ``listed`` and ``corpus`` (column key)."""
        listed = saved(listed.select("key").filter("key is not null").distinct(), "listed")
        n = listed.count()
        if not n:
            return cls()
        universe = corpus.agg(F.approx_count_distinct("key")).first()[0]
        error = min(0.5, n / (math.sqrt(2) * max(universe, 1)))
        levels = [Bloom.build(listed, 1, n, error)]
        inside = listed
        wrong = corpus.filter(levels[0].holds(F.col("key"))).select("key").distinct()
        outside = saved(wrong.join(listed, "key", "left_anti"), "passed")
        while n := outside.count():
            levels.append(Bloom.build(outside, len(levels) + 1, n, 0.5))
            passed = saved(inside.filter(levels[-1].holds(F.col("key"))), "passed")
            inside, outside = outside, passed
        return cls(tuple(levels))

    def lists(self, key: Column) -> Column:
        """Whether ``key`` is listed: the number of levels passed is odd."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.level % 2 == 0))
        return answer


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], otherwise: str = "allow") -> DataFrame:
    """The rule that decides on each URL.

    ``pages`` has ``page_id`` and ``url``; other columns are ignored. ``rules``
    are (action, rule) with action block or allow, a rule being a host and a path
    prefix that starts with a slash. A rule fits a URL of its host or a subdomain
    whose path starts with the rule's path; the longest that fits decides, and
    block if both lists have it. Gives ``page_id``, ``host``, ``path``, ``rule``
    (null if none fits) and ``verdict`` (then ``otherwise``), one row for each
    input row. A URL that is null or has no ``://`` has an empty host and path,
    which no rule fits. Empty tables and lists are allowed.
    """
    spark = pages.sparkSession
    hosts = [rule.partition("/")[0] for _, rule in rules]
    labels = sorted({host.count(".") + 1 for host in hosts})
    lengths = sorted({len(rule) - len(host) for host, (_, rule) in zip(hosts, rules, strict=True)})
    keys = keys_of(F.col("host"), F.col("path"), labels, lengths) if rules else F.array().cast("array<string>")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parsed.withColumn("keys", keys)
    corpus = keyed.select(F.explode("keys").alias("key"))
    cascades = {}
    for action in ("block", "allow"):
        mine = [rule for kind, rule in rules if kind == action]
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, mine)).cast("array<string>")).alias("key"))
        cascades[action] = Cascade.build(listed, corpus)
    fits = lambda key: cascades["block"].lists(key) | cascades["allow"].lists(key)
    decided = keyed.withColumn("rule", F.get(F.filter("keys", fits), F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), otherwise).when(cascades["block"].lists(F.col("rule")), "block").otherwise("allow")
    return decided.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
