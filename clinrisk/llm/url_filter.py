"""URL rules by a Bloom filter cascade: exact membership in a rule list without joining the URLs to it.

A rule is ``host/path``. It fits its host and all subdomains where the URL's path starts with its path, so a URL can only
match keys of the form (last labels of its host) + (first characters of its path), with the label counts and path lengths
that occur in the list. These candidate keys, over all URLs, are the cascade's universe. Level 1 is a Bloom filter of the
listed keys; level 2 holds the universe's keys that level 1 wrongly accepts; level 3 the listed keys that level 2 wrongly
accepts; and so on until a level accepts nothing wrongly. A key of the universe is listed if the number of levels accepting
it before the first refusal is odd.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.llm.common import ascii_lower, landed

MAX_FILTER_BITS = 1 << 26


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``; both empty without ``://`` or for NULL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(raw) + 1, F.length(after)), "^[^?#]*", 0)
    return ascii_lower(raw), path


class Cascade:
    """Exact membership of ``key`` for all keys of a universe.

    ``keys``: the listed keys (a DataFrame with column ``key``), ``universe``: all keys that will be asked (repeats allowed).
    Levels are collected as 64-bit words. Their size follows the list, as the first level's rate of errors is chosen for
    listed * sqrt(1/2) wrong keys out of the universe; more than ``max_bits`` in a level raises ValueError.
    """

    def __init__(self, keys: DataFrame, universe: DataFrame, max_bits: int = MAX_FILTER_BITS):
        keys = keys.where(F.col("key").isNotNull()).select("key").distinct()
        listed = keys.count()
        self.levels: list[tuple[list[int], int, int]] = []
        if not listed:
            return
        asked = universe.agg(F.approx_count_distinct("key", 0.02)).first()[0]
        rate = min(0.5, listed * math.sqrt(0.5) / max(asked - listed, 1))
        inside, outside, n = keys, universe.select("key"), listed
        while n:
            self._add_level(inside, n, rate, max_bits)
            # The next level holds what this one wrongly accepts. Only the first scan reads the whole universe; its
            # errors are about as many as listed keys.
            wrong = outside.where(self._accepts(len(self.levels) - 1, F.col("key")))
            if len(self.levels) == 1:
                wrong = wrong.distinct().join(keys, "key", "left_anti")
            wrong = landed(wrong, "cascade")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def _add_level(self, keys: DataFrame, n: int, rate: float, max_bits: int) -> None:
        bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
        if bits > max_bits:
            raise ValueError(f"a filter of {n} keys takes {bits} bits, more than {max_bits}; split the list")
        hashes, level = max(1, round(math.log2(1 / rate))), len(self.levels)
        at = F.explode(_positions(F.col("key"), level, hashes, bits)).alias("at")
        words = (keys.select(at).groupBy(F.expr("at div 64").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect())
        packed = [0] * math.ceil(bits / 64)
        for row in words:
            packed[row["word"]] = row["bits"]
        self.levels.append((packed, hashes, bits))

    def _accepts(self, level: int, key: Column) -> Column:
        packed, hashes, bits = self.levels[level]
        array = F.from_json(F.lit(json.dumps(packed)), "array<bigint>")  # folded into one literal
        one = lambda at: F.getbit(F.get(array, (at / 64).cast("int")), (at % 64).cast("int")) == 1
        return F.forall(_positions(key, level, hashes, bits), one)

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for every key of the universe, false for NULL."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            refused = F.lit(level % 2 == 1)
            out = F.when(self._accepts(level, key), out).otherwise(refused)
        return key.isNotNull() & out


def _positions(key: Column, level: int, hashes: int, bits: int) -> Column:
    first, step = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    # Both below 2^31, so that no product overflows.
    first, step = F.pmod(first, F.lit((1 << 31) - 1)), F.pmod(step, F.lit((1 << 31) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(first + i * step, F.lit(bits)))


def candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys a URL can match: struct(length, host_length, key) per (labels, path characters) that it is long enough for."""
    labels = F.split(host, "\\.")

    def one(n_labels: int, n_path: int) -> Column:
        suffix = F.array_join(F.slice(labels, -n_labels, n_labels), ".")
        key = F.concat(suffix, path.substr(1, n_path))
        fits = (F.size(labels) >= n_labels) & (F.length(path) >= n_path) & (host != "")
        return F.when(fits, F.struct(F.length(key).alias("length"), F.length(suffix).alias("host_length"), key.alias("key")))

    return F.filter(F.array(*[one(*s) for s in shapes]), lambda x: x.isNotNull())


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    max_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row of ``pages``.

    ``rules``: (verdict, host, path) with verdict ``allow`` or ``block``; the longest rule that fits wins, of equally long
    ones that with the longer host, and ``block`` where one key has both verdicts. URLs that no rule fits get ``default``:
    for the cascade, what is not listed is not blocked. A NULL or malformed URL has empty host and path and so no rule. Other
    columns of ``pages`` are ignored; repeated rows are judged one by one; no rules at all leave ``default``.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    if not shapes:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = parsed.select(F.explode(candidates(F.col("host"), F.col("path"), shapes)).alias("c")).select("c.key")
    cascades = {v: Cascade(_keys(spark, rules, v), universe, max_bits) for v in ("block", "allow")}
    listed = F.array_max(F.filter(
        F.transform(
            candidates(F.col("host"), F.col("path"), shapes),
            lambda c: F.struct(
                c["length"].alias("length"), c["host_length"].alias("host_length"), c["key"].alias("key"),
                F.when(cascades["block"].contains(c["key"]), "block")
                .when(cascades["allow"].contains(c["key"]), "allow").alias("verdict"))),
        lambda c: c["verdict"].isNotNull()))
    return (parsed.withColumn("_best", listed)
            .select(*keep, "host", "path", F.col("_best.key").alias("rule"),
                    F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")))


def _keys(spark: SparkSession, rules: Sequence[tuple[str, str, str]], verdict: str) -> DataFrame:
    rows = sorted({h.lower() + p for v, h, p in rules if v == verdict})
    listed = F.from_json(F.lit(json.dumps(rows)), "array<string>")
    return spark.range(1).select(F.explode(listed).alias("key"))
