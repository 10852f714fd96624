"""URL filters by a Bloom filter cascade (operator 4).

A rule is a host and a path prefix.  It fits a URL if the URL's host is the
rule's host or ends with a dot and it, and the URL's path starts with the
rule's path.  Of the rules that fit, the longest host decides, then the longest
path.

The rules of each action are the listed keys of one cascade.  Its universe is
every key that any URL of the corpus can ask for.  Level 1 encodes the listed
keys, level 2 the keys of the universe that level 1 takes for listed, level 3
the listed keys that level 2 takes for those, and so on until a level errs on
nothing.  A key of the universe is listed if and only if the first level that
rejects it is an even one (or none does and the number of levels is odd).
Judging a URL then takes a few array look-ups and no join.

Size: level 1 has so many bits a key that the keys of the universe it takes for
listed are about as many as the list; the bits grow with the logarithm of the
universe.  Level 2 encodes those, about as many keys as the list has, and the
later ones shrink geometrically.  So all filters are bounded by the list, which
is checked against ``MAX_RULES``, and each level's keys against what that
bound foresees before its filter comes to the driver.  A filter is one literal
of the plan.

Defined results.  A null URL, or one without ``://``, has an empty host and
path and fits no rule; what no rule fits gets ``default``.  An empty list lists
nothing.  Columns beyond ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.llm.storage import store

#: Bits and hashes a key from level 2 on.
BITS, HASHES = 10, 4
MAX_RULES = 1_000_000
MAX_LEVELS = 40
#: A level may hold so many times the keys of the list (and a few).
SPARE = 8


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """Host and path as one string; the separator occurs in no host."""
    return F.concat(host, F.lit("\n"), path)


def _candidates(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key that a URL can ask for, longest host first, then longest path.

    Hosts and paths longer than any rule's cannot fit and are not built, so a
    URL asks for at most (labels of the longest host) x (distinct path lengths).
    """
    labels = max((r.host.count(".") + 1 for r in rules), default=0)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    suffixes = F.when(
        (n > 0) & (host != ""),
        F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, -k, k), ".")),
    ).otherwise(F.array().cast("array<string>"))
    heads = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]) if lengths else F.array().cast("array<string>")
    heads = F.filter(heads, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: _key(h, p))))


def _bits(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    whole = F.xxhash64(key, F.lit(level))
    one, two = F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit((1 << 32) - 1))
    return [F.pmod(one + two * F.lit(k), F.lit(size)) for k in range(hashes)]


@dataclass(frozen=True)
class Level:
    size: int
    hashes: int
    words: tuple[int, ...]

    def holds(self, key: Column, level: int) -> Column:
        """Whether a level's filter takes ``key`` for a member."""
        table = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        word = lambda bit: F.get(table, F.floor(bit / F.lit(64)).cast("int"))
        return F.forall(F.array(*_bits(key, level, self.size, self.hashes)), lambda bit: F.getbit(word(bit), F.pmod(bit, F.lit(64)).cast("int")) == 1)


def _shape(n: int, universe: int) -> tuple[int, int]:
    """Bits and hashes a key of level 1, for ``n`` keys in a universe."""
    wrong = max(1.0, log2(max(1, universe) / n))
    return max(BITS, ceil(wrong / log(2))), max(HASHES, ceil(wrong))


def _level(keys: DataFrame, number: int, bits: int, hashes: int, most: int) -> Level | None:
    """A Bloom filter of the column ``key``; None for no keys.

    Its words come from grouped aggregation; only the filter itself comes to
    the driver, once its keys are counted and no more than ``most``.
    """
    n = keys.count()
    if not n:
        return None
    if n > most:
        raise ValueError(f"{n} keys in level {number}; the filters are bounded for {most}")
    size = max(64, (n * bits + 63) // 64 * 64)
    rows = (
        keys.select(F.explode(F.array(*_bits(F.col("key"), number, size, hashes))).alias("bit"))
        .groupBy(F.floor(F.col("bit") / F.lit(64)).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("bits"))
        .collect()
    )
    words = [0] * (size // 64)
    for row in rows:
        words[int(row["word"])] = row["bits"]
    return Level(size, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether ``key``, of the universe that the cascade was built for, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[number - 1].holds(key, number), answer).otherwise(F.lit(number % 2 == 0))
        return answer


def keys_table(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """Distinct keys as a table of the column ``key``, made from one literal."""
    text = json.dumps(sorted(set(keys)))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<string>")).alias("key"))


def build_cascades(lists: dict[str, list[str]], universe: DataFrame) -> dict[str, Cascade]:
    """A cascade for each list of keys, exact for every key of ``universe``.

    ``universe``, with a column ``key``, is read twice for all lists together:
    to count it and for level 2.  What later levels look at is stored, and
    about as long as the lists.
    """
    spark = universe.sparkSession
    listed = {name: keys_table(spark, keys) for name, keys in lists.items() if keys}
    if not listed:
        return {name: Cascade(()) for name in lists}
    total = universe.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    most = {name: SPARE * len(lists[name]) + 1000 for name in listed}
    first = {name: _level(t, 1, *_shape(len(set(lists[name])), total), most[name]) for name, t in listed.items()}
    met = universe.select("key", F.array_compact(F.array(*[F.when(level.holds(F.col("key"), 1), F.lit(name)) for name, level in first.items()])).alias("names"))
    taken = store(met.select("key", F.explode("names").alias("name")).distinct(), "taken")
    out = {name: Cascade(()) for name in lists}
    for name, level in first.items():
        levels, other = [level], listed[name]
        wrong = taken.where(F.col("name") == name).select("key").join(F.broadcast(other), "key", "left_anti")
        for number in range(2, MAX_LEVELS):
            level = _level(wrong, number, BITS, HASHES, most[name])
            if level is None:
                break
            levels.append(level)
            wrong, other = other.where(level.holds(F.col("key"), number)), wrong
        else:
            raise RuntimeError("the cascade did not end")
        out[name] = Cascade(tuple(levels))
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the filters are bounded for {MAX_RULES}")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = rows.select("page_id", "host", "path", _candidates(F.col("host"), F.col("path"), rules).alias("keys"))
    actions = sorted({r.action for r in rules})
    fits = build_cascades({a: [f"{r.host}\n{r.path}" for r in rules if r.action == a] for a in actions}, asked.select(F.explode("keys").alias("key")))

    def judge(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for action in actions:
            out = F.when(fits[action].lists(key), F.lit(action)).otherwise(out)
        return F.struct(key.alias("key"), out.alias("action"))

    best = F.get(F.filter(F.transform("keys", judge), lambda x: x["action"].isNotNull()), 0)
    judged = asked.select("page_id", "host", "path", best.alias("best"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.replace(F.col("best.key"), F.lit("\n"), F.lit("")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
