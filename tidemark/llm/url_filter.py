"""URL rules answered by Bloom filter cascades: exact membership without a join.

A rule is a host and a path prefix; it fits the host and its subdomains. Every URL gives the keys
"host suffix + path prefix" for the prefix lengths that rules have, and the keys of all URLs are the
universe. Level 1 of a cascade encodes the listed keys, level 2 the universe's keys that level 1
takes wrongly, level 3 the listed keys that level 2 takes, and so on until nothing is taken wrongly:
over the universe the first level that refuses a key decides exactly. One cascade tells whether a
key is listed, a second one whether a listed key allows.

The rule list is configuration and bounded by ``MAX_RULES``; level 1 is sized so that its false
positives over the universe are about as many as the rules, so all levels are bounded by the list,
not by the corpus.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and the
verdict of an unlisted URL. Of fitting rules the one with most characters wins, then the longer host.
A null or empty rule list blocks nothing. Rules that contradict each other are refused. Repeated rows are judged
alike, each in its own row. URLs of any length are read whole. An empty table gives an empty result. Extra columns
play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

MAX_RULES = 1_000_000
UNLISTED = "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Bloom:
    """A bit array with as many hash functions as its false-positive rate asks for."""

    def __init__(self, keys: Iterable[str], rate: float, seed: int):
        keys = list(keys)
        self.seed = seed
        self.bits = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, len(keys)) * math.log(2))) if keys else 1
        self.hashes = min(self.hashes, 40)
        self.array = np.zeros(self.bits, dtype=bool)
        for key in keys:
            self.array[self._at(key)] = True
        self.array = np.packbits(self.array)

    def _at(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), seed=self.seed)
        a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.array[i >> 3] >> (7 - (i & 7)) & 1 for i in self._at(key))


class Cascade:
    """Levels that alternately encode listed keys and keys taken wrongly."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def finish_cascade(first: Bloom, listed: set[str], wrong: set[str]) -> Cascade:
    """The cascade above a first level whose wrongly taken keys are known."""
    levels, yes, no = [first], set(listed), set(wrong)
    while no:
        level = Bloom(no, 0.5, seed=len(levels))
        levels.append(level)
        yes, no = no, {k for k in yes if k in level}
    return Cascade(levels)


def keys_of(host: str, path: str, lengths: list[int]) -> Iterator[tuple[int, int, str]]:
    """Length of key and host part, and the key, for every host suffix and rule length."""
    if not host:
        return
    labels = host.split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for n in lengths:
            if n <= len(path):
                yield len(suffix) + n, len(suffix), suffix + path[:n]


def _key_column(host: Column, path: Column, lengths: list[int]) -> Column:
    labels = F.split(host, r"\.")
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def build(urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> tuple[Cascade, Cascade, list[int]]:
    """Cascades of listed and of allowing keys over the key universe of ``urls``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    verdicts: dict[str, str] = {}
    for verdict, host, path in rules:
        if verdicts.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"rule {host + path} both allows and blocks")
    lengths = sorted({len(path) for _, _, path in rules})
    listed = set(verdicts)
    allowing = {k for k, v in verdicts.items() if v == "allow"}
    second = finish_cascade(Bloom(allowing, 0.5, 101), allowing, {k for k in listed - allowing if k in Bloom(allowing, 0.5, 101)})
    if not listed:
        return Cascade([Bloom([], 0.5, 0)]), second, lengths
    universe = urls.select(F.explode(_key_column(host_of(F.col(url)), path_of(F.col(url)), lengths)).alias("key"))
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    rate = min(0.5, len(listed) / (math.sqrt(2) * max(1, size)))
    first = Bloom(listed, rate, 0)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["key"].drop_duplicates()
            yield pd.DataFrame({"key": [k for k in keys if k in first]}, dtype=object)

    # Taken keys are listed ones and about as many others again, whatever the corpus holds.
    positive = universe.mapInPandas(taken, "key string").groupBy("key").agg(F.count("*").alias("n")).select("key")
    wrong = {r["key"] for r in positive.toLocalIterator()} - listed
    return finish_cascade(first, listed, wrong), second, lengths


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], ident: str = "page_id", url: str = "url") -> DataFrame:
    """Per URL: identifier, ``host``, ``path``, ``rule`` (or null) and ``verdict``."""
    base = urls.select(F.col(ident).alias("id"), F.col(url).alias("url"))
    listed, allowing, lengths = build(base, rules)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rule, verdict = [], []
            for host, path in zip(pdf["host"], pdf["path"], strict=True):
                fit = max((x for x in keys_of(host, path, lengths) if x[2] in listed), default=None)
                rule.append(fit and fit[2])
                verdict.append(UNLISTED if fit is None else "allow" if fit[2] in allowing else "block")
            yield pdf.assign(rule=pd.Series(rule, index=pdf.index, dtype=object), verdict=pd.Series(verdict, index=pdf.index, dtype=object))

    # Equal host and key reach are decided once per batch only through the cascade; no row is joined.
    parts = base.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = dict(parts.dtypes)["id"]
    return parts.mapInPandas(decide, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", ident)
