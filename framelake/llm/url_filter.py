"""URL rules by a sorted digest array."""
from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this many bytes travel with the tasks (an array of digests and the rule strings); larger lists are joined.
MAX_RULE_BYTES = 64 << 20
DEFAULT_VERDICT = "allow"


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first '://' up to '/', '?', '#' or the end; path from there up to '?', '#' or the
    end. Both empty without a '://'."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    start, cut = at + 3, len(url)
    for c in "?#":
        i = url.find(c, start)
        cut = i if 0 <= i < cut else cut
    slash = url.find("/", start, cut)
    host, path = (url[start:cut], "") if slash < 0 else (url[start:slash], url[slash:cut])
    return (host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)), path


def split_rule(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


class DigestArray:
    """Rule strings sorted by their 64-bit xxhash. The keys lie in a file that is memory-mapped; lookups are one
    vectorised binary search, and what it finds is compared with the stored string, so digest collisions never match."""

    def __init__(self, rules: dict[str, str], folder: str):
        keys = sorted((xxhash.xxh64_intdigest(r.encode()), r) for r in rules)
        path = os.path.join(folder, "digests.npy")
        np.save(path, np.array([k for k, _ in keys], dtype=np.uint64))
        self.keys = np.load(path, mmap_mode="r")
        self.rules = np.array([r for _, r in keys], dtype=object)
        self.verdicts = np.array([rules[r] for _, r in keys], dtype=object)
        self.run = int(np.unique(self.keys, return_counts=True)[1].max()) if len(keys) else 0
        self.path_lengths = sorted({len(split_rule(r)[1]) for r in rules})

    def find(self, names: list[str]) -> np.ndarray:
        """Positions of the names among the rules, -1 where there is none."""
        out = np.full(len(names), -1, dtype=np.int64)
        if not names or not len(self.keys):
            return out
        digest = np.fromiter((xxhash.xxh64_intdigest(n.encode()) for n in names), dtype=np.uint64, count=len(names))
        low = np.searchsorted(self.keys, digest)
        for step in range(self.run):                    # as many steps as rules share one digest
            at = np.minimum(low + step, len(self.keys) - 1)
            for i in np.flatnonzero((self.keys[at] == digest) & (out < 0)):
                if self.rules[at[i]] == names[i]:
                    out[i] = at[i]
        return out


def candidates(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Every rule string that would fit this url, longest first; of equally long ones that of the longer host."""
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1:])
        at = host.find(".", at + 1)
    # a rule is cut at its first '/', so a rule path is empty or begins with '/'
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts if h for n in path_lengths if n <= len(path)]
    return [c for _, _, c in sorted(found, reverse=True)]


def url_filter(pages: DataFrame, rules: dict[str, str], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages with columns host, path, rule and verdict added (columns of these names are replaced).

    rules: rule string (host and path, like 'example.net/en/') to 'allow' or 'block'. A rule fits its host and all
    subdomains when the url's path starts with the rule's path; the longest rule wins, of equally long ones that with the
    longer host. No rule: rule is null and the verdict is the default. Null urls and urls without '://' have an empty host
    and path and no rule. Rows are kept one to one, repeated ones too; nothing is shuffled. The rules travel with the
    tasks and must be within MAX_RULE_BYTES; use url_filter_joined for longer lists."""
    if sum(len(r.encode()) + 8 for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"rules take over {MAX_RULE_BYTES} bytes: use url_filter_joined")
    out = pages.drop("host", "path", "rule", "verdict")

    def judge(batches):
        with tempfile.TemporaryDirectory() as folder:
            array = DigestArray(rules, folder)
            for urls in batches:
                parts = [url_parts(None if u is None or u != u else u) for u in urls]
                names, owner = [], []
                for i, (h, p) in enumerate(parts):
                    c = candidates(h, p, array.path_lengths)
                    names += c
                    owner += [i] * len(c)
                at, best = array.find(names), np.full(len(parts), -1, dtype=np.int64)
                for k in np.flatnonzero(at >= 0)[::-1]:         # the first of a row's candidates is written last
                    best[owner[k]] = at[k]
                hit = best >= 0
                rule, verdict = np.full(len(parts), None, dtype=object), np.full(len(parts), default, dtype=object)
                rule[hit], verdict[hit] = array.rules[best[hit]], array.verdicts[best[hit]]
                yield pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": verdict})

    judged = F.pandas_udf(_typed(judge), "host string, path string, rule string, verdict string")
    return out.withColumn("_judged", judged(F.col(url))).select(*out.columns, "_judged.*")


def _typed(judge):
    from collections.abc import Iterator

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from judge(batches)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def url_filter_joined(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same judgement when the rules are a table (rule, verdict) of any size: candidate strings meet the rules in an
    equi join on digest and string. Returns key, host, path, rule, verdict; key must be unique. A rule listed with both
    verdicts blocks."""
    listed = (rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
              .withColumn("digest", F.xxhash64("rule")))
    lengths = [r[0] for r in listed.select(F.length(F.regexp_extract("rule", "(/.*)?$", 0))).distinct().limit(10_001).collect()]
    if len(lengths) > 10_000:
        raise ValueError("rule paths of over 10,000 lengths")

    @F.pandas_udf("host string, path string, names array<string>")
    def cut(urls: pd.Series) -> pd.DataFrame:
        parts = [url_parts(None if u is None or u != u else u) for u in urls]
        return pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "names": [candidates(h, p, lengths) for h, p in parts]})

    cutted = pages.select(F.col(key), cut(F.col(url)).alias("c")).select(key, "c.*")
    tried = cutted.select(key, F.posexplode("names").alias("place", "rule")).withColumn("digest", F.xxhash64("rule"))
    best = (tried.join(listed, ["digest", "rule"]).groupBy(key)
            .agg(F.min(F.struct("place", "rule", "verdict")).alias("b")))
    return (cutted.drop("names").join(best, key, "left")
            .select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict")))
