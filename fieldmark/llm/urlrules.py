"""URL allow and block rules by a sort-merge range join.

A host's labels are reversed and each is ended by a separator that sorts first, so a rule's host and all its subdomains are one
interval of keys, and intervals nest. Pages and rules are dealt by key ranges (a rule goes to every range that its interval
meets), sorted, and swept once: a stack holds the rules whose interval is open, the innermost on top. Path prefixes are looked
up on the open entries, so memory is the depth of the nesting, not the number of pages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import quoted, small, stash, without

END = "\x01"
#: Bounds on the ranges and on the keys sampled to place them. They shape the balance of tasks, never a result.
MOST_RANGES, ROWS_A_RANGE, KEYS_A_RANGE = 16_384, 1_000, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END))


def _fits(host: str, rule_host: str) -> bool:
    return host == rule_host or host.endswith("." + rule_host)


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Judge pages in key order, range by range; rules precede pages of the same key."""
    now, stack = None, []  # entries: key, host, {path: verdict}, path lengths, longest first
    for batch in batches:
        out = []
        rules, verdicts = [], []
        for at, key, is_page, host, path, verdict in zip(batch["range"], batch["key"], batch["is_page"], batch["host"], batch["path"], batch["rule_verdict"], strict=True):
            if at != now:
                now, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key or stack[-1][1] != host:
                    stack.append((key, host, {}, []))
                paths, lengths = stack[-1][2:]
                # One rule stated twice with both verdicts blocks.
                paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, rule_host, paths, lengths in reversed(stack):
                if _fits(host, rule_host):
                    for n in lengths:
                        if path[:n] in paths and len(path) >= n:
                            if best is None or len(rule_host) + n > best[0]:
                                best = (len(rule_host) + n, rule_host + path[:n], paths[path[:n]])
                            break
            rules.append(best and best[1])
            verdicts.append(best[2] if best else default)
        pages = batch[batch["is_page"]]
        out = pages.drop(columns=["range", "key", "is_page", "rule_verdict"])
        yield out.assign(rule=pd.Series(rules, index=out.index, dtype=object), verdict=pd.Series(verdicts, index=out.index, dtype=object))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns of every row of ``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path starts with its path. The rule with
    the longest host and path together wins, of two as long the one with the longer host. A null URL, or one without ``://``, has
    an empty host and path. Kept columns named like an added one are not returned. Rules with a null host, path or verdict are
    void.
    """
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict", "range", "key", "is_page", "rule_verdict")
    keep = tuple(c for c in keep if c.lower() not in added)
    keyed = pages.select(*[F.col(quoted(c)) for c in keep], url_host(F.col(quoted(url))).alias("host"), url_path(F.col(quoted(url))).alias("path")).withColumn("key", host_key(F.col("host")))

    rows = keyed.count()
    ranges = max(1, min(MOST_RANGES, rows // ROWS_A_RANGE))
    share = min(1.0, ranges * KEYS_A_RANGE / max(rows, 1))
    sample = sorted(r.key for r in keyed.select("key").sample(share, seed=7).collect())
    # A key that fills several ranges is listed as often, and its rows are spread over them.
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    @pandas_udf("int")
    def page_range(key: pd.Series, spread: pd.Series) -> pd.Series:
        lo, hi = [bisect_left(cuts, k) for k in key], [bisect_right(cuts, k) for k in key]
        return pd.Series([h if h - a < 2 else a + 1 + s % (h - a) for a, h, s in zip(lo, hi, spread, strict=True)], dtype="int32")

    @pandas_udf("array<int>")
    def rule_ranges(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(cuts, k), bisect_right(cuts, k + "\U0010ffff") + 1)) for k in key])

    spread = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in keep], "path"), F.lit(1 << 20)).cast("int")
    page_rows = keyed.withColumns({"is_page": F.lit(True), "rule_verdict": F.lit(None).cast("string"), "range": page_range("key", spread)})
    rule_rows = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.col("verdict").alias("rule_verdict"))
    rule_rows = rule_rows.withColumns({"key": host_key(F.col("host")), "is_page": F.lit(False)}).withColumn("range", F.explode(rule_ranges("key")))
    dealt = page_rows.unionByName(rule_rows, allowMissingColumns=True).repartition("range").sortWithinPartitions("range", "key", "is_page", "host", "path")
    schema = without(keyed, "key").schema.add("rule", "string").add("verdict", "string")
    return dealt.mapInPandas(lambda batches: sweep(batches, default), schema)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Rows of ``pages`` whose URL is allowed, with all their columns. Each distinct URL is judged once, and a row goes by its own
    URL's verdict; rows stay where they are if the blocked URLs are few enough to broadcast. A null URL gets the default."""
    own = pages.select(F.col(quoted(url)).alias("__url")).where("__url is not null").distinct()
    blocked = stash(judge_urls(own, rules, url="__url", keep=("__url",), default=default).where("verdict = 'block'").select("__url"))
    out = pages.join(small(blocked, blocked.count()), F.col(quoted(url)) == F.col("__url"), "left_anti")
    return out if default == "allow" else out.where(F.col(quoted(url)).isNotNull())
