"""URL filters: a sort-merge range join of urls with (host, path prefix) rules.

A host is written with its labels reversed, each ended by a byte 0x01 (one inside a
label is escaped), so that a host and all its subdomains are one interval of keys:
rule host `example.net` is `net\\x01example\\x01` up to the next string that doesn't
start with it. Urls and
rules are dealt into the same key ranges, sorted, and swept once with a stack
of the host intervals that are open; nested rules lie above each other. Of the
open rules whose path starts the url's path the longest (host and path) wins,
then the first in (host, path, verdict) order.

Ranges are bounded by (key, id) of urls of least hash, one range for each RANGE_ROWS
urls, so one hot host is spread over several ranges; a rule goes to each range that
its interval meets. The bounds steer the balance only, never the result. Two jobs, a
count and the choice of bounds (a few for each range), run while the plan is built.

Null ids are passed through. Null urls and urls without `://` have an empty host and path; no rule fits them.
Null rules are ignored, an empty rule host fits every url that has a host.
Repeated urls and ids keep one row each; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: A key after all that start with a prefix ending in 0x01: the last byte becomes 0x02.
_LABEL_END, _AFTER = "\x01", "\x02"
#: Urls of one range, and urls looked at for each bound.
RANGE_ROWS, LOOKED_AT = 100_000, 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    host = F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def host_key(host: Column) -> Column:
    plain = F.replace(F.replace(host, F.lit(_AFTER), F.lit(_AFTER + "b")), F.lit(_LABEL_END), F.lit(_AFTER + "a"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), _LABEL_END), F.lit(_LABEL_END)))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, kind): kind 0 opens a rule's host interval, kind 1 is a url."""
    stack: list[tuple[str, list]] = []
    current = None
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for part, key, kind, pid, host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != current:
                stack, current = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((-len(host) - len(path), host, path, verdict))
                continue
            best = min((r for _, rules in stack for r in rules if path.startswith(r[2])), default=None) if host else None
            for o, x in zip(out, (pid, host, path, best and best[1] + best[2], best[3] if best else default), strict=True):
                o.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 0 else pa.string()) for i, x in enumerate(out)], names=["page_id", "host", "path", "rule", "verdict"])


def url_filter(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of `urls`: the rule that wins and its verdict, or `default`. `rules` has host, path, verdict."""
    spark = urls.sparkSession
    host, path = split_url(F.col("url"))
    u = urls.select(urls[id_col].cast("long").alias("id"), urls[url_col].cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    u = u.withColumn("key", host_key(F.col("host")))
    count = u.count()
    n = -(-count // RANGE_ROWS) + int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = F.xxhash64("id", "key", F.lit(7)).bitwiseAND(F.lit((1 << 62) - 1)) < int(min(1.0, LOOKED_AT * n / max(count, 1)) * (1 << 62))
    ends = sorted({(r["key"], r["id"] or 0) for r in u.where(least).select("key", "id").collect()})
    n = max(1, min(len(ends), n))
    bounds = [ends[len(ends) * k // n] for k in range(1, n)] if ends else []

    @F.pandas_udf("int")
    def range_of(key, pid):
        import pandas as pd

        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(key, pid.fillna(0).astype("int64"), strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key):
        import pandas as pd

        top = lambda k: (k[:-1] + _AFTER,) if k else (chr(0x10FFFF),)
        return pd.Series([list(range(bisect.bisect_left(bounds, (k,)), bisect.bisect_right(bounds, top(k)) + 1)) for k in key])

    rule = rules.select(F.translate(rules["host"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), rules["path"].cast("string").alias("path"), rules["verdict"].cast("string").alias("verdict")).dropna()
    rule = rule.withColumn("key", host_key(F.col("host"))).withColumn("part", F.explode(ranges_of("key")))
    both = u.select(range_of("key", "id").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(rule.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path", "verdict"))
    return both.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "kind", "id").mapInArrow(lambda it: _sweep(it, default), SCHEMA)
