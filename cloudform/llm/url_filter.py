"""URL filters: path rules by host, and a blocked Bloom filter with an exact join for a list of canonical URLs.

A URL's host is what follows its first `://` up to `/`, `?`, `#` or its end, A-Z in lower case; its path goes on up to
`?`, `#` or the end. A rule `host/path` fits its host and all subdomains if the path starts with the rule's; the longest
fitting rule decides. The other URLs are looked up in the list: host and path without final slashes form the canonical
URL. A blocked Bloom filter (blocks of 512 bits, seven bits for a URL in one block) lets nearly only listed URLs through
to an exact join, which removes false hits. Its size follows from the number of listed URLs and the wanted rate of false
hits, up to a bound; beyond that more URLs go on to the join. Listed: block. Not listed: allow.

A null URL or one without `://` has an empty host and path, fits no rule and is on no list. Repeated rows get the same
verdict each. The list may hold nulls and repeats, which don't matter, and be empty. Columns other than page_id and url are
left away, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch, column, longs

# The rules to apply, longest host and path first is worked out below.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 7
MARKS = r"\*\*\*|%%%|###|\$\$\$"  # of junk in pages


def split_url(url: str) -> tuple[F.Column, F.Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, SMALL), part(2)


def canonical(host: F.Column, path: F.Column) -> F.Column:
    return F.when(host != "", F.concat(host, F.rtrim(path, F.lit("/"))))


def rule_for(host: F.Column, path: F.Column, rules: dict[str, str]) -> F.Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def filter_blocks(n: int, rate: float, most_bytes: int) -> int:
    """Blocks of 64 bytes for n keys at a rate of false hits; a third more than a filter without blocks takes."""
    bits = n * math.log(1 / rate) / math.log(2) ** 2 * 4 / 3
    return max(16, min(math.ceil(bits / 512), most_bytes // 64))


def bloom(keys: DataFrame, blocks: int) -> np.ndarray:
    """Bits of all keys: `blocks` * 8 words whatever their number."""
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    bit = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.expr("0L") + F.pmod(F.xxhash64("key", k), F.lit(512))))
    spots = keys.select(block.alias("block"), bit.alias("bit"))
    word = (F.col("block") * 8 + F.shiftright("bit", 6)).alias("word")
    rows = spots.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(blocks * 8, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def probed(filter_):
    def run(frames):
        words = filter_.value
        for batch in frames:
            first = longs(batch, "block") * 8
            hit = np.ones(len(batch), bool)
            for k in range(BITS):
                bit = longs(batch, f"bit{k}")
                hit &= (words[first + (bit >> 6)] >> (bit & 63)) & 1 == 1
            names = ["page_id", "host", "path", "rule", "key"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(hit)], [*names, "maybe"])

    return run


def url_filter(pages: DataFrame, listed: DataFrame, *, rules: dict[str, str] | None = None, rate: float = 0.01, most_bytes: int = 1 << 25) -> DataFrame:
    """page_id, host, path, rule, verdict, maybe (passed by the Bloom filter) and listed of each row of pages(page_id, url).

    listed(key) holds canonical URLs. The filter lets about `rate` of the other URLs through, as far as most_bytes allow.
    """
    spark = pages.sparkSession
    s = Scratch(spark)
    rules = RULES if rules is None else rules
    host, path = split_url("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("rule"), canonical(F.col("host"), F.col("path")).alias("key"))
    keys = s.put(listed.where("key is not null").select("key").distinct(), "listed")
    blocks = filter_blocks(keys.count(), rate, most_bytes)
    filter_ = spark.sparkContext.broadcast(bloom(keys, blocks))
    bits = [F.pmod(F.xxhash64("key", F.lit(k)), F.lit(512)).cast("long").alias(f"bit{k}") for k in range(BITS)]
    open_ = keyed.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long").alias("block"), *bits)
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, key string, maybe boolean"
    seen = s.put(open_.mapInArrow(probed(filter_), kind).withColumn("maybe", F.col("maybe") & F.col("key").isNotNull()), "probed")
    exact = seen.where("maybe").join(keys.withColumn("hit", F.lit(True)), "key", "left")
    rest = seen.where("not maybe").withColumn("hit", F.lit(False))
    out = exact.select(*seen.columns, "hit").union(rest.select(*seen.columns, "hit"))
    listed_ = F.coalesce("hit", F.lit(False))
    verdict = F.lit(None).cast("string")
    for rule, decided in rules.items():
        verdict = F.when(F.col("rule") == rule, decided).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(listed_, "block").otherwise("allow")).alias("verdict"), "maybe", listed_.alias("listed"))


def listed_by_text(pages: DataFrame, marks: str = MARKS, letters: int = 50) -> DataFrame:
    """A list for url_filter: canonical URLs of the pages whose html has a mark of junk for every `letters` characters."""
    host, path = split_url("url")
    junk = pages.where(F.regexp_count("html", F.lit(marks)) * letters >= F.length("html")).select(host.alias("host"), path.alias("path"))
    return junk.select(canonical(F.col("host"), F.col("path")).alias("key"))
