"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a directory (a path that ends in "/"); it covers
the host, its subdomains and every path that starts with the directory. A
page's URL is looked up under each of its host's suffixes with each of its
path's directories, as far as the list has entries of so many labels and so
deep directories. The Bloom filter drops most lookups that hit nothing; the
join with the list decides about the rest, so no false positive is left. All
of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter a listed entry, and bits set for each entry; a block is one 64-bit word.
BITS_PER_ENTRY, BITS_SET = 16, 4
#: Blocks up to which the filter is a literal of the plan (8 bytes each); a longer one is joined by its block number.
LITERAL_BLOCKS = 16_384


def host_of(url: Column) -> Column:
    """The part after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; empty without "://"."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(key: Column) -> Column:
    bits = [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(entry, {i}), 64) as int))") for i in range(1, BITS_SET + 1)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def _block(blocks: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64(entry), {blocks}) as int)")


def bloom_filter(listed: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """(block, bits) of the entries, and the number of blocks; its size follows from the count of entries alone."""
    blocks = max(1, -(-entries * BITS_PER_ENTRY // 64))
    return listed.select(_block(blocks).alias("block"), _mask(F.col("entry")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks


def judged(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict, possible_hits for every row of pages.

    listed: (host, path, verdict) with canonical lower-case hosts and paths
    that start with "/" and end in "/". The longest entry that covers the URL
    decides, of equally long ones that with the longer host; without one the
    verdict is otherwise. A null URL, or one without "://", has an empty host
    and path and fits nothing. Repeated pages are judged each; an entry listed
    with two verdicts blocks. An empty list gives otherwise for all. A listed path
    that doesn't start and end in "/" is an error. However many labels and
    directories a URL has, it is looked up under no more than the list has.
    """
    rules = listed.select(F.concat("host", "path").alias("entry"), F.col("host").alias("rule_host"), "verdict").groupBy("entry", "rule_host").agg(F.max("verdict").alias("ruled"))
    labels_in, depth_in = F.size(F.split("host", r"\.")), F.size(F.split("path", "/")) - 1
    odd = F.count_if(~(F.startswith("path", F.lit("/")) & F.endswith("path", F.lit("/"))))
    n, most_labels, most_depth, wrong = listed.agg(F.countDistinct(F.concat("host", "path"), "host"), F.coalesce(F.max(labels_in), F.lit(1)), F.coalesce(F.max(depth_in), F.lit(1)), odd).first()
    if wrong:
        raise ValueError(f"{wrong} listed paths don't start and end in '/'")
    found = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Each host and path is looked up once, however many pages have it.
    places = found.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.least(F.lit(most_depth), F.size(steps) - 1)), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    folders = F.when(F.size(steps) > 1, folders).otherwise(F.array().cast("array<string>"))
    asked = places.select("host", "path", F.explode(suffixes).alias("of_host"), folders.alias("folders")).select("host", "path", "of_host", F.explode("folders").alias("folder"))
    asked = asked.select("host", "path", "of_host", F.concat("of_host", "folder").alias("entry"))
    bloom, blocks = bloom_filter(rules, n)
    if blocks <= LITERAL_BLOCKS:
        words = dict(bloom.collect())  # at most LITERAL_BLOCKS rows, whatever is listed
        bits = F.expr("array(" + ",".join(f"{words.get(b, 0)}L" if words.get(b, 0) > -(2**63) else "(-9223372036854775807L - 1L)" for b in range(blocks)) + ")")
        possible = asked.where(F.get(bits, _block(blocks)).bitwiseAND(_mask(F.col("entry"))) == _mask(F.col("entry")))
    else:
        possible = asked.withColumn("block", _block(blocks)).join(bloom, "block").where(F.col("bits").bitwiseAND(_mask(F.col("entry"))) == _mask(F.col("entry")))
    named = rules.select(F.col("entry").alias("rule"), F.col("rule_host").alias("of_rule"), "ruled")
    hits = possible.join(named, (F.col("entry") == F.col("rule")) & (F.col("of_host") == F.col("of_rule"))).select("host", "path", "rule", "ruled", F.struct(F.length("rule"), F.length("of_rule")).alias("rank"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruled"), "rank").alias("best"))
    return found.join(best, ["host", "path"], "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(otherwise)).alias("verdict"))
