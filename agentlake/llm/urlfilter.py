"""Operator 3: URL filter by a blocked Bloom filter and an exact join.

Listed URLs and the URLs to filter are made canonical: scheme, 'www.', port
80/443, fragment, tracking parameters (utm_*, ref, fbclid, gclid), a closing
slash and 'index.html' do not matter, the rest of the query is sorted, host in
lower case.  The list becomes a blocked Bloom filter: a hash picks one block of
256 bits and BITS bits in it, so that a probe reads one block.  The blocks are
rows, built by a distributed aggregation and joined to the URLs by their number:
by broadcast up to MAX_BLOCKS blocks (40 bytes each), beyond by a shuffle of the
URLs' hashes.  What passes meets the list in an exact join, which removes false
positives.

Everything runs in the JVM.  Defined results: null and empty URLs never match,
and null or empty list entries list nothing; a URL that cannot be taken apart
is compared as it is; repeated rows match each, repeated entries count once;
an empty list matches nothing; other columns of pages are kept by ``matches``
and ``drop_listed`` and may be named anything (``matches`` puts its canonical URL
in place of an own column ``canonical_url``); ``drop_listed`` goes by the URL of each
row, whatever its page_id, null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, settle, unused

BITS, KEYS_PER_BLOCK, MAX_BLOCKS = 6, 16, 2_000_000
_TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical(url: Column) -> Column:
    """The canonical form of a URL."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/index\.html?|/+)$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(_TRACKING))))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Four 64-bit words with the bits of a key."""
    bits = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(256)) for i in range(BITS)]
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for b in bits:
            bit = F.call_function("shiftleft", F.expr("1L"), F.pmod(b, F.lit(64)).cast("int"))
            word = word.bitwiseOR(F.when(F.floor(b / 64) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom(listed: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, int]:
    """(block, four words) of the distinct keys, under the given names; the number of blocks."""
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    rows = listed.select(_block(F.col(key), blocks).alias(names[0]), *(m.alias(n) for m, n in zip(_masks(F.col(key)), names[1:], strict=True)))
    return rows.groupBy(names[0]).agg(*(F.bit_or(n).alias(n) for n in names[1:])), blocks


def passing(keyed: DataFrame, listed: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key the filter lets through: all listed ones, and few others."""
    names: list[str] = []
    for i in range(10):
        names.append(unused([*keyed.columns, *names], f"__url_{i}"))
    found, blocks = bloom(listed, key, names[:5])
    hashed = keyed.withColumns({names[5]: _block(F.col(key), blocks), **dict(zip(names[6:], _masks(F.col(key)), strict=True))})
    hit = F.lit(True)
    for word, mask in zip(names[1:5], names[6:], strict=True):
        hit = hit & (F.col(word).bitwiseAND(F.col(mask)) == F.col(mask))
    return hashed.join(F.broadcast(found) if blocks <= max_blocks else found, F.col(names[0]) == F.col(names[5])).where(hit).select(*(named(c) for c in keyed.columns))


def listing(urls: DataFrame, key: str = "__url_key") -> DataFrame:
    """The distinct canonical forms of column ``url``."""
    return settle(urls.select(canonical(F.col("url")).alias(key)).where(F.col(key) != "").distinct())


def matches(pages: DataFrame, urls: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of pages whose canonical URL is listed, with it as ``canonical_url``."""
    key = unused(pages.columns, "__url_key")
    listed = listing(urls, key)
    keyed = pages.withColumn(key, canonical(F.col("url"))).where(F.col(key) != "")
    found = passing(keyed, listed, key, max_blocks).join(listed, key, "left_semi")
    return found.select(*(F.col(named(c)) for c in pages.columns if c.lower() != "canonical_url"), F.col(key).alias("canonical_url"))


def drop_listed(pages: DataFrame, urls: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of pages whose canonical URL is not listed."""
    key = unused(pages.columns, "__url_key")
    gone = unused([*pages.columns, key], "__url_gone")
    found = settle(matches(pages.select("url"), urls, max_blocks).select(F.col("canonical_url").alias(gone)).distinct())
    keyed = pages.withColumn(key, canonical(F.col("url")))
    return keyed.join(found, F.col(key) == F.col(gone), "left_anti").select(*(F.col(named(c)) for c in pages.columns))
