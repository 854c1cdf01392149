"""Pages of a prefix cache: hashes, the longest cached prefix, allocation with reference counts and eviction."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE = 31  # fixed value


def page_hash(ids: Column, base: int = BASE) -> Column:
    """Polynomial hash of a page's ids (0 or more) in 64 unsigned bits, as DECIMAL(38,0); only of the page itself, so equal pages share it.

    The fold holds two halves of 32 bits in BIGINTs, which never overflow.
    """
    low = F.lit((1 << 32) - 1)
    zero = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))

    def step(h: Column, x: Column) -> Column:
        lo = h["lo"] * base + x
        return F.struct((h["hi"] * base + F.shiftright(lo, 32)).bitwiseAND(low).alias("hi"), lo.bitwiseAND(low).alias("lo"))

    whole = lambda h: (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + h["lo"]).cast("decimal(38,0)")
    return F.aggregate(ids, zero, step, whole)


def pages(df: DataFrame, key: str, ids: str, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Full pages of each row: key, the columns ``keep``, ``page`` (from 0) and ``hash``."""
    n = F.floor(F.size(ids) / size)
    each = df.filter(n > 0).select(key, *keep, ids, F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return each.select(key, *keep, "page", page_hash(F.slice(ids, (F.col("page") * size + 1).cast("int"), F.lit(size))).alias("hash"))


def cached_prefix(requests: DataFrame, cached: DataFrame, key: str, ids: str, size: int) -> DataFrame:
    """key and ``cached_pages``: how many leading full pages are all in ``cached`` (a table with ``hash``)."""
    mine = pages(requests, key, ids, size)
    hit = mine.join(cached.select("hash").distinct().withColumn("hit", F.lit(1)), "hash", "left")
    return _leading(hit, requests, key)


def cached_before(requests: DataFrame, seen: DataFrame, key: str, ids: str, at: str, size: int) -> DataFrame:
    """key and ``cached_pages`` where every request comes at its time ``at`` and the cache holds the full pages of all rows ``seen`` earlier.

    Rows of ``seen`` may come several times; the earliest counts.
    """
    first = pages(seen, key, ids, size, (at,)).groupBy("hash").agg(F.min(at).alias("_first"))
    mine = pages(requests, key, ids, size, (at,)).join(first, "hash", "left")
    return _leading(mine.withColumn("hit", (F.col("_first") < F.col(at)).cast("int")), requests, key)


def _leading(hit: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    run = hit.withColumn("ok", F.min(F.coalesce("hit", F.lit(0))).over(w))
    found = run.groupBy(key).agg(F.sum("ok").alias("cached_pages"))
    return requests.select(key).join(found, key, "left").select(key, F.coalesce("cached_pages", F.lit(0)).alias("cached_pages"))


class PageTable:
    """The lowest free page first; pages in use are counted, cached ones without users go out least recently used first."""

    def __init__(self, count: int):
        self.free = (1 << count) - 1
        self.users: dict[int, int] = {}
        self.by_hash: dict[int, int] = {}
        self.hash_of: dict[int, int] = {}
        self.idle: OrderedDict[int, None] = OrderedDict()

    def alloc(self) -> int | None:
        if not self.free:
            if not self.idle:
                return None
            page, _ = self.idle.popitem(last=False)
            self.by_hash.pop(self.hash_of.pop(page), None)
            self.free |= 1 << page
        page = (self.free & -self.free).bit_length() - 1
        self.free &= ~(1 << page)
        self.users[page] = 1
        return page

    def record(self, page: int, key: int) -> None:
        self.by_hash[key], self.hash_of[page] = page, key

    def lookup(self, keys: list[int]) -> list[int]:
        """Pages of the longest known run of leading keys; each gets one more user."""
        out = []
        for k in keys:
            if (page := self.by_hash.get(k)) is None:
                break
            self.users[page] = self.users.get(page, 0) + 1
            self.idle.pop(page, None)
            out.append(page)
        return out

    def release(self, page: int) -> None:
        self.users[page] -= 1
        if not self.users[page]:
            del self.users[page]
            if page in self.hash_of:
                self.idle[page] = None
            else:
                self.free |= 1 << page
