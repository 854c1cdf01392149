"""Token budget per source, language and domain, kept by signed deltas (problem 4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import hadoop, remove_at_end, shared_folder, written
from tokenmill.llm.encode import BYTE_BPE, token_counts

DEFAULT_DOMAIN = "__default__"


def clean_domain(column):
    """Case and blanks around a domain mean nothing; null and blank are the default domain."""
    name = F.lower(F.trim(column))
    return F.when(F.length(name) > 0, name).otherwise(F.lit(DEFAULT_DOMAIN))


def domains(ids: DataFrame, built: DataFrame, id_col: str) -> DataFrame:
    """id and ``domain`` of every id: that of the built record, or the default.

    Only id and domain of ``built`` are read, one row per id (the least domain,
    should deliveries differ), so no record is counted twice.
    """
    own = built.select(F.col(id_col).alias("_id"), clean_domain(built["domain"]).alias("_domain"))
    own = own.filter("_id is not null").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    each = ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    return each.join(own, each[id_col] == own["_id"], "left").select(id_col, F.coalesce("_domain", F.lit(DEFAULT_DOMAIN)).alias("domain"))


class TokenBudget:
    """Cubes of records and tokens that follow snapshots of a corpus.

    State, a folder of versions: ``members`` (id, slice, content hash, tokens), ``counts`` (hash of content and
    tokenizer, tokens: every text ever seen) and ``cube`` (slice, records, tokens). ``path`` names the folder; a later
    session that opens it goes on from its last whole version (the one before is kept, older ones are removed). Without
    a path the state lasts as long as the session.

    Every snapshot, the first too, is compared by (slice, hash) without its texts; each text whose hash isn't in
    ``counts`` is encoded once, however many records hold it, and the cube takes +1 and -1 rows for new, changed and
    removed records.

    Null texts count as a record of no tokens, like empty ones. Rows without id are left out. An id delivered more than
    once counts once, with its latest row if ``order_col`` is given. Null slices are slices of their own. Dimensions
    that the snapshot lacks come from ``attributes`` by id (one row an id).
    """

    TABLES = ("members", "counts", "cube")

    def __init__(self, id_col: str, text_col: str, dims: list[str], tokenizer: str = BYTE_BPE, order_col: str | None = None, path: str | None = None):
        self.id_col, self.text_col, self.dims, self.tokenizer, self.order_col, self.path = id_col, text_col, dims, tokenizer, order_col, path
        self.members: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.cube: DataFrame | None = None
        self.encoded, self.version = 0, 0

    def _folder(self, spark: SparkSession) -> str:
        if self.path is None:
            self.path = f"{shared_folder(spark)}/budget-{uuid.uuid4().hex}"
            remove_at_end(spark, self.path)
        return self.path.rstrip("/")

    def _versions(self, spark: SparkSession) -> list[int]:
        """Versions of which all is written, in order."""
        at, fs = hadoop(spark, f"{self._folder(spark)}/v*/done")
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(at) or [])

    def open(self, spark: SparkSession) -> DataFrame | None:
        """The cube of the last version in ``path``, which further updates go on from; null if there is none."""
        if versions := self._versions(spark):
            self.version = versions[-1]
            for name in self.TABLES:
                setattr(self, name, spark.read.parquet(f"{self._folder(spark)}/v{self.version}/{name}"))
        return self._shown() if versions else None

    def _shown(self) -> DataFrame:
        return self.cube.select(*[F.col(f"slice.{d}").alias(d) for d in self.dims], "records", "tokens")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._folder(df.sparkSession)}/v{self.version + 1}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _close(self, spark: SparkSession) -> None:
        """Mark the version as whole, then remove all but it and the one before."""
        self.version += 1
        at, fs = hadoop(spark, f"{self._folder(spark)}/v{self.version}/done")
        fs.create(at, True).close()
        for old in self._versions(spark)[:-2]:
            fs.delete(hadoop(spark, f"{self._folder(spark)}/v{old}")[0], True)

    def _hashed(self, snapshot: DataFrame):
        return F.unhex(F.md5(F.concat_ws("\0", F.lit(self.tokenizer), F.coalesce(snapshot[self.text_col], F.lit("")))))

    def _now(self, snapshot: DataFrame, attributes: DataFrame | None) -> DataFrame:
        """id, slice and hash of every record once, without its text."""
        order = F.col(self.order_col) if self.order_col else F.lit(0)
        own = [d for d in self.dims if d in snapshot.columns]
        rows = snapshot.filter(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).alias("id"), order.alias("at"), self._hashed(snapshot).alias("hash"), *own)
        rows = rows.groupBy("id").agg(F.max(F.struct("at", "hash", *own)).alias("row")).select("id", "row.*").drop("at")
        if attributes is not None:
            more = [d for d in self.dims if d not in own]
            rows = rows.join(attributes.select(F.col(self.id_col).alias("id"), *more), "id", "left")
        return rows.select("id", F.struct(*self.dims).alias("slice"), "hash")

    def update(self, snapshot: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
        spark = snapshot.sparkSession
        now = self._now(snapshot, attributes)
        if self.cube is None and self.open(spark) is None:
            empty = now.limit(0)
            self.members = empty.withColumn("n_tokens", F.lit(0).cast("bigint"))
            self.counts = self.members.select("hash", "n_tokens")
            self.cube = self.members.select("slice", F.lit(0).cast("bigint").alias("records"), F.lit(0).cast("bigint").alias("tokens"))
        old = self.members.select("id", F.col("slice").alias("was"), F.col("hash").alias("had"), F.col("n_tokens").alias("took"))
        changed = now.join(old, "id", "full").filter(~(F.col("slice").eqNullSafe(F.col("was")) & F.col("hash").eqNullSafe(F.col("had"))))
        changed = written(changed, "budget-changed")
        texts = snapshot.filter(F.col(self.id_col).isNotNull()).select(self._hashed(snapshot).alias("hash"), F.col(self.text_col).alias("text"))
        unseen = changed.filter("hash is not null").select("hash").distinct().join(self.counts.select("hash"), "hash", "left_anti")
        once = texts.join(unseen, "hash", "left_semi").dropDuplicates(["hash"])
        fresh = written(token_counts(once, "text", self.tokenizer), "budget-fresh")
        self.encoded = fresh.count()
        counts = self._keep("counts", self.counts.unionByName(fresh))
        plus = changed.filter("hash is not null").join(counts, "hash").select("id", "slice", "hash", "n_tokens")
        minus = changed.filter("had is not null").select(F.col("was").alias("slice"), F.lit(-1).cast("bigint").alias("records"), (-F.col("took")).alias("tokens"))
        deltas = plus.select("slice", F.lit(1).cast("bigint").alias("records"), F.col("n_tokens").alias("tokens")).unionByName(minus)
        cube = self.cube.unionByName(deltas).groupBy("slice").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens")).filter("records > 0")
        cube = self._keep("cube", cube)
        members = self._keep("members", self.members.join(changed.select("id"), "id", "left_anti").unionByName(plus))
        self._close(spark)
        self.members, self.counts, self.cube = members, counts, cube
        return self._shown()
