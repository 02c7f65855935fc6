"""Document sinks and verified publication."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTENT_VERSION = 1
INTENT = "version int, destination string, rows bigint, digest string"


class PublicationError(RuntimeError):
    """The table may not be published at this destination."""


def to_documents(df: DataFrame, path: str) -> None:
    """A stage table as JSON lines. Rows are written where they are, so a large book is many files."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def book_documents(df: DataFrame, order: list[str], key: str = "book_id", rows_per_part: int = 10000) -> DataFrame:
    """JSON documents per book, in numbered parts of bounded size (part = first order column div size)."""
    part = F.floor(F.col(order[0]) / rows_per_part).cast("bigint")
    rest = [c for c in df.columns if c not in (key, *order)]
    listed = df.groupBy(key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))
    return listed.select(key, "part", F.to_json("rows", {"ignoreNullFields": "false"}).alias("json"))


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and the sum of 60-bit row hashes. One row."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), total.alias("digest"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _text(files, path) -> str:
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _lease(spark: SparkSession, destination: str, intents: str, owner: str, seconds: float) -> str:
    """Take the only right to publish at ``destination``: a file that one attempt alone can create.

    A lease older than ``seconds`` belongs to an attempt that died. Its file is moved away, which again only one can do, and
    checked to be the one that was read; what that attempt had staged is removed."""
    name = f"{intents}/{hashlib.sha256(destination.encode()).hexdigest()}.lease"
    path, files = _files(spark, name)
    for _ in range(2):
        try:
            stream = files.create(path, False)
            stream.write(owner.encode())
            stream.close()
            return name
        except Exception as error:  # noqa: BLE001  whatever the store says when the file is there
            if not files.exists(path):
                raise PublicationError(f"no lease for {destination}") from error
        age = time.time() - files.getFileStatus(path).getModificationTime() / 1000
        holder = _text(files, path)
        if age < seconds:
            raise PublicationError(f"another publication of {destination} is under way")
        aside = _files(spark, f"{name}-{owner}")[0]
        if files.rename(path, aside):
            if _text(files, aside) != holder:
                files.rename(aside, path)
                raise PublicationError(f"another publication of {destination} is under way")
            files.delete(aside, False)
            files.delete(_files(spark, f"{destination}.staging-{holder}")[0], True)
    raise PublicationError(f"another publication of {destination} is under way")


def publish_table(df: DataFrame, destination: str, intents: str, audits: list[DataFrame] = (), lease_seconds: float = 6 * 3600) -> DataFrame:
    """Publish ``df`` as parquet, never overwriting. Refused while any audit has rows.

    One attempt at a time holds the lease of a destination; others are refused and touch nothing. Under the lease the table is
    written to a staging folder beside the destination and verified there; then the intent (digest of what is to be published)
    is recorded and the staging folder renamed. A crash leaves a lease and its staging folder, which the first attempt after
    ``lease_seconds`` takes over and removes: any attempt can be retried. A retry with the same intent and the same bytes
    succeeds, an unrelated table at the destination is an error. The store must create a file only where none is."""
    spark, destination, intents = df.sparkSession, destination.rstrip("/"), intents.rstrip("/")
    for audit in audits:
        if not audit.isEmpty():
            raise PublicationError(f"audit failed: {[r.rule for r in audit.select('rule').distinct().limit(5).collect()]}")
    owner = uuid.uuid4().hex
    lease = _lease(spark, destination, intents, owner, lease_seconds)
    staging = f"{destination}.staging-{owner}"
    path, files = _files(spark, lease)
    try:
        df.write.mode("errorifexists").parquet(staging)
        want = content_digest(spark.read.parquet(staging)).first()
        name = f"{intents}/{hashlib.sha256(destination.encode()).hexdigest()}"
        intent = (INTENT_VERSION, destination, want.rows, want.digest)
        recorded = exists(spark, name) and [tuple(r) for r in spark.read.schema(INTENT).json(name).collect()] == [intent]
        if exists(spark, destination):
            if not recorded:
                raise PublicationError("destination exists and was not written by this publication")
            if tuple(content_digest(spark.read.parquet(destination)).first()) != (want.rows, want.digest):
                raise PublicationError("destination differs from the recorded publication")
            return spark.read.schema(INTENT).json(name)
        if not files.exists(path) or _text(files, path) != owner:
            raise PublicationError("the lease was lost: writing took longer than it lasts")
        spark.createDataFrame([intent], INTENT).coalesce(1).write.mode("overwrite").json(name)
        if not files.rename(_files(spark, staging)[0], _files(spark, destination)[0]):
            raise PublicationError("destination could not be created")
    finally:
        files.delete(_files(spark, staging)[0], True)
        if files.exists(path) and _text(files, path) == owner:
            files.delete(path, False)
    return spark.read.schema(INTENT).json(name)
