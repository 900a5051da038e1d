"""Where tables live, by URI, and how they are read, made and written.

    memory:NAME                 a temporary view of the session
    parquet:PATH                a Parquet directory
    postgresql://HOST/DB?table= a relational table over JDBC
"""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def jdbc_options(uri: str) -> dict[str, str]:
    """Spark's JDBC options for a postgresql:// URI, credentials and table included."""
    parts = urlsplit(uri)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    options = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}", "dbtable": query.pop("table", "links")}
    if parts.username:
        options["user"] = parts.username
    if parts.password:
        options["password"] = parts.password
    return options | query


def read(spark: SparkSession, uri: str) -> DataFrame:
    scheme, _, rest = uri.partition(":")
    if scheme == "memory":
        return spark.table(rest)
    if scheme == "parquet":
        return spark.read.parquet(rest)
    if scheme == "postgresql":
        return spark.read.format("jdbc").options(**jdbc_options(uri)).load()
    raise ValueError(f"unsupported store {scheme!r}")


def write(df: DataFrame, uri: str, mode: str = "overwrite") -> None:
    scheme, _, rest = uri.partition(":")
    if scheme == "memory":
        df.createOrReplaceTempView(rest)
    elif scheme == "parquet":
        df.write.mode(mode).parquet(rest)
    elif scheme == "postgresql":
        df.write.format("jdbc").options(**jdbc_options(uri)).mode(mode).save()
    else:
        raise ValueError(f"unsupported store {scheme!r}")


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether there is anything at `uri`: a view, a folder, a relational table."""
    scheme, _, rest = uri.partition(":")
    if scheme == "memory":
        return spark.catalog.tableExists(rest)
    if scheme == "parquet":
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rest)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if scheme == "postgresql":
        options = jdbc_options(uri)
        schema, _, name = options["dbtable"].rpartition(".")
        quoted = lambda x: x.replace("'", "''")
        where = f"table_name = '{quoted(name)}'" + (f" and table_schema = '{quoted(schema)}'" if schema else "")
        query = {k: v for k, v in options.items() if k != "dbtable"} | {"query": f"select 1 as found from information_schema.tables where {where}"}
        return not spark.read.format("jdbc").options(**query).load().isEmpty()
    raise ValueError(f"unsupported store {scheme!r}")


def ensure(spark: SparkSession, uri: str, schema: T.StructType) -> DataFrame:
    """The table at `uri`, made empty if there is nothing at all; what is there is never written over, also if it cannot be read."""
    if not exists(spark, uri):
        write(spark.createDataFrame([], schema), uri, "errorifexists")
    return read(spark, uri)
