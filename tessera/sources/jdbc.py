"""SQL sources through Spark's JDBC reader (query or table, optional limit)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators.lineage import FILE, KEY, with_generated_order
from ..spec import JobSpec

# URL layouts per dialect.
URL_FORMATS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "sqlite": "jdbc:sqlite:{database}",
}


@dataclass(frozen=True)
class Connection:
    name: str
    dialect: str = "postgresql"
    host: str = "localhost"
    port: int = 5432
    database: str = ""
    user: str | None = None
    password: str | None = None
    url: str | None = None
    options: dict = field(default_factory=dict)
    partition: dict = field(default_factory=dict)    # parallel reads of a table, see ``read_sql``

    def jdbc_url(self) -> str:
        if self.url:
            return self.url
        fmt = URL_FORMATS.get(self.dialect)
        if fmt is None:
            raise ValueError(f"unknown dialect {self.dialect}")
        return fmt.format(host=self.host, port=self.port, database=self.database)

    def reader_options(self) -> dict:
        opts = {"url": self.jdbc_url(), **self.options}
        if self.user:
            opts["user"] = self.user
        if self.password:
            opts["password"] = self.password
        return opts


def read_sql(spark: SparkSession, conn: Connection, table: str | None = None, query: str | None = None,
             limit: int | None = None, partition: dict | None = None) -> DataFrame:
    """A table or a query (the query wins); ``limit`` is pushed to the database by Spark.

    ``partition`` (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``) splits a
    table read into parallel range queries; without it a JDBC read is one task.
    """
    if not table and not query:
        raise ValueError("a SQL source needs a table or a query")
    reader = spark.read.format("jdbc").options(**conn.reader_options())
    if query:
        reader = reader.option("query", query)
    else:
        reader = reader.option("dbtable", table)
        for k, v in (partition or {}).items():
            reader = reader.option(k, str(v))
    df = reader.load()
    return df.limit(int(limit)) if limit else df


def preview_sql(spark: SparkSession, conn: Connection, table: str | None = None, query: str | None = None,
                limit: int = 50) -> DataFrame:
    """The first ``limit`` rows (limit applied by Spark, the query text is never patched)."""
    return read_sql(spark, conn, table, query, limit)


def read_sql_with_spec(spark: SparkSession, spec: JobSpec, connections: dict,
                       limit: int | None = None) -> DataFrame:
    conn = connections.get(spec.connection_name)
    if conn is None:
        raise ValueError(f"unknown connection {spec.connection_name}")
    df = with_generated_order(read_sql(spark, conn, spec.sql_table, spec.sql_query, limit, conn.partition if spec.sql_table and not spec.sql_query else None))
    name = spec.source_file or spec.sql_table or conn.name      # what stands for the input file in groups and in the ledger
    return df.withColumns({FILE: F.lit(name), KEY: F.lit(f"sql:{conn.name}/{name}")})
