"""The relational tables: their columns, JDBC options, statements and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RULE_DEFINITIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("rule_json", T.StringType(), False),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("cooldown_seconds", T.LongType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ]
)
SCHEMA_DEFINITIONS = T.StructType(
    [T.StructField("schema_id", T.StringType(), False), T.StructField("schema_payload", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType())]
)
BATCH_ROWS = 5_000


def options(url: str, table: str, user: str, password: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password, "driver": "org.postgresql.Driver", "batchsize": str(BATCH_ROWS), "stringtype": "unspecified"}


def read(spark: SparkSession, url: str, table: str, user: str, password: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options(url, table, user, password)).load()


def write_rules(rules: DataFrame, url: str, user: str, password: str) -> None:
    """Append rules in batches of ``BATCH_ROWS``, each committed as it fills."""
    rules.drop("id").write.format("jdbc").options(**options(url, "rule_definitions", user, password)).mode("append").save()


def upsert_statement(table: str, columns: T.StructType, keys: Iterable[str], touch: str | None = None, mark: str = "?") -> str:
    """SQL that inserts a row of ``columns`` or replaces what is there under ``keys``; ``touch`` names a column to stamp.

    Works in PostgreSQL and in other databases that know ON CONFLICT.
    """
    keys, names = list(keys), columns.names
    if missing := [k for k in keys if k not in names]:
        raise ValueError(f"no column {missing[0]}")
    changes = [f"{n} = excluded.{n}" for n in names if n not in keys] + ([f"{touch} = now()"] if touch else [])
    action = f"DO UPDATE SET {', '.join(changes)}" if changes else "DO NOTHING"
    return f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))}) ON CONFLICT ({', '.join(keys)}) {action}"


def write_upsert(rows: DataFrame, table: str, keys: list[str], connect: Callable[[], object], touch: str | None = None, mark: str = "%s") -> None:
    """Upsert ``rows`` into a table through a Python database connection of each task.

    ``connect`` opens a DB-API connection on the executors; ``mark`` is its driver's
    parameter style.  A task commits every ``BATCH_ROWS`` rows.  As a row replaces what is
    there under its keys, a task that runs again changes nothing; keys must be unique in ``rows``.
    """
    statement = upsert_statement(table, rows.schema, keys, touch, mark)

    def write(part: Iterator[T.Row]) -> None:
        connection = connect()
        try:
            cursor, batch = connection.cursor(), []
            for row in part:
                batch.append(tuple(row))
                if len(batch) == BATCH_ROWS:
                    cursor.executemany(statement, batch)
                    connection.commit()
                    batch = []
            if batch:
                cursor.executemany(statement, batch)
            connection.commit()
        finally:
            connection.close()

    rows.foreachPartition(write)
