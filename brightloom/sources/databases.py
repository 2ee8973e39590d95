"""SQL databases: JDBC for servers, the standard library for SQLite."""

from __future__ import annotations

import math
import os
import shutil
import sqlite3
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyspark.find_spark_home import _find_spark_home
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter

MODES = {"append": "append", "replace": "overwrite", "failIfExists": "errorifexists"}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def jdbc_options(url: str) -> dict[str, str]:
    """Options from ``postgresql://user:password@host:port/db?sslmode=require``
    (also mysql); JDBC URLs pass."""
    if url.startswith("jdbc:"):
        kind = url.split(":")[1]
        return {"url": url} | ({"driver": DRIVERS[kind]} if kind in DRIVERS else {})
    parts = urlparse(url)
    kind = {"postgres": "postgresql"}.get(parts.scheme, parts.scheme)
    if kind not in ("postgresql", "mysql"):
        raise InvalidParameter(f"unknown database {parts.scheme!r}")
    port = parts.port or {"postgresql": 5432, "mysql": 3306}[kind]
    made = {"url": f"jdbc:{kind}://{parts.hostname}:{port}{parts.path}", "driver": DRIVERS[kind]}
    made |= {k: v for k, v in (("user", parts.username), ("password", parts.password)) if v}
    mode = parse_qs(parts.query).get("sslmode", ["prefer"])[0]
    return made | {"sslmode" if kind == "postgresql" else "sslMode": mode if kind == "postgresql" else mode.upper()}


def read_sql(spark: SparkSession, query: str, url: str, partition: tuple[str, object, object, int] | None = None) -> DataFrame:
    """A query's rows; ``partition`` (column, low, high, n) reads in parallel."""
    if url.startswith("sqlite:"):
        return read_sqlite(spark, query, url.removeprefix("sqlite:").removeprefix("//"))
    reader = spark.read.format("jdbc").options(**jdbc_options(url)).option("dbtable", f"({query}) q")
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, v)
    return reader.load()


def write_sql(df: DataFrame, table: str, url: str, mode: str = "append", batch: int = 500) -> None:
    if mode not in MODES:
        raise InvalidParameter(f"mode must be one of {list(MODES)}")
    if url.startswith("sqlite:"):
        write_sqlite(df, table, url.removeprefix("sqlite:").removeprefix("//"), mode, batch)
        return
    df.write.format("jdbc").options(**jdbc_options(url)).option("dbtable", table).option("batchsize", batch).mode(MODES[mode]).save()


def write_derby(df: DataFrame, table: str, folder: str, part_rows: int = 500_000) -> list[str]:
    """URLs of Derby databases in ``folder``, which all processes must see as a
    local path, each with ``table`` and a part of the rows. A Derby database is
    one process's as long as it can be written: a task fills one through Derby's
    own tool, and packs it into a jar, which any number of processes may read."""
    at = folder.removeprefix("file://")
    if "://" in at:
        raise InvalidParameter(f"Derby needs a local path, not {folder!r}")
    fixed = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR(32672)"}
    if odd := [c for c, k in df.dtypes if k not in fixed]:
        raise InvalidParameter(f"columns {odd} must be of {list(fixed)}")
    n, *longest = df.agg(F.count(F.lit(1)), *[F.max(F.length(f"`{c}`")) if k == "string" else F.lit(0) for c, k in df.dtypes]).first()
    kinds = ["CLOB" if (most or 0) > 32672 else fixed[k] for most, (_, k) in zip(longest, df.dtypes, strict=True)]
    columns = ", ".join('"{}" {}'.format(c.replace('"', '""'), kind) for c, kind in zip(df.columns, kinds, strict=True))
    parts = max(1, -(-n // part_rows))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="brightloom-") as own:
            writer = None
            for batch in batches:
                writer = writer or pa.csv.CSVWriter(f"{own}/rows.csv", batch.schema, write_options=pa.csv.WriteOptions(include_header=False))
                writer.write_batch(batch)
            script = f"CONNECT 'jdbc:derby:{own}/db/d;create=true';\nCREATE TABLE {table} ({columns});\n"
            if writer:
                writer.close()
                script += f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{own}/rows.csv', NULL, NULL, 'UTF-8', 0);\n"
            # a shutdown is told as an error, so it comes after the last checked command
            with open(f"{own}/fill.sql", "w") as f:
                f.write(script + "DISCONNECT;\nCONNECT 'jdbc:derby:;shutdown=true';\n")
            java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else "java"
            command = [java, "-Xmx256m", f"-Dderby.stream.error.file={own}/derby.log", "-cp", os.path.join(_find_spark_home(), "jars", "*"), "org.apache.derby.tools.ij", f"{own}/fill.sql"]
            said = subprocess.run(command, capture_output=True, text=True, cwd=own).stdout
            failed = [x for x in said.splitlines() if x.startswith("ERROR") and "XJ015" not in x]
            if failed or "XJ015" not in said:
                raise RuntimeError(f"Derby: {failed or said[-500:]}")
            name = f"{at}/{uuid.uuid4().hex}.jar"
            os.makedirs(at, exist_ok=True)
            # stored, not deflated: Derby skips to each page from the start of its file
            with zipfile.ZipFile(f"{own}/packed", "w", zipfile.ZIP_STORED) as jar:
                for where, _, names in os.walk(f"{own}/db"):
                    for x in names:
                        jar.write(f"{where}/{x}", os.path.relpath(f"{where}/{x}", f"{own}/db"))
            shutil.move(f"{own}/packed", name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    made = df.repartition(parts).mapInArrow(fill, "name string").collect()  # a name for each part
    return [f"jdbc:derby:jar:({r['name']})d" for r in made]


def read_sqlite(spark: SparkSession, query: str, path: str) -> DataFrame:
    """SQLite is a local file: read on the driver. A column is text if any cell
    is, else double if any is, else bigint."""
    with sqlite3.connect(path) as con:
        cursor = con.execute(query)
        names = [d[0] for d in cursor.description]
        rows = cursor.fetchall()
    kinds = []
    for k in range(len(names)):
        cells = [r[k] for r in rows if r[k] is not None]
        kinds.append("string" if any(isinstance(c, (str, bytes)) for c in cells) or not cells else "double" if any(isinstance(c, float) for c in cells) else "bigint")
    cast = {"string": lambda c: c if isinstance(c, str) else str(c), "double": float, "bigint": int}
    rows = [tuple(None if c is None else cast[k](c) for c, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def write_sqlite(df: DataFrame, table: str, path: str, mode: str = "append", batch: int = 500) -> None:
    """Rows stream through the driver in batches; NaN becomes NULL."""
    kind = lambda t: "BOOLEAN" if isinstance(t, T.BooleanType) else "INTEGER" if isinstance(t, T.IntegralType) else "REAL" if isinstance(t, (T.FractionalType,)) else "TEXT"
    quoted = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(path) as con:
        there = con.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()[0]
        if mode == "failIfExists" and there:
            raise InvalidParameter(f"table {table!r} exists")
        if mode == "replace":
            con.execute(f"DROP TABLE IF EXISTS {quoted}")
        con.execute(f"CREATE TABLE IF NOT EXISTS {quoted} ({', '.join(f'\"{f.name}\" {kind(f.dataType)}' for f in df.schema.fields)})")
        put, held = f"INSERT INTO {quoted} VALUES ({', '.join('?' * len(df.columns))})", []
        clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v if isinstance(v, (int, float, str, bytes, bool, type(None))) else str(v)
        for row in df.toLocalIterator():
            held.append(tuple(map(clean, row)))
            if len(held) >= batch:
                con.executemany(put, held)
                held = []
        con.executemany(put, held)


def query_sqlite(query: str, path: str) -> pd.DataFrame:
    with sqlite3.connect(path) as con:
        return pd.read_sql_query(query, con)
