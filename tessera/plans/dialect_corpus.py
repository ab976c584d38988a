"""A corpus of statements of every dialect: for each region and statement a file that is whole, misspelt in its first word, or has
a bracket too many, by the region's key. The oracle knows which was written, not how anything is parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import project
from .relational import views

#: For each dialect: texts that it reads whole.
TEXTS = {
    "ansi": [
        "CREATE TABLE shop.item (id INT NOT NULL PRIMARY KEY, price DECIMAL(10, 2) DEFAULT 0.5, maker INT REFERENCES maker (id) ON DELETE CASCADE, CONSTRAINT c CHECK (price > 0), UNIQUE (maker, id))",
        "CREATE TABLE a AS SELECT 1 AS x", "CREATE TEMPORARY TABLE b LIKE a", "DROP TABLE IF EXISTS a, b CASCADE", "CREATE OR REPLACE VIEW v (x, y) AS SELECT a, b FROM t", "DROP VIEW v RESTRICT",
        "INSERT INTO t (a, b) VALUES (1, DEFAULT), (2, 'x')", "INSERT INTO t SELECT a FROM u WHERE a > 1", "UPDATE t SET a = b + 1, c = DEFAULT WHERE d IN (SELECT 1 FROM e)", "DELETE FROM t WHERE a IS NULL", "TRUNCATE TABLE t",
        "MERGE INTO t USING (SELECT a, b FROM u) AS s ON t.a = s.a WHEN MATCHED AND s.b = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET b = s.b WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b)",
        "ALTER TABLE t ADD COLUMN c INT NOT NULL, DROP COLUMN d", "ALTER TABLE t RENAME TO u", "CREATE UNIQUE INDEX i ON t (a DESC, b)", "DROP INDEX i", "CREATE SCHEMA s AUTHORIZATION me", "SET SCHEMA s", "DROP SCHEMA s CASCADE", "DROP TYPE k", "CREATE DATABASE d", "DROP DATABASE IF EXISTS d",
        "CREATE ROLE r", "DROP ROLE r", "CREATE USER me", "DROP USER me", "GRANT SELECT, UPDATE (a) ON TABLE t TO r WITH GRANT OPTION", "REVOKE ALL PRIVILEGES ON t FROM PUBLIC", "CREATE CAST (INT AS BOOL) WITH FUNCTION f(INT)", "DROP CAST (INT AS BOOL)",
        "CREATE FUNCTION f(a INT, b INT) RETURNS INT LANGUAGE SQL AS 'SELECT a + b'", "DROP FUNCTION f", "CREATE MODEL m OPTIONS (kind = 'linear') AS SELECT 1 AS x", "DROP MODEL m", "DESCRIBE t", "USE d", "EXPLAIN SELECT 1", "BEGIN TRANSACTION", "COMMIT", "ROLLBACK",
        "CREATE SEQUENCE s START WITH 5 INCREMENT BY 2 NO CYCLE", "ALTER SEQUENCE s MAXVALUE 10", "DROP SEQUENCE s", "CREATE TRIGGER g BEFORE UPDATE OF a, b ON t FOR EACH ROW EXECUTE PROCEDURE f()", "DROP TRIGGER g",
    ],
    "athena": ["CREATE EXTERNAL TABLE t (a INT) PARTITIONED BY (d STRING) ROW FORMAT SERDE 'x' STORED AS PARQUET LOCATION 's3://b/k' TBLPROPERTIES ('a' = 'b')", "MSCK REPAIR TABLE t", "UNLOAD (SELECT 1) TO 's3://b/k' WITH (format = 'ORC')"],
    "bigquery": ["CREATE TABLE d.t (a INT64 OPTIONS (description = 'x'), b STRUCT<c STRING, e ARRAY<INT64>>) PARTITION BY DATE(a) CLUSTER BY b OPTIONS (x = 1)", "SELECT * EXCEPT (a) FROM my-project.d.t", 'SELECT r"a", """b""" FROM t', "DECLARE x INT64 DEFAULT 5", "EXPORT DATA OPTIONS (uri = 'x') AS SELECT 1", "MERGE t USING s ON t.a = s.a WHEN NOT MATCHED BY SOURCE THEN DELETE"],
    "clickhouse": ["CREATE TABLE d.t ON CLUSTER c (a UInt64 CODEC(ZSTD), b DateTime DEFAULT now()) ENGINE = MergeTree() PARTITION BY toYYYYMM(b) ORDER BY (a, b) SETTINGS index_granularity = 8192", "SELECT a FROM t FINAL PREWHERE a > 1 WHERE b LIMIT 2 BY a SETTINGS max_threads = 1", "OPTIMIZE TABLE t FINAL", "ALTER TABLE t DELETE WHERE a = 1", "SYSTEM RELOAD DICTIONARIES", "WITH 1 AS one SELECT one"],
    "databricks": ["CREATE CATALOG IF NOT EXISTS c COMMENT 'x'", "COPY INTO t FROM 's3://b' FILEFORMAT = PARQUET COPY_OPTIONS ('a' = 'b')", "OPTIMIZE t ZORDER BY (a, b)", "VACUUM t RETAIN 10 HOURS"],
    "db2": ["DECLARE GLOBAL TEMPORARY TABLE session.t (a INT) ON COMMIT PRESERVE ROWS NOT LOGGED", "SELECT a FROM t WITH UR"],
    "duckdb": ["CREATE OR REPLACE TABLE t AS FROM u", "SELECT * EXCLUDE (a) FROM t", "ATTACH 'f.db' AS f", "INSTALL httpfs", "PRAGMA table_info('t')", "CREATE MACRO f(a, b) AS a + b", "FROM t SELECT a"],
    "exasol": ["CREATE TABLE t (a DECIMAL(18, 0) IDENTITY, b VARCHAR(10), DISTRIBUTE BY a)", "EXPORT t INTO CSV AT 'x' FILE 'f'", "OPEN SCHEMA s"],
    "greenplum": ["CREATE TABLE t (a INT) DISTRIBUTED BY (a)", "CREATE TABLE t (a INT) DISTRIBUTED RANDOMLY"],
    "hive": ["CREATE EXTERNAL TABLE IF NOT EXISTS t (a INT, b MAP<STRING, ARRAY<INT>>) PARTITIONED BY (d STRING) CLUSTERED BY (a) INTO 4 BUCKETS STORED AS ORC", "INSERT OVERWRITE TABLE t PARTITION (d = '1') SELECT a FROM u", "LOAD DATA LOCAL INPATH 'x' OVERWRITE INTO TABLE t", "ANALYZE TABLE t COMPUTE STATISTICS FOR COLUMNS"],
    "materialize": ["CREATE SOURCE s FROM KAFKA CONNECTION k (TOPIC 't') FORMAT JSON", "CREATE SINK s FROM v INTO KAFKA CONNECTION k (TOPIC 't')", "SUBSCRIBE TO v", "CREATE CLUSTER c SIZE = 'x'"],
    "mysql": ["CREATE TABLE `t` (id INT UNSIGNED NOT NULL AUTO_INCREMENT, a VARCHAR(9) CHARACTER SET utf8, PRIMARY KEY (id), KEY k (a)) ENGINE=InnoDB DEFAULT CHARSET=utf8", "INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = VALUES(a)", "REPLACE INTO t SET a = 1", "SELECT a FROM t USE INDEX (k) WHERE b = @x LOCK IN SHARE MODE", "SET @a = 1, @b = 2", "SHOW TABLES", "# note\nDELETE FROM t WHERE a = 1 ORDER BY b LIMIT 3"],
    "oracle": ["CREATE TABLE t (a NUMBER(10) DEFAULT 1 NOT NULL ENABLE, b VARCHAR2(20 CHAR)) TABLESPACE x PCTFREE 10", "SELECT a FROM t START WITH a = 1 CONNECT BY PRIOR a = b", "CREATE OR REPLACE PROCEDURE p (a IN NUMBER) IS BEGIN NULL", "ALTER SESSION SET a = 1", "SELECT :x FROM dual"],
    "postgres": ["INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b WHERE t.c RETURNING a, b AS c", "SELECT E'a\\'b', $1::int[], $q$x'y$q$ FROM t", "CREATE MATERIALIZED VIEW v AS SELECT 1 WITH NO DATA", "COPY t (a) FROM STDIN WITH (FORMAT csv)", "CREATE TYPE e AS ENUM ('a', 'b')", "CREATE POLICY p ON t FOR SELECT TO PUBLIC USING (a = 1)", "ALTER TABLE t ALTER COLUMN a TYPE INT USING a::INT", "WITH d AS (SELECT 1) DELETE FROM t USING d WHERE t.a = 1", "CREATE TABLE p PARTITION OF t FOR VALUES FROM (1) TO (2)", "SELECT a FROM t FOR UPDATE SKIP LOCKED", "VACUUM ANALYZE t"],
    "redshift": ["CREATE TABLE t (a INT ENCODE zstd DISTKEY, b INT) DISTSTYLE KEY COMPOUND SORTKEY (a, b)", "UNLOAD ('SELECT 1') TO 's3://b' IAM_ROLE 'r' PARQUET", "COPY t FROM 's3://b' IAM_ROLE 'r' CSV GZIP"],
    "snowflake": ["CREATE TRANSIENT TABLE t (a NUMBER AUTOINCREMENT, b VARIANT) CLUSTER BY (a) DATA_RETENTION_TIME_IN_DAYS = 1", "CREATE TABLE t CLONE u AT (OFFSET => -60)", "SELECT b:x.y[0]::STRING, c.* FROM t AT (TIMESTAMP => 'x') AS c QUALIFY ROW_NUMBER() OVER (ORDER BY a) = 1", "COPY INTO t FROM @stage/x FILE_FORMAT = (TYPE = CSV)", "CREATE TASK k WAREHOUSE = w SCHEDULE = '1 MINUTE' AS INSERT INTO t VALUES (1)", "CREATE STREAM s ON TABLE t", "USE WAREHOUSE w", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE"],
    "sparksql": ["CREATE TABLE t (a INT COMMENT 'x', b STRUCT<c: INT>) USING parquet PARTITIONED BY (a) TBLPROPERTIES ('k' = 'v')", "CACHE LAZY TABLE t AS SELECT 1", "SELECT a FROM t LATERAL VIEW explode(b) x AS y DISTRIBUTE BY a SORT BY a", "REFRESH TABLE t", "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1", "SELECT * FROM t VERSION AS OF 3", "CREATE STREAMING TABLE t AS SELECT 1", "APPLY CHANGES INTO t FROM s KEYS (a) SEQUENCE BY b STORED AS SCD TYPE 2", "ADD JAR '/x.jar'"],
    "sqlite": ["CREATE TABLE t (a INTEGER PRIMARY KEY AUTOINCREMENT, b) WITHOUT ROWID", "INSERT OR REPLACE INTO t VALUES (1, 2)", "PRAGMA foreign_keys = ON", "ATTACH 'f' AS g", "SELECT [a b] FROM t"],
    "starrocks": ["CREATE TABLE t (a INT, b BIGINT SUM) AGGREGATE KEY (a) DISTRIBUTED BY HASH(a) BUCKETS 8 PROPERTIES ('x' = 'y')", "CREATE ROUTINE LOAD l ON t FROM KAFKA ('x' = 'y')"],
    "teradata": ["CREATE MULTISET VOLATILE TABLE t (a INT NOT NULL, b CHAR(3) CHARACTER SET LATIN) PRIMARY INDEX (a) ON COMMIT PRESERVE ROWS", "COLLECT STATISTICS COLUMN (a) ON t", "DEL FROM t ALL", "DATABASE d"],
    "trino": ["CREATE TABLE t WITH (format = 'ORC') AS SELECT 1 AS a", "SHOW TABLES FROM s LIKE 'x%'", "PREPARE p FROM SELECT ? AS a", "SET SESSION a = true", "SELECT a FROM UNNEST(ARRAY[1, 2]) WITH ORDINALITY AS t(a, n)"],
    "tsql": ["CREATE TABLE [dbo].[t] ([a b] INT IDENTITY(1, 1) NOT NULL, c NVARCHAR(MAX), CONSTRAINT p PRIMARY KEY CLUSTERED ([a b]))", "DECLARE @x INT = 5, @y TABLE (a INT)", "SELECT TOP 10 PERCENT a FROM #t WITH (NOLOCK) OPTION (RECOMPILE)", "EXEC dbo.p @a = 1", "UPDATE t SET a += 1 OUTPUT deleted.a WHERE b = 1", "IF @x = 1 PRINT 'y'", "SELECT 1\nGO\nSELECT 2", "CREATE PROCEDURE p @a INT AS SELECT @a"],
}


def _written() -> str:
    rows = []
    for dialect, statements in sorted(TEXTS.items()):
        for i, sql in enumerate(statements):
            if "\\" not in sql:  # the two engines read backslashes in literals differently
                rows.append(f"('{dialect}/{i}/', '-- tessera:dialect:{dialect}\u00ac-- tessera:rules:LT15\u00ac', '{sql.replace("'", "''").replace(chr(10), chr(172))}')")
    return f"SELECT concat(name, r_regionkey, '.sql') AS path, replace(concat(head, CASE r_regionkey % 3 WHEN 0 THEN body WHEN 1 THEN concat('X', body) ELSE concat(body, ' )') END), '\u00ac', chr(10)) AS source FROM region, (VALUES {', '.join(rows)}) AS v(name, head, body)"


CORPUS = _written()


def parse_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, whole) of each file: whether nothing in it is unparsable in its dialect."""
    views(spark, sf_dir, CORPUS)
    files = spark.sql(CORPUS)
    broken = project.violations(files).where("code = 'PRS'").select("path").distinct().withColumn("broken", F.lit(True))
    return files.join(broken, "path", "left").select("path", F.col("broken").isNull().alias("whole"))


def oracle() -> str:
    return f"SELECT path, CAST(regexp_extract(path, '([0-9]+)[.]sql$', 1) AS INTEGER) % 3 = 0 AS whole FROM ({CORPUS})"
