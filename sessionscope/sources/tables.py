"""The three shop tables as one bundle, with loaders, a sink and key checks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.plans.joins import hot_key_left_join
from sessionscope.sources.events import (
    orders_from_events,
    pageviews_from_events,
    sessions_from_events,
)
from sessionscope.sources.marks import (
    CREATED,
    PARTITION_DATE,
    SESSION_DATE,
    mark_day_partition,
    mark_session_day,
    mark_sessions,
    session_day_column,
    unmarked,
)
from sessionscope.sources.schemas import (
    EVENTS_SCHEMA,
    ORDER_ID,
    PAGEVIEW_ID,
    REQUIRED_COLUMNS,
    ROW_IDS,
    SCHEMAS,
    SESSION_ID,
)


_LAYOUT = "layout"
_APPENDED = "sessionscope.appended"


def layout_tokens(spark: SparkSession, root: str) -> list[str]:
    """Who wrote the layout below ``root``: one token for each write, none where nothing tells."""
    try:
        rows = spark.read.schema("token string").json(os.path.join(root, _LAYOUT)).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["token"] for r in rows)


def write_layout(spark: SparkSession, root: str, tokens: list[str], mode: str) -> None:
    """Add (or set) the tokens of the layout file."""
    rows = spark.createDataFrame([(t,) for t in tokens], "token string")
    rows.coalesce(1).write.mode(mode).json(os.path.join(root, _LAYOUT))


def _with_marks(table: DataFrame, name: str, tokens: list[str]) -> DataFrame:
    """Marks of a table with day columns: its own days, and the sessions' where one writer made all."""
    if not tokens:
        return table
    table = mark_day_partition(table, "+".join(tokens))
    if len(tokens) == 1 and name == "website_sessions":
        return mark_sessions(table, tokens[0])
    if len(tokens) == 1 and name == "website_pageviews":
        return mark_session_day(table, tokens[0])
    return table


class ShopTables:
    """``sessions``, ``pageviews`` and ``orders`` DataFrames.

    Either given directly, or derived on first access from an events frame
    (each derived table is built only when an operator asks for it).
    """

    _NAMES = ("sessions", "pageviews", "orders")

    def __init__(
        self,
        sessions: DataFrame | None = None,
        pageviews: DataFrame | None = None,
        orders: DataFrame | None = None,
        *,
        derive: dict[str, Callable[[], DataFrame]] | None = None,
    ) -> None:
        self._frames = {"sessions": sessions, "pageviews": pageviews, "orders": orders}
        self._derive = derive or {}

    def _get(self, name: str) -> DataFrame:
        if self._frames[name] is None:
            if name not in self._derive:
                raise ValueError(f"no {name} table")
            self._frames[name] = self._derive[name]()
        return self._frames[name]

    @property
    def sessions(self) -> DataFrame:
        return self._get("sessions")

    @property
    def pageviews(self) -> DataFrame:
        return self._get("pageviews")

    @property
    def orders(self) -> DataFrame:
        return self._get("orders")

    def __repr__(self) -> str:
        return f"ShopTables({', '.join(n for n in self._NAMES)})"

    # -- loaders ---------------------------------------------------------
    @classmethod
    def from_events(cls, spark: SparkSession, data_dir: str) -> "ShopTables":
        """Derive the tables from ``<data_dir>/events.parquet`` (lazy)."""
        # declared schema: no footer pass to infer it
        events = spark.read.schema(EVENTS_SCHEMA).parquet(os.path.join(data_dir, "events.parquet"))
        return cls.from_events_frame(events)

    @classmethod
    def from_events_frame(cls, events: DataFrame) -> "ShopTables":
        token = uuid.uuid4().hex
        return cls(
            derive={
                "sessions": lambda: sessions_from_events(events, token),
                "pageviews": lambda: pageviews_from_events(events, token),
                "orders": lambda: orders_from_events(events),
            }
        )

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        sessions_path: str,
        pageviews_path: str,
        orders_path: str,
    ) -> "ShopTables":
        """Read real tables with the declared schemas (no inference pass)."""
        tables = cls(
            sessions=spark.read.schema(SCHEMAS["website_sessions"]).parquet(sessions_path),
            pageviews=spark.read.schema(SCHEMAS["website_pageviews"]).parquet(pageviews_path),
            orders=spark.read.schema(SCHEMAS["shop_orders"]).parquet(orders_path),
        )
        tables.check_columns()
        return tables

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        paths: dict[str, str],
        format: str = "parquet",
        options: dict[str, str] | None = None,
    ) -> "ShopTables":
        """Read the three tables in any file format Spark reads (parquet, orc,
        csv, json, …) with the declared schemas, so no inference pass runs.

        ``paths`` maps ``website_sessions``, ``website_pageviews`` and
        ``shop_orders`` to their locations.
        """

        def read(name: str) -> DataFrame:
            reader = spark.read.schema(SCHEMAS[name]).format(format)
            for k, v in (options or {}).items():
                reader = reader.option(k, v)
            return reader.load(paths[name])

        tables = cls(read("website_sessions"), read("website_pageviews"), read("shop_orders"))
        tables.check_columns()
        return tables

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        *,
        tables: dict[str, str] | None = None,
        session_id_bounds: tuple[int, int],
        num_partitions: int,
        properties: dict[str, str] | None = None,
    ) -> "ShopTables":
        """Read the tables from a SQL database in parallel.

        Each table is split into ``num_partitions`` range reads on
        ``website_session_id`` between ``session_id_bounds`` (Spark's
        partitioned JDBC read), so no single connection carries a whole table.
        ``tables`` maps the three names to database table names (default:
        ``website_sessions``, ``website_pageviews``, ``orders``).  Not exercised
        by the tests: no database is available in the test environment.
        """
        names = {"website_sessions": "website_sessions", "website_pageviews": "website_pageviews", "shop_orders": "orders"}
        names.update(tables or {})
        lo, hi = session_id_bounds

        def read(name: str) -> DataFrame:
            df = spark.read.jdbc(
                url,
                names[name],
                column=SESSION_ID,
                lowerBound=lo,
                upperBound=hi,
                numPartitions=num_partitions,
                properties=properties or {},
            )
            return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields if f.name in df.columns])

        result = cls(read("website_sessions"), read("website_pageviews"), read("shop_orders"))
        result.check_columns()
        return result

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str) -> "ShopTables":
        """Read tables written by :meth:`write` (day-partitioned layout).

        The day columns are kept.  Where the layout file names one writer they are
        marked (:mod:`sessionscope.sources.marks`), so the operators' time windows skip
        whole days: of the rows' own days, and for windows on sessions of the days of
        the pageviews' sessions.  After appends by several writers the rows' own days
        still hold, those of the sessions may not; without a layout file nothing is
        known and nothing is pruned.
        """
        tokens = layout_tokens(spark, root)
        tables = cls(*(cls.read_table(spark, root, n, tokens) for n in ("website_sessions", "website_pageviews", "shop_orders")))
        tables.check_columns()
        return tables

    @staticmethod
    def read_table(spark: SparkSession, root: str, name: str, tokens: list[str]) -> DataFrame:
        """One table of the day-partitioned layout, marked as ``tokens`` allow."""
        days = [PARTITION_DATE]
        if tokens and name == "website_pageviews":
            days.append(SESSION_DATE)
        schema = T.StructType(SCHEMAS[name].fields + [T.StructField(d, T.DateType()) for d in days])
        table = spark.read.schema(schema).parquet(os.path.join(root, name)).select(schema.fieldNames())
        return _with_marks(table, name, tokens)

    # -- sink --------------------------------------------------------------
    def write(self, root: str, mode: str = "errorifexists") -> None:
        """Write the three tables as Parquet, partitioned by calendar day.

        Day partitions let the time windows of every operator prune whole
        directories.  Pageviews are also partitioned by the day of their *session*
        (``session_date``), so a window on sessions prunes the pageviews too and still
        finds the views that a session made on later days.  Within a day, rows are
        clustered by session id so the per-session aggregations combine well map-side.
        Range partitioning on (days, session) splits a large (or hot) day over several
        tasks and files instead of sending a whole day to one task, and the row's own
        id behind them splits a hot session.  The layout file is written last.
        """
        if mode == "overwrite":
            write_layout(self.sessions.sparkSession, root, [], mode)
        for name, df in self._with_days().items():
            days = [c for c in (SESSION_DATE, PARTITION_DATE) if c in df.columns]
            keys = list(dict.fromkeys([*days, SESSION_ID, ROW_IDS[name]]))
            (
                df.repartitionByRange(*keys)
                .sortWithinPartitions(*keys)
                .write.mode(mode)
                .partitionBy(*days)
                .parquet(os.path.join(root, name))
            )
        write_layout(self.sessions.sparkSession, root, [uuid.uuid4().hex], mode)

    def _with_days(self) -> dict[str, DataFrame]:
        """The tables with their day columns and without marks."""
        frames = {name: unmarked(df).withColumn(PARTITION_DATE, F.to_date(CREATED)) for name, df in self.named().items()}
        frames["website_pageviews"] = self._with_session_days(frames["website_pageviews"])
        return frames

    def _with_session_days(self, pageviews: DataFrame) -> DataFrame:
        """Pageviews with the day of their session, NULL for an unknown session and for
        one whose rows name several days."""
        if session_day_column(self.pageviews, self.sessions) == CREATED:
            return pageviews.withColumn(SESSION_DATE, F.to_date(CREATED))
        days = (
            self.sessions.groupBy(SESSION_ID)
            .agg(F.min(F.to_date(CREATED)).alias("_from"), F.max(F.to_date(CREATED)).alias("_to"))
            .select(SESSION_ID, F.expr(f"CASE WHEN _from = _to THEN _from END AS {SESSION_DATE}"))
        )
        rows = pageviews.drop(SESSION_DATE)
        return hot_key_left_join(rows, days, SESSION_ID, left_id=PAGEVIEW_ID, right_id=SESSION_ID)

    def save_as_tables(
        self, database: str, buckets: int, mode: str = "errorifexists"
    ) -> None:
        """Save the tables to the catalog, day-partitioned and bucketed by
        ``website_session_id`` into the same number of buckets.

        Every per-session aggregation and every session-keyed join then reads
        an existing hash partitioning: Spark plans them without an Exchange,
        and the three tables are co-located bucket by bucket.  Rows are first
        rebalanced by (day, bucket id): a (day, bucket) usually makes one file,
        and one that is larger than the advisory partition size, as with a hot
        session, is split over several tasks and files.
        """
        spark = self.sessions.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        # the bucket id Spark assigns: pmod(murmur3 hash(key), buckets)
        bucket_id = F.expr(f"pmod(hash({SESSION_ID}), {int(buckets)})")
        token = uuid.uuid4().hex
        for name, df in self._with_days().items():
            days = [c for c in (SESSION_DATE, PARTITION_DATE) if c in df.columns]
            (
                # the catalog keeps the marks with the columns
                _with_marks(df, name, [token])
                .withColumn("_bucket", bucket_id)
                .hint("rebalance", *days, "_bucket")
                .drop("_bucket")
                .write.mode(mode)
                .partitionBy(*days)
                .bucketBy(buckets, SESSION_ID)
                .sortBy(SESSION_ID)
                .saveAsTable(f"{database}.{name}")
            )
            if mode == "append":  # a session may now have rows of several writers
                spark.sql(f"ALTER TABLE {database}.{name} SET TBLPROPERTIES ('{_APPENDED}' = '{token}')")

    @classmethod
    def from_tables(
        cls, spark: SparkSession, database: str, *, bucketed_reads: bool = False
    ) -> "ShopTables":
        """Catalog tables written by :meth:`save_as_tables`.

        They are read as plain day-partitioned files: the per-session steps shuffle
        map-side partial aggregates, which spreads a hot session over all map
        tasks.  With ``bucketed_reads`` Spark uses the bucketing instead (no
        shuffle for per-session work), but each bucket is one task, so choose it
        only where no session holds a large share of the rows.
        """

        def read(name: str) -> DataFrame:
            table = spark.table(f"{database}.{name}")
            if not spark.sql(f"SHOW TBLPROPERTIES {database}.{name}").filter(F.col("key") == _APPENDED).isEmpty():
                table = mark_day_partition(unmarked(table), "appended")
            if bucketed_reads:
                return table
            location = (
                spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{name}")
                .filter("col_name = 'Location'")
                .first()["data_type"]
            )
            files = spark.read.schema(table.schema).parquet(location).select(table.columns)
            for f in table.schema.fields:
                files = files.withMetadata(f.name, f.metadata) if f.metadata else files
            return files

        tables = cls(read("website_sessions"), read("website_pageviews"), read("shop_orders"))
        tables.check_columns()
        return tables

    def materialize(self, spark: SparkSession, name: str | None = None) -> "ShopTables":
        """Write the tables once under the shared checkpoint folder and read
        them back in the day-partitioned layout.

        Without a ``name`` the folder is new; an existing one is never overwritten.

        Cuts the lineage back to the source (a lost executor recomputes from
        the written files, not from the raw events) and lets every later
        operator prune day partitions.  The folder is the one the cluster
        names in ``spark.checkpoint.dir``; a machine-local fallback is only
        set when none is configured (tests).
        """
        from sessionscope.session import ensure_checkpoint_dir

        root = os.path.join(ensure_checkpoint_dir(spark), name or f"shop-tables-{uuid.uuid4().hex}")
        self.write(root)
        return ShopTables.from_directory(spark, root)

    def named(self) -> dict[str, DataFrame]:
        return {
            "website_sessions": self.sessions,
            "website_pageviews": self.pageviews,
            "shop_orders": self.orders,
        }

    def register_views(self, orders_name: str = "shop_orders") -> None:
        """Expose the tables to ``spark.sql`` as ``website_sessions``,
        ``website_pageviews`` and ``orders_name`` (``"orders"`` lets SQL
        written for the original tables run unchanged)."""
        views = {"website_sessions": self.sessions, "website_pageviews": self.pageviews, orders_name: self.orders}
        for name, df in views.items():
            df.createOrReplaceTempView(name)

    # -- checks ----------------------------------------------------------
    def check_columns(self) -> None:
        for name, df in self.named().items():
            missing = [c for c in REQUIRED_COLUMNS[name] if c not in df.columns]
            if missing:
                raise ValueError(f"{name} lacks columns {missing}")

    def validate_keys(self) -> dict[str, bool]:
        """Distributed check of the key assumptions the operators rely on.

        One aggregation per table: a key is valid when it has no NULLs and
        ``count(key) == count(distinct key)``.  Orders must also reference a
        single session each.
        """

        def unique(df: DataFrame, key: str) -> bool:
            row = df.agg(
                F.count(F.lit(1)).alias("n"),
                F.count(key).alias("nn"),
                F.count_distinct(key).alias("nd"),
            ).first()
            return row["n"] == row["nn"] == row["nd"]

        one_session = (
            self.orders.groupBy(ORDER_ID)
            .agg(F.count_distinct(SESSION_ID).alias("k"))
            .filter(F.col("k") > 1)
            .isEmpty()
        )
        return {
            "sessions.website_session_id": unique(self.sessions, SESSION_ID),
            "pageviews.website_pageview_id": unique(self.pageviews, PAGEVIEW_ID),
            "orders.order_id": unique(self.orders, ORDER_ID) and one_session,
        }
