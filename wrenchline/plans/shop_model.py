"""The shop's tables as projections of the TPC-H-like parquet tables used for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.schemas import ACCEPTED, CLERK, MECHANIC, REFUSED
from wrenchline.sources.tables import load_tables

TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
         "timestamp_ntz": T.TimestampNTZType()}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


RAW_SCHEMAS = {name: _schema(columns) for name, columns in {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}.items()}


def catalog_of(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("part_code"), F.lit(1).alias("version"), F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")).alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        (F.col("p_partkey") % 10).alias("supplier"))


class Shop:
    """Model tables of one data folder. Every property is a plain projection or join, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.raw = load_tables(spark, folder, RAW_SCHEMAS, suffix=".parquet")

    @property
    def people(self) -> DataFrame:
        return self.raw["nation"].select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("first_name"))

    @property
    def staff(self) -> DataFrame:
        role = F.when(F.col("s_suppkey") % 5 == 4, CLERK).otherwise(MECHANIC)
        return self.raw["supplier"].select(
            F.col("s_suppkey").alias("staff_id"), F.col("s_nationkey").alias("person_id"), role.alias("role"))

    @property
    def vehicles(self) -> DataFrame:
        brand = F.concat(F.lit("Brand#"), (F.col("c_custkey") % 30 + 1).cast("string"))
        return self.raw["customer"].select(
            F.col("c_custkey").alias("plate"), brand.alias("brand"), F.col("c_nationkey").alias("owner_id"))

    @property
    def orders(self) -> DataFrame:
        done = F.col("o_orderstatus") == "F"
        return self.raw["orders"].select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("plate"),
            (F.col("o_custkey") % 10).alias("mechanic"), F.to_date("o_orderdate").alias("start_date"),
            F.lit(None).cast("date").alias("end_date"),
            F.when(done, 1 + F.col("o_orderkey") % 8).otherwise(0).alias("labor"))

    @property
    def catalog(self) -> DataFrame:
        return catalog_of(self.raw["part"])

    @property
    def lines(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("bigint")
        return self.raw["lineitem"].select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_code"),
            F.col("l_linenumber").alias("line_no"), quantity.alias("needed"),
            F.when(F.col("l_linestatus") == "F", quantity).otherwise(0).alias("available"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
            F.to_date("l_shipdate").alias("requested"))

    @property
    def decisions(self) -> DataFrame:
        outcome = F.when(F.col("o_orderstatus") == "P", REFUSED).otherwise(ACCEPTED)
        return self.raw["orders"].select(F.col("o_orderkey").alias("order_id"), outcome.alias("outcome"))

    @property
    def waiting(self) -> DataFrame:
        return self.lines.filter(F.col("available") == 0)

    @property
    def pending(self) -> DataFrame:
        """Stock on order: waiting lines of accepted orders, per part."""
        accepted = self.decisions.filter(F.col("outcome") == ACCEPTED).select("order_id")
        quantity = self.waiting.join(accepted, "order_id", "left_semi") \
            .groupBy("part_code").agg(F.sum("needed").alias("quantity"))
        return quantity.withColumn("supplier", F.col("part_code") % 10)

    @property
    def deliveries(self) -> DataFrame:
        """A sequence of receipts per part: what supplied lines brought, in their order."""
        seq = (F.unix_date("requested").cast("bigint") * F.lit(10 ** 12)
               + F.col("order_id") * 10 + F.col("line_no"))
        return self.lines.filter(F.col("available") > 0).select(
            "part_code", seq.alias("seq"), F.col("available").alias("arrived"))

    @property
    def named_lines(self) -> DataFrame:
        return self.with_names(self.lines)

    def with_names(self, lines: DataFrame) -> DataFrame:
        """Lines with a part name of their own: every third part is written down under a name that the
        catalogue does not have, so the part counts as unused."""
        own = F.when(F.col("part_code") % 3 == 0, F.concat(F.lit("pezzo "), F.col("part_code").cast("string")))
        return lines.join(self.catalog.select("part_code", "name"), "part_code").withColumn(
            "name", F.coalesce(own, "name"))
