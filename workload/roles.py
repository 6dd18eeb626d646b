"""The library tables, derived from the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.calendar import calendar_columns
from shelfwise.functions.operations import action_type, operation_flags

# Operation code by (return flag, line status), and its description; code 8 has none on purpose.
LOAN_OUT, LOAN_IN, RETURN_OUT, RETURN_IN, RENEWAL, OTHER = 4, 97, 5, 98, 7, 8
DESCRIPTIONS = (
    (LOAN_OUT, "loan out"),
    (LOAN_IN, "loan in house"),
    (RETURN_OUT, "return out"),
    (RETURN_IN, "return in house"),
    (RENEWAL, "renewal check"),
)


class Roles:
    """Lazy access to each table; nothing is read until a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def titles(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("TITUL_KEY"),
            F.concat_ws(" ", "p_type", F.col("p_partkey").cast("string")).alias("TITUL_SIGN_FULL"),
            F.col("p_name").alias("TITUL_NAZEV"),
            F.col("p_brand").alias("TITUL_ZAHLAVI"),
            (F.lit(1970) + F.col("p_size")).cast("bigint").alias("TITUL_ROK_VYDANI"),
            F.col("p_brand").alias("TITUL_JAZYK"),
            F.col("p_type").alias("TITUL_DRUH_DOKUMENTU"),
        )

    @staticmethod
    def _copy_key():
        return F.col("l_partkey") * 1000000 + F.col("l_suppkey")

    @staticmethod
    def _opid():
        returned, finished = F.col("l_returnflag"), F.col("l_linestatus") == "F"
        return (
            F.when((returned == "R") & finished, LOAN_OUT)
            .when(returned == "R", LOAN_IN)
            .when((returned == "A") & finished, RETURN_OUT)
            .when(returned == "A", RETURN_IN)
            .when(finished, RENEWAL)
            .otherwise(OTHER)
            .cast("bigint")
        )

    def copies(self) -> DataFrame:
        pairs = self.table("lineitem").select(
            self._copy_key().alias("SVAZKY_KEY"), F.col("l_partkey").alias("SVAZKY_PTR_TITUL")
        )
        return pairs.distinct()

    def operations(self, *, readers: bool = False) -> DataFrame:
        lines = self.table("lineitem")
        columns = [
            self._copy_key().alias("STAT_VYP_PTR_SVAZKY"),
            F.col("l_shipdate").alias("STAT_VYP_TIME"),
            self._opid().alias("STAT_VYP_OPID"),
            F.col("l_suppkey").alias("STAT_VYP_PTR_KNODDEL"),
        ]
        if readers:
            orders = self.table("orders").select("o_orderkey", "o_custkey")
            # of a line only the finished columns are shuffled
            lines = lines.select("l_orderkey", *columns)
            joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left")
            return joined.select(*lines.columns[1:], F.col("o_custkey").alias("STAT_VYP_PTR_LEG"))
        return lines.select(*columns)

    def op_types(self) -> DataFrame:
        rows = ", ".join(f"({code}L, '{text}')" for code, text in DESCRIPTIONS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(OPIDY_OPID, OPIDY_POPIS)")

    def branches(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").select(
            F.col("s_suppkey").alias("KNODDEL_KEY"),
            F.col("s_name").alias("KNODDEL_NAZEV"),
            F.col("n_name").alias("KNODDEL_ULICE"),
            F.col("s_nationkey").cast("string").alias("KNODDEL_PSC"),
        )

    def doc_types(self) -> DataFrame:
        """Labels of all types but one: the code list has no entry for ``STANDARD``, which therefore keeps its code."""
        return (
            self.table("part")
            .filter("p_type <> 'STANDARD'")
            .select(
                F.col("p_type").alias("CISELNIKY_ZKRATKA"),
                F.concat(F.lit("type "), F.lower("p_type")).alias("CISELNIKY_TEXT"),
            )
            .distinct()
        )

    def readers(self) -> DataFrame:
        key = F.col("c_custkey")
        postcode = (
            F.when(key % 10 == 0, "$NIC$")
            .when(key % 10 == 1, "")
            .when(key % 10 == 2, "1 2")
            .otherwise(F.concat((key % 800 + 100).cast("string"), F.lit(" 00")))
        )
        return self.table("customer").select(
            key.alias("LEG_KEY"),
            F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("VEK"),
            (F.col("c_nationkey") % 8).cast("string").alias("POHLAVI"),
            postcode.alias("ADRESY_PSC"),
        )

    def txdesk(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("TXDESK_KEY"), F.col("n_name").alias("TXDESK_DESKRIPTOR")
        )

    def desk(self) -> DataFrame:
        lines, supplier = self.table("lineitem"), self.table("supplier")
        # lines have nearly as many pairs of title and supplier as rows, and few of title and nation: only these are shuffled
        pairs = lines.select("l_partkey", "l_suppkey")
        return (
            pairs.join(supplier, pairs["l_suppkey"] == supplier["s_suppkey"], "left")
            .select(F.col("l_partkey").alias("DESK_PTR_TITUL"), F.col("s_nationkey").alias("DESK_PTR_TXDESK"))
            .distinct()
        )

    def txoch(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("TXOCH_KEY"), F.col("r_name").alias("TXOCH_TEXT"))

    def och(self) -> DataFrame:
        nation = self.table("nation")
        desk = self.desk()
        return (
            desk.join(nation, desk["DESK_PTR_TXDESK"] == nation["n_nationkey"], "left")
            .select(F.col("DESK_PTR_TITUL").alias("OCH_PTR_TITUL"), F.col("n_regionkey").alias("OCH_PTR_TXOCH"))
            .distinct()
        )

    def subject_tables(self) -> dict[str, DataFrame]:
        return {"och": self.och(), "txoch": self.txoch(), "desk": self.desk(), "txdesk": self.txdesk()}

    def enriched(self) -> DataFrame:
        """Wide operations as an already enriched table would hold them (without subjects)."""
        lines, part, types = self.table("lineitem"), self.titles(), self.op_types()
        opid, day = self._opid(), F.col("l_shipdate").cast("timestamp_ntz")
        rows = lines.select(
            F.col("l_partkey").alias("key"),
            self._copy_key().alias("SVAZKY_KEY"),
            opid.alias("VYP_OPID"),
            *[c.alias(n) for n, c in calendar_columns(day).items()],
        )
        joined = rows.join(part, rows["key"] == part["TITUL_KEY"], "left").join(
            types, rows["VYP_OPID"] == types["OPIDY_OPID"], "left"
        )
        flags = operation_flags(F.col("VYP_OPID"))
        return joined.withColumns(
            {**flags, "ACTION_TYPE": action_type(F.col("OPIDY_POPIS"), F.col("VYP_OPID"))}
        ).drop("key")
