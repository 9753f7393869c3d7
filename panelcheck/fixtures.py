"""Label tables derived from the benchmark tables, at any scale.

Each method is one view; the same rows are described in SQL in
``plans/catalog/views.py`` for the oracle.  Small fixed multipliers (five panels
per inspection, seven field types per panel) come from ``explode`` of a literal
sequence, so a view is one narrow pass over its base table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcheck.functions.expr import case_map
from panelcheck.functions.joins import plan_bytes
from panelcheck.session import configure
from panelcheck.sources.rulepacks import core_rule_pack

ROLES = {0: "front_pdp", 1: "back_panel", 2: "sticker", 3: "ecommerce_listing", 4: "side_panel"}
TYPES = {
    0: "mrp", 1: "net_quantity", 2: "manufacturer_address", 3: "mfg_date",
    4: "consumer_care", 5: "country_of_origin", 6: "commodity_name",
}
CATEGORIES = {1: "general", 2: "food", 3: "cosmetics", 4: "pan_masala", 5: "electronics", 6: "blown_glass", 7: "garments"}
REGIONS = {1: "Mumbai Zone", 2: "Delhi North", 3: "Chennai", 4: "Kolkata", 5: "Pune_West"}
LABELS = {0: "mrp", 1: "net_quantity", 2: "barcode", 3: "consumer_care"}


PART_BYTES = 256 * 1024


def _times(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(n)])))


def _s(col: Column) -> Column:
    return col.cast("string")


class Fixtures:
    """The views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def base(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
        return df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns])

    def dealt(self, table: str, key: str, *columns: str) -> DataFrame:
        """A parent table dealt by its key before its children are made from it.

        The children stay where their parent is, so what groups or joins them by the parent needs no exchange of their own rows:
        a parent moves as a few numbers, its children would as twenty wide rows.  A file of few MB holds millions of parents,
        so there are tasks by the size of the file, not by the blocks it is read in.
        """
        df = self.base(table)
        return df.select(key, *columns).repartition(self.tasks(df), key)

    def tasks(self, df: DataFrame) -> int:
        """So many tasks for what is made from a base table: no fewer than the session asks for."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(df) // PART_BYTES))

    def _supplier_count(self) -> Column:
        return self.base("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()

    def users(self) -> DataFrame:
        s, n, r = self.base("supplier"), self.base("nation"), self.base("region")
        key = F.col("s_suppkey")
        return (
            s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("id"),
                F.concat(F.lit("officer"), _s(key), F.lit("@example.in")).alias("email"),
                F.col("s_name").alias("full_name"),
                F.when(key % 5 == 4, "supervisor").when(key % 13 == 12, "admin").otherwise("officer").alias("role"),
                F.when(key % 7 == 3, F.lit(None)).otherwise(F.col("r_name")).alias("region"),
            )
        )

    def inspections(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.base("orders").select(
            o.alias("id"),
            ((c * 7 + o) % self._supplier_count()).alias("officer_id"),
            F.when(c % 2 == 0, c).alias("batch_id"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "needs_review")
            .when(o % 4 == 0, "sync_pending")
            .otherwise("draft")
            .alias("status"),
            case_map(c % 8, CATEGORIES).alias("commodity_category"),
            F.when(o % 9 == 0, "2025.01.01").otherwise("2026.02.01").alias("rule_pack_version"),
            (F.col("o_orderpriority") == "5-LOW").alias("is_self_check"),
            case_map(c % 6, REGIONS).alias("region"),
            (o % 3 == 0).alias("captured_offline"),
            F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("c-"), _s(o % 1000)).alias("client_id"),
        )

    def images(self) -> DataFrame:
        o, k = F.col("o_orderkey"), F.col("k")
        blank = (o + k) % 17 == 0
        ident = o * 10 + k
        return (
            _times(self.dealt("orders", "o_orderkey", "o_orderdate"), "k", 5)
            .filter(k <= o % 5)
            .select(
                ident.alias("id"),
                o.alias("inspection_id"),
                case_map(k, ROLES).alias("image_role"),
                F.when(blank, F.lit(None)).otherwise(800 + (o * 13 + k) % 1200).alias("width_px"),
                F.when(blank, F.lit(None)).otherwise(900 + (o * 29 + k) % 1500).alias("height_px"),
                F.when((o + k) % 4 == 0, F.lit(None))
                .otherwise(0.03 + ((o * 3 + k) % 12) / F.lit(100.0))
                .alias("calibration_scale_mm_per_px"),
                ((o + k) % 6 != 0).alias("quality_check_passed"),
                F.col("o_orderdate").alias("captured_at"),
                F.concat(F.lit("i-"), _s(ident % 500)).alias("client_id"),
                F.when(ident % 5 == 1, F.concat(F.lit("https://store.example/"), _s(ident), F.lit(".jpg")))
                .otherwise(F.concat(F.lit("local://"), _s(o), F.lit("/"), _s(ident), F.lit(".jpg")))
                .alias("storage_url"),
                F.when(ident % 10 == 3, F.lit(None))
                .otherwise(F.sha2(F.concat(F.lit("img-"), _s(ident)), 256))
                .alias("sha256_hash"),
            )
        )

    def extracted_fields(self) -> DataFrame:
        i, t = F.col("id"), F.col("t")
        insp = F.col("inspection_id")
        price = 100 + insp % 50 + F.when(i % 11 == 2, 35).when(i % 13 == 3, -10).otherwise(0)
        amount = 50 * (1 + insp % 20) + F.when(i % 19 == 1, 50).otherwise(0)
        month = 1 + (insp + F.when(i % 29 == 1, 1).otherwise(0)) % 9
        parsed = (
            F.when(t == 0, F.concat(F.lit("Rs. "), _s(price), F.lit(".00")))
            .when(t == 1, F.concat(_s(amount), F.lit(" g")))
            .when(t == 2, F.when(i % 23 == 3, "Other Foods Pvt Ltd").otherwise("Acme Foods"))
            .when(t == 3, F.concat(F.lit("0"), _s(month), F.lit("/2026")))
            .when(t == 5, F.when(i % 31 == 3, "CHINA").otherwise("INDIA"))
            .otherwise("x")
        )
        return (
            _times(self.images().select("id", "inspection_id"), "t", 7)
            .filter((i + t * 5) % 6 != 0)
            .select(
                (i * 10 + t).alias("id"),
                insp,
                i.alias("source_image_id"),
                (i * 10 + t).alias("field_seq"),
                case_map(t, TYPES).alias("field_type"),
                F.concat(F.lit("seen "), parsed).alias("raw_text"),
                parsed.alias("parsed_value"),
                (0.60 + ((i * 7 + t * 13) % 40) / F.lit(100.0)).alias("confidence"),
                ((i * 3 + t) % 400).cast("double").alias("box_x"),
                ((i * 11 + t) % 500).cast("double").alias("box_y"),
                (60 + (i + t) % 90).cast("double").alias("box_w"),
                ((i * 5 + t) % 40 + 4).alias("box_h"),
                F.when((i + t) % 12 == 5, "needs_review")
                .when((i + t) % 41 == 7, "fail")
                .when((i + t) % 43 == 9, "not_applicable")
                .otherwise("pass")
                .alias("verdict"),
                ((i + t) % 10 == 3).alias("reviewed_by_officer"),
                F.when((i + t) % 20 == 3, F.concat(F.lit("fixed "), _s(t))).alias("officer_override_value"),
            )
        )

    def violations(self) -> DataFrame:
        o, n = F.col("o_orderkey"), F.col("n")
        return (
            _times(self.base("orders").select("o_orderkey", "o_orderdate"), "n", 7)
            .filter(((o * 7 + n * 5) % 11 < 2) & (o % 3 != 1))
            .select(
                (o * 10 + n).alias("id"),
                o.alias("inspection_id"),
                F.when(n % 3 != 0, o * 100 + n).alias("extracted_field_id"),
                F.concat(F.lit("rule-"), _s(n)).alias("rule_id"),
                F.concat(F.lit("Rule 6("), _s(n), F.lit(")")).alias("citation"),
                F.concat(F.lit("deficiency "), _s(n)).alias("description"),
                F.when(n < 2, "critical").when(n < 5, "major").otherwise("minor").alias("severity"),
                F.col("o_orderdate").alias("created_at"),
            )
        )

    def audit_logs(self) -> DataFrame:
        e = F.col("event_id")
        return self.base("events").select(
            e.alias("id"),
            (F.col("user_id") % self._supplier_count()).alias("actor_user_id"),
            F.concat(F.lit("field_"), F.col("event_type")).alias("action"),
            F.when(e % 5 == 0, "inspection").otherwise("extracted_field").alias("entity_type"),
            (e % 200).alias("entity_id"),
            F.when(e % 4 == 1, '{"verdict": "needs_review"}').alias("before_value"),
            F.col("props").alias("after_value"),
            F.col("ts").alias("created_at"),
        )

    def ocr_lines(self) -> DataFrame:
        p, n = F.col("p_partkey"), F.col("n")
        unit = F.when(p % 3 == 0, " GMS").when(p % 3 == 1, " ml").otherwise(" N")
        text = (
            F.when(n == 0, F.concat(F.upper("p_name"), F.lit(" NET WEIGHT")))
            .when(n == 1, F.concat(F.lit("NET QTY: "), _s(F.col("p_size") * 10), unit))
            .when(n == 2, F.concat(F.lit("M.R.P. Rs. "), _s(F.floor("p_retailprice").cast("int")), F.lit(".50")))
            .when(n == 3, F.when(p % 4 == 0, "PRICE AS STAMPED").otherwise("(Incl. of all taxes)"))
            .when(n == 4, F.concat(F.lit("MFD: 0"), _s(1 + p % 9), F.lit("/2026")))
            .when(n == 5, "Manufactured by: Acme Foods Ltd.")
            .when(n == 6, F.concat(F.lit("Gurugram, Haryana "), _s(122000 + p % 900)))
            .when(n == 7, F.concat(F.lit("Consumer Care: care"), _s(p), F.lit("@acme.in")))
            .otherwise("Country of Origin: India")
        )
        # Patterns cost far more than bytes: a part file of few MB is one block, and all its lines would be one task's.
        part = self.base("part")
        spread = part.select("p_partkey", "p_name", "p_size", "p_retailprice").repartition(self.tasks(part))
        return _times(spread, "n", 9).select(
            p.alias("source_image_id"),
            n.alias("line_number"),
            text.alias("text"),
            (0.70 + ((p * 3 + n * 7) % 30) / F.lit(100.0)).alias("confidence"),
            F.lit(10.0).alias("x"),
            (30.0 * n).alias("y"),
            F.lit(200.0).alias("w"),
            F.lit(25.0).alias("h"),
        )

    def boxes(self) -> DataFrame:
        o, k = F.col("o_orderkey"), F.col("k")
        predicted = F.col("src") == "prediction"
        d = _times(self.dealt("orders", "o_orderkey"), "k", 4).filter(k <= o % 4)
        return (
            d.withColumn("src", F.explode(F.array(F.lit("truth"), F.lit("prediction"))))
            .filter(~(predicted & ((o + k) % 5 == 0)))
            .select(
                o.alias("task_id"),
                "src",
                k.alias("box_id"),
                case_map(((o + k) % 4).cast("int"), LABELS).alias("label"),
                (5.0 + 12 * k + F.when(predicted, o % 7).otherwise(0)).alias("x"),
                (10.0 + o % 30).alias("y"),
                F.lit(20.0).alias("width"),
                F.lit(15.0).alias("height"),
            )
        )

    def rule_packs(self) -> DataFrame:
        return core_rule_pack(self.spark)
