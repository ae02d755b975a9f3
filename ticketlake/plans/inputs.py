"""Spark projections of the benchmark tables onto the receipt domain."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.functions.fixed_values import PARSER_FORMATS

CENTS = "cast(cast({0} as decimal(18,2)) * 100 as bigint)"


def cents(column: str) -> str:
    return CENTS.format(column)


class Inputs:
    """Domain tables for one data folder. Everything is lazy and reads only needed columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def retail_brands(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey as retail_brand_id", "n_name as name", "array(n_name) as aliases")

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey as store_id",
            "s_nationkey as retail_brand_id",
            "s_name as location_name",
            "case s_suppkey % 3 when 0 then 'physical' when 1 then 'drive' else 'click_collect' end as channel",
        )

    @cached_property
    def receipts(self) -> DataFrame:
        formats = ", ".join(f"'{f}'" for f in PARSER_FORMATS)
        return self.table("orders").selectExpr(
            "o_orderkey as receipt_id",
            "o_custkey % 10 as store_id",
            "o_orderkey as document_id",
            f"element_at(array({formats}), cast(o_orderkey % 6 + 1 as int)) as parser_format",
            "case when o_orderkey % 11 <> 0 then cast(o_orderdate as timestamp_ntz) end as purchased_at",
            "o_orderpriority as register_number",
            "cast(o_orderkey as string) as ticket_number",
            f"{cents('o_totalprice')} as total_cents",
            "cast(o_orderkey % 7 as int) as declared_article_count",
            "case o_orderstatus when 'F' then 'reviewed' when 'P' then 'parsed' else 'needs_review' end as parser_status",
            "cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey) as created_at",
        )

    @cached_property
    def lines(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_name")
        price = cents("l_extendedprice")
        return (
            self.table("lineitem")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .selectExpr(
                f"concat_ws('-', l_orderkey, l_linenumber, l_partkey, {price}) as line_id",
                "l_orderkey as receipt_id",
                "l_linenumber as position",
                "p_name",
                "case l_linenumber % 3 when 0 then upper(p_name) when 1 then p_name else replace(p_name, 'e', 'é') end as label",
                "l_partkey % 17 = 0 as label_truncated",
                "cast(l_quantity as decimal(10,3)) as quantity",
                "case when l_suppkey % 5 = 0 then 'kg' else 'piece' end as unit_of_measure",
                f"case when l_linenumber % 2 = 1 then cast(round(cast({price} as decimal(18,0)) / cast(l_quantity as decimal(10,3))) as bigint) end as unit_price_cents",
                f"{price} as total_cents",
                "case when l_suppkey % 2 = 0 then 550 else 2000 end as vat_rate_bp",
                "l_suppkey % 3 = 0 as tr_eligible",
                "concat('S', l_suppkey % 4) as section_label",
                "case l_returnflag when 'N' then 'item' when 'R' then 'discount' else 'fee' end as kind",
                "l_partkey as part_id",
                "cast(round(l_tax * 100) as int) as tax_step",
                "cast(l_shipdate as timestamp_ntz) as shipped_at",
            )
        )

    @cached_property
    def matches(self) -> DataFrame:
        return self.lines.where("tax_step >= 5").selectExpr(
            "concat('m-', line_id) as match_id",
            "line_id",
            "case when tax_step <> 6 then part_id end as variant_id",
            "case tax_step when 5 then 'confirmed' when 6 then 'ignored' when 7 then 'rejected' else 'suggested' end as status",
            "case tax_step when 8 then 'heuristic' else 'user' end as source",
            "case tax_step when 8 then cast(0.5 as decimal(5,4)) end as confidence",
            "label as label_snapshot",
            "p_name as normalized_label_snapshot",
            "shipped_at as decided_at",
        )

    @cached_property
    def product_brands(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_brand as record_id",
            "p_brand as name",
            "regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ') as normalized_name",
            "case when cast(substr(p_brand, 7) as int) % 2 = 0 then cast(substr(p_brand, 7) as int) % 25 end as retail_brand_id",
        ).distinct()

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat(p_brand, '|', p_type) as record_id",
            "p_type as name",
            "lower(p_type) as normalized_name",
            "p_brand as product_brand_id",
            "p_type as category_name",
        ).distinct()

    @cached_property
    def variants(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as record_id",
            "p_name as name",
            "p_name as normalized_name",
            "concat(p_brand, '|', p_type) as product_id",
            "p_brand as product_brand_id",
            "lower(p_type) as product_normalized_name",
            "regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ') as brand_normalized_name",
            "case when p_partkey % 3 <> 0 then cast(p_partkey % 3 as int) end as package_count",
            "case when p_partkey % 5 <> 0 then cast(p_size as decimal(10,3)) end as quantity_value",
            "case when p_partkey % 4 <> 0 then concat('unit-', p_partkey % 4) end as comparison_unit_id",
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as category_id",
            "case when p_partkey > 0 then (p_partkey - 1) div 2 end as parent_id",
            "concat(p_name, ' ', p_partkey) as name",
        )

    @cached_property
    def checked_receipts(self) -> DataFrame:
        """Receipts whose declared totals and counts are off by a few for some keys."""
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.expr(f"sum({cents('l_extendedprice')})").alias("_sum"),
            F.expr("sum(case when l_returnflag = 'N' then case when l_suppkey % 5 = 0 then 1 else cast(l_quantity as bigint) end else 0 end)").alias("_count"),
        ).selectExpr(
            "l_orderkey as receipt_id",
            "_sum + l_orderkey % 5 - 2 as total_cents",
            "case when l_orderkey % 4 <> 0 then _count + l_orderkey % 3 - 1 end as declared_article_count",
        )

    @cached_property
    def checked_payments(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey as receipt_id",
            "l_linenumber as position",
            "'CB' as raw_label",
            f"{cents('l_extendedprice')} + case when l_linenumber = 1 and l_orderkey % 6 = 0 then 2 else 0 end as amount_cents",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as extraction_id",
            "user_id as document_id",
            "cast(ts as timestamp_ntz) as ran_at",
            "event_type <> 'error' as success",
            "cast(ts as timestamp_ntz) + make_dt_interval(0, 0, 0, event_id % 3) as created_at",
        )

    @cached_property
    def arrivals(self) -> DataFrame:
        """Receipts with coarse keys, so that duplicates occur."""
        return self.table("orders").selectExpr(
            "o_orderkey as receipt_id",
            "o_custkey % 5 as store_id",
            "case when o_orderkey % 13 <> 0 then o_orderpriority else '' end as register_number",
            "cast(o_custkey % 50 as string) as ticket_number",
            "cast(date_trunc('month', o_orderdate) as timestamp_ntz) + make_dt_interval(0, cast(o_orderkey % 3 as int)) as purchased_at",
            f"{cents('o_totalprice')} div 5000000 as total_cents",
            "cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey) as created_at",
        )
