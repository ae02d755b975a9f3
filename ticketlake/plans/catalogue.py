"""Product catalogue queries."""

from pyspark.sql import functions as F

from ticketlake.operators import catalogue as ops
from ticketlake.operators.ordering import with_rank
from ticketlake.plans.registry import query

MEMBERS = """SELECT p_partkey // 4 AS group_id, p_partkey AS variant_id, ['equivalent', 'comparable_size', 'different_size'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS equivalence FROM part
    UNION ALL SELECT 1000000 + p_partkey // 10, p_partkey, 'equivalent' FROM part WHERE p_size > 25"""


def memberships(t):
    first = t.table("part").selectExpr("p_partkey div 4 as group_id", "p_partkey as variant_id", "element_at(array('equivalent', 'comparable_size', 'different_size'), cast(p_partkey % 3 + 1 as int)) as equivalence")
    second = t.table("part").where("p_size > 25").selectExpr("1000000 + p_partkey div 10 as group_id", "p_partkey as variant_id", "'equivalent' as equivalence")
    return first.unionByName(second)


@query("variant_product_brand", "SELECT v.record_id, p.name AS product_name, b.name AS brand_name, b.normalized_name AS brand_normalized_name FROM variants_v v JOIN products_v p ON v.product_id = p.record_id JOIN product_brands_v b ON p.product_brand_id = b.record_id")
def variant_product_brand(t):
    variants = t.variants.select("record_id", "product_id")
    return ops.variant_product_brand(variants, t.products.withColumn("category_id", F.col("category_name")), t.product_brands).select(
        "record_id", "product_name", "brand_name", "brand_normalized_name"
    )


HOLDERS = "SELECT parent_id AS category_id, 'children' AS held_by FROM categories_v WHERE parent_id IS NOT NULL UNION SELECT p_size * 7, 'products' FROM part UNION SELECT p_size * 11, 'groups' FROM part"


def _holders(t):
    products = t.table("part").selectExpr("cast(p_size * 7 as bigint) as category_id")
    groups = t.table("part").selectExpr("cast(p_size * 11 as bigint) as category_id")
    return t.categories, products, groups


@query("categories_in_use", f"SELECT category_id, held_by FROM ({HOLDERS}) WHERE category_id IN (SELECT category_id FROM categories_v)")
def categories_in_use(t):
    return ops.categories_in_use(*_holders(t))


@query("deletable_categories", f"SELECT category_id FROM categories_v WHERE category_id NOT IN (SELECT category_id FROM ({HOLDERS}))")
def deletable_categories(t):
    return ops.deletable_categories(*_holders(t)).select("category_id")


@query("relationship_counts", """SELECT 'products_per_brand' AS relation, b.record_id AS parent, count(p.record_id) AS children FROM product_brands_v b LEFT JOIN products_v p ON p.product_brand_id = b.record_id GROUP BY ALL
    UNION ALL SELECT 'variants_per_product', p.record_id, count(v.record_id) FROM products_v p LEFT JOIN variants_v v ON v.product_id = p.record_id GROUP BY ALL
    UNION ALL SELECT 'children_per_category', CAST(c.category_id AS VARCHAR), count(k.category_id) FROM categories_v c LEFT JOIN categories_v k ON k.parent_id = c.category_id GROUP BY ALL""")
def relationship_counts(t):
    pairs = [
        ("products_per_brand", t.product_brands, "record_id", t.products, "product_brand_id"),
        ("variants_per_product", t.products, "record_id", t.variants, "product_id"),
        ("children_per_category", t.categories, "category_id", t.categories, "parent_id"),
    ]
    counted = [
        ops.relationship_counts(parents, key, children, child).select(F.lit(name).alias("relation"), F.col(key).cast("string").alias("parent"), "children")
        for name, parents, key, children, child in pairs
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("alternatives_of_variant", f"""WITH m AS ({MEMBERS}) SELECT a.variant_id, a.group_id, b.variant_id AS alternative_id, b.equivalence AS alternative_equivalence
    FROM m a JOIN m b ON a.group_id = b.group_id AND a.variant_id <> b.variant_id WHERE a.variant_id IN (SELECT variant_id FROM matches_v WHERE status = 'suggested')""")
def alternatives_of_variant(t):
    wanted = t.matches.where("status = 'suggested'").select("variant_id").distinct()
    return ops.alternatives_of_variants(wanted, memberships(t)).select("variant_id", "group_id", "alternative_id", "alternative_equivalence")


@query("product_group_members", f"SELECT DISTINCT group_id, product_id FROM ({MEMBERS}) JOIN variants_v ON variant_id = record_id")
def product_group_members(t):
    return ops.product_group_members(memberships(t), t.variants)


@query("membership_changes", f"""WITH m AS ({MEMBERS}) SELECT group_id, variant_id FROM (SELECT group_id, variant_id FROM m UNION SELECT p_partkey // 8, p_partkey FROM part)
    WHERE NOT (group_id >= 1000000 AND variant_id % 2 = 0)""")
def membership_changes(t):
    current = memberships(t)
    additions = t.table("part").selectExpr("p_partkey div 8 as group_id", "p_partkey as variant_id", "'equivalent' as equivalence")
    removals = current.where("group_id >= 1000000 and variant_id % 2 = 0")
    return ops.membership_changes(current, additions, removals).select("group_id", "variant_id")


def _catalogue_index(name, sort, direction, order):
    @query(name, f"SELECT record_id, row_number() OVER (ORDER BY {order}) AS rank FROM variants_v")
    def index(t):
        return with_rank(t.variants.select("record_id", "name", "normalized_name", "package_count", "quantity_value"), ops.catalogue_order("product_variants", "record_id", sort, direction)).select("record_id", "rank")


_catalogue_index("catalogue_index", None, "asc", "normalized_name, record_id")
_catalogue_index("catalogue_index_by_count_desc", "package_count", "desc", "package_count DESC NULLS FIRST, record_id")
_catalogue_index("catalogue_index_by_unknown", "secret", "asc", "normalized_name, record_id")


def paths(t):
    return ops.category_paths(t.categories)


@query("category_path", "SELECT category_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path, crumb AS breadcrumb FROM tree_v")
def category_path(t):
    return paths(t).select("category_id", "depth", F.array_join(F.transform("path_ids", lambda x: x.cast("string")), "/").alias("path"), "breadcrumb")


@query("category_descendants", "SELECT ancestor_id, category_id AS descendant_id, CAST(depth - place AS INTEGER) AS distance FROM (SELECT category_id, depth, unnest(path) AS ancestor_id, generate_subscripts(path, 1) AS place FROM tree_v) WHERE ancestor_id <> category_id")
def category_descendants(t):
    return ops.category_descendants(paths(t))


@query("category_cycles", """SELECT p_partkey AS category_id FROM part WHERE p_partkey IN (1, 3, 7)""")
def category_cycles(t):
    # Node 1 is put below its descendant 7, which closes the ring 1 - 3 - 7.
    looped = t.categories.withColumn("parent_id", F.when(F.col("category_id") == 1, F.lit(7)).otherwise(F.col("parent_id")))
    return ops.category_cycles(looped)


@query("invalid_moves", """SELECT p_partkey AS category_id, CAST(p_size AS BIGINT) AS new_parent_id FROM part JOIN tree_v ON category_id = p_size WHERE list_contains(path, p_partkey)""")
def invalid_moves(t):
    moves = t.table("part").selectExpr("p_partkey as category_id", "cast(p_size as bigint) as new_parent_id")
    return ops.invalid_moves(moves, paths(t))


@query("valid_parents", "SELECT CAST(w AS BIGINT) AS category_id, category_id AS parent_id, crumb AS breadcrumb FROM tree_v CROSS JOIN (VALUES (1), (5), (8)) AS wanted(w) WHERE NOT list_contains(path, w)")
def valid_parents(t):
    return ops.valid_parents([1, 5, 8], paths(t)).withColumn("category_id", F.col("category_id").cast("bigint"))


@query("allowed_parents", "SELECT category_id AS parent_id, crumb AS breadcrumb FROM tree_v WHERE NOT list_contains(path, 5)")
def allowed_parents(t):
    return ops.allowed_parents(5, paths(t))


@query("catalogue_label", """SELECT v.record_id AS variant_id, v.product_brand_id || CASE WHEN r.name IS NULL THEN '' ELSE ' (' || r.name || ' private label)' END AS brand_label,
    v.product_brand_id || ' — ' || p.name || ' — ' || c.crumb AS product_label, v.product_brand_id || ' — ' || p.name || ' — ' || c.crumb || ' — ' || v.name AS variant_label
    FROM variants_v v JOIN products_v p ON p.record_id = v.product_id JOIN product_brands_v b ON b.record_id = v.product_brand_id
    LEFT JOIN retail_brands_v r USING (retail_brand_id) JOIN tree_v c ON c.category_id = length(p.record_id)""")
def catalogue_label(t):
    products = t.products.withColumn("category_id", F.length("record_id").cast("bigint"))
    return ops.catalogue_labels(t.variants.select("record_id", "name", "product_id"), products, t.product_brands, t.retail_brands, paths(t))


@query("upsert_catalogue_chain", """WITH asked AS (SELECT DISTINCT 'brand' AS kind, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS a, '' AS b, '' AS c, '' AS d FROM part
    UNION SELECT 'category', lower(p_type), '', '', '' FROM part WHERE p_size <= 40
    UNION SELECT 'product', regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'), lower(p_type), split_part(p_name, ' ', 2), '' FROM part WHERE p_size <= 40
    UNION SELECT 'variant', regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'), lower(p_type), split_part(p_name, ' ', 2), p_name FROM part WHERE p_size <= 40)
    SELECT kind, count(*) AS n FROM asked GROUP BY kind UNION ALL SELECT 'reject', count(*) FROM part WHERE p_size > 40""")
def upsert_catalogue_chain(t):
    """Chains for all parts; half the brands exist, large sizes come without a category."""
    asked = t.table("part").selectExpr(
        "p_brand as brand_name", "cast(null as int) as retail_brand_id", "case when p_size <= 40 then p_type else '' end as category_name",
        "split(p_name, ' ')[1] as product_name", "upper(p_name) as variant_name", "p_size as package_count", "cast(p_size as decimal(10,3)) as quantity_value", "cast(null as string) as barcode",
    )
    brands = t.product_brands.withColumn("slug", F.lower("name"))
    none = t.spark.createDataFrame([], "record_id string, name string, normalized_name string, slug string")
    products = t.spark.createDataFrame([], "record_id string, product_brand_id string, category_id string, normalized_name string, name string, slug string")
    variants = t.spark.createDataFrame([], "record_id string, product_id string, normalized_name string, name string, slug string, package_count int, quantity_value decimal(10,3), barcode string")
    out = ops.upsert_catalogue_chain(asked, brands, none, products, variants)
    counted = None
    for kind, table in [("brand", "product_brands"), ("category", "categories"), ("product", "products"), ("variant", "product_variants"), ("reject", "rejects")]:
        part = out[table].agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        counted = part if counted is None else counted.unionByName(part)
    return counted


def filled_chain(t):
    """Chains for all parts over stored brands, categories, products, variants, makers and units; stored gaps are filled."""
    sized = "element_at(array('SM', 'LG', 'MED', 'JUMBO', 'WRAP'), cast(p_size % 5 + 1 as int))"
    parts = t.table("part").selectExpr(
        "p_partkey", "p_brand as brand_name", "cast(null as int) as retail_brand_id", "p_type as category_name", "split(p_name, ' ')[1] as product_name", "upper(p_name) as variant_name", "p_size as package_count",
        "cast(p_size as decimal(10,3)) as quantity_value", "concat('b', p_partkey) as barcode", "if(p_size > 10, concat('Maker ', substr(p_brand, 7, 1)), ' ') as manufacturer_name", f"if(p_partkey % 2 = 0, concat('Size ', {sized}), null) as unit_name",
        f"{sized} as unit_symbol",
    )
    brands = t.product_brands.withColumn("slug", F.lower("name"))
    named = ("name", "lower(name) as normalized_name", "lower(name) as slug")
    categories = parts.where("p_partkey % 4 = 0").selectExpr("category_name as name").distinct().selectExpr("concat('c-', lower(name)) as record_id", *named)
    key = "concat_ws('/', brand_name, lower(category_name), product_name)"
    products = parts.where("p_partkey % 4 = 0").selectExpr(
        f"concat('p-', {key}) as record_id", "brand_name as product_brand_id", "concat('c-', lower(category_name)) as category_id", "product_name as normalized_name", "product_name as name", "product_name as slug",
        "if(length(product_name) % 2 = 0, 'm-stored', null) as manufacturer_id",
    ).distinct()
    variants = parts.where("p_partkey % 8 = 0").groupBy(F.expr(f"concat('p-', {key}) as product_id"), F.lower("variant_name").alias("normalized_name")).agg(
        F.min(F.expr("if(p_partkey % 16 = 8, 7, null)")).alias("package_count")
    ).selectExpr("concat('v-', product_id, normalized_name) as record_id", "*", "normalized_name as name", "normalized_name as slug", "cast(null as decimal(10,3)) as quantity_value", "'old' as barcode", "cast(null as string) as comparison_unit_id")
    makers = t.table("part").selectExpr("concat('Maker ', substr(p_brand, 7, 1)) as name").distinct().where("name < 'Maker 3'").selectExpr("concat('m-', name) as record_id", *named)
    units = parts.select("unit_symbol").distinct().where("unit_symbol in ('SM', 'LG')").selectExpr("concat('u-', unit_symbol) as record_id", "concat('stored ', unit_symbol) as name", "lower(concat('stored ', unit_symbol)) as normalized_name", "lower(unit_symbol) as slug", "unit_symbol as symbol")
    tables = {"product_brands": brands, "categories": categories, "products": products, "product_variants": variants, "manufacturers": makers, "comparison_units": units}
    return ops.fill_chain(parts.drop("p_partkey"), tables)


CHAINED = """WITH a AS (SELECT *, p_brand AS b, lower(p_type) AS c, split_part(p_name, ' ', 2) AS p, p_name AS v, ['SM', 'LG', 'MED', 'JUMBO', 'WRAP'][CAST(p_size % 5 + 1 AS INTEGER)] AS u FROM part),
    np AS (SELECT b, c, p, count(*) FILTER (WHERE p_partkey % 4 = 0) > 0 AS old, min(CASE WHEN p_size > 10 THEN 'Maker ' || substr(p_brand, 7, 1) END) AS m FROM a GROUP BY b, c, p),
    nv AS (SELECT b, c, p, v, count(*) FILTER (WHERE p_partkey % 8 = 0) > 0 AS old, coalesce(min(CASE WHEN p_partkey % 16 = 8 THEN 7 END), min(p_size)) AS package_count,
        CASE WHEN count(*) FILTER (WHERE p_partkey % 8 = 0) > 0 THEN 'old' ELSE min('b' || p_partkey) END AS barcode, min(u) AS symbol FROM a GROUP BY b, c, p, v)"""


@query("catalogue_chain_products", CHAINED + """ SELECT b AS brand, c AS category, p AS product, old AS stored, CASE WHEN old AND length(p) % 2 = 0 THEN 'stored' ELSE m END AS maker FROM np""")
def catalogue_chain_products(t):
    out = filled_chain(t)
    categories = out["categories"].selectExpr("record_id as category_id", "normalized_name as category")
    makers = out["manufacturers"].selectExpr("record_id as manufacturer_id", "name as maker")
    joined = out["products"].join(categories, "category_id").join(makers, "manufacturer_id", "left")
    return joined.selectExpr("product_brand_id as brand", "category", "normalized_name as product", "record_id like 'p-%' as stored", "if(manufacturer_id = 'm-stored', 'stored', maker) as maker")


@query("catalogue_chain_variants", CHAINED + """ SELECT b AS brand, c AS category, p AS product, v AS variant, old AS stored, package_count, barcode, symbol, symbol IN ('SM', 'LG') AS stored_unit FROM nv""")
def catalogue_chain_variants(t):
    out = filled_chain(t)
    categories = out["categories"].selectExpr("record_id as category_id", "normalized_name as category")
    products = out["products"].join(categories, "category_id").selectExpr("record_id as product_id", "product_brand_id as brand", "category", "normalized_name as product")
    units = out["comparison_units"].selectExpr("record_id as comparison_unit_id", "symbol")
    return out["product_variants"].join(products, "product_id").join(units, "comparison_unit_id").selectExpr(
        "brand", "category", "product", "normalized_name as variant", "record_id like 'v-%' as stored", "package_count", "barcode", "symbol", "comparison_unit_id like 'u-%' as stored_unit"
    )
