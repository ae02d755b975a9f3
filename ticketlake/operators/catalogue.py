"""Product catalogue: labels, relationship counts, category tree, find-or-create upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.functions.fixed_values import BREADCRUMB_SEPARATOR, LABEL_SEPARATOR, PRIVATE_LABEL_TEXT
from ticketlake.operators.ordering import earliest_by, ordered
from ticketlake.session import durable

# Sortable columns per catalogue table.
CATALOGUE_SORTS = {
    "categories": ["name", "normalized_name", "slug"],
    "products": ["name", "normalized_name", "slug"],
    "product_variants": ["name", "normalized_name", "slug", "package_count", "quantity_value", "barcode"],
    "product_brands": ["name", "normalized_name", "slug"],
    "manufacturers": ["name", "normalized_name", "slug"],
    "comparison_units": ["name", "normalized_name", "slug", "symbol"],
    "product_alternative_groups": ["name"],
}


def catalogue_order(table: str, key: str, sort: str | None = None, direction: str = "asc") -> list[Column]:
    default = "name" if table == "product_alternative_groups" else "normalized_name"
    column = sort if sort in CATALOGUE_SORTS[table] else default
    return [ordered(column, direction), ordered(key)]


def variant_product_brand(variants: DataFrame, products: DataFrame, brands: DataFrame) -> DataFrame:
    """Variants with product and brand names; dimension sizes decide the join strategy."""
    product = products.select(
        F.col("record_id").alias("product_id"),
        "category_id",
        F.col("name").alias("product_name"),
        F.col("normalized_name").alias("product_normalized_name"),
        "product_brand_id",
    )
    brand = brands.select(
        F.col("record_id").alias("product_brand_id"),
        F.col("name").alias("brand_name"),
        F.col("normalized_name").alias("brand_normalized_name"),
    )
    keep = [c for c in variants.columns if c not in ("product_brand_id", "category_id")]
    return variants.select(*keep).join(product, "product_id").join(brand, "product_brand_id")


def categories_in_use(categories: DataFrame, products: DataFrame, groups: DataFrame) -> DataFrame:
    """Categories with children, products or alternative groups, and what holds them."""
    holders = (
        categories.where("parent_id is not null").select(F.col("parent_id").alias("category_id"), F.lit("children").alias("held_by"))
        .unionByName(products.select("category_id", F.lit("products").alias("held_by")))
        .unionByName(groups.select("category_id", F.lit("groups").alias("held_by")))
        .distinct()
    )
    return holders.join(categories.select("category_id"), "category_id", "left_semi")


def deletable_categories(categories: DataFrame, products: DataFrame, groups: DataFrame) -> DataFrame:
    return categories.join(categories_in_use(categories, products, groups), "category_id", "left_anti")


def relationship_counts(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Children per parent; zero counts are kept."""
    counted = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("children"))
    return parents.select(parent_key).join(counted, parent_key, "left").na.fill(0, ["children"])


def alternatives_of_variants(wanted: DataFrame, memberships: DataFrame) -> DataFrame:
    """Other members of the groups the wanted variants belong to, with both equivalence levels."""
    mine = memberships.join(wanted.select("variant_id"), "variant_id", "left_semi")
    others = memberships.select("group_id", F.col("variant_id").alias("alternative_id"), F.col("equivalence").alias("alternative_equivalence"))
    return mine.join(others, "group_id").where(F.col("variant_id") != F.col("alternative_id"))


def product_group_members(memberships: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct products per alternative group: product-level alternatives in factored form."""
    owner = variants.select(F.col("record_id").alias("variant_id"), "product_id")
    return memberships.join(owner, "variant_id").select("group_id", "product_id").distinct()


def membership_changes(current: DataFrame, additions: DataFrame, removals: DataFrame) -> DataFrame:
    """Next membership snapshot: one row per group and variant, removals last.

    Of several additions of a pair the first equivalence in byte order counts.
    """
    keys = ["group_id", "variant_id"]
    fresh = earliest_by(additions.select(*current.columns), keys, ["equivalence"]).select(*current.columns)
    fresh = fresh.join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh).join(removals.select(*keys), keys, "left_anti")


def derive_identity(names: DataFrame, name: str = "name") -> DataFrame:
    return names.withColumn("normalized_name", text.normalize_text(F.col(name))).withColumn("slug", text.slugify(F.col(name)))


def category_cycles(categories: DataFrame) -> DataFrame:
    """Categories whose ancestor walk returns to themselves.

    Pointer doubling: after enough jumps only cycle members are still reached, and the set
    of reached nodes stops shrinking. Logarithmically many equi-joins, one row per node.
    """
    jumps = durable(categories.select("category_id", F.col("parent_id").alias("target")))
    reached = jumps.where("target is not null").select("target").distinct().count()
    while reached:
        step = jumps.select(F.col("category_id").alias("target"), F.col("target").alias("_next"))
        jumps = durable(jumps.join(step, "target", "left").select("category_id", F.col("_next").alias("target")))
        remaining = jumps.where("target is not null").select("target").distinct().count()
        if remaining == reached:
            break
        reached = remaining
    return jumps.where("target is not null").select(F.col("target").alias("category_id")).distinct()


def category_paths(categories: DataFrame) -> DataFrame:
    """Root-to-node ids and names, depth and breadcrumb, by path doubling; cycles are left out."""
    sound = categories.join(category_cycles(categories), "category_id", "left_anti")
    ids = categories.schema["category_id"].dataType
    state = sound.select(
        "category_id",
        F.array(F.col("category_id")).alias("path_ids"),
        F.array(F.col("name")).alias("path_names"),
        F.col("parent_id").cast(ids).alias("_next"),
    )
    state = durable(state)
    while not state.where("_next is not null").isEmpty():
        above = state.select(
            F.col("category_id").alias("_next"),
            F.col("path_ids").alias("_ids"),
            F.col("path_names").alias("_names"),
            F.col("_next").alias("_above"),
        )
        joined = state.join(above, "_next", "left")
        state = durable(
            joined.select(
                "category_id",
                F.when(F.col("_ids").isNotNull(), F.concat("_ids", "path_ids")).otherwise(F.col("path_ids")).alias("path_ids"),
                F.when(F.col("_names").isNotNull(), F.concat("_names", "path_names")).otherwise(F.col("path_names")).alias("path_names"),
                F.col("_above").alias("_next"),
            )
        )
    return state.select(
        "category_id",
        "path_ids",
        F.size("path_ids").alias("depth"),
        F.array_join("path_names", BREADCRUMB_SEPARATOR).alias("breadcrumb"),
    )


def category_descendants(paths: DataFrame) -> DataFrame:
    """Transitive closure (ancestor, descendant, distance) from the root-to-node paths."""
    exploded = paths.select(F.col("category_id").alias("descendant_id"), "depth", F.posexplode("path_ids").alias("_at", "ancestor_id"))
    return exploded.where(F.col("_at") < F.col("depth") - 1).select(
        "ancestor_id", "descendant_id", (F.col("depth") - 1 - F.col("_at")).alias("distance")
    )


def invalid_moves(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """Proposed (category, new parent) pairs whose new parent is the category or lies below it.

    That is so when the category is on the path of the new parent.
    """
    above = paths.select(F.col("category_id").alias("new_parent_id"), "path_ids")
    joined = moves.join(above, "new_parent_id", "left")
    itself = F.col("category_id") == F.col("new_parent_id")
    return joined.where(itself | F.array_contains("path_ids", F.col("category_id"))).select(*moves.columns)


def valid_parents(wanted: Sequence[int], paths: DataFrame) -> DataFrame:
    """Categories that each of the wanted ones may move under, with their breadcrumbs.

    ``wanted`` are the ids of a request; every category is read once for all of them.
    """
    asked = F.explode(F.array(*[F.lit(w) for w in wanted]).cast(f"array<{paths.schema['category_id'].dataType.simpleString()}>"))
    return paths.withColumn("_wanted", asked).where(~F.array_contains("path_ids", F.col("_wanted"))).select(
        F.col("_wanted").alias("category_id"), F.col("category_id").alias("parent_id"), "breadcrumb"
    )


def allowed_parents(category_id, paths: DataFrame) -> DataFrame:
    """Categories one category may move under, with their breadcrumbs."""
    return paths.where(~F.array_contains("path_ids", F.lit(category_id))).select(
        F.col("category_id").alias("parent_id"), "breadcrumb"
    )


def catalogue_labels(variants: DataFrame, products: DataFrame, brands: DataFrame, retail_brands: DataFrame, paths: DataFrame) -> DataFrame:
    """Composed display labels for every variant, its product and its brand."""
    named = variant_product_brand(variants, products, brands)
    retailer = brands.join(
        retail_brands.select("retail_brand_id", F.col("name").alias("retailer")), "retail_brand_id", "left"
    ).select(F.col("record_id").alias("product_brand_id"), "retailer")
    crumbs = paths.select("category_id", "breadcrumb")
    brand_label = F.when(F.col("retailer").isNotNull(), F.format_string(PRIVATE_LABEL_TEXT, "brand_name", "retailer")).otherwise(F.col("brand_name"))
    product_label = F.concat_ws(LABEL_SEPARATOR, "brand_name", "product_name", "breadcrumb")
    return (
        named.join(retailer, "product_brand_id")
        .join(crumbs, "category_id")
        .select(
            F.col("record_id").alias("variant_id"),
            brand_label.alias("brand_label"),
            product_label.alias("product_label"),
            F.concat_ws(LABEL_SEPARATOR, product_label, F.col("name")).alias("variant_label"),
        )
    )


def find_or_create(existing: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """Records by normalised name: existing ones, plus one new record per unseen name.

    The first spelling in byte order names a new record; ids derive from the name.
    """
    wanted = derive_identity(names.where(F.col("name").isNotNull()).select("name").distinct()).where("normalized_name <> ''")
    unseen = wanted.join(existing.select("normalized_name"), "normalized_name", "left_anti")
    created = earliest_by(unseen, ["normalized_name"], ["name"])
    created = created.withColumn("record_id", F.concat(F.lit(prefix + ":"), F.substring(F.sha2("normalized_name", 256), 1, 16)))
    return existing.select("record_id", "name", "normalized_name", "slug").unionByName(
        created.select("record_id", "name", "normalized_name", "slug")
    )


def find_or_create_units(existing: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units after the requests, and the unit of each distinct (symbol, name) asked for.

    ``existing``: record_id, name, normalized_name, slug, symbol. ``asked``: unit_symbol, unit_name; rows with
    neither get no unit. A missing symbol is the slug of the name, a missing name the symbol. A unit is found
    by symbol first, then by normalised name; stored ones never change. Unknown ones are made in rounds: each
    name offers its least symbol and each symbol takes the least name offered, so that names and symbols stay
    unique whatever the requests' order, until every request finds its unit.
    """
    given = asked.select("unit_symbol", "unit_name").distinct().where(~text.is_blank(F.col("unit_symbol")) | ~text.is_blank(F.col("unit_name")))
    symbol = F.when(~text.is_blank(F.col("unit_symbol")), F.col("unit_symbol")).otherwise(text.slugify(F.col("unit_name")))
    wanted = given.withColumn("symbol", symbol)
    wanted = wanted.withColumn("name", F.when(~text.is_blank(F.col("unit_name")), F.col("unit_name")).otherwise(F.col("symbol")))
    wanted = durable(wanted.withColumn("normalized_name", text.normalize_text(F.col("name"))))
    columns = ["record_id", "name", "normalized_name", "slug", "symbol"]
    units = existing.select(*columns)
    while True:
        by_symbol = units.where("symbol is not null").groupBy("symbol").agg(F.min("record_id").alias("_by_symbol"))
        by_name = units.groupBy("normalized_name").agg(F.min("record_id").alias("_by_name"))
        found = durable(
            wanted.join(by_symbol, "symbol", "left").join(by_name, "normalized_name", "left")
            .withColumn("comparison_unit_id", F.coalesce("_by_symbol", "_by_name")).drop("_by_symbol", "_by_name")
        )
        open_ones = found.where("comparison_unit_id is null")
        if open_ones.isEmpty():
            return units, found.select("unit_symbol", "unit_name", "symbol", "comparison_unit_id")
        offered = open_ones.groupBy("normalized_name").agg(F.min(F.struct("symbol", "name")).alias("_least")).select("normalized_name", "_least.*")
        made = earliest_by(offered, ["symbol"], ["normalized_name"]).withColumn("slug", text.slugify(F.col("name")))
        made = made.withColumn("record_id", F.concat(F.lit("unit:"), F.substring(F.sha2("normalized_name", 256), 1, 16)))
        units = durable(units.unionByName(made.select(*columns)))


def fill_chain(requests: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``upsert_catalogue_chain`` with manufacturers and comparison units.

    ``requests`` also has manufacturer_name, unit_name and unit_symbol. ``tables``: product_brands, categories,
    products (with manufacturer_id), product_variants (with comparison_unit_id), manufacturers, comparison_units.
    A blank manufacturer or unit leaves the reference as it is; stored references are never replaced. Of several
    requests for one product the manufacturer with the least normalised name counts, for one variant the
    unit with the least symbol. Rejected requests make no manufacturer and no unit.
    """
    whole = requests.select([c for c in requests.columns if c not in ("manufacturer_name", "unit_name", "unit_symbol")])
    out = upsert_catalogue_chain(whole, tables["product_brands"], tables["categories"], tables["products"], tables["product_variants"])
    turned_away = out["rejects"].select(*[F.col(c).alias("_" + c) for c in whole.columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in whole.columns]
    accepted = durable(requests.join(turned_away, same, "left_anti"))
    makers = find_or_create(tables["manufacturers"], accepted.where(~text.is_blank(F.col("manufacturer_name"))).select(F.col("manufacturer_name").alias("name")), "manufacturer")
    units, found = find_or_create_units(tables["comparison_units"], accepted)

    named = accepted.select(
        text.normalize_text(F.col("brand_name")).alias("_brand"), text.normalize_text(F.col("category_name")).alias("_category"),
        text.normalize_text(F.col("product_name")).alias("_product"), text.normalize_text(F.col("variant_name")).alias("_variant"),
        text.normalize_text(F.col("manufacturer_name")).alias("_maker"), "unit_symbol", "unit_name",
    )
    place = (
        out["products"].select("product_brand_id", "category_id", F.col("record_id").alias("product_id"), F.col("normalized_name").alias("_product"))
        .join(out["product_brands"].select(F.col("record_id").alias("product_brand_id"), F.col("normalized_name").alias("_brand")), "product_brand_id")
        .join(out["categories"].select(F.col("record_id").alias("category_id"), F.col("normalized_name").alias("_category")), "category_id")
    )
    placed = durable(named.join(place.select("product_id", "_brand", "_category", "_product"), ["_brand", "_category", "_product"]))
    maker = makers.select(F.col("normalized_name").alias("_maker"), F.col("record_id").alias("_offered"))
    makers_of = placed.join(maker, "_maker").groupBy(F.col("product_id").alias("record_id")).agg(F.min_by("_offered", "_maker").alias("_offered"))
    units_of = (
        placed.join(found.select(F.col("unit_symbol").alias("_s"), F.col("unit_name").alias("_n"), "symbol", "comparison_unit_id"),
                    F.col("unit_symbol").eqNullSafe(F.col("_s")) & F.col("unit_name").eqNullSafe(F.col("_n")))
        .groupBy("product_id", F.col("_variant").alias("normalized_name")).agg(F.min_by("comparison_unit_id", "symbol").alias("_offered"))
    )
    stored_makers = tables["products"].select("record_id", "manufacturer_id")
    stored_units = tables["product_variants"].select("record_id", "comparison_unit_id")
    products = out["products"].join(stored_makers, "record_id", "left").join(makers_of, "record_id", "left")
    variants = out["product_variants"].join(stored_units, "record_id", "left").join(units_of, ["product_id", "normalized_name"], "left")
    return {
        **out,
        "products": products.withColumn("manufacturer_id", F.coalesce("manufacturer_id", "_offered")).drop("_offered"),
        "product_variants": variants.withColumn("comparison_unit_id", F.coalesce("comparison_unit_id", "_offered")).drop("_offered"),
        "manufacturers": makers,
        "comparison_units": units,
    }


def upsert_catalogue_chain(requests: DataFrame, brands: DataFrame, categories: DataFrame, products: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    """Find or create brand, category, product and variant for each requested chain.

    ``requests``: brand_name, retail_brand_id, category_name, product_name, variant_name,
    package_count, quantity_value, barcode. Existing non-null attributes are never changed.
    A request without a category, or that claims a brand for another retailer than the one
    it belongs to, goes to ``rejects``.
    """
    asked = requests.withColumn("_brand", text.normalize_text(F.col("brand_name"))).withColumn(
        "_category", text.normalize_text(F.col("category_name"))
    )
    owner = (
        brands.where("retail_brand_id is not null").select(F.col("normalized_name").alias("_brand"), F.col("retail_brand_id").alias("_owner"))
        .unionByName(
            earliest_by(
                asked.join(brands.where("retail_brand_id is not null").select(F.col("normalized_name").alias("_brand")), "_brand", "left_anti")
                .where("retail_brand_id is not null")
                .select("_brand", F.col("retail_brand_id").alias("_owner")),
                ["_brand"],
                ["_owner"],
            )
        )
    )
    judged = asked.join(owner, "_brand", "left").withColumn(
        "reason",
        F.when(F.col("_category") == "", F.lit("category_missing")).when(
            F.col("retail_brand_id").isNotNull() & (F.col("retail_brand_id") != F.col("_owner")), F.lit("retail_brand_conflict")
        ),
    )
    rejects = judged.where("reason is not null").select(*requests.columns, "reason")
    accepted = judged.where("reason is null")

    next_brands = find_or_create(brands, accepted.select(F.col("brand_name").alias("name")), "brand").join(
        owner.select(F.col("_brand").alias("normalized_name"), F.col("_owner").alias("retail_brand_id")), "normalized_name", "left"
    )
    next_categories = find_or_create(categories, accepted.select(F.col("category_name").alias("name")), "category")
    located = (
        accepted.join(next_brands.select(F.col("normalized_name").alias("_brand"), F.col("record_id").alias("product_brand_id")), "_brand")
        .join(next_categories.select(F.col("normalized_name").alias("_category"), F.col("record_id").alias("category_id")), "_category")
        .withColumn("_product", text.normalize_text(F.col("product_name")))
        .withColumn("_variant", text.normalize_text(F.col("variant_name")))
    )
    product_key = ["product_brand_id", "category_id", "normalized_name"]
    wanted_products = located.select("product_brand_id", "category_id", F.col("_product").alias("normalized_name"), F.col("product_name").alias("name"))
    new_products = earliest_by(wanted_products.join(products.select(*product_key), product_key, "left_anti"), product_key, ["name"])
    new_products = new_products.withColumn("slug", text.slugify(F.col("name"))).withColumn(
        "record_id", F.concat(F.lit("product:"), F.substring(F.sha2(F.concat_ws("|", *product_key), 256), 1, 16))
    )
    product_columns = ["record_id", *product_key, "name", "slug"]
    next_products = products.select(*product_columns).unionByName(new_products.select(*product_columns))

    chained = located.join(
        next_products.select("product_brand_id", "category_id", F.col("normalized_name").alias("_product"), F.col("record_id").alias("product_id")),
        ["product_brand_id", "category_id", "_product"],
    )
    variant_key = ["product_id", "normalized_name"]
    offered = chained.groupBy("product_id", F.col("_variant").alias("normalized_name")).agg(
        F.min("variant_name").alias("_name"),
        F.min("package_count").alias("_package_count"),
        F.min("quantity_value").alias("_quantity_value"),
        F.min("barcode").alias("_barcode"),
    )
    merged = variants.join(offered, variant_key, "full_outer")
    name = F.coalesce("name", "_name")
    next_variants = merged.select(
        F.coalesce("record_id", F.concat(F.lit("variant:"), F.substring(F.sha2(F.concat_ws("|", *variant_key), 256), 1, 16))).alias("record_id"),
        *variant_key,
        name.alias("name"),
        F.coalesce("slug", text.slugify(name)).alias("slug"),
        F.coalesce("package_count", "_package_count").alias("package_count"),
        F.coalesce("quantity_value", "_quantity_value").alias("quantity_value"),
        F.coalesce("barcode", "_barcode").alias("barcode"),
    )
    return {
        "product_brands": next_brands,
        "categories": next_categories,
        "products": next_products,
        "product_variants": next_variants,
        "rejects": rejects,
    }
