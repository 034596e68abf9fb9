"""Queries of what goes in and out: requests, responses, pictures, labels, categories and selected features. Texts are made from table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brands, briefs, categories, features, payloads, requests, specs
from ..functions.text import bound
from ..operators import requirements, shortlist
from ..sources import research, shopping
from .registry import query, spread, table


def _part(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey", *columns)


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sofa' WHEN 1 THEN 'desk for' WHEN 2 THEN 'sectional' WHEN 3 THEN 'best deals' ELSE 'air fryer' END AS base,
  CASE p_partkey % 5 WHEN 0 THEN 'furniture' WHEN 1 THEN 'furniture' WHEN 2 THEN 'furniture' WHEN 3 THEN 'general' ELSE 'appliances' END AS category FROM part
""")
def base_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = """CASE p_partkey % 5 WHEN 0 THEN concat('Best black sofa under $', p_size, ',000') WHEN 1 THEN concat('desk under ', p_size, ' inches wide for sale') WHEN 2 THEN 'left-facing grey  sectional' WHEN 3 THEN 'best deals'
      ELSE concat('top rated air fryer at least ', p_size, ' inches') END AS q"""
    rows = _part(spark, sf_dir, q).select("p_partkey", categories.base_category(F.col("q")).alias("base"))
    return rows.select("p_partkey", "base", briefs.base_group(F.col("base")).alias("category"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'couch' WHEN 1 THEN 'sleeper sofa' WHEN 2 THEN 'tv stand' ELSE 'brand ' || p_size END AS key, CASE p_partkey % 4 WHEN 0 THEN 'Seats' WHEN 2 THEN 'Width,Shelves' END AS names FROM part")
def feature_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of searches, and the features that a small catalogue has for them."""
    rows = _part(spark, sf_dir, "CASE p_partkey % 4 WHEN 0 THEN 'Large SOFA' WHEN 1 THEN 'pull out couch, grey' WHEN 2 THEN 'oak tv stand' ELSE concat('Brand & ', p_size) END AS c")
    rows = rows.withColumn("c", F.regexp_replace("c", "Brand & ", "Brand "))
    catalogue = spark.createDataFrame([("tv stand", 1, "Shelves"), ("tv stand", 0, "Width"), ("couch", 0, "Seats")], "category_key string, ord int, name string")
    out = categories.fallback_features(rows, "c", catalogue)
    return out.select("p_partkey", categories.feature_category(F.col("c")).alias("key"), F.array_join(F.col("features.name"), ",").alias("names"))


@query("SELECT p_partkey, 'between $' || format('{:,}', p_partkey * 1000) || '.5 and $' || format('{:,}', p_size * 100 + 1000) || ' for x2' AS shown FROM part")
def budget_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, "concat('between ', p_partkey * 1000, '.5 and $ ', p_size * 100 + 1000, ' for x2') AS b").select("p_partkey", payloads.budget_input(F.col("b")).alias("shown"))


@query("""
SELECT p_partkey, '{"query":"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"budget":"' || p_size || '"' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',"avoid":"glass"' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',"selectedFeatures":["a","b"]' ELSE '' END || '}' AS payload FROM part
""")
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "concat('  ', p_name, ' ') AS q", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' ') ELSE '  ' END AS b", "CASE WHEN p_partkey % 3 = 0 THEN ' glass' END AS a", "CASE WHEN p_partkey % 5 = 0 THEN array('a', 'b') ELSE array() END AS f")
    return rows.select("p_partkey", payloads.request_payload(F.col("q"), F.col("b"), F.lit(None).cast("string"), F.col("a"), F.col("f")).alias("payload"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 >= 2 THEN 'PASS' WHEN p_size % 4 = 1 OR p_partkey % 5 >= 2 THEN 'MINOR' ELSE 'FAIL' END AS grade, CASE p_partkey % 8 WHEN 0 THEN 429 WHEN 1 THEN 413 WHEN 2 THEN 400 WHEN 3 THEN 400 WHEN 4 THEN 503 WHEN 5 THEN 499 WHEN 6 THEN 502 ELSE 200 END AS status FROM part")
def response_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "p_size % 4 AS exact", "p_partkey % 5 AS near", "element_at(array('rate_limit', 'too_large', 'invalid_json', 'vague', 'unavailable', 'cancelled', 'failed', NULL), cast(p_partkey % 8 + 1 AS int)) AS problem")
    return rows.select("p_partkey", payloads.smoke_grade(F.col("exact"), F.col("near")).alias("grade"), payloads.response_status(F.col("problem")).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN NULL ELSE p_name || '|' || p_name || ' 2' END AS names, CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 = 3 THEN 0 END AS pictures FROM part")
def client_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as a client takes them: further keys and links without https make the list void, bad pictures don't."""
    image = """',"image":{"url":"https://encrypted-tbn1.gstatic.com/shopping?q=', p_size, '","sourceUrl":"https://', CASE WHEN p_partkey % 4 = 3 THEN 'shop.test' ELSE 'shop.com' END, '/p","sourceTitle":"t","productId":"12"}'"""
    first = f"""concat('{{"name":"', p_name, '","productPageUrl":"', CASE WHEN p_partkey % 4 = 1 THEN 'http' ELSE 'https' END, '://a.com/x"', {image}, CASE WHEN p_partkey % 4 = 2 THEN ',"price":1' ELSE '' END, '}}')"""
    body = f"""concat('{{"result":{{"recommendations":[', {first}, ',{{"name":"', p_name, ' 2","productPageUrl":"https://b.com/"}}]}}}}') AS body"""
    rows = _part(spark, sf_dir, body).withColumn("list", payloads.client_products(F.col("body")))
    return rows.select("p_partkey", F.array_join("list.name", "|").alias("names"), F.when(F.col("list").isNotNull(), F.size(F.filter("list", lambda p: p["image"].isNotNull()))).alias("pictures"))


@query("""SELECT p_partkey, '{"query":"' || p_name || '","budget":"' || p_size || '"}' AS request, 'c' || p_partkey AS id, 'tv' AS category, '["quiet"]' AS hard_requirements, '' AS search_type FROM part""")
def benchmark_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without what would give their answers away."""
    case = """concat('{"id":"c', p_partkey, '","category":"tv","hardRequirements":["quiet"],"referenceProductIds":[1],"request":{"query":"', p_name, '","budget":"', p_size, '","grade":3}}') AS body"""
    return _part(spark, sf_dir, case).select("p_partkey", payloads.benchmark_request(F.col("body")).alias("r")).select("p_partkey", "r.request", "r.id", "r.category", "r.hard_requirements", "r.search_type")


@query("SELECT p_partkey, p_partkey % 4 < 3 AS is_source, CASE p_partkey % 4 WHEN 3 THEN p_name || ': x' ELSE 'x' END AS rest FROM part")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "CASE p_partkey % 4 WHEN 0 THEN 'The Home Depot.com' WHEN 1 THEN 'Best Buy' WHEN 2 THEN 'Acme store' ELSE p_name END AS label")
    return rows.select("p_partkey", brands.source_label(F.col("label")).alias("is_source"), brands.without_source_label(F.concat("label", F.lit(": x"))).alias("rest"))


@query("""
SELECT p_partkey, p_partkey % 5 IN (0, 2, 4) AS shown, p_partkey % 5 = 1 AS measure, CASE WHEN p_partkey % 5 < 3 THEN 'HP' WHEN p_partkey % 5 = 3 THEN 'DeWalt' ELSE 'Acme ' || p_size END AS canonical,
  CASE p_partkey % 5 WHEN 0 THEN 'HP' WHEN 2 THEN 'HP' WHEN 3 THEN 'Milwaukee' END AS inferred FROM part
""")
def brand_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "CASE p_partkey % 5 WHEN 3 THEN 'only 20V Max' WHEN 4 THEN concat('Acme ', p_size) ELSE 'hp brand' END AS brand", "CASE p_partkey % 5 WHEN 0 THEN 'an HP laptop' WHEN 1 THEN concat(p_size, ' hp motor') WHEN 2 THEN 'Hewlett Packard 5 hp' WHEN 3 THEN 'M18 Fuel drill' ELSE concat('the ', 'acme-', p_size, ' blower') END AS said")
    b, t = F.col("brand"), F.col("said")
    return rows.select("p_partkey", brands.shows_brand(t, b).alias("shown"), brands.brand_is_measure(t, b).alias("measure"), brands.canonical_brand(b).alias("canonical"), brands.inferred_brand(t).alias("inferred"))


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos FROM lineitem)
SELECT l_orderkey, pos, CASE WHEN pos <= 5 AND l_partkey % 3 < 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END END AS chosen FROM l WHERE pos <= 6
""")
def product_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as products with three listings each: another model, the model at a shop, and on the product's own page. Of the sixth none counts."""
    along = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", along).where("pos <= 6")
    products = lines.selectExpr("l_orderkey", "pos", "concat('Acme XQ-', l_partkey) AS name", "concat('https://acme.com/', l_partkey, '?utm_source=a') AS url")
    title = "CASE WHEN rank = 0 THEN concat('Acme XQ-', l_partkey + 1) WHEN l_partkey % 3 = 2 THEN concat('Acme XQ-', l_partkey, ' charger') ELSE concat('Acme XQ', l_partkey, ' blower') END AS title"
    link = "CASE WHEN rank = 2 AND l_partkey % 3 = 0 THEN concat('https://acme.com/', l_partkey) ELSE 'https://shop.com/p' END AS link"
    listings = lines.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr("l_orderkey", "pos", "rank", title, "concat('https://encrypted-tbn0.gstatic.com/shopping?q=', rank) AS image_url", link, "'x' AS product_id")
    out = shortlist.enriched(products, listings, ["l_orderkey"])
    return out.select("l_orderkey", "pos", F.substring_index("image.url", "=", -1).cast("int").alias("chosen"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'missing_web_search' WHEN 2 THEN 'invalid_output' WHEN 3 THEN 'invalid_output' END AS problem, CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN '{}' END AS said,
  CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 3 END AS sources, CASE WHEN p_partkey % 5 = 1 THEN '' ELSE p_name || '|more' END AS queries, CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 2 END AS completed, 1 AS unfinished FROM part
""")
def research_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses: without a search, with a message after the final one, not finished, and good ones."""
    search = """CASE WHEN p_partkey % 5 = 1 THEN '' ELSE concat('{"type":"web_search_call","status":"completed","action":{"type":"search","query":"', p_name, '","queries":["more"],"sources":[{"url":"https://a.com/1"},{"url":"http://a.com/2"},{"url":"https://a.com/1"}]}},') END"""
    opened = """'{"type":"web_search_call","status":"completed","action":{"type":"open_page","url":"https://b.com/"}},{"type":"web_search_call","status":"failed","action":{"type":"open_page","url":"https://f.com/"}},'"""
    final = """'{"type":"message","phase":"final_answer","role":"assistant","status":"completed","content":[{"type":"output_text","text":"{}","annotations":[', CASE WHEN p_partkey % 5 = 1 THEN '' ELSE '{"type":"url_citation","url":"https://c.com/"}' END, ']}]}'"""
    after = """CASE WHEN p_partkey % 5 = 2 THEN ',{"type":"message","role":"assistant","status":"completed","content":[]}' ELSE '' END"""
    body = f"""concat('{{"status":"', CASE WHEN p_partkey % 5 = 3 THEN 'incomplete' ELSE 'completed' END, '","output":[', {search}, {opened}, {final}, {after}, ']}}') AS body"""
    rows = _part(spark, sf_dir, body).withColumn("r", research.parsed(F.col("body")))
    r, n = F.col("r"), F.col("n")
    rows = rows.withColumn("n", research.counts(r))
    said = F.when(F.col("p_partkey") % 5 != 3, research.final_text(r))
    return rows.select("p_partkey", research.problem(r).alias("problem"), said.alias("said"), n["sources"].alias("sources"), F.array_join(research.observed_queries(r), "|").alias("queries"), n["completed"].alias("completed"), n["unfinished"].alias("unfinished"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pod only' WHEN 1 THEN 'quiet' WHEN 2 THEN 'pet hair' ELSE 'xq ' || p_size || ' trays' END AS meaning, CASE p_partkey % 4 WHEN 0 THEN 19 WHEN 1 THEN 18 WHEN 2 THEN 35 ELSE 3 END AS forms,
  CASE p_partkey % 4 WHEN 0 THEN 'dealbreaker' WHEN 1 THEN 'soft' WHEN 2 THEN 'hard' ELSE 'dealbreaker' END AS strictness, CASE p_partkey % 4 WHEN 0 THEN 'compatibility' WHEN 1 THEN 'quality' WHEN 2 THEN 'feature' ELSE 'brand' END AS kind FROM part
""")
def requirement_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with what their definitions add."""
    rows = _part(spark, sf_dir, "CASE p_partkey % 4 WHEN 0 THEN 'K-Cup only' WHEN 1 THEN 'whisper-quiet' WHEN 2 THEN 'for my pets: dog hair' ELSE concat('XQ-', p_size, ' trays') END AS v", "CASE p_partkey % 4 WHEN 3 THEN 'avoid' ELSE 'query' END AS s", "CASE p_partkey % 4 WHEN 1 THEN 'soft' END AS strict", "CASE p_partkey % 4 WHEN 3 THEN 'brand' ELSE 'feature' END AS k")
    n = features.normalised_requirement(F.col("v"), F.col("s"), F.lit(""), F.col("k"), F.col("strict"))
    return rows.select("p_partkey", n.alias("n")).select("p_partkey", "n.meaning", F.size("n.aliases").alias("forms"), "n.strictness", "n.kind")


def _picked(name: str, unit: str, kind: str, raw: str):
    return requests.selected_feature(F.lit("k"), F.expr(name), F.lit(kind), F.lit(unit), F.array(F.lit("equals")), F.expr(raw))


@query("""
WITH p AS (SELECT p_partkey, p_size AS n FROM part)
SELECT p_partkey, 'Seat depth: at least ' || n || ' in,Seat depth: under ' || (n + 5) || ' in' AS labels FROM p WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'Cable: ' || n || ' ft' FROM p WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'Width: under ' || n || ' in' FROM p WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, '' FROM p WHERE p_partkey % 4 = 3
""")
def selected_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that selected features stand for; exact heights are none."""
    f = _picked("CASE p_partkey % 4 WHEN 0 THEN 'Seat depth' WHEN 1 THEN concat('Cable ', p_size, ' ft long') WHEN 2 THEN 'Width' ELSE 'Height' END", "in", "number", "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' to ', p_size + 5) WHEN 2 THEN concat('under ', p_size) ELSE string(p_size) END")
    f = bound(f, lambda f: F.when(F.col("p_partkey") % 4 == 1, f.withField("unit", F.lit("ft")).withField("name", F.expr("concat('Cable ', p_size, ' ft')"))).otherwise(f))
    f = bound(f, lambda f: F.when(F.col("p_partkey") % 4 == 1, f.withField("name", F.concat(F.lit("Cable"), F.lit(" length ")))).otherwise(f))
    labels = F.array_join(F.transform(briefs.selected_sizes(f), lambda s: F.replace(s["label"], F.lit("Cable length"), F.lit("Cable"))), ",")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", labels.alias("labels"))


@query("""
SELECT p_partkey, 'spec-cfm-min-' || (p_size + 100) || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'hard:priorities' ELSE 'soft:query' END || ',spec-noiseDb-max-60:hard:smart_feature,spec-weightLb-max-9:hard:avoid' AS specs FROM part
""")
def merged_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of four sources: a hard one takes the place of a soft one of the same id."""
    rows = _part(spark, sf_dir, "concat('a ', p_size + 100, ' cfm blower') AS q", "CASE WHEN p_partkey % 2 = 0 THEN concat('at least ', p_size + 100, ' cfm') ELSE '' END AS p", "'Noise under 60 db' AS f", "'must be below 9 lbs' AS a")
    merged = specs.merged_specs([(F.col(c), source) for c, source in (("q", "query"), ("p", "priorities"), ("f", "smart_feature"), ("a", "avoid"))])
    return rows.select("p_partkey", F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s["id"], s["strictness"], s["source"])), ",").alias("specs"))


@query("""
SELECT p_partkey, 'Required: Budget: $' || (p_size + 100) || ' or less' || chr(10) || 'Required: Seat depth: 20-' || (p_size + 20) || ' in' || chr(10) || 'Required: Color: Navy or Black' || chr(10) || 'Required: Seat depth: at least 20 in' || chr(10)
  || 'Required: Seat depth: under ' || (p_size + 20) || ' in' || chr(10) || 'Avoid: without Material velvet' AS summary, 'Navy,black' AS colors, 'without Material velvet' AS materials, floor(least((p_size + 100) * 1.8, p_size + 1100) + 0.5)::DOUBLE AS premium_cap
FROM part
""")
def feature_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs with selected features: a range of depths, a colour, and a material to avoid."""
    chosen = F.array(_picked("'Seat depth'", "in", "number", "concat('20 to ', p_size + 20)"), _picked("'Color'", "", "enum", "'Navy'"), _picked("'Material'", "", "enum", "'velvet'").withField("operator", F.lit("not_equals")))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lit("black sofa").alias("q"), F.expr("concat('under $', p_size + 100)").alias("b"), F.lit("").alias("p"), F.lit(None).cast("string").alias("a"), chosen.alias("f"))
    out = requirements.structured_requirements(rows, "q", "b", "p", "a", "f")
    return out.select("p_partkey", "summary", F.array_join("colors.value", ",").alias("colors"), F.array_join("materials.value", ",").alias("materials"), F.col("budget_rule.premium_cap").alias("premium_cap"))


@query("SELECT p_partkey, r AS rank, p_name || ' ' || r AS title, CASE WHEN r = 2 THEN NULL ELSE 'https://shop.com/' || r END AS link FROM part, range(1, 11) t(r) WHERE p_partkey % 3 = 0")
def shopping_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of twelve listings; answers that are no JSON or no list have none."""
    rows = ",".join("""{"title":"', p_name, ' %d"%s}""" % (i, "" if i == 2 else ',"link":"https://shop.com/%d"' % i) for i in range(1, 13))
    body = f"CASE p_partkey % 3 WHEN 0 THEN concat('{{\"shopping\":[{rows}]}}') WHEN 1 THEN '{{\"shopping\":7}}' ELSE p_name END AS body"
    return shopping.listings(_part(spark, sf_dir, body), "body").select("p_partkey", "rank", "title", "link")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Color,Width' ELSE 'Color,Width,Width' END AS names FROM part")
def distinct_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.array(_picked("'Color'", "", "enum", "'Navy'"), _picked("'Width'", "in", "number", "concat('under ', p_size)"), _picked("'Color'", "", "enum", "'Navy'"), _picked("'Width'", "in", "number", "concat('under ', p_size + p_size % 2)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(requests.distinct_features(f), lambda x: x["name"]), ",").alias("names"))


#: A phrase that shows each specification, and the value it shows.
_PHRASES = {
    "cfm": ("450 cfm", 450), "mph": ("120 mph", 120), "psi": ("1500 psi", 1500), "gpm": ("2.3 gpm", 2.3), "runtimeMin": ("45 min runtime", 45), "suctionAirwatts": ("150 air watts", 150), "weightLb": ("9.5 lbs", 9.5), "noiseDb": ("55 dba", 55),
    "capacityL": ("3.5 litres", 3.5), "capacityCups": ("12-cup", 12), "btu": ("9,000 btu", 9000), "cookingAreaSqIn": ("500 square inches", 500), "burners": ("4 burners", 4), "wattage": ("1500 watts", 1500), "energyCapacityWh": ("1,024 watt-hours", 1024),
    "runningWattage": ("3000 running watts", 3000), "sliceCapacity": ("4-slice", 4), "functionCount": ("8-in-1", 8), "capacityQt": ("6 quart", 6), "capacityGal": ("30 gallon", 30), "capacityPint": ("50 pint", 50), "temperatureF": ("450 f", 450),
    "screenSizeIn": ("27 inch", 27), "refreshRateHz": ("144 hz", 144), "displayResolutionHeightPx": ("1080 p", 1080), "storageGb": ("512 gb ssd", 512), "memoryGb": ("16 gb ram", 16), "batteryIncluded": ("battery included", 1), "twoBatteriesIncluded": ("dual battery kit", 1),
}
_NTH = {name: i for i, name in enumerate(_PHRASES)}


def _chosen(values, modulus: int) -> str:
    return f"CASE p_partkey % {modulus} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_chosen(_PHRASES, len(_PHRASES))} AS spec, {_chosen([v for _, v in _PHRASES.values()], len(_PHRASES))}::DOUBLE AS observed FROM part")
def all_observed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every specification of the dictionary, shown by a title."""
    rows = _part(spark, sf_dir, f"concat('Acme ', {_chosen([t for t, _ in _PHRASES.values()], len(_PHRASES))}, ', new') AS title")
    wanted = F.expr(_chosen(_PHRASES, len(_PHRASES)))
    return specs.observed_specs(rows, "title").where(F.col("spec") == wanted).select("p_partkey", "spec", "observed")


_FEATURES = [f.name for f in features.FEATURES]


@query(f"SELECT p_partkey, {_chosen(_FEATURES, len(_FEATURES))} AS feature, CASE (p_partkey // {len(_FEATURES)}) % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'needs_verification' END AS status FROM part")
def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of the dictionary: named, lacking, not confirmed, and not spoken of."""
    name = _chosen(_FEATURES, len(_FEATURES))
    text = f"CASE floor(p_partkey / {len(_FEATURES)}) % 4 WHEN 0 THEN concat('it has ', {name}, ' for you') WHEN 1 THEN concat('sold without ', {name}) WHEN 2 THEN concat({name}, ' has not been verified') ELSE 'a product' END AS said"
    checked = features.features_checked(_part(spark, sf_dir, text), "said")
    return checked.where(F.col("feature") == F.expr(name)).select("p_partkey", "feature", "status")
