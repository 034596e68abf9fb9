from briefloom.operators import coverage


def test_resemblance_of_stated_pairs(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", None), ("b", 2), ("b", 3), ("c", 9), (None, 1)], "run string, item int")
    pairs = spark.createDataFrame([("a", "b", 7), ("b", "a", 7), ("a", "c", 7), ("a", "a", 7), ("d", "e", 7), ("a", "e", 7), ("a", "b", 8)], "one string, other string, note int")
    got = sorted(tuple(r) for r in coverage.resemblance(sets, pairs, "run", "item").collect())
    want = [("a", "a", 7, 2, 2, 1.0), ("a", "b", 7, 1, 3, 0.3333), ("a", "b", 8, 1, 3, 0.3333), ("a", "c", 7, 0, 3, 0.0), ("a", "e", 7, 0, 2, 0.0), ("b", "a", 7, 1, 3, 0.3333), ("d", "e", 7, 0, 0, None)]
    assert got == want


def test_coverage_by_brand_and_line(spark):
    names = ["Roborock Q10 robot vacuum", "Roborock Q5 Max", "RIDGID 14 Gallon Wet Dry Vac HD1400", "14 Gallon NXT Wet Dry Vac HD1400", "Airtok purifier", "Black and Decker dustbuster", "Decker tool", "Ridgid HDX vac", None, ""]
    leaders = [(1, "Roborock", ["Q5"]), (2, "RIDGID", ["hd"]), (3, "AI", None), (4, "Black+Decker", []), (5, "", ["q5"]), (6, None, None), (7, "Unheard", ["of"]), (8, "Roborock", ["S8", "q10"])]
    got = coverage.covered(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(leaders, "id int, brand string, lines array<string>"), "name", "id", "brand", "lines")
    assert sorted(map(tuple, got.collect())) == sorted([("Roborock Q5 Max", 1), ("RIDGID 14 Gallon Wet Dry Vac HD1400", 2), ("Black and Decker dustbuster", 4), ("Roborock Q10 robot vacuum", 8)])
    assert coverage.covered(spark.createDataFrame([], "name string"), spark.createDataFrame(leaders, "id int, brand string, lines array<string>"), "name", "id", "brand", "lines").count() == 0


def test_coverage_is_counted_without_its_pairs(spark):
    names = ["Roborock Q10 vacuum", "Roborock Q5 Max", "max roborock q5", "RIDGID Vac HD1400", "Black and Decker", None, "", "Roborock Q5 Max"] * 50
    leaders = [(1, "Roborock", ["Q5"]), (2, "RIDGID", ["hd"]), (3, "Black+Decker", []), (4, "", ["q5"]), (5, None, None), (6, "Unheard", None), (7, "roborock!", ["q5", "Q10"]), (8, "ridgid", None), (1, "Roborock", ["Q5"]), (None, "Ridgid", ["hd"])] + [(100 + i, "Roborock", ["Q5"]) for i in range(50)]
    products, listed = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(leaders, "id int, brand string, lines array<string>")
    every = coverage.covered(products, listed, "name", "id", "brand", "lines").groupBy("id").count()
    assert sorted(map(tuple, coverage.covering(products, listed, "name", "id", "brand", "lines").collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)
    # names and leaders meet once per kind, not once per pair
    met = coverage._meeting(products.groupBy("name").count().withColumn("_held", coverage.words(products["name"])), listed.select(coverage.words(listed["brand"]).alias("_brand"), coverage.words(listed["brand"]).alias("_lines")).distinct())
    assert met.count() < 20
