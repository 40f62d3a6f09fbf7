from scholia.operators import outcomes


def test_bloom_by_the_verbs_of_a_labels_chunks(spark):
    chunks = spark.createDataFrame([("1", "define and define and design a lens"), ("2", "justify the lens, appraise the ray"), ("3", "no verb here but a ray"), ("4", None), ("5", "compare and analyze")], "id string, text string")
    found = spark.createDataFrame([("lens", "1"), ("lens", "2"), ("ray", "2"), ("ray", "3"), ("none", "3"), ("empty", "4"), ("both", "5"), ("both", "5")], "label string, id string")
    got = {r.label: r.bloom for r in outcomes.bloom(found, chunks).collect()}
    # lens: two of remember, two of evaluate, one of create; the higher of equal ones. compare is a verb of understanding first
    assert got == {"lens": "evaluate", "ray": "evaluate", "none": "understand", "empty": "understand", "both": "analyze"}


def test_junk_and_stop_words(spark):
    found = spark.createDataFrame([("lens",), ("School",), (" page ",), ("x",), ("12",), (None,), ("lens & ray",)], "label string")
    assert [r.label for r in outcomes.concepts(found).collect()] == ["lens"]
    voted = spark.createDataFrame([("lens", "ray"), ("Life", "ray"), ("class", "ray"), ("ray", "life")], "prerequisite string, concept string")
    assert [tuple(r) for r in outcomes.prerequisites(voted).collect()] == [("lens", "ray"), ("ray", "life")]


def test_layer_inherits_only_known_concepts(spark):
    profiled = spark.createDataFrame([("lens", "lo:1"), ("ray", "lo:2")], "label string, outcome_id string")
    voted = spark.createDataFrame([("lens", "ray", 1.25), ("lens", "gone", 0.5), ("gone", "ray", 0.5)], "prerequisite string, concept string, score double")
    assert sorted(map(tuple, outcomes.layer(profiled, voted).collect())) == [("MAPS_TO", "lens", "lo:1", 1.0), ("MAPS_TO", "ray", "lo:2", 1.0), ("PREREQUISITE_OF", "lo:1", "lo:2", 1.0)]
