"""Terms by one automaton against one search for each term; registries."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import terms


def test_first_rule_equals_a_search_for_each_term(spark):
    rng = random.Random(6)
    rules = {f"r{i}": tuple("".join(rng.choice("abAé ") for _ in range(rng.randint(1, 4))) for _ in range(5)) for i in range(12)}
    texts = [None, "", *("".join(rng.choice("abcdeéÉA \n") for _ in range(rng.randint(0, 25))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.rule for r in rows.select("doc_id", terms.first_rule(F.col("text"), rules).alias("rule")).collect()}
    assert got == {i: next((name for name, own in rules.items() if t and any(w.lower() in t.lower() for w in own)), None) for i, t in enumerate(texts)}
    assert {r.rule for r in rows.select(terms.first_rule(F.col("text"), {}).alias("rule")).collect()} == {None}
    with pytest.raises(ValueError, match="characters"):
        terms.first_rule(F.col("text"), {"x": ("y" * 5_000_000,)})


def test_topics(spark):
    words = {"novel": [1.0, 0.0], "finance": [0.0, 1.0]}
    embed = lambda name: F.when(name == "tale", F.array(F.lit(0.9), F.lit(0.1))).when(name == "money", F.array(F.lit(0.1), F.lit(5.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    rows = spark.createDataFrame([(t,) for t in ("A Historical NOVEL", "the API report", "tale", " money ", "other", " ", None)], "topic string")
    got = rows.withColumn("rule", terms.topic_rule(F.col("topic"), embed=embed, vectors=words)).withColumn("said", terms.guidance(F.col("topic"), F.col("rule"))).collect()
    assert [r.rule for r in got] == ["literature", "finance", "literature", "finance", None, None, None]
    assert got[4].said == "Topic Guidance: align style with topic 'other'." and got[5].said == got[6].said == "Topic Guidance: None"


def test_a_topic_is_embedded_once(spark):
    """The plan does not hold the embedding once more for each word to compare it with."""
    embed = lambda name: F.array(F.levenshtein(name, F.lit("x")).cast("double"), F.lit(1.0))
    rows = spark.createDataFrame([("tale",)], "topic string").select(terms.topic_rule(F.col("topic"), embed=embed, vectors={w: [1.0, float(i)] for i, w in enumerate(w for own in terms.TOPICS.values() for w in own)}))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") <= 2


def test_registries(spark):
    registry = spark.createDataFrame([("en", 0, "here"), ("en", 1, "This Part"), ("fr", 0, "ici"), ("fr", 1, "here"), ("xx", 0, "no")], "language string, place int, term string")
    weak = spark.createDataFrame([("en", "this part"), ("fr", "This part"), ("en", "ici")], "language string, term string")
    strong = terms.strong_terms(registry, weak)
    assert sorted((r.language, r.term) for r in strong.collect()) == [("en", "here"), ("fr", "here"), ("fr", "ici"), ("xx", "no")]
    assert [r.term for r in terms.ordered_union(strong, ["fr", "en"]).orderBy("place").collect()] == ["ici", "here"]
    assert [r.term for r in terms.ordered_union(registry, ["en", "fr"]).orderBy("place").collect()] == ["here", "This Part", "ici"]
