"""A small keyword taxonomy for the classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Leaf, label, parent and terms with their weights (below 0: speaks against).
LEAVES = [
    (0, "Sensing", "P0", {"sensor fusion": 1.0, "imaging arrays": 1.0, "beamforming": 0.8, "motion capture": 0.6, "sensor networks": -0.5}),
    (1, "Materials", "P0", {"flow channels": 1.0, "grain boundary": 1.0, "thin films": 1.0, "nanoindentation": 0.5}),
    (2, "Neuroscience", "P1", {"spike timing": 1.0, "place coding": 1.0, "memory traces": 1.0, "spike sorting": 0.5}),
    (3, "Ecology", "P1", {"soil respiration": 1.0, "coral bleaching": 1.0, "groundwater flow": 1.0, "sediment cores": 0.5}),
    (4, "Learning", "P2", {"lesson study": 1.0, "tutoring systems": 1.0, "coding camps": 1.0, "after-school clubs": 1.0}),
    (5, "Policy", "P2", {"jury decisions": 1.0, "welfare programs": 1.0, "court backlogs": 1.0, "legal analysis": 0.5, "flow": -0.2}),
]
PARENTS = {"P0": "Engineering", "P1": "Life", "P2": "Society"}
#: Titles that say nothing.
PLACEHOLDERS = ["grant", "research", "project", "award"]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(leaf, t, w) for leaf, _, _, terms in LEAVES for t, w in terms.items()], "leaf int, term string, weight double")


def leaves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(leaf, label, parent, sum(w > 0 for w in terms.values())) for leaf, label, parent, terms in LEAVES], "leaf int, label string, parent string, n_leaf_terms int")


TERMS_SQL = "(VALUES " + ", ".join(f"({leaf}, '{t}', {w})" for leaf, _, _, terms in LEAVES for t, w in terms.items()) + ") tax(leaf, term, weight)"
LEAVES_SQL = "(VALUES " + ", ".join(f"({leaf}, '{label}', '{parent}', {sum(w > 0 for w in terms.values())})" for leaf, label, parent, terms in LEAVES) + ") lv(leaf, label, parent, n_leaf_terms)"
