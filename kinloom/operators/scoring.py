"""How well identities match a known or partial truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(n):
    return n * (n - 1) / 2


def pairwise(labelled: DataFrame, by: list[str] = ["event_id"]) -> DataFrame:
    """Pairwise precision, recall and F1 per event from (event_id, item, pred, truth); a null pred is a group of its own.

    Counted from group sizes: no pair is made."""
    cell = labelled.where("pred is not null").groupBy(*by, "pred", "truth").agg(F.count("*").alias("n"))
    both = cell.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("together"))
    claimed = labelled.where("pred is not null").groupBy(*by, "pred").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("claimed"))
    true = labelled.groupBy(*by, "truth").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("true"))
    out = true.join(claimed, by, "left").join(both, by, "left").na.fill(0.0, ["claimed", "together", "true"])
    p = F.when(F.col("claimed") == 0, 1.0).otherwise(F.col("together") / F.col("claimed"))
    r = F.when(F.col("true") == 0, 1.0).otherwise(F.col("together") / F.col("true"))
    out = out.select(*by, p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.select(*by, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def contamination(labelled: DataFrame) -> DataFrame:
    """Persons with more than one true label: labels, size, majority label and its share."""
    cell = labelled.where("pred is not null").groupBy("event_id", "pred", "truth").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("truth")).alias("k")))
    out = cell.groupBy("event_id", "pred").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), best.alias("b")).where("labels > 1")
    return out.select("event_id", "pred", "labels", "size", (-F.col("b.k")).alias("majority"), F.round(F.col("b.n") / F.col("size"), 6).alias("purity"))


def splits(labelled: DataFrame) -> DataFrame:
    """Per event and true label: faces, persons among the assigned, leftovers."""
    return labelled.groupBy("event_id", "truth").agg(F.count("*").alias("faces"), F.countDistinct("pred").alias("persons"), F.count_if(F.col("pred").isNull()).alias("leftovers"))


def sanity(counts: DataFrame, low: float = 10.0, high: float = 125.0) -> DataFrame:
    """counts (event_id, people, photos, leftovers) with people per 1000 photos and alarms; small events raise none."""
    rate = F.when(F.col("photos") > 0, F.col("people") / F.col("photos") * 1000)
    big = F.col("photos") >= 200
    alarms = F.array_compact(F.array(F.when(big & (rate < low), "few people"), F.when(big & (rate > high), "many people"), F.when(F.col("leftovers") > 0, "leftovers")))
    return counts.select("event_id", F.round(rate, 3).alias("per_1000"), F.array_join(alarms, "; ").alias("alarms"))


def misplaced(labelled: DataFrame) -> DataFrame:
    """Faces outside the majority person of their true label, where it has several or leftovers."""
    cell = labelled.where("pred is not null").groupBy("event_id", "truth", "pred").agg(F.count("*").alias("n"))
    top = cell.groupBy("event_id", "truth").agg(F.max(F.struct("n", (-F.col("pred")).alias("k"))).alias("b")).select("event_id", "truth", (-F.col("b.k")).alias("home"))
    return labelled.join(top, ["event_id", "truth"], "left").where(F.col("pred").isNull() | (F.col("pred") != F.col("home"))).select("event_id", "item", "truth", "pred", "home")


def judged_score(same: DataFrame, different: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs (event_id, a, b) people called same or different against pred (event_id, item, pred): recall and merge safety."""

    def together(pairs: DataFrame) -> DataFrame:
        of = lambda c: pred.select("event_id", F.col("item").alias(c), F.col("pred").alias(f"p{c}"))
        found = pairs.join(of("a"), ["event_id", "a"]).join(of("b"), ["event_id", "b"])
        return found.agg(F.count("*").alias("n"), F.count_if(F.col("pa") == F.col("pb")).alias("k"))

    s, d = together(same), together(different).withColumnsRenamed({"n": "dn", "k": "dk"})
    return s.crossJoin(d).select(  # one row each
        F.col("n").alias("same_pairs"), F.col("dn").alias("different_pairs"),
        F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(F.col("dn") > 0, 1 - F.col("dk") / F.col("dn")).otherwise(1.0), 6).alias("merge_safety"),
    )


def blamed(different: DataFrame, pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, pred, face): pairs (a, b) called different that share a person, with the face that is out of place there.

    Of the two it is the one with less company: fewer faces in that person whose asserted identity
    (labels: item, label) is its own; a face without one has the company of the others without a label
    row, which is none. At a tie it is a."""
    of = lambda c: pred.select(F.col("item").alias(c), F.col("pred").alias(f"p{c}"))
    merged = different.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("pa = pb")
    support = labels.join(pred.select("item", "pred"), "item").groupBy("label", "pred").agg(F.count("*").alias("n"))
    for c in ("a", "b"):
        own = labels.select(F.col("item").alias(c), F.col("label").alias(f"l{c}"))
        n = support.select(F.col("label").alias("sl"), F.col("pred").alias("sp"), F.col("n").alias(f"n{c}"))
        merged = merged.join(own, c, "left").join(n, F.col(f"l{c}").eqNullSafe(F.col("sl")) & (F.col("pa") == F.col("sp")), "left").drop("sl", "sp")
    less = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    return merged.select("a", "b", F.col("pa").alias("pred"), F.when(less, F.col("a")).otherwise(F.col("b")).alias("face"))


def merged_examples(different: DataFrame, pred: DataFrame, n: int = 20) -> DataFrame:
    """The first n pairs called different that share a person, by their faces."""
    of = lambda c: pred.select(F.col("item").alias(c), F.col("pred").alias(f"p{c}"))
    return different.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("pa = pb").select("a", "b", F.col("pa").alias("pred")).orderBy("a", "b").limit(n)


def candidates(groups: DataFrame, line: float, judged: DataFrame | None = None, n: int = 40) -> DataFrame:
    """Pairs of persons (event_id, person_id, centroid, cover) worth asking about: gap around the line, closest first."""
    from ..functions.vector import unit_distance

    a = groups.select("event_id", F.col("person_id").alias("a"), F.col("centroid").alias("ca"), F.col("cover").alias("face_a"))
    b = groups.select("event_id", F.col("person_id").alias("b"), F.col("centroid").alias("cb"), F.col("cover").alias("face_b"))
    pairs = a.join(b, "event_id").where("a < b").withColumn("gap", F.round(unit_distance(F.col("ca"), F.col("cb")), 6))
    pairs = pairs.where(F.col("gap").between(max(0.05, line - 0.20), min(0.95, line + 0.25)))
    if judged is not None:
        pairs = pairs.join(judged.select("event_id", "face_a", "face_b"), ["event_id", "face_a", "face_b"], "left_anti")
    top = pairs.orderBy("gap", "event_id", "a", "b").limit(n)
    return top.select("event_id", "a", "b", "face_a", "face_b", "gap", F.when(F.col("gap") <= line, "same?").otherwise("different?").alias("verdict"))
