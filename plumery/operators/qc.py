"""Reviews by several users: consensus per candidate, conflicts, accepted flight lines and the funnel of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumery.functions import names
from plumery.operators.graph import dense_numbers

#: The labels of the review tool by what they say.
POSITIVE = ("Plume", "Super Plume")
NEGATIVE = ("False Enhancement", "Artifact", "Cloud")
UNCLEAR = ("Ambiguous", "Duplicate", "Background")


def consensus(reviews: DataFrame, keys: tuple[str, ...] = ("lid", "cid")) -> DataFrame:
    """One row per candidate: label, class (-1, 0, 1), evaluation (FP, ??, TP), and what its labels hold.

    In this order: a single label stands; any Reject rejects; only unclear labels, or positive with negative, or anything
    unclear is Ambiguous; only negatives are False Enhancement; positives are Super Plume if one says so, else Plume. Labels
    of no known kind give a null label of class 0.
    """
    label = F.col("label")
    g = reviews.groupBy(*keys).agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("n_reviews"), F.count_distinct("uid").alias("n_users"),
        F.coalesce(F.bool_or(label == "Reject"), F.lit(False)).alias("any_reject"), F.coalesce(F.bool_or(label.isin(*POSITIVE)), F.lit(False)).alias("any_pos"),
        F.coalesce(F.bool_or(label.isin(*NEGATIVE)), F.lit(False)).alias("any_neg"), F.coalesce(F.bool_or(label.isin(*UNCLEAR)), F.lit(False)).alias("any_amb"),
        F.coalesce(F.bool_or(label == "Super Plume"), F.lit(False)).alias("any_super"),
    )
    pos, neg, amb = F.col("any_pos"), F.col("any_neg"), F.col("any_amb")
    out = (
        F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).when(F.col("any_reject"), "Reject").when(amb & ~pos & ~neg, "Ambiguous").when(pos & neg, "Ambiguous")
        .when(amb, "Ambiguous").when(neg, "False Enhancement").when(F.col("any_super"), "Super Plume").when(pos, "Plume")
    )
    kind = F.when(F.col("label").isin(*POSITIVE), 1).when(F.col("label").isin(*NEGATIVE), -1).otherwise(0)
    return g.withColumn("label", out).withColumn("class", kind).withColumn("evaluation", F.when(F.col("class") == 1, "TP").when(F.col("class") == -1, "FP").otherwise("??"))


def conflicts(reviews: DataFrame, known: DataFrame | None = None, keys: tuple[str, ...] = ("lid", "cid")) -> DataFrame:
    """All reviews, sorted, of candidates whose labels disagree: positive with negative, or unclear with either. With
    ``known``, only of candidates in that list."""
    c = consensus(reviews, keys).where("not any_reject and ((any_pos and any_neg) or (any_amb and (any_pos or any_neg)))")
    if known is not None:
        c = c.join(known.select(*keys).distinct(), list(keys), "left_semi")
    return reviews.join(c.select(*keys), list(keys), "left_semi").orderBy(*keys, "uid", "row_id")


def flags_long(lines: DataFrame, flags: list[str]) -> DataFrame:
    """(uid, lid, flag, value) of a table with a column per flag."""
    return lines.unpivot(["uid", "lid"], flags, "flag", "value")


def flag_decisions(flags: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, lid, decision): Reject if any flag's value is in its reject list. rules has flag, value, decision.

    A value in neither list is an error when the row is computed.
    """
    both = flags.join(F.broadcast(rules), ["flag", "value"], "left")
    known = F.when(F.col("decision").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no rule for"), "flag", "value"))).otherwise(F.col("decision"))
    return both.groupBy("uid", "lid").agg(F.when(F.bool_or(known == "Reject"), "Reject").otherwise("Accept").alias("decision"))


def line_decisions(decisions: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """(lid, n_users, decision): where users differ, the adjudicated decision, or Ambiguous."""
    g = decisions.groupBy("lid").agg(F.count_distinct("uid").alias("n_users"), F.count_distinct("decision").alias("n"), F.min("decision").alias("one"))
    if adjudicated is not None:
        g = g.join(adjudicated.select("lid", F.col("decision").alias("judged")), "lid", "left")
    else:
        g = g.withColumn("judged", F.lit(None).cast("string"))
    return g.select("lid", "n_users", F.when(F.col("n") == 1, F.col("one")).otherwise(F.coalesce("judged", F.lit("Ambiguous"))).alias("decision"))


def with_line_decisions(reviews: DataFrame, lines: DataFrame) -> DataFrame:
    """Reviews of candidates in rejected flight lines become Reject."""
    bad = lines.where("decision = 'Reject'").select("lid", F.lit(True).alias("_bad"))
    return reviews.join(bad, "lid", "left").withColumn("label", F.when(F.col("_bad"), "Reject").otherwise(F.col("label"))).drop("_bad")


def funnel(rows: DataFrame, order: str = "row_id") -> dict[str, DataFrame]:
    """Nested outputs: first row per candidate, then without Duplicate, without Reject, without anything unclear."""
    label = F.col("label")
    filt = names.first_rows(rows, ["lid", "cid"], order)
    nodup = filt.where(label.isNull() | (label != "Duplicate"))
    norej = nodup.where(label.isNull() | (label != "Reject"))
    return {"filt": filt, "nodup": nodup, "norej": norej, "noamb": norej.where(label.isNull() | ~label.isin(*UNCLEAR))}


def write_funnel(rows: DataFrame, path: str, lines: DataFrame | None = None, assigned: DataFrame | None = None) -> None:
    """Write the nested outputs below path: ``cid_all`` and the stages of funnel(), ``cid_diff`` with the rows whose reviews
    differ; with the reviews of flight lines (uid, lid, ...) ``lid_all``; with the assigned ones too ``done`` and ``todo``."""
    out = {f"cid_{n}": df for n, df in {"all": rows, **funnel(rows), "diff": conflicts(rows)}.items()}
    if lines is not None:
        out["lid_all"] = lines
        if assigned is not None:
            open_ = to_do(assigned, rows, lines)
            out |= {"todo": open_, "done": assigned.join(open_.select("uid", "lid").distinct(), ["uid", "lid"], "left_anti")}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def funnel_counts(rows: DataFrame) -> DataFrame:
    out = None
    for name, df in funnel(rows).items():
        one = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counters(reviews: DataFrame) -> DataFrame:
    """Reviews by user and label, with totals (null user, null label)."""
    return reviews.rollup("uid", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lid").alias("n_lines"))


def agreement(reviews: DataFrame) -> DataFrame:
    """Candidates seen by one user, by several who agree, and by several who don't."""
    g = reviews.groupBy("lid", "cid").agg(F.count_distinct("uid").alias("u"), F.count_distinct("label").alias("k"))
    return g.agg(F.count_if(F.col("u") == 1).alias("single"), F.count_if((F.col("u") > 1) & (F.col("k") == 1)).alias("agree"), F.count_if((F.col("u") > 1) & (F.col("k") > 1)).alias("differ"))


def enrich(reviews: DataFrame, plumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews of listed candidates with the list's further columns, and reviews of new candidates; keys lid and cid."""
    more = [c for c in plumes.columns if c not in reviews.columns]
    listed = names.first_rows(plumes, ["lid", "cid"]) if "row_id" in plumes.columns else plumes.dropDuplicates(["lid", "cid"])
    return reviews.join(listed.select("lid", "cid", *more), ["lid", "cid"]), reviews.join(listed, ["lid", "cid"], "left_anti")


def progress(assigned: DataFrame, cid_files: DataFrame, lid_files: DataFrame) -> DataFrame:
    """(uid, assigned, done): lines of each user with both submissions. All have uid and lid."""
    both = cid_files.select("uid", "lid").distinct().join(lid_files.select("uid", "lid").distinct(), ["uid", "lid"])
    state = assigned.select("uid", "lid").distinct().join(both.withColumn("_done", F.lit(True)), ["uid", "lid"], "left")
    return state.groupBy("uid").agg(F.count(F.lit(1)).alias("assigned"), F.count("_done").alias("done"))


def to_do(assigned: DataFrame, cid_files: DataFrame, lid_files: DataFrame) -> DataFrame:
    both = cid_files.select("uid", "lid").distinct().join(lid_files.select("uid", "lid").distinct(), ["uid", "lid"])
    return assigned.join(both, ["uid", "lid"], "left_anti")


def unpaired(cid_files: DataFrame, lid_files: DataFrame) -> DataFrame:
    """(uid, lid, missing): submissions with only one of the two files."""
    a, b = cid_files.select("uid", "lid").distinct().withColumn("c", F.lit(1)), lid_files.select("uid", "lid").distinct().withColumn("l", F.lit(1))
    return a.join(b, ["uid", "lid"], "full").where("c is null or l is null").select("uid", "lid", F.when(F.col("c").isNull(), "cid").otherwise("lid").alias("missing"))


def assign_users(lines: DataFrame, n_users: int, key: Column | None = None) -> DataFrame:
    """(lid, user): flight lines dealt in turn to users 0 .. n_users - 1 in order of a key, by default a hash of the line,
    so that no user has more than ceil(n / users)."""
    order = F.xxhash64("lid") if key is None else key
    placed = lines.select("lid").distinct().select(F.struct(order.alias("k"), F.col("lid").alias("lid")).alias("at"))
    return dense_numbers(placed, "at").select("at.lid", F.pmod(F.col("number") - 1, F.lit(n_users)).cast("int").alias("user"))


def images_of_lines(images: DataFrame, lines: DataFrame) -> DataFrame:
    """images (name, ...) whose flight line, the first part of the name, is in lines (lid); rows and columns stay as they are."""
    return images.join(lines.select(F.col("lid").alias("_lid")).distinct(), names.flight_id(F.col("name")) == F.col("_lid"), "left_semi")


def user_added(submitted: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates that users added."""
    return submitted.join(listed, ["lid", "cid"], "left_anti")


def positives_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("class").desc(), "lid", "cid")


def image_candidates(plumes: DataFrame, image: str) -> DataFrame:
    """Located candidates of one image, the first of each (lid, evaluation, place), with web map coordinates; positives first."""
    from plumery.functions import geo

    at = plumes.where(F.col("lid").contains(image) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != -9999) & (F.col("lon") != -9999))
    one = names.first_rows(at, ["lid", "evaluation", "lon", "lat"])
    xy = geo.web_mercator(F.col("lat"), F.col("lon"))
    return positives_first(one.withColumns({"x": xy["x"], "y": xy["y"], "cid": names.candidate_tail(F.col("candidate_id"))}))
