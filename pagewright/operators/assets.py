"""Checks of image references against a table of files: assets(doc_id, path), paths relative to the document's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def resolved(refs: DataFrame) -> DataFrame:
    """Adds target, the normal form of a reference; null if it leaves the document's folder."""
    return refs.withColumn("target", T.normal_path(F.col("ref")))


def escaping(refs: DataFrame) -> DataFrame:
    return resolved(refs).filter(F.col("target").isNull()).drop("target")


def missing(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """References inside the folder without a file."""
    inside = resolved(refs).filter(F.col("target").isNotNull())
    return inside.join(assets.select("doc_id", F.col("path").alias("target")), ["doc_id", "target"], "left_anti").select(refs.columns)


def orphans(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Image files that nothing refers to: doc_id, path."""
    image = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*T.IMAGE_SUFFIXES) & F.col("path").contains(".")
    used = resolved(refs).select("doc_id", F.col("target").alias("path"))
    return assets.filter(image).select("doc_id", "path").distinct().join(used, ["doc_id", "path"], "left_anti")


def duplicates(refs: DataFrame) -> DataFrame:
    """doc_id, ref, times for references that occur more than once."""
    return refs.groupBy("doc_id", "ref").agg(F.count("*").alias("times")).filter("times > 1")


#: Steps of a way through links after which it is taken to go round in circles.
MOST_STEPS = 200


def through_links(refs: DataFrame, links: DataFrame) -> DataFrame:
    """Adds target and fate to refs(doc_id, ref, ...): where a reference leads when links are followed, and `inside`, `outside` or `loop`.

    links(doc_id, path, target): a path below the document's folder that is a link, and what it points to, from the link's folder on or
    absolute. A path is walked part by part; where what has been walked is a link, its target is walked before the rest.
    Leaving the document's folder is `outside` even if a link would come back; so is an absolute target. A way of more than MOST_STEPS parts is a
    `loop`. Targets are null but inside. A document's links are one map, joined to its references; of links of one path the smallest target counts."""
    one = links.groupBy("doc_id", "path").agg(F.min("target").alias("target"))
    maps = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "target"))).alias("_links"))
    d = refs.join(maps, "doc_id", "left").withColumn("_links", F.coalesce("_links", F.create_map().cast("map<string,string>")))
    none = F.array().cast("array<string>")
    state = lambda done, rest, fate: F.struct(done.alias("done"), rest.alias("rest"), fate.alias("fate"))
    out = lambda word: state(none, none, F.lit(word))

    def step(acc, _):
        part, left = F.get(acc["rest"], F.lit(0)), F.slice(acc["rest"], 2, F.greatest(F.size(acc["rest"]) - 1, F.lit(0)))
        up = F.when(F.size(acc["done"]) == 0, out("outside")).otherwise(state(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), left, acc["fate"]))

        def walked(here):
            followed = lambda target: F.when(target.isNull(), state(here, left, acc["fate"])).when(target.startswith("/"), out("outside")).otherwise(state(acc["done"], F.concat(F.split(target, "/"), left), acc["fate"]))
            return T.once(F.try_element_at("_links", F.array_join(here, "/")), followed)

        ahead = F.when(part.isin("", "."), state(acc["done"], left, acc["fate"])).when(part == "..", up).otherwise(T.once(F.concat(acc["done"], F.array(part)), walked))
        return F.when((F.size(acc["rest"]) == 0) | (acc["fate"] != "inside"), acc).otherwise(ahead)

    def ended(way):
        fate = F.when(way["fate"] != "inside", way["fate"]).when(F.size(way["rest"]) > 0, "loop").otherwise("inside")
        return F.struct(F.when(fate == "inside", F.array_join(way["done"], "/")).alias("target"), fate.alias("fate"))

    start = F.when(F.col("ref").startswith("/"), out("outside")).otherwise(state(none, F.split("ref", "/"), F.lit("inside")))
    plain = F.struct(T.normal_path(F.col("ref")).alias("target"), F.when(T.normal_path(F.col("ref")).isNull(), "outside").otherwise("inside").alias("fate"))
    way = T.once(F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step), ended)
    d = d.withColumn("_w", F.when(F.size("_links") == 0, plain).otherwise(way))
    return d.withColumns({"target": F.col("_w.target"), "fate": F.col("_w.fate")}).drop("_w", "_links")


def stem(ref):
    """The name of a path without its folder and its last suffix."""
    name = F.element_at(F.split(ref, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def alt_issues(refs: DataFrame, require_stem: bool = False) -> DataFrame:
    """doc_id, seq, ref, issue: references without alternative text and, if asked for, whose text isn't the file's stem (not for those that leave the folder)."""
    alt = T.strip(F.col("alt"))
    issues = F.array(F.when(alt == "", F.lit("empty")), F.when(F.lit(require_stem) & F.col("target").isNotNull() & (stem(F.col("ref")) != alt), F.lit("stem")))
    return resolved(refs).select("doc_id", "seq", "ref", F.explode(F.array_compact(issues)).alias("issue"))
