"""Problem 4: variant spellings of names typed by people."""

from pyspark.sql import functions as F

from ...session import table
from ..names import link_departments, link_projects, spelling_pairs


def p4_found(spark, sf_dir):
    panel = table(spark, sf_dir, "panel_duplicates")
    return spelling_pairs(link_projects(panel), "project_name").unionByName(spelling_pairs(link_departments(panel), "department"))


def p4_classes(spark, sf_dir):
    """Every spelling with its class, named by the class's longest spelling (the least at a tie)."""
    panel = table(spark, sf_dir, "panel_duplicates")
    linked = (
        link_projects(panel).drop("pid").withColumn("field_name", F.lit("project_name"))
        .unionByName(link_departments(panel).withColumn("field_name", F.lit("department")))
    )
    longest = linked.groupBy("field_name", "entity").agg(
        F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("class_name"), F.count("*").alias("n_spellings")
    )
    return linked.join(longest, ["field_name", "entity"]).select("field_name", "name", "class_name", "n_spellings")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
SQL = {}
