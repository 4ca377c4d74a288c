"""Bundles of files with pinned inputs: a bundle is sound if it is what its manifest says and all it needs is sound.

The least set of which that holds is built from below: each round settles bundles
whose needs are settled, so it takes as many rounds as the longest chain. What is
never settled is in a cycle, or needs one. A fault names the bundle it was found in,
so everything above an altered leaf names that leaf.

Cases: a bundle that needs nothing stands by itself. Repeated references are one. A
reference to no bundle is a fault of the one that makes it. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.graph import dealt_anew
from loomtrace.sources.storage import new_path

#: What may be wrong with a bundle by itself, in the order in which it is looked for.
FAULTS = ("reserved or repeated path", "files differ from the manifest", "needs no known bundle", "pinned manifest or project differs", "pinned file differs")
MANIFEST = "manifest.json"


def faults(bundles: DataFrame, entries: DataFrame, found: DataFrame, references: DataFrame) -> DataFrame:
    """id, fault: what is wrong with each bundle by itself (null: nothing).

    bundles: id, project, manifest_sha256; entries and found: id, path, bytes, sha256 of
    what the manifest lists and what lies there; references: id, needs, project,
    manifest_sha256, path, sha256.
    """
    listed = entries.groupBy("id", "path").agg(F.count("*").alias("n"))
    paths = listed.where((F.col("n") > 1) | (F.col("path") == MANIFEST)).select("id", F.lit(0).alias("rule"))
    row = ["id", "path", "bytes", "sha256"]
    here = found.where(F.col("path") != MANIFEST).select(*row, F.lit(-1).alias("k")).unionByName(entries.select(*row).distinct().withColumn("k", F.lit(1)))
    differ = here.groupBy(*row).agg(F.sum("k").alias("k")).where("k != 0").select("id", F.lit(1).alias("rule"))
    of = dealt_anew(bundles.select(F.col("id").alias("needs"), F.col("project").alias("is_project"), F.col("manifest_sha256").alias("is_manifest")), "needs")
    held = dealt_anew(entries.groupBy(F.col("id").alias("needs"), F.col("path").alias("file")).agg(F.min("sha256").alias("is_sha256")), "needs").withColumnRenamed("needs", "holder")
    pins = references.distinct().join(of, "needs", "left")
    j = pins.join(held, (F.col("needs") == F.col("holder")) & (F.col("path") == F.col("file")), "left")
    pinned = F.when(F.col("is_manifest").isNull(), 2).when(~(F.col("is_manifest").eqNullSafe(F.col("manifest_sha256")) & F.col("is_project").eqNullSafe(F.col("project"))), 3).when(~F.col("is_sha256").eqNullSafe(F.col("sha256")), 4)
    wrong = paths.unionByName(differ).unionByName(j.select("id", pinned.alias("rule")).where("rule IS NOT NULL"))
    least = dealt_anew(wrong.groupBy("id").agg(F.min("rule").alias("rule")), "id")
    fault = F.coalesce(*[F.when(F.col("rule") == k, name) for k, name in enumerate(FAULTS)])
    return bundles.select("id").join(least, "id", "left").select("id", fault.alias("fault"))


def verified(bundles: DataFrame, entries: DataFrame, found: DataFrame, references: DataFrame) -> DataFrame:
    """id, state (sound, faulty, needs faulty, in a cycle), fault, member: the bundle that the fault is of."""
    spark = bundles.sparkSession
    path = new_path(spark, "bundles")
    own = faults(bundles, entries, found, references)
    own.write.parquet(f"{path}/own")
    own = spark.read.schema(own.schema).parquet(f"{path}/own")
    edges = references.select("id", "needs").distinct()
    edges.write.parquet(f"{path}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{path}/edges")
    none = F.lit(None).cast("string")
    kind = bundles.schema["id"].dataType
    bad = own.where("fault IS NOT NULL").select("id", F.lit("faulty").alias("state"), "fault", F.col("id").alias("member"))
    alone = own.where("fault IS NULL").join(edges.select("id"), "id", "left_anti").select("id", F.lit("sound").alias("state"), none.alias("fault"), F.lit(None).cast(kind).alias("member"))
    new, k = bad.unionByName(alone), 0
    schema = new.schema
    while True:
        # one folder a round, all read as one scan
        new.write.parquet(f"{path}/settled/round={k}")
        settled = spark.read.schema(schema).parquet(f"{path}/settled")
        if k and spark.read.schema(schema).parquet(f"{path}/settled/round={k}").isEmpty():
            break
        open_ = own.join(settled.select("id"), "id", "left_anti")
        of = settled.select(F.col("id").alias("needs"), F.struct((F.col("state") == "sound").alias("ok"), "member", "fault").alias("is"))
        by = edges.join(open_.select("id"), "id", "left_semi").join(dealt_anew(of, "needs"), "needs", "left").groupBy("id").agg(
            F.count("*").alias("n"), F.count("is").alias("known"), F.min(F.when(~F.col("is.ok"), F.struct("is.member", "is.fault"))).alias("worst")
        )
        by = by.where("worst IS NOT NULL OR n = known")
        new = by.select("id", F.when(F.col("worst").isNull(), "sound").otherwise("needs faulty").alias("state"), F.col("worst.fault").alias("fault"), F.col("worst.member").alias("member"))
        k += 1
    return own.select("id").join(dealt_anew(settled, "id"), "id", "left").select("id", F.coalesce("state", F.lit("in a cycle")).alias("state"), "fault", "member")
