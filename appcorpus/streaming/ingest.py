"""New packages to the catalog, each content once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from appcorpus.sources.packages import FACT_DDL, facts

CHANGED = "input changed"


def ingest(stream: DataFrame, catalog: str, checkpoint: str) -> StreamingQuery:
    """Streams (path, content) into `catalog`/packages and `catalog`/facts, all that is there now.

    packages holds (package_id, path, copies, status), copies being the rows of a path in its batch: `new` is the smallest path of a content that no earlier batch has and whose
    facts are taken, `copy` any other path of a known content, `changed` a path that had another content before or has
    several in this batch; that gives one error row in facts. A file without content (over the size limit)
    stands for itself. A batch writes its own folder anew, so one that is run again
    after a failure doesn't double its rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("package_id", F.coalesce(F.sha2("content", 256), F.sha2(F.concat(F.lit("no content: "), "path"), 256)))
        seen = hashed.groupBy("path", "package_id").agg(F.count("*").alias("copies")).withColumn("before", F.lit(None).cast("string"))
        known = spark.createDataFrame([], "package_id string")
        if number:
            earlier = spark.read.parquet(f"{catalog}/packages").where(F.col("batch") < number)
            known = earlier.where("status = 'new'").select("package_id").distinct()
            before = earlier.where("status <> 'changed'").groupBy("path").agg(F.max("package_id").alias("before"))
            seen = seen.drop("before").join(before, "path", "left")
        one = seen.groupBy("path").agg(F.max("package_id").alias("package_id"), F.max("copies").alias("copies"), (~F.min("package_id").eqNullSafe(F.max("package_id")) | (F.max("before") != F.max("package_id"))).alias("_other"))
        one = one.withColumn("_other", F.coalesce("_other", F.lit(False)))
        first = one.where("not _other").groupBy("package_id").agg(F.min("path").alias("path")).join(known, "package_id", "left_anti").withColumn("_new", F.lit(True))
        status = F.when(F.col("_other"), "changed").when(F.col("_new"), "new").otherwise("copy")
        one.join(first, ["package_id", "path"], "left").select("package_id", "path", "copies", status.alias("status")).write.mode("overwrite").parquet(f"{catalog}/packages/batch={number}")
        now = spark.read.parquet(f"{catalog}/packages/batch={number}")
        new = now.where("status = 'new'")
        rows_of = lambda paths: hashed.join(paths.select("path", "package_id"), ["path", "package_id"], "left_semi")
        taken, repeated = rows_of(new.where("copies = 1")), new.where("copies > 1")
        if not repeated.isEmpty():  # only rows that a batch holds twice are shuffled with their bytes
            taken = taken.unionByName(rows_of(repeated).dropDuplicates(["path"]))
        empty = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FACT_DDL.split(", ")}
        errors = now.where("status = 'changed'").select(*({**empty, "path": F.col("path"), "fact": F.lit("error").alias("fact"), "error": F.lit(CHANGED).alias("error")}.values()))
        facts(taken).unionByName(errors).write.mode("overwrite").parquet(f"{catalog}/facts/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
