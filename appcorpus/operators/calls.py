"""Calls between methods of a whole package, across its DEX images, and the exceptions that travel along them."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appcorpus.functions.names import has, invoke_kind
from appcorpus.operators.hierarchy import closure, flooded
from appcorpus.operators.references import KEY
from appcorpus.shared import stored

#: A method by its reference, the same in every image that names it.
REFERENCE = ["owner", "name", "proto"]
#: A method by its place: one body.
BODY = ["entry_index", "logical_index", "method_index"]

# The exception types that tell checked from unchecked.
THROWABLE, UNCHECKED = "Ljava/lang/Throwable;", ("Ljava/lang/RuntimeException;", "Ljava/lang/Error;")


def body(*columns: str | Column) -> Column:
    return F.struct(*(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for c, name in zip(columns or BODY, BODY)))


def link_table(defined: DataFrame) -> DataFrame:
    """(package_id, owner, name, proto, body): the one body that a reference stands for; of several images that define it the first in DEX order."""
    return defined.groupBy("package_id", *REFERENCE).agg(F.min(body()).alias("body"))


def call_edges(refs: DataFrame, method_ids: DataFrame, defined: DataFrame) -> DataFrame:
    """(KEY, method_index, pc, kind, callee, body, exact): each call with its invoke kind, linked over the package.

    method_ids: the images' tables of referenced methods (KEY, method_index, owner, name, proto). defined: methods that a class
    of an image declares; an id alone defines nothing. callee is the target as text, null if the image has no such id;
    body is the defining image's, null for platform or missing methods. exact: a static, direct or super call with a
    body, so that no other one can run instead.
    """
    targets = method_ids.select(*KEY, F.col("method_index").alias("target_index"), *REFERENCE)
    linked = targets.join(link_table(defined), ["package_id", *REFERENCE], "left")
    linked = linked.select(*KEY, "target_index", F.concat("owner", F.lit("->"), "name", "proto").alias("callee"), "body")
    calls = refs.where("ref_kind = 'method'").select(*KEY, "method_index", "pc", invoke_kind(F.col("opcode")).alias("kind"), "target_index")
    calls = calls.join(linked, [*KEY, "target_index"], "left").drop("target_index")
    return calls.withColumn("exact", F.col("kind").isin("static", "direct", "super") & F.col("body").isNotNull())


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(package_id, start, callee, distance): what the started methods reach over exact calls, with the fewest calls in between.

    edges: of `call_edges`. starts: (KEY, method_index). Semi-naive: each round joins the newest rows only.
    """
    steps = edges.where("exact").select("package_id", body().alias("child"), F.col("body").alias("parent")).distinct()
    found = closure(steps, starts.select("package_id", body().alias("child")))
    return found.select("package_id", F.col("descriptor").alias("start"), F.col("ancestor").alias("callee"), "distance")


def exception_types(asked: DataFrame, edges: DataFrame, platform: DataFrame) -> DataFrame:
    """(package_id, exception, above): each asked type with itself and all that is above it, in its own package.

    asked: (package_id, exception). edges: the packages' own (package_id, child, parent); platform: (descriptor, superclass) for
    all packages. What a package defines goes by its own classes, up to where the platform's begin.
    """
    asked = asked.select("package_id", F.col("exception").alias("child")).distinct()
    own = closure(edges.select("package_id", "child", "parent"), asked).select("package_id", F.col("descriptor").alias("exception"), F.col("ancestor").alias("above"))
    fixed = closure(platform.select(F.lit("").alias("package_id"), F.col("descriptor").alias("child"), F.col("superclass").alias("parent")))
    fixed = fixed.where("distance > 0").select(F.col("descriptor").alias("above"), F.col("ancestor").alias("further"))
    defined = edges.select("package_id", F.col("child").alias("above")).distinct()
    ends = own.join(defined, ["package_id", "above"], "left_anti")
    return own.unionByName(ends.join(fixed, "above").select("package_id", "exception", F.col("further").alias("above"))).distinct()


def checked(throws: DataFrame, types: DataFrame) -> DataFrame:
    """Rows whose `exception` is in their package below Throwable but not below RuntimeException or Error. types: of `exception_types`."""
    kinds = types.groupBy("package_id", "exception").agg(F.max(F.col("above") == THROWABLE).alias("_thrown"), F.max(F.col("above").isin(*UNCHECKED)).alias("_unchecked"))
    return throws.join(kinds.where("_thrown and not _unchecked").select("package_id", "exception"), ["package_id", "exception"], "left_semi")


def covering_handlers(thrown: DataFrame, handlers: DataFrame, types: DataFrame) -> DataFrame:
    """thrown (KEY, method_index, pc, exception) with the handlers that take it: around pc, and for all or a type at or above it in the package."""
    up = types.select("package_id", "exception", F.col("above").alias("catch_type"), F.lit(True).alias("_up"))
    inside = thrown.join(handlers, [*KEY, "method_index"]).where("start_addr <= pc and pc < end_addr")
    return inside.join(up, ["package_id", "exception", "catch_type"], "left").where("catch_type is null or _up or catch_type = exception").drop("_up")


def contracts(methods: DataFrame, throws: DataFrame, inherited: DataFrame, carriers: DataFrame) -> DataFrame:
    """(KEY, method_index, exception): what a method declares, or, if it declares nothing and is synthetic or of a function object, what it inherits.

    methods: KEY, class_def_idx, method_index, owner, name, proto, access_flags. throws: KEY, method_index, exception. inherited: (package_id,
    owner, name, proto, exception). carriers: (KEY, class_def_idx) of function objects.
    """
    own = throws.select(*KEY, "method_index", "exception").distinct()
    silent = methods.join(own.select(*KEY, "method_index").distinct(), [*KEY, "method_index"], "left_anti")
    marked = silent.join(carriers.select(*KEY, "class_def_idx").distinct().withColumn("_carrier", F.lit(True)), [*KEY, "class_def_idx"], "left")
    marked = marked.where(has(F.col("access_flags"), 0x1000) | F.col("_carrier"))
    return own.unionByName(marked.join(inherited, ["package_id", *REFERENCE]).select(*KEY, "method_index", "exception").distinct())


def escaping_exceptions(methods: DataFrame, declared: DataFrame, edges: DataFrame, handlers: DataFrame, types: DataFrame) -> DataFrame:
    """(KEY, method_index, exception, inferred): checked exceptions that leave each method, declared or from calls without a handler for them.

    declared: of `contracts`; a method with a contract has no other exceptions, and class initialisers none, so both are closed to
    what their calls throw. edges: of `call_edges`; all kinds of calls count, as long as they have a body. A package's checked
    exceptions are numbered and go as bits, 64 to a row. Handlers are looked up once: they give each way from a body to its caller the
    bits that pass. Each round goes on from the newest bits only, over the whole package.
    """
    place = [*KEY, "method_index"]
    declared, types = stored(declared), stored(types)
    seeds = stored(checked(declared, types).select(*place, "exception").distinct())
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("exception")) - 1
    numbered = seeds.select("package_id", "exception").distinct().withColumn("n", number)
    numbered = stored(numbered.select("package_id", "exception", F.expr("n div 64").alias("block"), F.expr("shiftleft(1L, n % 64)").alias("bit")))
    blocks = numbered.select("package_id", "block").distinct()

    named = types.select("package_id", "exception", F.col("above").alias("catch_type")).unionByName(numbered.select("package_id", "exception", F.col("exception").alias("catch_type")))
    stops = numbered.join(named, ["package_id", "exception"]).groupBy("package_id", "catch_type", "block").agg(F.bit_or("bit").alias("stop"))
    guards = handlers.where("catch_type is not null").join(stops, ["package_id", "catch_type"])
    guards = guards.unionByName(handlers.where("catch_type is null").join(blocks, "package_id").withColumn("stop", F.lit(-1).cast("long")), allowMissingColumns=True)
    guards = guards.select(*(F.col(k).alias(f"_{k}") for k in [*place, "block"]), "start_addr", "end_addr", "stop")
    closed = methods.where("name = '<clinit>'").select(*place).unionByName(declared.select(*place)).distinct()
    calls = edges.where("body is not null").select(*place, "pc", "body").distinct().join(closed, place, "left_anti").join(blocks, "package_id")
    around = reduce(and_, (F.col(k) == F.col(f"_{k}") for k in [*place, "block"])) & (F.col("start_addr") <= F.col("pc")) & (F.col("pc") < F.col("end_addr"))
    sites = calls.join(guards, around, "left").groupBy(*place, "pc", "body", "block").agg(F.bitwise_not(F.coalesce(F.bit_or("stop"), F.lit(0).cast("long"))).alias("passed"))
    ways = sites.groupBy(*place, "body", "block").agg(F.bit_or("passed").alias("passed")).where("passed <> 0")
    ways = stored(ways.select("package_id", F.col("body").alias("node"), "block", body().alias("caller"), "passed"))

    first = seeds.join(numbered, ["package_id", "exception"]).select("package_id", body().alias("node"), "block", F.col("bit").alias("fresh"))
    passing = lambda new: new.join(ways, ["package_id", "node", "block"]).select("package_id", F.col("caller").alias("node"), "block", F.col("fresh").bitwiseAND(F.col("passed")).alias("fresh"))
    of_block = numbered.groupBy("package_id", "block").agg(F.collect_list(F.struct("bit", "exception")).alias("exceptions"))
    found = flooded(first, passing).where("distance > 0").join(of_block, ["package_id", "block"])
    found = found.select("package_id", "node.*", F.explode(F.filter("exceptions", lambda e: F.col("fresh").bitwiseAND(e["bit"]) != 0)).alias("e"))
    inferred = found.select(*place, F.col("e.exception").alias("exception"), F.lit(True).alias("inferred"))
    return seeds.withColumn("inferred", F.lit(False)).unionByName(inferred)
