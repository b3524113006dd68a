"""What classes declare and inherit: overriding, exception contracts, dependencies and member tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appcorpus.functions.names import dotted_name, has, hex_flags, java_type, modifiers, package_name, proto_params, proto_return, signature_types, simple_name
from appcorpus.operators.hierarchy import OBJECT
from appcorpus.operators.references import KEY

# Annotation types that carry metadata of the format, not of the source.
SYSTEM_ANNOTATIONS = [f"Ldalvik/annotation/{name};" for name in ("AnnotationDefault", "EnclosingClass", "EnclosingMethod", "InnerClass", "MemberClasses", "Signature", "Throws")]


def source_annotation(visibility: Column, type_: Column) -> Column:
    return visibility.isin("build", "runtime") & ~type_.isin(SYSTEM_ANNOTATIONS)


def overridable(name: Column, flags: Column) -> Column:
    """Neither a constructor nor an initialiser, nor private, static or a bridge."""
    return ~name.isin("<init>", "<clinit>") & ~has(flags, 2) & ~has(flags, 8) & ~has(flags, 64)


def visible_from(flags: Column, declaring: Column, owner: Column, owner_flags: Column) -> Column:
    """Whether a method of `declaring` is seen by class `owner`."""
    same = package_name(declaring) == package_name(owner)
    return F.when(has(flags, 2), False).when(has(owner_flags, 0x200) & (declaring == OBJECT), has(flags, 1)).when(has(flags, 1) | has(flags, 4), True).otherwise(same)


def class_flags(classes: DataFrame) -> DataFrame:
    """One row a class; the flags of repeated definitions are united."""
    return classes.groupBy("package_id", "descriptor").agg(F.bit_or("access_flags").alias("flags"))


def cast_convertible(pairs: DataFrame, closure: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (package_id, l, r) with `convertible`: a subtype either way, or as the interface and final bits allow."""
    up = closure.select("package_id", F.col("descriptor").alias("l"), F.col("ancestor").alias("r"), F.lit(True).alias("_up"))
    down = closure.select("package_id", F.col("descriptor").alias("r"), F.col("ancestor").alias("l"), F.lit(True).alias("_down"))
    flags = class_flags(classes)
    side = lambda name: flags.select("package_id", F.col("descriptor").alias(name), F.col("flags").alias(f"_{name}"))
    out = pairs.join(up, ["package_id", "l", "r"], "left").join(down, ["package_id", "l", "r"], "left")
    out = out.join(side("l"), ["package_id", "l"], "left").join(side("r"), ["package_id", "r"], "left")
    l_iface, r_iface = has(F.col("_l"), 0x200), has(F.col("_r"), 0x200)
    bits = F.when(l_iface & r_iface, True).when(l_iface, ~has(F.col("_r"), 16)).when(r_iface, ~has(F.col("_l"), 16)).otherwise(False)
    related = F.col("_up").isNotNull() | F.col("_down").isNotNull() | F.col("l").eqNullSafe(F.col("r")) | F.col("r").eqNullSafe(F.lit(OBJECT)) | F.col("l").eqNullSafe(F.lit(OBJECT))
    return out.withColumn("convertible", related | F.when(F.col("_l").isNull() | F.col("_r").isNull(), False).otherwise(bits)).drop("_up", "_down", "_l", "_r")


def overrides(closure: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(package_id, owner, name, proto, base, base_proto, is_base): the ancestors' methods that each method overrides first.

    An ancestor's method counts if name and erased parameters are equal, it is no constructor, neither static nor private,
    visible, and the return type is the same or, for classes, Object or an ancestor's. Of several in one ancestor the one
    of the same shape goes first, then those that are no bridges, then the smallest shape. It is a base if no direct parent
    of its class has such a method that the class sees. A method all of whose overridden ones have such a parent keeps the
    farthest (of equally far ones the last by name), with `is_base` false.
    """
    one, flags = ["package_id", "owner", "name", "proto"], F.col("access_flags")
    typed = methods.withColumn("params", F.array_join(proto_params(F.col("proto")), "")).withColumn("ret", proto_return(F.col("proto")))
    own = typed.where(overridable(F.col("name"), flags)).select(*one, "params", "ret").distinct()
    instance = ~F.col("name").isin("<init>", "<clinit>") & ~has(flags, 2) & ~has(flags, 8)
    upper = typed.where(instance).select("package_id", "name", "params", F.col("owner").alias("ancestor"), F.col("proto").alias("base_proto"), F.col("ret").alias("up_ret"), flags.alias("up_flags")).distinct()
    up = closure.where("distance > 0").select("package_id", F.col("descriptor").alias("owner"), "ancestor", "distance")
    found = own.join(up, ["package_id", "owner"]).join(upper, ["package_id", "name", "params", "ancestor"])
    types = closure.select("package_id", F.col("descriptor").alias("ret"), F.col("ancestor").alias("up_ret"), F.lit(True).alias("_narrower"))
    found = found.join(types, ["package_id", "ret", "up_ret"], "left")
    reference = F.col("ret").startswith("L") | F.col("ret").startswith("[")
    same = (F.col("ret") == F.col("up_ret")) | F.col("_narrower").isNotNull() | (reference & (F.col("up_ret") == OBJECT))
    found = found.where(same).select(*one, "ancestor", "distance", "base_proto", "up_flags")
    side = lambda name: class_flags(classes).select("package_id", F.col("descriptor").alias(name), F.col("flags").alias("_flags"))
    seen = found.join(side("owner"), ["package_id", "owner"]).where(visible_from(F.col("up_flags"), F.col("ancestor"), F.col("owner"), F.col("_flags")))
    first = F.min(F.struct(F.col("base_proto") != F.col("proto"), has(F.col("up_flags"), 64), "base_proto"))["base_proto"]
    seen = seen.groupBy(*one, "ancestor", "distance").agg(first.alias("base_proto"))
    parents = up.where("distance = 1").select("package_id", F.col("owner").alias("ancestor"), F.col("ancestor").alias("above"))
    higher = seen.join(parents, ["package_id", "ancestor"]).join(found.select(*one, F.col("ancestor").alias("above"), "up_flags"), [*one, "above"])
    higher = higher.join(side("ancestor"), ["package_id", "ancestor"]).where(visible_from(F.col("up_flags"), F.col("above"), F.col("ancestor"), F.col("_flags")))
    covered = higher.select(*one, "ancestor").distinct().withColumn("_covered", F.lit(True))
    out = seen.join(covered, [*one, "ancestor"], "left").withColumn("is_base", F.col("_covered").isNull())
    all_of = Window.partitionBy(*one)
    out = out.withColumn("_any", F.max("is_base").over(all_of)).withColumn("_last", F.max(F.struct("distance", "ancestor")).over(all_of)["ancestor"])
    return out.where(F.col("is_base") | (~F.col("_any") & (F.col("ancestor") == F.col("_last")))).select(*one, F.col("ancestor").alias("base"), "base_proto", "is_base")


def inherited_throws(bases: DataFrame, throws: DataFrame) -> DataFrame:
    """Exceptions that all true bases of a method declare. throws: (package_id, owner, name, proto, exception)."""
    one, bases = ["package_id", "owner", "name", "proto"], bases.where("is_base")
    number = bases.groupBy(*one).agg(F.count("*").alias("_bases"))
    declared = throws.select("package_id", F.col("owner").alias("base"), "name", F.col("proto").alias("base_proto"), "exception").distinct()
    each = bases.join(declared, ["package_id", "base", "name", "base_proto"])
    shared = each.groupBy(*one, "exception").agg(F.count_distinct("base").alias("_n")).join(number, one)
    return shared.where("_n = _bases").select(*one, "exception")


def class_outline(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(KEY, class_def_idx, descriptor, head, members): a class as it would be declared, without bodies.

    head: modifiers, kind, name, what it extends (Object is left out) and implements. members: fields in declaration order,
    then methods, each with modifiers and readable signature, a line each.
    """
    key = [*KEY, "class_def_idx"]
    field = F.concat_ws(" ", F.nullif(modifiers(F.col("access_flags"), "field"), F.lit("")), java_type(F.col("type")), "name")
    params = F.array_join(F.transform(proto_params(F.col("proto")), java_type), ", ")
    signature = F.concat("name", F.lit("("), params, F.lit(") -> "), java_type(proto_return(F.col("proto"))))
    method = F.concat_ws(" ", F.nullif(modifiers(F.col("access_flags"), "method"), F.lit("")), signature)
    each = fields.select(*key, F.struct(F.lit(0).alias("k"), F.col("field_index").alias("i"), field.alias("text")).alias("m"))
    each = each.unionByName(methods.select(*key, F.struct(F.lit(1).alias("k"), F.col("method_index").alias("i"), method.alias("text")).alias("m")))
    lines = each.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["text"]), "\n").alias("members"))
    upper = F.when(F.col("superclass") != OBJECT, F.concat(F.lit("extends "), dotted_name(F.col("superclass"))))
    interfaces = F.array_distinct(F.array_compact(F.array("iface1", "iface2")))
    listed = F.when(F.size(interfaces) > 0, F.concat(F.lit("implements "), F.array_join(F.transform(interfaces, dotted_name), ", ")))
    head = F.concat_ws(" ", F.nullif(modifiers(F.col("access_flags"), "class"), F.lit("")), class_kind(F.col("access_flags")), dotted_name(F.col("descriptor")), upper, listed)
    return classes.select(*key, "descriptor", head.alias("head")).join(lines, key, "left").withColumn("members", F.coalesce("members", F.lit("")))


def result_bytes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with `json_bytes`: the length of each row's JSON object of the columns, as a client would get it."""
    return rows.withColumn("json_bytes", F.octet_length(F.to_json(F.struct(*columns))).cast("long")).select(*keys, *(c for c in columns if c not in keys), "json_bytes")


def definition_verdicts(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """asked (package_id, descriptor) with definitions, dexes and verdict: not found, unique or ambiguous."""
    found = classes.groupBy("package_id", "descriptor").agg(F.count("*").alias("definitions"), F.array_join(F.sort_array(F.collect_list("dex_id")), " ").alias("dexes"))
    out = asked.join(found, ["package_id", "descriptor"], "left").withColumn("definitions", F.coalesce("definitions", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("definitions") == 0, "not found").when(F.col("definitions") > 1, "ambiguous").otherwise("unique"))


def nested_children(nesting: DataFrame, member_classes: DataFrame, classes: DataFrame) -> DataFrame:
    """(package_id, child, parent): the declared parent, or else the class whose list of member classes has the child, if it is defined.

    nesting: (package_id, child, parent or null). member_classes: (package_id, descriptor, child). Of several that list a
    child the first by name counts.
    """
    defined = classes.select("package_id", F.col("descriptor").alias("child")).distinct()
    declared = nesting.where("parent is not null").select("package_id", "child", "parent").distinct()
    listed = member_classes.join(defined, ["package_id", "child"], "left_semi").join(declared, ["package_id", "child"], "left_anti")
    return declared.unionByName(listed.groupBy("package_id", "child").agg(F.min("descriptor").alias("parent")))


def function_objects(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Classes that only carry a function: synthetic, final, with an interface, below Object, one method, final state."""
    key = [*KEY, "class_def_idx"]
    shape = classes.where(has(F.col("access_flags"), 0x1000) & has(F.col("access_flags"), 16) & F.col("iface1").isNotNull() & (F.col("superclass").isNull() | (F.col("superclass") == OBJECT)))
    loose = fields.where(has(F.col("access_flags"), 8) | ~has(F.col("access_flags"), 16)).select(*key)
    callable_ = methods.where(~F.col("name").isin("<init>", "<clinit>") & ~has(F.col("access_flags"), 8)).groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return shape.join(loose, key, "left_anti").join(callable_, key, "left_semi")


def class_kind(flags: Column) -> Column:
    return F.when(has(flags, 0x200), "interface").when(has(flags, 0x4000), "enum").when(has(flags, 0x2000), "@interface").otherwise("class")


def class_shape(inner: Column, inner_name: Column, enclosing_method: Column, parent: Column) -> Column:
    """anonymous: inner-class data with no name or one of digits; local: in a method; inner: has a parent."""
    anonymous = inner & (inner_name.isNull() | inner_name.rlike("^[0-9]+$"))
    return F.when(anonymous, "anonymous").when(enclosing_method.isNotNull(), "local").when(parent.isNotNull(), "inner").otherwise("top-level")


#: The opcode of a class constant.
CONST_CLASS = 0x1C


def constant_types(refs: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """(package_id, descriptor, type): the types that a class's code has as class constants."""
    found = refs.where((F.col("ref_kind") == "type") & (F.col("opcode") == CONST_CLASS)).select(*KEY, "method_index", "target_index").distinct()
    named = found.join(types.select(*KEY, F.col("type_index").alias("target_index"), F.col("descriptor").alias("type")), [*KEY, "target_index"])
    return named.join(methods.select(*KEY, "method_index", F.col("owner").alias("descriptor")), [*KEY, "method_index"]).select("package_id", "descriptor", "type").distinct()


def dependencies(classes: DataFrame, fields: DataFrame, methods: DataFrame, more: DataFrame | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """(package_id, descriptor, type): the object types that a class names in its header and in its members.

    more: (package_id, descriptor, type) of annotations, constants and thrown exceptions. signatures: (package_id,
    descriptor, signature) of classes and members, whose bounds, arguments and raw types count too.
    """
    head = classes.select("package_id", "descriptor", F.explode(F.array("superclass", "iface1", "iface2")).alias("type"))
    held = fields.select("package_id", F.col("owner").alias("descriptor"), "type")
    used = methods.select("package_id", F.col("owner").alias("descriptor"), F.explode(F.concat(proto_params(F.col("proto")), F.array(proto_return(F.col("proto"))))).alias("type"))
    every = head.unionByName(held).unionByName(used)
    if more is not None:
        every = every.unionByName(more.select("package_id", "descriptor", "type"))
    if signatures is not None:
        every = every.unionByName(signatures.select("package_id", "descriptor", F.explode(signature_types(F.col("signature"))).alias("type")))
    every = every.withColumn("type", F.regexp_replace("type", r"^\[+", ""))
    return every.where(F.col("type").startswith("L")).distinct()


def import_plan(used: DataFrame) -> DataFrame:
    """used with `plan`: qualified where another used type has the same simple name, none in java.lang or the own package."""
    simple = simple_name(F.col("type"))
    same = F.count("*").over(Window.partitionBy("package_id", "descriptor", simple)) > 1
    near = package_name(F.col("type")).isin("java/lang") | (package_name(F.col("type")) == package_name(F.col("descriptor")))
    return used.withColumn("plan", F.when(same, "qualified").when(near, "none").otherwise("import"))


def single_abstract_methods(closure: DataFrame, methods: DataFrame, object_methods: DataFrame) -> DataFrame:
    """(package_id, descriptor, name, params) of interfaces with one abstract method; the nearest declaration counts."""
    params = F.array_join(proto_params(F.col("proto")), "")
    own = methods.where(~has(F.col("access_flags"), 8) & ~has(F.col("access_flags"), 2)).select("package_id", F.col("owner").alias("ancestor"), "name", params.alias("params"), has(F.col("access_flags"), 0x400).alias("abstract"))
    one = ["package_id", "descriptor", "name", "params"]
    # Of the nearest declarations one with a body wins, whatever their order.
    nearest = closure.join(own, ["package_id", "ancestor"]).groupBy(*one).agg(F.min(F.struct("distance", "abstract")).alias("d")).where("d.abstract").drop("d")
    left = nearest.join(object_methods.select("name", params.alias("params")), ["name", "params"], "left_anti")
    return left.groupBy("package_id", "descriptor").agg(F.count("*").alias("_n"), F.min("name").alias("name"), F.min("params").alias("params")).where("_n = 1").drop("_n")


def static_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Static fields with `value`: value i belongs to static field i of the class; further fields have none."""
    key = [*KEY, "class_def_idx"]
    order = Window.partitionBy(*key).orderBy("field_index")
    static = fields.where(has(F.col("access_flags"), 8)).withColumn("ordinal", F.row_number().over(order) - 1)
    return static.join(values.select(*key, "ordinal", "value"), [*key, "ordinal"], "left")


def member_table(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(KEY, class_def_idx, row, line): fields by runtime slot, then direct and virtual methods in declaration order."""
    key = [*KEY, "class_def_idx"]
    static = has(F.col("access_flags"), 8)
    slot = F.row_number().over(Window.partitionBy(*key).orderBy(static, "field_index")) - 1
    text = F.concat(F.lit("# members fields: field_ids="), "field_index", F.lit(" slot="), slot, F.lit(" static="), static.cast("string"), F.lit(" flags="), hex_flags(F.col("access_flags")), F.lit(" type="), "type", F.lit(" name="), "name")
    one = fields.select(*key, F.lit(0).alias("kind"), F.col("field_index").alias("i"), static.alias("late"), text.alias("line"))
    text = F.concat(F.lit("# members methods: method_ids="), "method_index", F.lit(" proto="), "proto", F.lit(" flags="), hex_flags(F.col("access_flags")), F.lit(" name="), "name")
    direct = F.col("name").isin("<init>", "<clinit>") | static | has(F.col("access_flags"), 2)
    two = methods.select(*key, F.lit(1).alias("kind"), F.col("method_index").alias("i"), (~direct).alias("late"), text.alias("line"))
    row = F.row_number().over(Window.partitionBy(*key).orderBy("kind", "late", "i")) - 1
    return one.unionByName(two).select(*key, row.alias("row"), "line")
