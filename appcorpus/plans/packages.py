"""Registered queries over package files. Fixtures write the files from the views once, so the SQL reads the views.

Files are read by ranges: directories first, then each image by a task of its own. The streaming queries take packages as rows of bytes.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcorpus.operators.annotations import metadata
from appcorpus.operators import hierarchy as h
from appcorpus.operators import references as r
from appcorpus.plans.queries import _UP, _findrefs_sql, query
from appcorpus.shared import shared_folder, stored
from appcorpus.sources import archives
from appcorpus.sources import packages as p
from appcorpus.streaming.ingest import CHANGED, ingest
from appcorpus.testing.packages import BROKEN, MARKED, SIGNATURE, THROWS, bare_images, containers, packages, written

_GOOD = f"not ({BROKEN})"


def _named(df: DataFrame) -> DataFrame:
    """package_id from the file's name, without its ending; a pattern over whole paths would try every place of each folder's name."""
    return df.withColumn("package_id", F.regexp_extract(F.substring_index("path", "/", -1), r"(?s)^(.*)[.]", 1)).drop("path")


def _entries(v, make=packages) -> DataFrame:
    return archives.list_entries(v("fx_classes").sparkSession, written(v, make))


def _table(v, fact: str) -> DataFrame:
    return _named(p.table(archives.read_facts(_entries(v), [fact]), fact))


#: Entries of each package behind its images, and what reading them gives.
_MORE = """more as (select package_id, n + t.k as entry_index, t.name, t.label, t.verdict from (select package_id, count(distinct entry_index) as n from fx_classes group by 1)
join (values (0, 'AndroidManifest.xml', 'stored', 'ok'), (1, 'assets/classes3.dex', 'stored', 'ok'), (2, 'res/short.bin', 'stored', 'size differs'), (3, 'res/cut.bin', 'deflated', 'truncated'), (4, 'res/packed.bin', 'other', 'unsupported method'),
(5, 'res/long.bin', 'deflated', 'size differs')) t(k, name, label, verdict) on t.k < 2 or cast(substr(package_id, 4) as bigint) % 3 = 0)"""


@query("select distinct package_id || '.apk' as path, 'archive' as kind from fx_classes union all select distinct package_id || '/' || dex_id, 'dex' from fx_classes where entry_index = 0")
def s01_package_scan(v):
    """Archives and bare images, told apart by their first bytes; no payload is read."""
    found = _entries(v, bare_images).select("path", "kind").distinct()
    return found.select(F.regexp_extract("path", r"(pkg[0-9]*[./].*)$", 1).alias("path"), "kind")


@query(f""", {_MORE} select path, kind, entry_count, dex_entry_count from (select package_id || '.apk' as path, 'archive' as kind, count(*) as entry_count, count(*) filter (name like '%.dex' and not contains(name, '/')) as dex_entry_count
from (select distinct package_id, dex_id as name from fx_classes union all select package_id, name from more) group by 1) union all select distinct package_id || '/' || dex_id, 'dex', 1, 1 from fx_classes where entry_index = 0""")
def s02_package_kinds(v):
    """Each input with its kind, its entries and those that are images of the root."""
    root = F.col("name").endswith(".dex") & ~F.contains("name", F.lit("/"))
    found = _entries(v, bare_images).groupBy("path", "kind").agg(F.count("entry_index").alias("entry_count"), F.count_if(root).alias("dex_entry_count"))
    return found.withColumn("path", F.regexp_extract("path", r"(pkg[0-9]*[./].*)$", 1))


@query(f""", {_MORE} select package_id, entry_index, dex_id as name, case entry_index when 0 then 'stored' when 1 then 'deflated' when 2 then 'stored' else 'deflated' end as label from (select distinct package_id, entry_index, dex_id from fx_classes)
union all select package_id, entry_index, name, label from more""")
def s03_archive_directory(v):
    label = F.when(F.col("compression") == 0, "stored").when(F.col("compression") == 8, "deflated").otherwise("other")
    return _named(_entries(v)).select("package_id", "entry_index", "name", label.alias("label"))


@query("""select package_id, sha256('<manifest package="' || package_id || '"/>') as sha256, 22 + length(package_id) as size from (select distinct package_id from fx_classes)""")
def s05_entry_payload(v):
    """Digests of the entries whose text SQL knows: manifests."""
    found = archives.verdicts(_entries(v).where("name = 'AndroidManifest.xml'"))
    return _named(found).select("package_id", "sha256", "size")


@query(f""", {_MORE} select package_id, entry_index, dex_id as name, 'ok' as verdict from (select distinct package_id, entry_index, dex_id from fx_classes) union all select package_id, entry_index, name, verdict from more""")
def s05_payload_verdicts(v):
    """Every entry, stored and deflated, whole and damaged. Digests of images have no SQL: they are compared with zipfile in the tests."""
    return _named(archives.verdicts(_entries(v))).select("package_id", "entry_index", "name", "verdict")


@query(f"select distinct package_id, entry_index, 0 as logical_index, dex_id from fx_classes where {_GOOD}")
def s07_logical_dex(v):
    return _table(v, "header").select("package_id", "entry_index", "logical_index", "dex_id")


@query("""select package_id, dense_rank() over (partition by package_id order by entry_index) - 1 as logical_index, case when count(*) over (partition by package_id) > 1 then 'classes.dex!classes' || dense_rank() over (partition by package_id order by entry_index) || '.dex' else 'classes.dex' end as dex_id,
'041' as version, true as checksum_ok, classes, methods, refs from (select package_id, entry_index, count(*) as classes from fx_classes group by 1, 2)
join (select package_id, entry_index, count(*) as methods from fx_methods group by 1, 2) using (package_id, entry_index)
left join (select package_id, entry_index, count(*) as refs from (select package_id, entry_index from fx_code_refs union all select package_id, entry_index from fx_type_refs) group by 1, 2) using (package_id, entry_index)""")
def s07_container_members(v):
    """Version 041 containers: each member is a logical image, with its own classes, methods and references."""
    found = _named(archives.read_facts(_entries(v, containers), ["header", "class", "method", "ref"]))
    count = lambda fact: F.count_if(F.col("fact") == fact)
    head = F.max(F.when(F.col("fact") == "header", F.struct(F.col("a").alias("version"), (F.col("m") == 1).alias("checksum_ok"))))
    each = found.where("dex_id is not null").groupBy("package_id", "logical_index", "dex_id").agg(head.alias("head"), count("class").alias("classes"), count("method").alias("methods"), F.nullif(count("ref"), F.lit(0)).alias("refs"))
    return each.select("package_id", "logical_index", "dex_id", "head.*", "classes", "methods", "refs")


@query(f"select distinct package_id, entry_index, '035' as version, true as checksum_ok from fx_classes where {_GOOD}")
def s08_dex_header(v):
    return _table(v, "header").select("package_id", "entry_index", "version", "checksum_ok")


_USED = r"""select package_id, entry_index, unnest([descriptor, superclass, iface1, iface2]) as t from fx_classes union all select package_id, entry_index, type from fx_fields
union all select package_id, entry_index, unnest(regexp_extract_all(proto, '\[*(?:[ZBSCIJFDV]|L[^;]+;)')) from fx_methods union all select package_id, entry_index, catch_type from fx_try_handlers
union all select package_id, entry_index, type from fx_annotations union all select package_id, entry_index, exception from fx_throws
union all select distinct package_id, entry_index, unnest(['Ldalvik/annotation/Throws;', 'Lcom/lib/F;', 'Lcom/lib/P;', 'Ldalvik/annotation/InnerClass;', 'Ldalvik/annotation/EnclosingClass;', 'Ldalvik/annotation/EnclosingMethod;', 'Ldalvik/annotation/MemberClasses;', 'Lcom/lib/In;']) from fx_classes"""


_NAMED = f"""select distinct package_id, entry_index, value from (select package_id, entry_index, t as value from ({_USED}) where t is not null union all select package_id, entry_index, name from fx_fields
union all select package_id, entry_index, name from fx_methods union all select distinct package_id, entry_index, unnest(['V', 'value', 'Lcom/', 'name', 'accessFlags', 'Inner']) from fx_classes)"""


_STRINGS = f"""select package_id, entry_index, string_index, value from (select package_id, entry_index, string_index, value from fx_strings
union all select m.package_id, m.entry_index, coalesce(c.n, 0) + row_number() over (partition by m.package_id, m.entry_index order by m.value) - 1, m.value
from ({_NAMED}) m left join (select package_id, entry_index, count(*) as n from fx_strings group by 1, 2) c on c.package_id = m.package_id and c.entry_index = m.entry_index
where not exists (select 1 from fx_strings s where s.package_id = m.package_id and s.entry_index = m.entry_index and s.value = m.value)) where {_GOOD}"""


@query(_STRINGS)
def s09_string_table(v):
    """The whole table, with the names of types, members and annotations."""
    return _table(v, "string").select("package_id", "entry_index", "string_index", "value")


@query(f"select s.*, c.dex_id, length(s.value) as chars from ({_STRINGS}) s join (select distinct package_id, entry_index, dex_id from fx_classes) c using (package_id, entry_index)")
def s09_dex_strings(v):
    """Whole tables too, by image and with their lengths."""
    return _table(v, "string").select("package_id", "entry_index", "dex_id", "string_index", "value", F.length("value").cast("long").alias("chars"))


@query(f"select distinct package_id, entry_index, t as descriptor from ({_USED}) where t is not null and {_GOOD}")
def s10_dex_types(v):
    return _table(v, "type").select("package_id", "entry_index", "descriptor")


@query(f"select distinct package_id, entry_index, proto from fx_methods where {_GOOD}")
def s11_dex_protos(v):
    return _table(v, "proto").select("package_id", "entry_index", "proto")


@query(f"select package_id, entry_index, field_index, owner || '->' || name || ':' || type as reference from fx_fields where {_GOOD}")
def s12_dex_fields(v):
    return _table(v, "field").select("package_id", "entry_index", "field_index", F.concat("owner", F.lit("->"), "name", F.lit(":"), "type").alias("reference"))


@query(f"select package_id, entry_index, method_index, owner || '->' || name || proto as reference from fx_methods where {_GOOD}")
def s13_dex_methods(v):
    return _table(v, "method").select("package_id", "entry_index", "method_index", F.concat("owner", F.lit("->"), "name", "proto").alias("reference"))


@query(f"select package_id, entry_index, class_def_idx, descriptor, superclass, access_flags, concat_ws(' ', iface1, iface2) as interfaces from fx_classes where {_GOOD}")
def s14_class_defs(v):
    return _table(v, "class").select("package_id", "entry_index", "class_def_idx", "descriptor", "superclass", "access_flags", F.array_join("interfaces", " ").alias("interfaces"))


@query(f"""select package_id, entry_index, class_def_idx, case when (access_flags & 8) <> 0 then 'static_field' else 'instance_field' end as kind, field_index as member_index, name, type as type_or_proto, access_flags from fx_fields where {_GOOD}
union all select package_id, entry_index, class_def_idx, case when name = '<init>' or (access_flags & 10) <> 0 then 'direct_method' else 'virtual_method' end, method_index, name, proto, access_flags from fx_methods where {_GOOD}""")
def s15_class_members(v):
    return _table(v, "member").select("package_id", "entry_index", "class_def_idx", "kind", "member_index", "name", "type_or_proto", "access_flags")


@query(f"select package_id, entry_index, method_index, ref_kind, target_index, count(*) as n from (select * from fx_code_refs union all select * from fx_type_refs) where {_GOOD} group by all")
def s17_code_refs(v):
    return _table(v, "ref").groupBy("package_id", "entry_index", "method_index", "ref_kind", "target_index").agg(F.count("*").alias("n"))


@query(f"select package_id, entry_index, method_index, start_addr, end_addr, handler_order, catch_type, handler_addr from fx_try_handlers where {_GOOD}")
def s18_try_handlers(v):
    return _table(v, "try").select("package_id", "entry_index", "method_index", "start_addr", "end_addr", "handler_order", "catch_type", "handler_addr")


#: Each value's text, and its parts by type.
_VALUES = f"""select package_id, entry_index, class_def_idx, ordinal, 'int' as tag, cast(value as varchar) as value, value as num, null::double as dbl, null as str, null::boolean as flag from fx_static_values where {_GOOD}
union all select package_id, entry_index, class_def_idx, ordinal, tag, case tag when 'byte' then (number - 30)::varchar when 'short' then (-9 * number)::varchar when 'char' then (1000 * number)::varchar when 'long' then (-number::bigint * 1099511627776)::varchar
when 'float' then (number / 4.0)::double::varchar when 'double' then (-number / 8.0)::double::varchar when 'string' then 'value' when 'type' then descriptor when 'method' then descriptor || '-><init>:()V' when 'array' then '[' || number || ', value, [null]]'
when 'annotation' then 'Lcom/lib/F;(value=' || number || ')' when 'methodtype' then '()V' when 'methodhandle' then number::varchar when 'bool' then 'true' when 'null' then null else descriptor || '->f0:' || field_type end,
case tag when 'byte' then number - 30 when 'short' then -9 * number when 'char' then 1000 * number when 'long' then -number::bigint * 1099511627776 when 'methodhandle' then number when 'array' then number when 'annotation' then number end,
case tag when 'float' then number / 4.0 when 'double' then -number / 8.0 end, case tag when 'string' then 'value' when 'type' then descriptor when 'method' then descriptor || '-><init>:()V' when 'array' then 'value' when 'annotation' then 'Lcom/lib/F;' when 'methodtype' then '()V'
when 'field' then descriptor || '->f0:' || field_type when 'enum' then descriptor || '->f0:' || field_type end, case tag when 'bool' then true end from fx_encoded_values where {_GOOD}"""


@query(f"select package_id, entry_index, class_def_idx, ordinal, tag, value from ({_VALUES})")
def s20_static_values(v):
    """Values of every kind, as text."""
    return _table(v, "static").select("package_id", "entry_index", "class_def_idx", "ordinal", "tag", "value")


@query(f"select package_id, entry_index, class_def_idx, tag, num, dbl, str, flag from ({_VALUES})")
def s20_typed_values(v):
    """The same as variants: numbers, strings and flags by type; of an array its first two values, of an annotation its type and element."""
    get = lambda path, kind: F.try_variant_get("typed", path, kind)
    tag = F.col("tag")
    num = F.when(tag == "array", get("$.value[0].value", "long")).when(tag == "annotation", get("$.value.value.value", "long")).when(tag.isin("byte", "short", "char", "int", "long", "methodhandle"), get("$.value", "long"))
    text = F.when(tag == "array", get("$.value[1].value", "string")).when(tag == "annotation", get("$.type", "string")).when(tag.isin("string", "type", "field", "method", "enum", "methodtype"), get("$.value", "string"))
    dbl, flag = F.when(tag.isin("float", "double"), get("$.value", "double")), F.when(tag == "bool", get("$.value", "boolean"))
    return _table(v, "static").select("package_id", "entry_index", "class_def_idx", "tag", num.alias("num"), dbl.alias("dbl"), text.alias("str"), flag.alias("flag"))


#: The compiler's marks on nested and nesting classes, in their order behind a class's own annotation.
_NESTS = """select package_id, entry_index, class_def_idx, 'InnerClass' as mark, 'accessFlags=9' || case nest when 'enclosed' then ' name=Inner' else '' end as elements from fx_nest_marks where nest <> 'members'
union all select package_id, entry_index, class_def_idx, 'EnclosingClass', 'value=' || superclass from fx_nest_marks where nest = 'enclosed'
union all select package_id, entry_index, class_def_idx, 'EnclosingMethod', 'value=' || descriptor || '-><init>:()V' from fx_nest_marks where nest = 'anonymous'
union all select package_id, entry_index, class_def_idx, 'MemberClasses', 'value=' || unnest([superclass, 'Lcom/lib/In;']) from fx_nest_marks where nest = 'members'"""


@query(f"""select * from (select package_id, entry_index, class_def_idx, 'class' as target_kind, null::bigint as target_index, null::bigint as parameter, visibility, type,
case when type = '{SIGNATURE}' then 'value=Lcom/ value=' || descriptor else 'value=' || class_def_idx end as elements from fx_annotations
union all select package_id, entry_index, class_def_idx, 'field', field_index, null, 'runtime', 'Lcom/lib/F;', '' from fx_fields where name = 'f1'
union all select m.package_id, m.entry_index, class_def_idx, 'method', m.method_index, null, 'system', '{THROWS}', 'value=' || exception from fx_throws t join fx_methods m on m.package_id = t.package_id and m.entry_index = t.entry_index and m.method_index = t.method_index
union all select package_id, entry_index, class_def_idx, 'parameter', method_index, 1, 'build', 'Lcom/lib/P;', '' from fx_methods where proto = '{MARKED}'
union all select package_id, entry_index, class_def_idx, 'class', null, null, 'system', 'Ldalvik/annotation/' || mark || ';', elements from ({_NESTS})) where {_GOOD}""")
def s21_annotations(v):
    return _table(v, "annotation").select("package_id", "entry_index", "class_def_idx", "target_kind", "target_index", "parameter", "visibility", "type", F.array_join("elements", " ").alias("elements"))


@query(f"""select * from (select a.package_id, a.entry_index, a.class_def_idx, 'class' as target_kind, null::bigint as target_index, case when type = '{SIGNATURE}' then 'Lcom/' || a.descriptor end as signature,
case when type = '{THROWS}' then cast(a.class_def_idx as varchar) end as throws, case nest when 'enclosed' then 'Inner' end as inner_name, case when nest in ('enclosed', 'anonymous') then 9 end as inner_flags,
case nest when 'enclosed' then superclass end as enclosing_class, case nest when 'anonymous' then a.descriptor || '-><init>:()V' end as enclosing_method, case nest when 'members' then superclass || ' Lcom/lib/In;' else '' end as member_classes
from fx_annotations a left join fx_nest_marks n on n.package_id = a.package_id and n.entry_index = a.entry_index and n.class_def_idx = a.class_def_idx
union all select m.package_id, m.entry_index, class_def_idx, 'method', m.method_index, null, exception, null, null, null, null, '' from fx_throws t join fx_methods m on m.package_id = t.package_id and m.entry_index = t.entry_index and m.method_index = t.method_index
union all select package_id, entry_index, class_def_idx, 'field', field_index, null, null, null, null, null, null, '' from fx_fields where name = 'f1') where {_GOOD}""")
def s21_class_metadata(v):
    """Every annotated class, field and method with all that the compiler's marks say of it."""
    found = metadata(_table(v, "annotation"), ["package_id", "entry_index"])
    return found.select("package_id", "entry_index", "class_def_idx", "target_kind", "target_index", "signature", F.array_join("throws", " ").alias("throws"), "inner_name", "inner_flags", "enclosing_class", "enclosing_method", F.array_join("member_classes", " ").alias("member_classes"))


@query(f"select distinct package_id, entry_index, dex_id from fx_classes where {BROKEN}")
def s24_quarantine(v):
    return _table(v, "error").select("package_id", "entry_index", "dex_id")


@query(f"select package_id || '.apk' as path, count(*) as classes from fx_classes where {_GOOD} group by 1")
def t01_incremental_ingest(v):
    """Every package arrives in two files, the second time under another name; each is taken once."""
    made = packages(v)
    spark = made.sparkSession
    home = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    made.select("path", "content").write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema("path string, content binary").parquet(f"{home}/in")
    ingest(stream, f"{home}/catalog", f"{home}/state").awaitTermination()
    spark.read.schema("path string, content binary").parquet(f"{home}/in").select(F.concat(F.lit("copy-"), "path").alias("path"), "content").write.parquet(f"{home}/more")
    spark.read.parquet(f"{home}/more").write.mode("append").parquet(f"{home}/in")
    ingest(stream, f"{home}/catalog", f"{home}/state").awaitTermination()
    return p.table(spark.read.parquet(f"{home}/catalog/facts"), "class").groupBy("path").agg(F.count("*").alias("classes"))


@query("""select distinct package_id || '.apk' as path, case when cast(substr(package_id, 4) as int) % 3 = 0 then 'changed' else 'copy' end as status from fx_classes
union all select distinct package_id || '.apk', 'new' from fx_classes""")
def t01_changed_inputs(v):
    """Every package is seen twice under its name, every third one with another content the second time: that is an error row."""
    made = packages(v).select("path", "content")
    spark = made.sparkSession
    home = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    made.write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema("path string, content binary").parquet(f"{home}/in")
    ingest(stream, f"{home}/catalog", f"{home}/state").awaitTermination()
    third = F.expr("cast(substring(path, 4, length(path) - 7) as int) % 3 = 0")
    spark.read.parquet(f"{home}/in").withColumn("content", F.when(third, F.expr("content || X'00'")).otherwise(F.col("content"))).write.parquet(f"{home}/more")
    spark.read.parquet(f"{home}/more").write.mode("append").parquet(f"{home}/in")
    ingest(stream, f"{home}/catalog", f"{home}/state").awaitTermination()
    seen = spark.read.parquet(f"{home}/catalog/packages")
    errors = p.table(spark.read.parquet(f"{home}/catalog/facts").where(F.col("error") == CHANGED), "error").select("path", F.lit("changed").alias("status"))
    return seen.where("status <> 'changed'").select("path", "status").unionByName(errors)


def _catalog(v, *only: str):
    """One pass over the files; every table of it is read from what that pass wrote."""
    found = stored(archives.read_facts(_entries(v), only))
    return lambda fact: _named(p.table(found, fact))


@query(f"select * from ({_findrefs_sql('string', "select package_id, entry_index, string_index as target_index, value as text from fx_strings where contains(value, 'Authorization')")}) where {_GOOD}".replace("select * from (select m.package_id,", "select package_id, dex_id, method_index, member, matched from (select m.package_id, m.entry_index,"))
def j01_findrefs_from_bytes(v):
    """From package bytes to rendered references, through the extracted catalog alone."""
    tables = _catalog(v, "string", "ref", "method")
    targets = tables("string").where(r.contains_literal(F.col("value"), "Authorization")).select(*r.KEY, F.col("string_index").alias("target_index"), F.col("value").alias("text"))
    return r.find_references(tables("ref"), "string", targets, tables("method"))


@query(_UP.replace("from fx_classes)", f"from fx_classes where {_GOOD})") + " select package_id, descriptor, ancestor, distance from up")
def j05_ancestors_from_bytes(v):
    """The hierarchy of the classes that were read from bytes."""
    classes = _catalog(v, "class")("class").withColumns({"iface1": F.get("interfaces", F.lit(0)), "iface2": F.get("interfaces", F.lit(1))})
    return h.ancestors(h.parent_edges(classes))
