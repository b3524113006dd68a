"""Catalog views over the given tables: the same SQL runs in Spark and, as common table expressions, in DuckDB."""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "lineitem", "orders", "documents", "benchmark", "pages", "events")

VIEWS = {
    "fx_classes": """
select p_partkey as src_key,
       'pkg' || lpad(cast(cast(floor(p_partkey/20) as bigint) as varchar(20)), 6, '0') as package_id,
       p_partkey % 4 as entry_index, 0 as logical_index,
       case when p_partkey % 4 = 0 then 'classes.dex'
            else 'classes' || cast(p_partkey % 4 + 1 as varchar(20)) || '.dex' end as dex_id,
       cast(floor((p_partkey % 20)/4) as bigint) as class_def_idx,
       (p_partkey % 20) % 15 as c,
       'Lcom/p' || cast(cast(floor(p_partkey/20) as bigint) as varchar(20)) || '/g' || cast(((p_partkey % 20) % 15) % 3 as varchar(20))
         || '/C' || cast((p_partkey % 20) % 15 as varchar(20)) || ';' as descriptor,
       case when (p_partkey % 20) % 15 = 0 then 'Ljava/lang/Object;'
            else 'Lcom/p' || cast(cast(floor(p_partkey/20) as bigint) as varchar(20)) || '/g'
              || cast(cast(floor(((p_partkey % 20) % 15 - 1)/2) as bigint) % 3 as varchar(20))
              || '/C' || cast(cast(floor(((p_partkey % 20) % 15 - 1)/2) as bigint) as varchar(20)) || ';' end as superclass,
       case when p_size % 2 = 0 then 'Lcom/lib/I' || cast(p_size % 7 as varchar(20)) || ';' end as iface1,
       case when p_size % 4 = 0 then 'Lcom/lib/I' || cast((p_size + 3) % 7 as varchar(20)) || ';' end as iface2,
       cast(p_size % 2 + case when p_size % 3 = 0 then 16 else 0 end
            + case when p_size % 7 = 6 then 1536 when p_size % 11 = 3 then 16384 when p_size % 13 = 5 then 8192 else 0 end as bigint) as access_flags,
       p_size
from part
""",
    "fx_methods": """
select k.src_key, k.package_id, k.entry_index, k.logical_index, k.dex_id, k.class_def_idx,
       k.class_def_idx*4 + m.m as method_index, k.descriptor as owner,
       case m.m when 0 then '<init>' when 1 then 'onCreate' when 2 then 'run' || cast(k.p_size % 5 as varchar(20)) else 'access$' || cast(k.c as varchar(20)) end as name,
       case when m.m = 0 then '()V' when k.p_size % 3 = 0 then '(I)V' when k.p_size % 3 = 1 then '()Ljava/lang/Object;' else '(Ljava/lang/String;[I)Z' end as proto,
       cast(case m.m when 0 then 65537 when 1 then 4 when 2 then 1 else 4104 end as bigint) as access_flags
from fx_classes k cross join (values (0),(1),(2),(3)) as m(m)
""",
    "fx_strings": """
select package_id, entry_index, logical_index, dex_id,
       row_number() over (partition by package_id, entry_index order by value) - 1 as string_index, value
from (select distinct k.package_id, k.entry_index, k.logical_index, k.dex_id, v.value
      from fx_classes k join (select p_partkey, p_name as value from part union all select p_partkey, p_brand from part
                              union all select p_partkey, 'Authorization ' || p_type from part) v on v.p_partkey = k.src_key) d
""",
    "fx_code_refs": """
select k.package_id, k.entry_index, k.logical_index, k.dex_id,
       k.class_def_idx*4 + l.l_linenumber % 4 as method_index, l.l_linenumber*3 as pc,
       case l.l_returnflag when 'A' then 'method' when 'N' then 'field' else 'string' end as ref_kind,
       case l.l_returnflag when 'A' then l.l_suppkey % 20 when 'N' then l.l_suppkey % 10 else l.l_suppkey % 6 end as target_index,
       cast(case l.l_returnflag when 'A' then 110 + l.l_orderkey % 5 when 'N' then 82 else 26 end as bigint) as opcode
from lineitem l join fx_classes k on k.src_key = l.l_partkey
""",
    "fx_deep_edges": """
select 'deep' as package_id, 'Ldeep/C' || cast(p_partkey as varchar(20)) || ';' as descriptor,
       case when p_partkey = 0 then 'Ljava/lang/Object;'
            when p_partkey % 97 = 0 then 'Lmissing/X' || cast(p_partkey as varchar(20)) || ';'
            else 'Ldeep/C' || cast(cast(floor((p_partkey-1)/2) as bigint) as varchar(20)) || ';' end as superclass
from part
""",
    "fx_platform_edges": """
select * from (values ('Ljava/lang/Throwable;','Ljava/lang/Object;'),('Ljava/lang/Exception;','Ljava/lang/Throwable;'),
 ('Ljava/lang/Error;','Ljava/lang/Throwable;'),('Ljava/lang/RuntimeException;','Ljava/lang/Exception;'),
 ('Ljava/io/IOException;','Ljava/lang/Exception;')) as t(descriptor, superclass)
""",
    "fx_throws": """
select package_id, entry_index, logical_index, method_index,
       case when src_key % 2 = 0 then 'Ljava/io/IOException;' else 'Ljava/lang/RuntimeException;' end as exception
from fx_methods where name = 'onCreate' and src_key % 5 = 0
""",
    "fx_try_handlers": """
select package_id, entry_index, logical_index, method_index, 0 as start_addr, 12 as end_addr, 0 as handler_order,
       case src_key % 3 when 0 then 'Ljava/io/IOException;' when 1 then 'Ljava/lang/Exception;' end as catch_type, 18 as handler_addr
from fx_methods where src_key % 4 <> 3
""",
    "fx_nesting": """
select package_id, descriptor,
       'Lcom/p' || cast(cast(floor(src_key/20) as bigint) as varchar(20)) || '/g' || cast(c % 3 as varchar(20)) || '/C' || cast(c as varchar(20)) || '$' || cast(p_size % 4 as varchar(20)) || ';' as child,
       case when p_size % 4 = 0 then descriptor end as enclosing_class,
       case when p_size % 4 = 1 then descriptor || '->run0()V' end as enclosing_method,
       case when p_size % 4 = 2 then 'Inner' end as inner_name
from fx_classes
""",
    "fx_entries": """
select 'pkg' || lpad(cast(o_custkey as varchar(20)), 6, '0') as package_id,
       row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry_index,
       case o_orderpriority when '1-URGENT' then 'classes.dex' when '2-HIGH' then 'classes2.dex'
            when '3-MEDIUM' then 'AndroidManifest.xml' when '5-LOW' then 'app.dex' else 'assets/classes3.dex' end as name,
       case o_orderstatus when 'F' then 0 when 'O' then 8 else 12 end as compression,
       cast(floor(o_totalprice) as bigint) as uncompressed_size
from orders
""",
    "fx_fields": """
select k.package_id, k.entry_index, k.logical_index, k.dex_id, k.class_def_idx, k.class_def_idx*2 + f.f as field_index, k.descriptor as owner,
       'f' || cast(f.f as varchar(20)) as name,
       case when k.p_size % 3 = 0 then 'I' when k.p_size % 3 = 1 then '[[Ljava/lang/String;' else 'Lcom/lib/I1;' end as type,
       cast(case when f.f = 1 and k.p_size % 4 < 2 then 9 when k.p_size % 5 = 0 then 2 else 18 end as bigint) as access_flags
from fx_classes k cross join (values (0),(1)) as f(f)
""",
    "fx_static_values": """
select package_id, entry_index, logical_index, class_def_idx, 0 as ordinal, cast(p_size * 3 as bigint) as value from fx_classes where p_size % 3 = 0
""",
    "fx_encoded_values": """
select k.package_id, k.entry_index, k.logical_index, k.class_def_idx, 0 as ordinal, k.descriptor, k.p_size as number, f.type as field_type,
       case p_size % 16 when 0 then 'byte' when 1 then 'short' when 2 then 'char' when 3 then 'long' when 4 then 'float' when 5 then 'double' when 6 then 'string' when 7 then 'type' when 8 then 'field'
            when 9 then 'method' when 10 then 'enum' when 11 then 'array' when 12 then 'annotation' when 13 then 'methodtype' when 14 then 'methodhandle'
            else case when p_size % 2 = 1 and class_def_idx % 2 = 0 then 'bool' else 'null' end end as tag
from fx_classes k join (select package_id, entry_index, class_def_idx as c, type from fx_fields where name = 'f0') f on f.package_id = k.package_id and f.entry_index = k.entry_index and f.c = k.class_def_idx
where p_size % 3 <> 0
""",
    "fx_nest_marks": """
select package_id, entry_index, logical_index, class_def_idx, descriptor, superclass,
       case p_size % 5 when 0 then 'enclosed' when 1 then 'anonymous' when 2 then 'members' end as nest
from fx_classes where p_size % 5 < 3
""",
    "fx_types": """
select package_id, entry_index, logical_index, dex_id,
       row_number() over (partition by package_id, entry_index order by descriptor) - 1 as type_index, descriptor
from (select distinct package_id, entry_index, logical_index, dex_id, descriptor from fx_classes) d
""",
    "fx_type_refs": """
select m.package_id, m.entry_index, m.logical_index, m.dex_id, m.method_index, 0 as pc, 'type' as ref_kind, t.type_index as target_index, cast(34 as bigint) as opcode
from fx_methods m join fx_types t on t.package_id = m.package_id and t.entry_index = m.entry_index and t.descriptor = m.owner where m.name = 'onCreate'
""",
    "fx_const_refs": """
select m.package_id, m.entry_index, m.logical_index, m.dex_id, m.method_index, 3 as pc, 'type' as ref_kind, t.type_index as target_index, cast(28 as bigint) as opcode
from fx_methods m join fx_types t on t.package_id = m.package_id and t.entry_index = m.entry_index and t.type_index = (m.method_index * 3) % 5 where m.name like 'run%'
""",
    "fx_annotations": """
select package_id, entry_index, logical_index, class_def_idx, descriptor,
       case p_size % 3 when 0 then 'build' when 1 then 'runtime' else 'system' end as visibility,
       case p_size % 4 when 0 then 'Ldalvik/annotation/Throws;' when 1 then 'Ldalvik/annotation/Signature;' else 'Lcom/lib/A' || cast(p_size % 5 as varchar(20)) || ';' end as type
from fx_classes
""",
    "fx_iface_methods": """
select distinct package_id, iface1 as owner, case p_size % 4 when 0 then 'call' when 1 then 'toString' else 'run' end as name,
       case when p_size % 4 = 1 then '()Ljava/lang/String;' else '(I)V' end as proto, cast(case when p_size % 5 = 0 then 1 else 1025 end as bigint) as access_flags
from fx_classes where iface1 is not null
""",
    "fx_iface_edges": """
select distinct package_id, iface1 as child, case when p_size % 7 = 0 then 'Ljava/lang/Object;' else 'Lcom/lib/I' || cast(cast(floor(p_size % 7 / 2) as bigint) as varchar(20)) || ';' end as parent
from fx_classes where iface1 is not null
""",
    "fx_shapes": """
select package_id, entry_index, logical_index, dex_id, class_def_idx + 100 as class_def_idx, 'Lcom/shape/S' || cast(src_key as varchar(20)) || ';' as descriptor,
       case p_size % 4 when 0 then 'Lcom/lib/Base;' when 1 then cast(null as varchar(20)) else 'Ljava/lang/Object;' end as superclass, iface1, iface2,
       cast(case when p_size % 3 = 0 then 16 else 4112 end as bigint) as access_flags, src_key, p_size
from fx_classes
""",
    "fx_shape_fields": """
select package_id, entry_index, logical_index, class_def_idx, 0 as field_index, cast(case when p_size % 5 = 0 then 2 when p_size % 7 = 0 then 24 else 18 end as bigint) as access_flags from fx_shapes where src_key % 3 <> 0
""",
    "fx_shape_methods": """
select s.package_id, s.entry_index, s.logical_index, s.class_def_idx, m.m as method_index, case m.m when 0 then '<init>' when 1 then 'call' when 2 then 'of' else 'run' end as name,
       cast(case when m.m = 2 then 9 else 1 end as bigint) as access_flags
from fx_shapes s join (values (0),(1),(2),(3)) as m(m) on m.m < 3 or s.src_key % 4 = 0
""",
    "fx_member_classes": """
select package_id, descriptor, 'Lcom/p' || cast(cast(floor(src_key/20) as bigint) as varchar(20)) || '/g' || cast((c + 1) % 3 as varchar(20)) || '/C' || cast(c + 1 as varchar(20)) || ';' as child from fx_classes where p_size % 3 = 1
""",
    "fx_wordlist": """
select case when item_id % 4 = 1 then '  ' || upper(word) || '  # listed ' || word when item_id % 4 = 2 then '# ' || word when item_id % 4 = 3 then '   ' else word end as line
from (select cast(item_id as bigint) as item_id, split_part(text, ' ', 3) as word from benchmark) w where length(word) >= 6
union all select distinct upper(source) from documents where source like '%7'
""",
    "fx_program_methods": """
select src_key, package_id, entry_index, logical_index, dex_id, class_def_idx, method_index, owner,
       case when method_index % 4 = 3 and src_key % 6 = 0 then '<clinit>' else name end as name,
       case when method_index % 4 = 3 and src_key % 6 = 0 then '()V' else proto end as proto,
       access_flags + case when name = 'onCreate' and src_key % 3 = 0 then 4096 else 0 end as access_flags
from fx_methods
""",
    "fx_images": """
select distinct package_id, entry_index, logical_index, dex_id from fx_classes
""",
    "fx_method_ids": """
select package_id, entry_index, logical_index, dex_id, method_index, owner, name, proto from fx_program_methods
union all
select m.package_id, i.entry_index, i.logical_index, i.dex_id, 20 + m.method_index as method_index, m.owner, m.name, m.proto
from fx_program_methods m join fx_images i on i.package_id = m.package_id and i.entry_index = (m.entry_index + 1) % 4
union all
select i.package_id, i.entry_index, i.logical_index, i.dex_id, 40 + t.k as method_index, t.owner, t.name, '()V' as proto
from fx_images i cross join (values (0, 'Ljava/lang/System;', 'exit'), (1, 'Lcom/gone/X;', 'run')) as t(k, owner, name)
""",
    "fx_calls": """
select package_id, entry_index, logical_index, dex_id, method_index, pc, ref_kind, target_index, opcode from fx_code_refs where ref_kind = 'method'
union all
select k.package_id, k.entry_index, k.logical_index, k.dex_id, k.class_def_idx*4 + l.l_suppkey % 4 as method_index, l.l_linenumber*3 as pc, 'method' as ref_kind,
       20 + l.l_orderkey % 22 as target_index, cast(110 + l.l_suppkey % 5 as bigint) as opcode
from lineitem l join fx_classes k on k.src_key = l.l_partkey where l.l_linenumber < 4
""",
    "fx_exception_edges": """
select distinct package_id, 'Lapp/E;' as child, case when cast(substr(package_id, 4) as bigint) % 2 = 0 then 'Ljava/lang/Exception;' else 'Ljava/lang/RuntimeException;' end as parent from fx_classes
union all
select distinct package_id, t.child, t.parent from fx_classes cross join (values ('Lapp/Sub;', 'Lapp/E;'), ('Lapp/Lost;', 'Lgone/Base;')) as t(child, parent)
""",
    "fx_app_throws": """
select package_id, entry_index, logical_index, method_index, exception from fx_throws
union all
select package_id, entry_index, logical_index, method_index, case src_key % 7 when 0 then 'Lapp/Sub;' when 1 then 'Lapp/E;' else 'Lapp/Lost;' end as exception
from fx_program_methods where name like 'run%' and src_key % 7 < 3
""",
    "fx_app_handlers": """
select package_id, entry_index, logical_index, method_index, start_addr, end_addr, handler_order, catch_type, handler_addr from fx_try_handlers
union all
select package_id, entry_index, logical_index, method_index, 3 as start_addr, 9 as end_addr, 1 as handler_order, 'Lapp/E;' as catch_type, 30 as handler_addr from fx_program_methods where src_key % 5 < 2
""",
    "fx_object_methods": """
select * from (values ('equals', '(Ljava/lang/Object;)Z'), ('hashCode', '()I'), ('toString', '()Ljava/lang/String;')) as t(name, proto)
""",
}


_registered: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog view as a DataFrame. Tables and views are registered in the session when another folder is asked for."""
    app = spark.sparkContext.applicationId
    if _registered.get(app) != sf_dir or not spark.catalog.tableExists(name):
        for table in TABLES:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        for own, text in VIEWS.items():
            spark.sql(text).createOrReplaceTempView(own)
        _registered[app] = sf_dir
    return spark.table(name)


def ctes() -> str:
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in VIEWS.items())
