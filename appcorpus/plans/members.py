"""Registered queries about inheritance, exceptions, dependencies and members, each beside its SQL."""

from pyspark.sql import functions as F

from appcorpus.functions import names as n
from appcorpus.operators import calls as c
from appcorpus.operators import hierarchy as h
from appcorpus.operators import members as m
from appcorpus.operators import references as r
from appcorpus.plans.queries import _UP, KIND, LINKED, TYPES, _findrefs_sql, exception_types, linked_calls, query

_PARAMS = r"regexp_extract({}, '^\((.*)\)', 1)"
_RETURN = r"regexp_extract({}, '\)(.*)$', 1)"
_FLAGS = ", cf as (select package_id, descriptor, bit_or(access_flags) as flags from fx_classes group by 1, 2)"
_PACKAGE = "regexp_extract({}, '^L(.*)/[^/]*;$', 1)"


def _closure(v):
    return h.ancestors(h.parent_edges(v("fx_classes")))


@query(_findrefs_sql("field", "select package_id, entry_index, field_index as target_index, owner || '->' || name || ':' || type as text from fx_fields where contains(name, 'f1')"))
def j01_findrefs_field(v):
    targets = v("fx_fields").where(r.member_condition("f1")).select(*r.KEY, F.col("field_index").alias("target_index"), F.concat("owner", F.lit("->"), "name", F.lit(":"), "type").alias("text"))
    return r.find_references(v("fx_code_refs"), "field", targets, v("fx_methods"))


@query(_findrefs_sql("type", "select package_id, entry_index, type_index as target_index, descriptor as text from fx_types where contains(descriptor, '/g1/')").replace("fx_code_refs", "fx_type_refs"))
def j01_findrefs_type(v):
    targets = v("fx_types").where(r.contains_literal(F.col("descriptor"), "/g1/")).select(*r.KEY, F.col("type_index").alias("target_index"), F.col("descriptor").alias("text"))
    return r.find_references(v("fx_type_refs"), "type", targets, v("fx_methods"))


@query("select distinct f.package_id, f.dex_id, m.owner || '->' || m.name as caller from fx_code_refs f join fx_methods m using (package_id, entry_index, method_index) where f.ref_kind = 'method'")
def j02_caller_lookup(v):
    named = v("fx_methods").select(*r.KEY, "method_index", F.concat("owner", F.lit("->"), "name").alias("caller"))
    return v("fx_code_refs").where("ref_kind = 'method'").select(*r.KEY, "dex_id", "method_index").distinct().join(named, [*r.KEY, "method_index"]).select("package_id", "dex_id", "caller").distinct()


_SYSTEM = ", ".join(f"'{t}'" for t in m.SYSTEM_ANNOTATIONS)


@query(f"select package_id, descriptor, type, visibility from fx_annotations where visibility in ('build', 'runtime') and type not in ({_SYSTEM})")
def f08_source_annotations(v):
    return v("fx_annotations").where(m.source_annotation(F.col("visibility"), F.col("type"))).select("package_id", "descriptor", "type", "visibility")


def _visible_sql(flags: str, declaring: str, owner: str, owner_flags: str) -> str:
    return f"""case when ({flags} & 2) <> 0 then false when ({owner_flags} & 512) <> 0 and {declaring} = 'Ljava/lang/Object;' then ({flags} & 1) <> 0
when ({flags} & 5) <> 0 then true else {_PACKAGE.format(declaring)} = {_PACKAGE.format(owner)} end"""


@query(_UP + _FLAGS + f"""select distinct up.package_id, up.descriptor, x.owner, x.name, x.proto, {_visible_sql('x.access_flags', 'x.owner', 'up.descriptor', 'cf.flags')} as visible
from up join fx_methods x on x.package_id = up.package_id and x.owner = up.ancestor join cf on cf.package_id = up.package_id and cf.descriptor = up.descriptor where up.distance = 1""")
def f10_visible_from(v):
    flags = m.class_flags(v("fx_classes"))
    above = _closure(v).where("distance = 1").withColumnRenamed("ancestor", "owner").join(flags, ["package_id", "descriptor"]).join(v("fx_methods"), ["package_id", "owner"])
    visible = m.visible_from(F.col("access_flags"), F.col("owner"), F.col("descriptor"), F.col("flags"))
    return above.select("package_id", "descriptor", "owner", "name", "proto", visible.alias("visible")).distinct()


@query("""select package_id, entry_index, class_def_idx, descriptor from fx_shapes c where (access_flags & 4096) <> 0 and (access_flags & 16) <> 0 and iface1 is not null and (superclass is null or superclass = 'Ljava/lang/Object;')
and not exists (select 1 from fx_shape_fields f where f.package_id = c.package_id and f.entry_index = c.entry_index and f.class_def_idx = c.class_def_idx and ((f.access_flags & 8) <> 0 or (f.access_flags & 16) = 0))
and (select count(*) from fx_shape_methods x where x.package_id = c.package_id and x.entry_index = c.entry_index and x.class_def_idx = c.class_def_idx and x.name not in ('<init>', '<clinit>') and (x.access_flags & 8) = 0) = 1""")
def f11_function_object(v):
    return m.function_objects(v("fx_shapes"), v("fx_shape_fields"), v("fx_shape_methods")).select("package_id", "entry_index", "class_def_idx", "descriptor")


@query("""select distinct n.package_id, n.child, case when inner_name is null and enclosing_class is not null then 'anonymous' when enclosing_method is not null then 'local' when inner_name is not null then 'inner' else 'top-level' end as shape,
""" + KIND.format("c.access_flags") + """ as kind from fx_nesting n join fx_classes c on c.package_id = n.package_id and c.descriptor = n.descriptor""")
def f12_class_shape(v):
    rows = v("fx_nesting").join(v("fx_classes").select("package_id", "descriptor", "access_flags"), ["package_id", "descriptor"])
    parent = F.coalesce("enclosing_class", "inner_name")
    shape = m.class_shape(F.col("enclosing_class").isNotNull() | F.col("inner_name").isNotNull(), F.col("inner_name"), F.col("enclosing_method"), parent)
    return rows.select("package_id", "child", shape.alias("shape"), m.class_kind(F.col("access_flags")).alias("kind")).distinct()


@query(_UP + _FLAGS + """, p as (select distinct a.package_id, a.descriptor as l, b.descriptor as r from fx_classes a join fx_classes b on b.package_id = a.package_id and b.c = (a.c * 7 + 3) % 15
union select package_id, descriptor, superclass from fx_classes)
select p.package_id, p.l, p.r, p.l = p.r or p.r = 'Ljava/lang/Object;' or u.ancestor is not null or d.ancestor is not null or coalesce(case when (x.flags & 512) <> 0 and (y.flags & 512) <> 0 then true
when (x.flags & 512) <> 0 then (y.flags & 16) = 0 when (y.flags & 512) <> 0 then (x.flags & 16) = 0 end, false) as convertible
from p left join up u on u.package_id = p.package_id and u.descriptor = p.l and u.ancestor = p.r left join up d on d.package_id = p.package_id and d.descriptor = p.r and d.ancestor = p.l
left join cf x on x.package_id = p.package_id and x.descriptor = p.l left join cf y on y.package_id = p.package_id and y.descriptor = p.r""")
def j08_cast_convertible(v):
    one = v("fx_classes").select("package_id", F.col("descriptor").alias("l"), ((F.col("c") * 7 + 3) % 15).alias("c"))
    two = v("fx_classes").select("package_id", F.col("descriptor").alias("r"), "c")
    up = v("fx_classes").select("package_id", F.col("descriptor").alias("l"), F.col("superclass").alias("r"))
    return m.cast_convertible(one.join(two, ["package_id", "c"]).drop("c").unionByName(up).distinct(), _closure(v), v("fx_classes"))


_BASES = _UP + _FLAGS + f""", own as (select distinct package_id, owner, name, proto, {_PARAMS.format('proto')} as params, {_RETURN.format('proto')} as ret, access_flags as fl from fx_methods where name not in ('<init>', '<clinit>') and (access_flags & 74) = 0),
above as (select distinct package_id, owner, name, proto, {_PARAMS.format('proto')} as params, {_RETURN.format('proto')} as ret, access_flags as fl from fx_methods where name not in ('<init>', '<clinit>') and (access_flags & 10) = 0),
cand as (select distinct o.package_id, o.owner, o.name, o.proto, up.ancestor, up.distance, a.proto as base_proto, a.fl from own o join up on up.package_id = o.package_id and up.descriptor = o.owner and up.distance > 0
join above a on a.package_id = o.package_id and a.owner = up.ancestor and a.name = o.name and a.params = o.params
where (a.ret = o.ret or (a.ret = 'Ljava/lang/Object;' and o.ret[1] in ('L', '[')) or exists (select 1 from up t where t.package_id = o.package_id and t.descriptor = o.ret and t.ancestor = a.ret))),
best as (select * from (select c.*, row_number() over (partition by c.package_id, c.owner, c.name, c.proto, c.ancestor order by c.base_proto <> c.proto, (c.fl & 64) <> 0, c.base_proto) as k
from cand c join cf on cf.package_id = c.package_id and cf.descriptor = c.owner where {_visible_sql('c.fl', 'c.ancestor', 'c.owner', 'cf.flags')}) where k = 1),
judged as (select b.*, not exists (select 1 from cand d join up on up.package_id = b.package_id and up.descriptor = b.ancestor and up.ancestor = d.ancestor and up.distance = 1 join cf on cf.package_id = b.package_id and cf.descriptor = b.ancestor
where d.package_id = b.package_id and d.owner = b.owner and d.name = b.name and d.proto = b.proto and {_visible_sql('d.fl', 'd.ancestor', 'b.ancestor', 'cf.flags')}) as is_base from best b),
bases as (select package_id, owner, name, proto, ancestor as base, base_proto, is_base from (select *, bool_or(is_base) over (partition by package_id, owner, name, proto) as based,
row_number() over (partition by package_id, owner, name, proto order by distance desc, ancestor desc) as last from judged) where is_base or (not based and last = 1))"""


@query(_BASES + " select * from bases")
def j09_overrides(v):
    return m.overrides(_closure(v), v("fx_methods"), v("fx_classes"))


_THROWS = f", ft as (select distinct t.package_id, x.owner, x.name, x.proto, t.exception from fx_throws t join fx_methods x using (package_id, entry_index, method_index))"


@query(_BASES + _THROWS + f""" select b.package_id, b.owner, b.name, b.proto, ft.exception from (select *, count(*) over (partition by package_id, owner, name, proto) as bases from bases where is_base) b
join ft on ft.package_id = b.package_id and ft.owner = b.base and ft.name = b.name and ft.proto = b.base_proto group by b.package_id, b.owner, b.name, b.proto, ft.exception, b.bases having count(distinct b.base) = b.bases""")
def a08_inherited_throws(v):
    declared = v("fx_throws").join(v("fx_methods"), [*r.KEY, "method_index"]).select("package_id", "owner", "name", "proto", "exception")
    return m.inherited_throws(m.overrides(_closure(v), v("fx_methods"), v("fx_classes")), declared)


#: What methods declare, or inherit if they declare nothing and are synthetic or of a function object.
_PROGRAM_BASES = _BASES.replace("fx_methods", "fx_program_methods")
_CONTRACTS = """, thr as (select distinct t.package_id, x.owner, x.name, x.proto, t.exception from fx_app_throws t join fx_program_methods x using (package_id, entry_index, method_index)),
inh as (select b.package_id, b.owner, b.name, b.proto, thr.exception from (select *, count(*) over (partition by package_id, owner, name, proto) as bases from bases where is_base) b
join thr on thr.package_id = b.package_id and thr.owner = b.base and thr.name = b.name and thr.proto = b.base_proto group by b.package_id, b.owner, b.name, b.proto, thr.exception, b.bases having count(distinct b.base) = b.bases),
said as (select distinct package_id, entry_index, method_index, exception from fx_app_throws),
declared as (select * from said union select x.package_id, x.entry_index, x.method_index, inh.exception from fx_program_methods x join inh using (package_id, owner, name, proto)
where (x.access_flags & 4096) <> 0 and (x.package_id, x.entry_index, x.method_index) not in (select (package_id, entry_index, method_index) from said))"""


def _contracts(v):
    methods, throws = v("fx_program_methods"), v("fx_app_throws")
    named = throws.join(methods, [*r.KEY, "method_index"]).select("package_id", "owner", "name", "proto", "exception")
    inherited = m.inherited_throws(m.overrides(_closure(v), methods, v("fx_classes")), named)
    carriers = m.function_objects(v("fx_classes"), v("fx_fields"), methods)
    return c.contracts(methods, throws, inherited, carriers)


@query(_PROGRAM_BASES + _CONTRACTS + " select package_id, entry_index, method_index, exception from declared")
def j15_contracts(v):
    """Exceptions by declaration or, for synthetic methods, by what all their bases declare."""
    return _contracts(v).drop("logical_index")


@query(_PROGRAM_BASES + _CONTRACTS + TYPES + LINKED + """,
shut as (select package_id, entry_index, method_index from declared union select package_id, entry_index, method_index from fx_program_methods where name = '<clinit>'),
seed as (select * from declared where (package_id, exception) in (select (package_id, exception) from checked)),
free as (select distinct l.package_id, l.entry_index, l.method_index, l.body_entry, l.body_method, x.exception from (select distinct package_id, entry_index, method_index, pc, body_entry, body_method from linked where body_method is not null) l
join (select distinct package_id, exception from seed) x on x.package_id = l.package_id where (l.package_id, l.entry_index, l.method_index) not in (select (package_id, entry_index, method_index) from shut)
and not exists (select 1 from fx_app_handlers t where t.package_id = l.package_id and t.entry_index = l.entry_index and t.method_index = l.method_index and t.start_addr <= l.pc and l.pc < t.end_addr
and (t.catch_type is null or (l.package_id, x.exception, t.catch_type) in (select (package_id, exception, above) from types)))),
esc as (select * from (with recursive w(package_id, entry_index, method_index, exception) as (select * from seed union select f.package_id, f.entry_index, f.method_index, w.exception from w join free f
on f.package_id = w.package_id and f.body_entry = w.entry_index and f.body_method = w.method_index and f.exception = w.exception) select * from w))
select esc.*, (package_id, entry_index, method_index, exception) not in (select (package_id, entry_index, method_index, exception) from seed) as inferred from esc""")
def j15_escaping_exceptions(v):
    """Over the whole package: inherited contracts are seeds, declared contracts and class initialisers take nothing from calls."""
    return c.escaping_exceptions(v("fx_program_methods"), _contracts(v), linked_calls(v), v("fx_app_handlers"), exception_types(v)).drop("logical_index")


@query("""select f.package_id, f.entry_index, f.class_def_idx, f.name, s.value from (select *, row_number() over (partition by package_id, entry_index, class_def_idx order by field_index) - 1 as k from fx_fields where (access_flags & 8) <> 0) f
left join fx_static_values s on s.package_id = f.package_id and s.entry_index = f.entry_index and s.class_def_idx = f.class_def_idx and s.ordinal = f.k""")
def j16_field_initial_value(v):
    return m.static_values(v("fx_fields"), v("fx_static_values")).select("package_id", "entry_index", "class_def_idx", "name", "value")


_USES = r""", used as (select distinct package_id, descriptor, regexp_replace(type, '^\[+', '') as type from (select package_id, descriptor, unnest([superclass, iface1, iface2]) as type from fx_classes
union all select package_id, owner, type from fx_fields union all select package_id, owner, unnest(regexp_extract_all(proto, '\[*(?:[ZBSCIJFDV]|L[^;]+;)')) from fx_methods
union all select package_id, descriptor, type from fx_annotations where visibility in ('build', 'runtime') and type not in (""" + _SYSTEM + r""") union all select t.package_id, x.owner, t.exception from fx_throws t join fx_methods x using (package_id, entry_index, method_index)
union all select x.package_id, x.owner, t.descriptor from fx_const_refs f join fx_types t on t.package_id = f.package_id and t.entry_index = f.entry_index and t.type_index = f.target_index
join fx_methods x on x.package_id = f.package_id and x.entry_index = f.entry_index and x.method_index = f.method_index where f.opcode = 28
union all select package_id, descriptor, unnest(['Lgen/Bound;', 'Lgen/L' || c || ';', 'Lgen/A;', 'Lgen/X;']) from fx_classes where superclass is not null) where regexp_replace(type, '^\[+', '') like 'L%')"""


def _dependencies(v):
    """With annotations, exceptions, class constants and a generic signature for each class below another."""
    marks = v("fx_annotations").where(m.source_annotation(F.col("visibility"), F.col("type"))).select("package_id", "descriptor", "type")
    thrown = v("fx_throws").join(v("fx_methods"), [*r.KEY, "method_index"]).select("package_id", F.col("owner").alias("descriptor"), F.col("exception").alias("type"))
    signature = F.expr("'<T:Lgen/Bound;L::Lgen/L' || c || ';>' || substring(superclass, 1, length(superclass) - 1) || '<TT;[Lgen/A;>.List<-Lgen/X;*>;'")
    return m.dependencies(v("fx_classes"), v("fx_fields"), v("fx_methods"), marks.unionByName(thrown).unionByName(m.constant_types(v("fx_const_refs"), v("fx_types"), v("fx_methods"))), v("fx_classes").select("package_id", "descriptor", signature.alias("signature")))


@query(_USES + " select * from used")
def a05_class_dependencies(v):
    return _dependencies(v)


@query(_USES + f""" select package_id, descriptor, type, case when count(*) over (partition by package_id, descriptor, regexp_extract(type, '([^/]*);$', 1)) > 1 then 'qualified'
when {_PACKAGE.format('type')} in ('java/lang', {_PACKAGE.format('descriptor')}) then 'none' else 'import' end as plan from used""")
def a06_import_plan(v):
    return m.import_plan(_dependencies(v))


@query(f""", up as (select * from (with recursive w(package_id, descriptor, ancestor, distance) as (select distinct package_id, child, child, 0 from fx_iface_edges
union select w.package_id, w.descriptor, e.parent, w.distance + 1 from w join fx_iface_edges e on e.package_id = w.package_id and e.child = w.ancestor where w.distance < 12) select package_id, descriptor, ancestor, min(distance) as distance from w group by package_id, descriptor, ancestor)),
seen as (select u.package_id, u.descriptor, x.name, {_PARAMS.format('x.proto')} as params, u.distance, (x.access_flags & 1024) <> 0 as abstract from up u join fx_iface_methods x on x.package_id = u.package_id and x.owner = u.ancestor),
near as (select package_id, descriptor, name, params, bool_and(abstract) as abstract from seen s where distance = (select min(distance) from seen t where t.package_id = s.package_id and t.descriptor = s.descriptor and t.name = s.name and t.params = s.params) group by 1, 2, 3, 4)
select package_id, descriptor, min(name) as name, min(params) as params from near where abstract and (name, params) not in (select (name, {_PARAMS.format('proto')}) from fx_object_methods) group by 1, 2 having count(*) = 1""")
def a07_single_abstract_method(v):
    return m.single_abstract_methods(h.ancestors(v("fx_iface_edges")), v("fx_iface_methods"), v("fx_object_methods"))


@query("""select package_id, entry_index, class_def_idx, row_number() over (partition by package_id, entry_index, class_def_idx order by kind, late, i) - 1 as row, line from (
select package_id, entry_index, class_def_idx, 0 as kind, field_index as i, (access_flags & 8) <> 0 as late, '# members fields: field_ids=' || field_index || ' slot=' || (row_number() over (partition by package_id, entry_index, class_def_idx order by (access_flags & 8) <> 0, field_index) - 1)
|| ' static=' || ((access_flags & 8) <> 0) || ' flags=0x' || lower(to_hex(access_flags)) || ' type=' || type || ' name=' || name as line from fx_fields
union all select package_id, entry_index, class_def_idx, 1, method_index, not (name in ('<init>', '<clinit>') or (access_flags & 10) <> 0), '# members methods: method_ids=' || method_index || ' proto=' || proto || ' flags=0x' || lower(to_hex(access_flags)) || ' name=' || name from fx_methods)""")
def w02_member_table(v):
    return m.member_table(v("fx_fields"), v("fx_methods")).select("package_id", "entry_index", "class_def_idx", F.col("row").cast("long").alias("row"), "line")


@query(_findrefs_sql("method", "select package_id, entry_index, method_index as target_index, owner || '->' || name || proto as text from fx_methods where contains(name, 'run')") + " order by m.dex_id, member, x.matched")
def o01_reference_order(v):
    targets = v("fx_methods").where(r.member_condition("run")).select(*r.KEY, F.col("method_index").alias("target_index"), F.concat("owner", F.lit("->"), "name", "proto").alias("text"))
    return r.find_references(v("fx_code_refs"), "method", targets, v("fx_methods")).orderBy("dex_id", "member", "matched")


@query("select package_id, entry_index, logical_index, class_def_idx, descriptor from fx_classes order by 1, 2, 3, 4")
def o04_physical_order(v):
    return v("fx_classes").select("package_id", "entry_index", "logical_index", "class_def_idx", "descriptor").orderBy("package_id", "entry_index", "logical_index", "class_def_idx")


@query("""select dex_id || ' | ' || descriptor || ' extends ' || superclass as line from fx_classes where superclass is not null union all
select dex_id || ' | ' || descriptor || ' implements ' || i from (select distinct src_key, dex_id, descriptor, unnest([iface1, iface2]) as i from fx_classes) where i is not null order by line""")
def o05_relation_order(v):
    own = v("fx_classes")
    up = own.where("superclass is not null").select(F.concat("dex_id", F.lit(" | "), "descriptor", F.lit(" extends "), "superclass").alias("line"))
    interface = F.explode(F.array_distinct(F.array_compact(F.array("iface1", "iface2"))))
    return up.union(own.select("dex_id", "descriptor", interface.alias("i")).select(F.concat("dex_id", F.lit(" | "), "descriptor", F.lit(" implements "), "i"))).orderBy("line")


@query(TYPES + LINKED + """,
thrown as (select distinct l.package_id, l.entry_index, l.method_index, l.pc, x.exception from linked l join fx_app_throws x on x.package_id = l.package_id and x.entry_index = l.body_entry and x.method_index = l.body_method)
select t.package_id, t.entry_index, t.method_index, t.pc, t.exception, h.catch_type, count(*) as n from thrown t join fx_app_handlers h on h.package_id = t.package_id and h.entry_index = t.entry_index and h.method_index = t.method_index
and h.start_addr <= t.pc and t.pc < h.end_addr where h.catch_type is null or (t.package_id, t.exception, h.catch_type) in (select (package_id, exception, above) from types) group by 1, 2, 3, 4, 5, 6""")
def j14_handlers_for_exception(v):
    """Of what each called method declares, in whatever image, the handlers around the call that take it."""
    declared = v("fx_app_throws").select("package_id", c.body().alias("body"), "exception")
    thrown = linked_calls(v).join(declared, ["package_id", "body"]).select(*r.KEY, "method_index", "pc", "exception").distinct()
    found = c.covering_handlers(thrown, v("fx_app_handlers"), exception_types(v))
    return found.groupBy("package_id", "entry_index", "method_index", "pc", "exception", "catch_type").agg(F.count("*").alias("n"))


@query("select distinct package_id, dex_id, ref_kind, target_index from (select * from fx_code_refs union all select * from fx_type_refs)")
def u01_union_dexes(v):
    return v("fx_code_refs").unionByName(v("fx_type_refs")).select("package_id", "dex_id", "ref_kind", "target_index").distinct()


@query(r"""select package_id, field_index, entry_index, owner || '->' || name || ':' || type as reference, regexp_replace(regexp_replace(regexp_replace(type, '^(\[*)I$', '\1int'), '^(\[*)L(?:.*/)?([^/;]*);$', '\1\2'), '^(\[+)(.*)$', '\2' || repeat('[]', length(regexp_extract(type, '^\[*')))) as java_type from fx_fields""")
def x14_java_type(v):
    whole = F.concat("owner", F.lit("->"), "name", F.lit(":"), "type")
    part = n.field_reference(whole)
    return v("fx_fields").select("package_id", "field_index", "entry_index", F.concat(part["owner"], F.lit("->"), part["name"], F.lit(":"), part["type"]).alias("reference"), n.java_type(part["type"]).alias("java_type"))
