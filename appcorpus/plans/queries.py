"""The registered queries over the catalog, each beside its SQL. `{fx}` stands for the catalog views."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcorpus.functions import names as n
from appcorpus.operators import audit
from appcorpus.operators import calls as c
from appcorpus.operators import hierarchy as h
from appcorpus.operators import members as m
from appcorpus.operators import references as r
from appcorpus.operators.pages import page
from appcorpus.testing.fixtures import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The same queries as functions of a table reader: the name of a catalog table to its DataFrame.
PLANS: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}


def query(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = f"{ctes()}\n{sql}"
        return f

    return put


@query("select package_id, count(*) as entry_count, count(*) filter (name like '%.dex' and not contains(name, '/')) as dex_entry_count, sum(uncompressed_size)::bigint as size from fx_entries group by package_id")
def s02_package_summary(v):
    root = F.col("name").endswith(".dex") & ~F.col("name").contains("/")
    return v("fx_entries").groupBy("package_id").agg(F.count("*").alias("entry_count"), F.count_if(root).alias("dex_entry_count"), F.sum("uncompressed_size").alias("size"))


@query("select package_id, entry_index, name, case compression when 0 then 'stored' when 8 then 'deflated' else 'other' end as label, uncompressed_size from fx_entries")
def s03_archive_entries(v):
    return v("fx_entries").select("package_id", "entry_index", "name", n.compression_label(F.col("compression")).alias("label"), "uncompressed_size")


@query("""select package_id, name, entry_index from (select *, row_number() over (partition by package_id, name order by entry_index) as k from (
select *, max(case when regexp_matches(name, '^classes.*[.]dex$') and not contains(name, '/') then 1 else 0 end) over (partition by package_id) as named from fx_entries) e
where not contains(name, '/') and name like '%.dex' and (named = 0 or name like 'classes%')) where k = 1""")
def s04_root_dex(v):
    root = v("fx_entries").where(F.col("name").endswith(".dex") & ~F.col("name").contains("/"))
    named = root.withColumn("named", F.max(F.col("name").startswith("classes")).over(Window.partitionBy("package_id"))).where(~F.col("named") | F.col("name").startswith("classes"))
    return h.first_by(named, ["package_id", "name"], "entry_index").select("package_id", "name", "entry_index")


@query("select package_id, max(entry_index) as entry_index, arg_max(uncompressed_size, entry_index) as uncompressed_size from fx_entries where name = 'AndroidManifest.xml' group by package_id")
def s06_manifest_entry(v):
    last = v("fx_entries").where(F.col("name") == "AndroidManifest.xml").groupBy("package_id").agg(F.max_by(F.struct("entry_index", "uncompressed_size"), "entry_index").alias("e"))
    return last.select("package_id", "e.*")


@query("select package_id, dex_id, replace(descriptor[2:-2], '/', '.') as name from fx_classes where contains(lower(replace(descriptor[2:-2], '/', '.')), lower('G1.C'))")
def f01_class_filter(v):
    return v("fx_classes").select("package_id", "dex_id", n.dotted_name(F.col("descriptor")).alias("name")).where(r.contains_folded(F.col("name"), "G1.C"))


@query("select doc_id, length(text) as n from documents where contains(lower(text), lower('ÉRE'))")
def f02_string_filter(v):
    return v("documents").where(r.contains_folded(F.col("text"), "ÉRE")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("select package_id, entry_index, string_index, value from fx_strings where contains(value, 'Authorization')")
def f03_target_string(v):
    return v("fx_strings").where(r.contains_literal(F.col("value"), "Authorization")).select("package_id", "entry_index", "string_index", "value")


@query("select distinct package_id, descriptor from fx_classes where contains(descriptor, '/g2/')")
def f04_target_type(v):
    return v("fx_classes").where(r.contains_literal(F.col("descriptor"), "/g2/")).select("package_id", "descriptor").distinct()


@query("select package_id, entry_index, method_index, owner, name from fx_methods where contains(name, 'run') and contains(owner, 'com/p1')")
def f05_target_member(v):
    return v("fx_methods").where(r.member_condition("run", "com.p1", fuzzy=True)).select("package_id", "entry_index", "method_index", "owner", "name")


@query("select package_id, entry_index, method_index, name from fx_methods where owner = 'Lcom/p3/g1/C4;'")
def f06_class_exact(v):
    return v("fx_methods").where(r.member_condition(owner="com.p3.g1.C4")).select("package_id", "entry_index", "method_index", "name")


@query("select package_id, descriptor, entry_index from fx_classes where contains(descriptor, 'p2/g0')")
def f07_class_fuzzy(v):
    return v("fx_classes").where(F.col("descriptor").contains(n.fuzzy_pattern(F.lit("p2.g0")))).select("package_id", "descriptor", "entry_index")


@query("select package_id, entry_index, method_index, owner, name from fx_methods where name not in ('<init>', '<clinit>') and (access_flags & (8 | 2 | 64)) = 0")
def f09_overridable(v):
    return v("fx_methods").where(m.overridable(F.col("name"), F.col("access_flags"))).select("package_id", "entry_index", "method_index", "owner", "name")


#: Of each package, every exception type that is asked for with all that is above it; the platform's types go on where its own end.
TYPES = """, plat as (select * from (with recursive w(d, a) as (select descriptor, superclass from fx_platform_edges union select w.d, e.superclass from w join fx_platform_edges e on e.descriptor = w.a) select d, a from w)),
types as (select * from (with recursive w(package_id, exception, above) as (select distinct package_id, exception, exception from fx_app_throws union select w.package_id, w.exception, e.parent from w
join fx_exception_edges e on e.package_id = w.package_id and e.child = w.above) select package_id, exception, above from w
union select w.package_id, w.exception, plat.a from w join plat on plat.d = w.above)),
checked as (select package_id, exception from types group by 1, 2 having bool_or(above = 'Ljava/lang/Throwable;') and not bool_or(above in ('Ljava/lang/RuntimeException;', 'Ljava/lang/Error;')))"""


def exception_types(v):
    return c.exception_types(v("fx_app_throws"), v("fx_exception_edges"), v("fx_platform_edges"))


@query(TYPES + " select package_id, entry_index, method_index, exception from fx_app_throws where (package_id, exception) in (select (package_id, exception) from checked)")
def f13_checked_exception(v):
    """Each package by its own classes: one name is checked in some and unchecked in others."""
    return c.checked(v("fx_app_throws"), exception_types(v)).select("package_id", "entry_index", "method_index", "exception")


def _findrefs_sql(kind: str, targets: str) -> str:
    return f"""select m.package_id, m.dex_id, m.method_index, m.owner || '->' || m.name as member, x.matched from (
select package_id, entry_index, method_index, string_agg(text, '; ' order by target_index) as matched from (
select distinct f.package_id, f.entry_index, f.method_index, f.target_index, t.text from fx_code_refs f join ({targets}) t
on f.package_id = t.package_id and f.entry_index = t.entry_index and f.target_index = t.target_index where f.ref_kind = '{kind}') d group by all) x
join fx_methods m on m.package_id = x.package_id and m.entry_index = x.entry_index and m.method_index = x.method_index"""


@query(_findrefs_sql("string", "select package_id, entry_index, string_index as target_index, value as text from fx_strings where contains(value, 'Authorization')"))
def j01_findrefs_string(v):
    targets = v("fx_strings").where(r.contains_literal(F.col("value"), "Authorization")).select(*r.KEY, F.col("string_index").alias("target_index"), F.col("value").alias("text"))
    return r.find_references(v("fx_code_refs"), "string", targets, v("fx_methods"))


@query(_findrefs_sql("method", "select package_id, entry_index, method_index as target_index, owner || '->' || name || proto as text from fx_methods where contains(name, 'onCreate')"))
def j01_findrefs_method(v):
    own = v("fx_methods").where(r.member_condition("onCreate"))
    targets = own.select(*r.KEY, F.col("method_index").alias("target_index"), F.concat("owner", F.lit("->"), "name", "proto").alias("text"))
    return r.find_references(v("fx_code_refs"), "method", targets, v("fx_methods"))


@query("select package_id, descriptor, dex_id from fx_classes where superclass = 'Lcom/p1/g0/C0;'")
def j03_extends(v):
    return v("fx_classes").where(F.col("superclass") == n.class_descriptor(F.lit("com.p1.g0.C0"))).select("package_id", "descriptor", "dex_id")


@query("select package_id, descriptor, dex_id from fx_classes where iface1 = 'Lcom/lib/I2;' or iface2 = 'Lcom/lib/I2;'")
def j04_implements(v):
    interfaces = F.array_compact(F.array("iface1", "iface2"))
    return v("fx_classes").where(F.array_contains(interfaces, "Lcom/lib/I2;")).select("package_id", "descriptor", "dex_id")


_WITH_OBJECT = """up as (select * from known union all select package_id, descriptor, 'Ljava/lang/Object;', 4611686018427387903 from known where distance = 0
and (package_id, descriptor) not in (select (package_id, descriptor) from known where ancestor = 'Ljava/lang/Object;'))"""
_UP = """, e as (select distinct package_id, descriptor as child, parent from (select package_id, descriptor, unnest([superclass, iface1, iface2]) as parent from fx_classes) where parent is not null),
known as (select * from (with recursive w(package_id, descriptor, ancestor, distance) as (select distinct package_id, child, child, 0 from e
union select w.package_id, w.descriptor, e.parent, w.distance + 1 from w join e on e.package_id = w.package_id and e.child = w.ancestor where w.distance < 40)
select package_id, descriptor, ancestor, min(distance)::bigint as distance from w group by all)), """ + _WITH_OBJECT
_DEEP = """, e as (select package_id, descriptor as child, superclass as parent from fx_deep_edges),
known as (select * from (with recursive w(package_id, descriptor, ancestor, distance) as (select package_id, child, child, 0 from e
union select w.package_id, w.descriptor, e.parent, w.distance + 1 from w join e on e.package_id = w.package_id and e.child = w.ancestor where w.distance < 60)
select package_id, descriptor, ancestor, min(distance)::bigint as distance from w group by package_id, descriptor, ancestor)), """ + _WITH_OBJECT
_UP = _UP.replace("group by all", "group by package_id, descriptor, ancestor")


def _deep(v):
    return v("fx_deep_edges").select("package_id", F.col("descriptor").alias("child"), F.col("superclass").alias("parent"))


@query(_UP + " select package_id, descriptor, ancestor, distance from up")
def j05_ancestors(v):
    return h.ancestors(h.parent_edges(v("fx_classes")))


@query(_DEEP + """, bad as (select distinct descriptor from up where ancestor <> 'Ljava/lang/Object;' and ancestor not in (select child from e)),
p as (select package_id, descriptor, 'Ldeep/C' || cast(k as varchar) || ';' as expected from fx_deep_edges cross join (values (1), (2), (5)) t(k))
select p.descriptor, p.expected, case when up.ancestor is not null then 'yes' when bad.descriptor is not null then 'unknown' else 'no' end as verdict
from p left join up on up.descriptor = p.descriptor and up.ancestor = p.expected left join bad on bad.descriptor = p.descriptor""")
def j06_subtype_relation(v):
    edges = _deep(v)
    expected = F.explode(F.array(*(F.lit(f"Ldeep/C{k};") for k in (1, 2, 5)))).alias("expected")
    pairs = v("fx_deep_edges").select("package_id", "descriptor", expected)
    return h.subtype_relation(pairs, h.ancestors(edges), edges).select("descriptor", "expected", "verdict")


@query(_DEEP + """, p as (select a.child as l, b.child as r from (select child, cast(regexp_extract(child, '[0-9]+') as bigint) as k from e) a join (select child, cast(regexp_extract(child, '[0-9]+') as bigint) as k from e) b on b.k = a.k + 3),
c as (select p.l, p.r, x.ancestor, x.distance as dl, y.distance as dr from p join up x on x.descriptor = p.l join up y on y.descriptor = p.r and y.ancestor = x.ancestor),
d as (select distinct c.l, c.r, up.ancestor from c join up on up.descriptor = c.ancestor and up.distance > 0)
select l, r, arg_min(ancestor, (greatest(dl, dr), least(dl, dr), ancestor)) as lcs from c anti join d using (l, r, ancestor) group by l, r""")
def j07_least_common_supertype(v):
    edges = _deep(v)
    k = F.regexp_extract("child", "[0-9]+", 0).cast("long")
    left, right = edges.select("package_id", F.col("child").alias("l"), k.alias("k")), edges.select("package_id", F.col("child").alias("r"), (k - 3).alias("k"))
    return h.least_common_supertype(left.join(right, ["package_id", "k"]).drop("k"), h.ancestors(edges)).select("l", "r", "lcs")


@query(_UP + r""" select up.package_id, up.descriptor, m.name, len(regexp_extract_all(regexp_extract(m.proto, '^\((.*)\)', 1), '\[*(?:[ZBSCIJFD]|L[^;]+;)')) as arity, string_agg(distinct m.proto, ' ' order by m.proto) as protos
from up join fx_methods m on m.package_id = up.package_id and m.owner = up.ancestor group by 1, 2, 3, 4""")
def j10_overloads(v):
    return h.overloads(h.ancestors(h.parent_edges(v("fx_classes"))), v("fx_methods")).withColumn("arity", F.col("arity").cast("long"))


_PARENT = "coalesce(enclosing_class, case when enclosing_method is not null then split_part(enclosing_method, '->', 1) end, case when inner_name is not null then regexp_replace(child, '[$][^$]*;$', ';') end)"


def _parents(v):
    stem = F.when(F.col("inner_name").isNotNull(), F.regexp_replace("child", "[$][^$]*;$", ";"))
    return v("fx_nesting").select("package_id", "child", F.coalesce("enclosing_class", F.substring_index("enclosing_method", "->", 1), stem).alias("parent"))


@query(f"select distinct package_id, child, {_PARENT} as parent from fx_nesting")
def j11_lexical_parent(v):
    return _parents(v).distinct()


_NESTED = f""", declared as (select distinct package_id, child, {_PARENT} as parent from fx_nesting where {_PARENT} is not null),
nested as (select * from declared union all select package_id, child, min(descriptor) from fx_member_classes where (package_id, child) in (select (package_id, descriptor) from fx_classes)
and (package_id, child) not in (select (package_id, child) from declared) group by 1, 2)"""


@query(_NESTED + " select package_id, child, parent from nested")
def j11_parent_of_all(v):
    """Declared parents, and for other defined classes the one that lists them as members."""
    return m.nested_children(_parents(v), v("fx_member_classes"), v("fx_classes"))


@query(_NESTED + " select package_id, parent, string_agg(distinct child, ' ' order by child) as children from nested group by 1, 2")
def j12_nested_children(v):
    nested = m.nested_children(_parents(v), v("fx_member_classes"), v("fx_classes"))
    return nested.groupBy("package_id", "parent").agg(F.array_join(F.array_sort(F.collect_set("child")), " ").alias("children"))


_KIND = "case c.opcode " + " ".join(f"when {0x6E + k} then '{name}'" for k, name in enumerate(n.INVOKE_KINDS)) + " end"
#: Calls with their target's text and the body that it stands for: the first in DEX order of the images that define it.
LINKED = f""", bodies as (select * from (select *, row_number() over (partition by package_id, owner, name, proto order by entry_index, logical_index, method_index) as k from fx_program_methods) where k = 1),
linked as (select c.package_id, c.entry_index, c.method_index, c.pc, {_KIND} as kind, t.owner || '->' || t.name || t.proto as callee, b.entry_index as body_entry, b.method_index as body_method,
c.opcode in (111, 112, 113) and b.method_index is not null as exact from fx_calls c left join fx_method_ids t on t.package_id = c.package_id and t.entry_index = c.entry_index and t.method_index = c.target_index
left join bodies b on b.package_id = t.package_id and b.owner = t.owner and b.name = t.name and b.proto = t.proto)"""


def linked_calls(v):
    return c.call_edges(v("fx_calls"), v("fx_method_ids"), v("fx_program_methods"))


@query(LINKED + """ select package_id, callee, body_entry, kind, exact, count(distinct (entry_index, method_index)) as callers, count(*) as calls from linked group by all""")
def j13_call_edges(v):
    """Callees may lie in another image, or nowhere: then no call of them is exact."""
    edges = linked_calls(v).withColumn("body_entry", F.col("body.entry_index"))
    return edges.groupBy("package_id", "callee", "body_entry", "kind", "exact").agg(F.count_distinct("entry_index", "method_index").alias("callers"), F.count("*").alias("calls"))


@query(LINKED + """, x as (select distinct package_id, entry_index as ae, method_index as am, body_entry as be, body_method as bm from linked where exact)
select package_id, ae as entry_index, am as method_index, be as callee_entry, bm as callee_method, distance from (with recursive w(package_id, ae, am, be, bm, distance) as (
select package_id, entry_index, method_index, entry_index, method_index, 0 from fx_program_methods where name = 'onCreate'
union select w.package_id, w.ae, w.am, x.be, x.bm, w.distance + 1 from w join x on x.package_id = w.package_id and x.ae = w.be and x.am = w.bm where w.distance < 30)
select package_id, ae, am, be, bm, min(distance)::bigint as distance from w group by all)""")
def j13_callee_closure(v):
    """What the entry points (onCreate) reach through exact calls, whatever image it is in, with the fewest calls in between."""
    found = c.reached(linked_calls(v), v("fx_program_methods").where("name = 'onCreate'"))
    place = lambda side, e, m_: [F.col(f"{side}.entry_index").alias(e), F.col(f"{side}.method_index").alias(m_)]
    return found.select("package_id", *place("start", "entry_index", "method_index"), *place("callee", "callee_entry", "callee_method"), "distance")


@query(LINKED + """ select b.package_id, b.entry_index, b.method_index, string_agg(distinct l.entry_index || ':' || l.method_index, ' ' order by l.entry_index || ':' || l.method_index) as callers
from linked l join bodies b on b.package_id = l.package_id and b.entry_index = l.body_entry and b.method_index = l.body_method where l.exact group by 1, 2, 3""")
def j13_callers_index(v):
    """Each body with all methods of the package that call it exactly."""
    callers = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "entry_index", "method_index"))), " ").alias("callers")
    found = linked_calls(v).where("exact").groupBy("package_id", "body").agg(callers)
    return found.select("package_id", F.col("body.entry_index").alias("entry_index"), F.col("body.method_index").alias("method_index"), "callers")


@query("""select c.package_id, c.entry_index, c.method_index, c.pc, t.catch_type, t.handler_addr, count(*) as n from fx_code_refs c join fx_try_handlers t on t.package_id = c.package_id and t.entry_index = c.entry_index
and t.method_index = c.method_index and t.start_addr <= c.pc and c.pc < t.end_addr group by all""")
def j14_handlers_for_call(v):
    inside = (F.col("start_addr") <= F.col("pc")) & (F.col("pc") < F.col("end_addr"))
    found = v("fx_code_refs").join(v("fx_try_handlers"), [*r.KEY, "method_index"]).where(inside)
    return found.groupBy("package_id", "entry_index", "method_index", "pc", "catch_type", "handler_addr").agg(F.count("*").alias("n"))


@query("select package_id, descriptor, min(dex_id) as dex_id from fx_classes group by 1, 2")
def a02_class_index(v):
    return v("fx_classes").groupBy("package_id", "descriptor").agg(F.min("dex_id").alias("dex_id"))


@query("""select a.package_id, a.descriptor, count(c.dex_id) as definitions, case when count(c.dex_id) = 0 then 'not found' when count(c.dex_id) > 1 then 'ambiguous' else 'unique' end as verdict, string_agg(dex_id, ' ' order by dex_id) as dexes
from (select distinct package_id, descriptor from fx_classes union select distinct package_id, superclass from fx_classes) a left join fx_classes c on c.package_id = a.package_id and c.descriptor = a.descriptor group by 1, 2""")
def a03_definition_verdict(v):
    """Asked for: every class that is defined or extended."""
    own = v("fx_classes")
    asked = own.select("package_id", "descriptor").union(own.select("package_id", "superclass")).distinct()
    return m.definition_verdicts(asked, own)


_JSON = "octet_length(encode(to_json({'dex_id': dex_id, 'string_index': string_index, 'value': value})::varchar))"


@query(f"select package_id, count(*) as items, (50 + sum({_JSON}) + count(*) - 1)::bigint as bytes, count(*) <= 50 and 50 + sum({_JSON}) + count(*) - 1 <= 4096 as accepted from fx_strings group by 1")
def a04_result_budget(v):
    """The envelope, each row as JSON, and a separator between rows; a package's result is taken whole or not at all."""
    rows = m.result_bytes(v("fx_strings"), ["package_id"], ["dex_id", "string_index", "value"])
    found = rows.groupBy("package_id").agg(F.count("*").alias("items"), (F.sum("json_bytes") + F.count("*") + 49).alias("bytes"))
    return found.withColumn("accepted", (F.col("items") <= 50) & (F.col("bytes") <= 4096))


@query("select dex_id, count(*) as methods, count(*) filter (name = '') as unnamed, count(*) filter (contains(name, '$')) as dollar from fx_methods group by rollup(dex_id)")
def a09_dex_census(v):
    return v("fx_methods").rollup("dex_id").agg(F.count("*").alias("methods"), F.count_if(F.col("name") == "").alias("unnamed"), F.count_if(F.col("name").contains("$")).alias("dollar"))


_DENY = """, tokens as (select distinct lower(trim(string_split(line, '#')[1])) as token from fx_wordlist where trim(string_split(line, '#')[1]) <> ''),
paths as (select source || '/' || doc_id as path, string_split(text, chr(10)) as l from documents),
lines as (select path, unnest(range(1, len(l) + 1)) as line, unnest(l) as body from paths),
hits as (select path, line, token, left(trim(body), 140) as excerpt from lines join tokens on contains(lower(body), token)
union all select path, 0, token, '(file name)' from paths join tokens on contains(lower(path), token))"""


def _denied(v):
    files = v("documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "text")
    return audit.denylist_hits(files, audit.tokens(v("fx_wordlist")))


@query(_DENY + " select token, count(*) as hits, string_agg(path || ':' || line, ' ' order by path, line) filter (k <= 4) as places from (select *, row_number() over (partition by token order by path, line) as k from hits) group by token")
def a10_denylist_summary(v):
    return audit.denylist_summary(_denied(v))


@query(_DENY + " select path, line, token, excerpt from hits")
def a11_denylist_scan(v):
    return _denied(v)


_WORD = "case {0} when 'V' then 'void' when 'Z' then 'boolean' when 'I' then 'int' else regexp_replace(regexp_replace({0}, ';$', ''), '^.*/', '') end"
_TYPE = "(" + _WORD.format(r"regexp_replace({0}, '^\[+', '')") + r" || repeat('[]', length(regexp_extract({0}, '^\[*'))))"


def _modifiers_sql(flags: str, *more: tuple[int, str]) -> str:
    seen = f"case when ({flags} & 1) <> 0 then 'public' when ({flags} & 2) <> 0 then 'private' when ({flags} & 4) <> 0 then 'protected' end"
    return f"concat_ws(' ', {seen}, " + ", ".join(f"case when ({flags} & {bit}) <> 0 then '{name}' end" for bit, name in more) + ")"


_DOT = "replace({0}[2:-2], '/', '.')"
_USUAL = ((8, "static"), (16, "final"))
KIND = "case when ({0} & 512) <> 0 then 'interface' when ({0} & 16384) <> 0 then 'enum' when ({0} & 8192) <> 0 then '@interface' else 'class' end"


@query(f"""select c.package_id, c.entry_index, c.class_def_idx, c.descriptor, concat_ws(' ', nullif({_modifiers_sql('c.access_flags', *_USUAL, (1024, 'abstract'))}, ''), {KIND.format('c.access_flags')}, {_DOT.format('c.descriptor')},
case when superclass <> 'Ljava/lang/Object;' then 'extends ' || {_DOT.format('superclass')} end, case when iface1 is not null then 'implements ' || {_DOT.format('iface1')} || coalesce(', ' || {_DOT.format('iface2')}, '') end) as head, x.members from fx_classes c
join (select package_id, entry_index, class_def_idx, string_agg(text, chr(10) order by k, i) as members from (
select package_id, entry_index, class_def_idx, 0 as k, field_index as i, concat_ws(' ', nullif({_modifiers_sql('access_flags', *_USUAL, (128, 'transient'), (64, 'volatile'))}, ''), {_TYPE.format('type')}, name) as text from fx_fields
union all select package_id, entry_index, class_def_idx, 1, method_index, concat_ws(' ', nullif({_modifiers_sql('access_flags', *_USUAL, (1024, 'abstract'), (256, 'native'), (32, 'synchronized'), (2048, 'strictfp'))}, ''),
name || '(' || array_to_string(list_transform(regexp_extract_all(regexp_extract(proto, '^\\((.*)\\)', 1), '\\[*(?:[ZBSCIJFD]|L[^;]+;)'), lambda p: {_TYPE.format('p')}), ', ') || ') -> ' || {_TYPE.format("regexp_extract(proto, '[)](.*)$', 1)")}) from fx_methods
) group by 1, 2, 3) x on x.package_id = c.package_id and x.entry_index = c.entry_index and x.class_def_idx = c.class_def_idx""")
def a12_class_outline(v):
    return m.class_outline(v("fx_classes"), v("fx_fields"), v("fx_methods")).select("package_id", "entry_index", "class_def_idx", "descriptor", "head", "members")


@query("select package_id, entry_index, class_def_idx, field_index, row_number() over (partition by package_id, entry_index, class_def_idx order by (access_flags & 8) <> 0, field_index) - 1 as slot from fx_fields")
def w01_field_slot(v):
    w = Window.partitionBy(*r.KEY, "class_def_idx").orderBy(n.has(F.col("access_flags"), 8), "field_index")
    return v("fx_fields").select("package_id", "entry_index", "class_def_idx", "field_index", (F.row_number().over(w) - 1).cast("long").alias("slot"))


@query("select package_id, entry_index, name from (select *, row_number() over (partition by package_id, name order by entry_index) as k from fx_entries) where k = 1")
def w03_first_duplicate_entry(v):
    return h.first_by(v("fx_entries"), ["package_id", "name"], "entry_index").select("package_id", "entry_index", "name")


@query(f"""select package_id, entry_index, string_index, bytes from (select package_id, entry_index, string_index, (49 + sum({_JSON} + 1) over (partition by package_id order by entry_index, string_index rows unbounded preceding))::bigint as bytes from fx_strings) where bytes <= 1024""")
def w05_budget_prefix(v):
    w = Window.partitionBy("package_id").orderBy("entry_index", "string_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = m.result_bytes(v("fx_strings"), ["package_id", "entry_index"], ["dex_id", "string_index", "value"])
    return rows.select("package_id", "entry_index", "string_index", (F.sum(F.col("json_bytes") + 1).over(w) + 49).alias("bytes")).where("bytes <= 1024")


@query("select descriptor, dex_id, package_id from fx_classes order by descriptor, dex_id, package_id")
def o02_class_order(v):
    return v("fx_classes").select("descriptor", "dex_id", "package_id").orderBy("descriptor", "dex_id", "package_id")


@query("select package_id, entry_index, string_index, value from fx_strings where contains(lower(value), 'a') order by package_id, entry_index, logical_index, string_index limit 25 offset 10")
def o03_string_page(v):
    page = v("fx_strings").where(r.contains_folded(F.col("value"), "A")).orderBy("package_id", "entry_index", "logical_index", "string_index").offset(10).limit(25)
    return page.select("package_id", "entry_index", "string_index", "value")


@query("""select package_id, entry_index, string_index, value from (select *, row_number() over (order by package_id, entry_index, logical_index, string_index) - 1 as place, count(*) over () as n from fx_strings) where place >= n * 3 // 4 and place < n * 3 // 4 + 40""")
def o03_deep_page(v):
    """Forty rows from three quarters of all strings on: the ranges before are counted, not sorted."""
    strings = v("fx_strings")
    found = page(strings, ["package_id", "entry_index", "logical_index", "string_index"], strings.count() * 3 // 4, 40, range_rows=500)
    return found.select("package_id", "entry_index", "string_index", "value")


@query("select distinct package_id, type from (select package_id, superclass as type from fx_classes union all select package_id, iface1 from fx_classes union all select package_id, iface2 from fx_classes) where type is not null and (package_id, type) not in (select package_id, descriptor from fx_classes)")
def u03_undefined_types(v):
    used = h.parent_edges(v("fx_classes")).select("package_id", F.col("parent").alias("descriptor")).distinct()
    return used.join(v("fx_classes"), ["package_id", "descriptor"], "left_anti").withColumnRenamed("descriptor", "type")


@query("select package_id, kind, name, count(*) as n from (select package_id, 'class' as kind, descriptor as name from fx_classes union all select package_id, 'method', name from fx_methods) group by all")
def u02_union_kinds(v):
    both = v("fx_classes").select("package_id", F.lit("class").alias("kind"), F.col("descriptor").alias("name")).unionByName(v("fx_methods").select("package_id", F.lit("method").alias("kind"), "name"))
    return both.groupBy("package_id", "kind", "name").agg(F.count("*").alias("n"))


@query("""select package_id, entry_index, class_def_idx, 'field' as kind, field_index as member_index, name, type, null as proto, access_flags from fx_fields
union all select package_id, entry_index, class_def_idx, 'method', method_index, name, null, proto, access_flags from fx_methods""")
def u02_union_members(v):
    """Fields and methods as one list of members; what only one kind has is null for the other."""
    fields = v("fx_fields").select("package_id", "entry_index", "class_def_idx", F.lit("field").alias("kind"), F.col("field_index").alias("member_index"), "name", "type", "access_flags")
    methods = v("fx_methods").select("package_id", "entry_index", "class_def_idx", F.lit("method").alias("kind"), F.col("method_index").alias("member_index"), "name", "proto", "access_flags")
    return fields.unionByName(methods, allowMissingColumns=True)


@query(r"""select src_key, 'L' || replace(descriptor[2:-2], '.', '/') || ';' as x01, descriptor[2:-2] as x03, replace(descriptor[2:-2], '/', '.') as x04,
regexp_extract(descriptor[2:-2], '^(.*)/[^/]*$', 1) as x05, regexp_extract(descriptor, '([^/]*);$', 1) as x06, '0x' || lower(to_hex(access_flags)) as x18,
entry_index || ':' || logical_index || ':' || class_def_idx as x19 from fx_classes""")
def x_class_names(v):
    d = F.col("descriptor")
    return v("fx_classes").select(
        "src_key", n.class_descriptor(n.dotted_name(d)).alias("x01"), n.java_name(d).alias("x03"), n.dotted_name(d).alias("x04"), n.package_name(d).alias("x05"),
        n.simple_name(d).alias("x06"), n.hex_flags(F.col("access_flags")).alias("x18"), F.concat_ws(":", "entry_index", "logical_index", "class_def_idx").alias("x19"),
    )


def _flags_sql(flags: list[tuple[int, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when (access_flags & {bit}) <> 0 then '{name}' end" for bit, name in flags) + "], lambda x: x is not null), '|')"


@query(" union all ".join(
    f"select '{kind}' as target, package_id, entry_index, {number} as number, {_flags_sql(n.ACCESS_FLAGS[kind])} as names, case when (access_flags & 1) <> 0 then 3 when (access_flags & 4) <> 0 then 2 when (access_flags & 2) <> 0 then 0 else 1 end as level from (select * replace (access_flags | (1 << ({number} % 17)) as access_flags) from {table})"
    for kind, table, number in (("class", "fx_classes", "class_def_idx"), ("field", "fx_fields", "field_index"), ("method", "fx_methods", "method_index"))
))
def x09_access_flags(v):
    """Classes, fields and methods, each with one bit more, so that all bits occur, also those that a kind doesn't have."""
    out = None
    for kind, table, number in (("class", "fx_classes", "class_def_idx"), ("field", "fx_fields", "field_index"), ("method", "fx_methods", "method_index")):
        flags = F.expr(f"access_flags | shiftleft(1L, cast({number} % 17 as int))")
        one = v(table).select(F.lit(kind).alias("target"), "package_id", "entry_index", F.col(number).alias("number"), n.access_names(flags, kind).alias("names"), n.visibility_level(flags).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


@query(r"""select package_id, entry_index, method_index, regexp_extract(proto, '^\((.*)\)', 1) as params, len(regexp_extract_all(proto, '\[*(?:[ZBSCIJFD]|L[^;]+;)', 0)) - case when proto like '%)V' then 0 else 1 end as arity, regexp_extract(proto, '\)(.*)$', 1) as return_type from fx_methods""")
def x13_proto_split(v):
    p = F.col("proto")
    return v("fx_methods").select("package_id", "entry_index", "method_index", F.array_join(n.proto_params(p), "").alias("params"), F.size(n.proto_params(p)).cast("long").alias("arity"), n.proto_return(p).alias("return_type"))


@query("select package_id, dex_id || ' | ' || descriptor || ' extends ' || superclass as line from fx_classes")
def x20_render_relation(v):
    return v("fx_classes").select("package_id", F.concat("dex_id", F.lit(" | "), "descriptor", F.lit(" extends "), "superclass").alias("line"))


@query("select package_id, count(*) filter (contains(value, 'Authorization')) as matching, min(value) filter (contains(value, 'Authorization')) as first from fx_strings group by 1")
def c01_client_pipeline(v):
    hit = F.col("value").contains("Authorization")
    return v("fx_strings").groupBy("package_id").agg(F.count_if(hit).alias("matching"), F.min(F.when(hit, F.col("value"))).alias("first"))


@query("select package_id, string_index, lower(value) as value from fx_strings where contains(value, 'Authorization') order by package_id, value, string_index limit 40")
def c01_filter_sort_slice_map(v):
    hit = v("fx_strings").where(F.col("value").contains("Authorization")).orderBy("package_id", "value", "string_index").limit(40)
    return hit.select("package_id", "string_index", F.lower("value").alias("value"))


@query(r"""select distinct package_id, child, regexp_replace(regexp_replace(child[2:-2], '^.*/', ''), '^.*[$]', '') as x07, regexp_extract(child[2:-2], '^(.*)[$][^$]*$', 1) as x08,
replace(replace(replace(replace(replace('<a b="' || child || '">' || '&' || chr(39), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') as x17,
replace(replace(replace('<a b="' || child || '">&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as x17_text from fx_nesting""")
def x_nested_names(v):
    child = F.col("child")
    attribute, text = F.concat(F.lit('<a b="'), child, F.lit('">&'), F.lit("'")), F.concat(F.lit('<a b="'), child, F.lit('">&'))
    return v("fx_nesting").select("package_id", "child", n.inner_name(child).alias("x07"), n.outer_class(child).alias("x08"), n.xml_escape(attribute, True).alias("x17"), n.xml_escape(text).alias("x17_text")).distinct()


@query(r"""select package_id, entry_index, method_index, case when method_index % 3 = 0 then null else owner end as owner, case when method_index % 3 = 0 then null else name end as name,
case when method_index % 3 = 0 then null else regexp_extract(proto, '^\((.*)\)', 1) end as params, case when method_index % 3 = 0 then null else regexp_extract(proto, '[)](.*)$', 1) end as return_type from fx_methods""")
def x15_member_reference(v):
    """Every third text lacks its arrow and is no reference."""
    text = F.concat("owner", F.when(F.col("method_index") % 3 == 0, "").otherwise("->"), "name", "proto")
    return v("fx_methods").withColumn("p", n.method_reference(text)).select("package_id", "entry_index", "method_index", "p.owner", "p.name", "p.params", "p.return_type")


@query(f"select package_id, entry_index, method_index, {_modifiers_sql('access_flags', *_USUAL, (1024, 'abstract'), (256, 'native'), (32, 'synchronized'), (2048, 'strictfp'))} as modifiers from fx_methods")
def x10_modifier_string(v):
    return v("fx_methods").select("package_id", "entry_index", "method_index", n.modifiers(F.col("access_flags"), "method").alias("modifiers"))


@query(f"""select package_id, 'class' as kind, dex_id || ' | ' || descriptor || ' | ' || {_DOT.format('descriptor')} || ' | package=' || regexp_extract(descriptor[2:-2], '^(.*)/[^/]*$', 1) || ' | class=' || regexp_extract(descriptor, '([^/]*);$', 1) as line from fx_classes
union all select package_id, 'string', dex_id || ' | ' || string_index || ' | ' || value from fx_strings
union all select package_id, 'entry', name || ' | ' || case compression when 0 then 'stored' when 8 then 'deflated' else 'other' end || ' | ' || uncompressed_size || ' | ' || uncompressed_size from fx_entries""")
def x20_render_rows(v):
    size = F.col("uncompressed_size")
    lines = v("fx_classes").select("package_id", F.lit("class").alias("kind"), n.class_line(F.col("dex_id"), F.col("descriptor")).alias("line"))
    lines = lines.union(v("fx_strings").select("package_id", F.lit("string"), n.string_line(F.col("dex_id"), F.col("string_index"), F.col("value"))))
    return lines.union(v("fx_entries").select("package_id", F.lit("entry"), n.entry_line(F.col("name"), F.col("compression"), size, size)))
