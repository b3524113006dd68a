import duckdb
import pytest
from pyspark.sql import functions as F

from appcorpus.functions import names as n
from appcorpus.operators import audit, hierarchy, references
from appcorpus.operators import members as member_operators
from appcorpus.plans import manifests, members, packages, queries  # noqa: F401, all but the last register theirs
from appcorpus.testing.fixtures import TABLES

OBJECT = hierarchy.OBJECT
SF = "/root/testdata/sf0.001"


def rows(columns, values):
    return sorted(map(repr, ([v[columns.index(c)] for c in sorted(columns)] for v in values)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, expected.fetchall())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# Name cases that must give the reference's results.
@pytest.mark.parametrize("name, descriptor", [("com.foo.Main", "Lcom/foo/Main;"), ("Lcom.foo.Main;", "Lcom/foo/Main;"), ("LMain;", "LMain;"), ("Main", "LMain;"), ("I", "LI;"), ("[Lcom/foo/Main;", "L[Lcom/foo/Main;"), ("foo.bar;", "Lfoo/bar;"), (None, None)])
def test_class_descriptor(spark, name, descriptor):
    assert one(spark, n.class_descriptor(F.lit(name).cast("string"))) == descriptor


def test_empty_class_name_is_an_error(spark):
    with pytest.raises(Exception, match="cannot be empty"):
        one(spark, n.class_descriptor(F.lit("")))


def test_descriptors(spark):
    assert one(spark, n.java_type(F.lit("[[Ljava/lang/String;"))) == "String[][]"
    assert one(spark, n.java_type(F.lit("[I"))) == "int[]"
    assert one(spark, n.proto_params(F.lit("(I[JLa/B;)V"))) == ["I", "[J", "La/B;"]
    assert one(spark, n.method_reference(F.lit("La/B;->run(I)V"))).asDict() == {"owner": "La/B;", "name": "run", "params": "I", "return_type": "V"}
    assert one(spark, n.method_reference(F.lit("La/B;->(I)V"))) is None
    assert one(spark, n.field_reference(F.lit("La/B;->x:V"))) is None
    assert one(spark, n.modifiers(F.lit(25).cast("long"), "method")) == "public static final"
    assert one(spark, n.xml_escape(F.lit("a<\"b\"&c"), attribute=True)) == "a&lt;&quot;b&quot;&amp;c"


def test_member_query_needs_a_name_or_a_class(spark):
    with pytest.raises(ValueError):
        references.member_condition("", None)
    assert one(spark, references.contains_literal(F.lit("abc"), "")) is False


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("p", "A", "B"), ("p", "B", "C"), ("p", "C", "A")], "package_id string, child string, parent string")
    found = {(r.descriptor, r.ancestor, r.distance) for r in hierarchy.ancestors(edges).collect()}
    # Object is an ancestor of all, far away where no known chain leads to it
    assert found == {(x, y, (ord(y) - ord(x)) % 3) for x in "ABC" for y in "ABC"} | {(x, hierarchy.OBJECT, hierarchy.UNREACHED) for x in "ABC"}


def test_classes_below_undefined_ones_have_object_in_common(spark):
    edges = spark.createDataFrame([("p", "A", "Missing"), ("p", "B", "Other"), ("p", "C", "A")], "package_id string, child string, parent string")
    pairs = spark.createDataFrame([("p", "A", "B"), ("p", "C", "A"), ("p", "C", "B")], "package_id string, l string, r string")
    found = {(r.l, r.r): r.lcs for r in hierarchy.least_common_supertype(pairs, hierarchy.ancestors(edges)).collect()}
    assert found == {("A", "B"): hierarchy.OBJECT, ("C", "A"): "A", ("C", "B"): hierarchy.OBJECT}


def test_overriding(spark):
    """C -> B -> A and D -> C; an interface I. Flags: 1 public, 4 protected, 64 bridge."""
    classes = spark.createDataFrame([("p", f"L{d};", 1 if d[-1] != "I" else 0x201, up, i) for d, up, i in [("x/A", OBJECT, None), ("y/B", "Lx/A;", None), ("y/C", "Ly/B;", "Ly/I;"), ("z/D", "Ly/C;", None), ("y/I", OBJECT, None)]], "package_id string, descriptor string, access_flags long, superclass string, iface1 string").withColumn("iface2", F.lit(None).cast("string"))
    methods = [
        ("Lx/A;", "m", "()V", 1), ("Ly/C;", "m", "()V", 1), ("Lz/D;", "m", "()V", 1),  # B has none: C and A are both bases of D's
        ("Ly/B;", "q", "()V", 0), ("Ly/C;", "q", "()V", 4), ("Lz/D;", "q", "()V", 4),  # D doesn't see B's, which C overrides
        ("Ly/I;", "r", "()Ljava/lang/Object;", 65), ("Ly/I;", "r", "()Lx/A;", 1), ("Ly/C;", "r", "()Ly/B;", 1),
        ("Lx/A;", "s", "()V", 9), ("Lx/A;", "t", "(I)V", 1), ("Ly/B;", "s", "()V", 1), ("Ly/B;", "t", "(J)V", 1),  # static, and another shape
    ]
    made = spark.createDataFrame([("p", *x) for x in methods], "package_id string, owner string, name string, proto string, access_flags long")
    closure = hierarchy.ancestors(hierarchy.parent_edges(classes))
    found = member_operators.overrides(closure, made, classes)
    assert {(r.owner[1:-1], r.name, r.base[1:-1], r.base_proto, r.is_base) for r in found.collect()} == {
        ("y/C", "m", "x/A", "()V", True), ("z/D", "m", "x/A", "()V", True), ("z/D", "m", "y/C", "()V", True),
        ("y/C", "q", "y/B", "()V", True), ("z/D", "q", "y/C", "()V", False), ("y/C", "r", "y/I", "()Lx/A;", True)}
    throws = spark.createDataFrame([("p", o, n_, "()V", e) for o, n_, e in [("Lx/A;", "m", "Le/X;"), ("Lx/A;", "m", "Le/Y;"), ("Ly/C;", "m", "Le/Y;"), ("Ly/C;", "q", "Le/X;")]], "package_id string, owner string, name string, proto string, exception string")
    assert {(r.owner, r.name, r.exception) for r in member_operators.inherited_throws(found, throws).collect()} == {("Ly/C;", "m", "Le/X;"), ("Ly/C;", "m", "Le/Y;"), ("Lz/D;", "m", "Le/Y;")}


def test_signature_types(spark):
    cases = {"<T:La/Base;L::La/Inter;>La/Up<TT;[La/Arg;>.List<-Lx/W;*>;": ["La/Base;", "La/Inter;", "La/Up;", "La/Arg;", "Lx/W;"], "(ILa/B;TT;[J)TLong;^Le/X;": ["La/B;", "Le/X;"], "": []}
    for text, types in cases.items():
        assert one(spark, n.signature_types(F.lit(text))) == types
    assert one(spark, n.signature_types(F.lit(None).cast("string"))) is None


def test_word_list_hits(spark):
    lines = spark.createDataFrame([("alpha # first",), ("# none",), ("  ",), ("ALPHABET",), ("pha",)], "line string")
    files = spark.createDataFrame([("dir/Alpha.txt", "nothing\n  an alphabet here\nPHA pha"), ("b", None), (None, "alpha"), ("c", "")], "path string, text string")
    hits = audit.denylist_hits(files, audit.tokens(lines))
    expected = set()
    for path, text in [(r.path, r.text) for r in files.collect()]:
        for token in ("alpha", "alphabet", "pha"):
            expected |= {(path, k, token, line.strip()) for k, line in enumerate((text or "").split("\n"), 1) if token in line.lower()} | ({(path, 0, token, "(file name)")} if token in (path or "").lower() else set())
    assert {tuple(r) for r in hits.collect()} == expected and hits.count() == len(expected)
    assert audit.denylist_hits(files, audit.tokens(lines.limit(0))).count() == 0


def test_words_with_line_breaks_are_in_no_line(spark):
    words = spark.createDataFrame([("two\nlines",), ("two",)], "token string")
    files = spark.createDataFrame([("a/Two\nLines", "one two\nlines\ntwo")], "path string, text string")
    assert {(r.line, r.token) for r in audit.denylist_hits(files, words).collect()} == {(1, "two"), (3, "two"), (0, "two"), (0, "two\nlines")}
    only = audit.denylist_hits(files.withColumn("path", F.lit("a")), words.where("token <> 'two'"))
    assert only.count() == 0 and audit.denylist_summary(only).count() == 0


def test_invoke_kinds(spark):
    rows = spark.createDataFrame([(k,) for k in (0x6E, 0x6F, 0x70, 0x71, 0x72, 0x74, 0x78, 0xFA, 0xFB, 0x73, 0x1A)], "o int").select(n.invoke_kind(F.col("o"))).collect()
    assert [r[0] for r in rows] == ["virtual", "super", "direct", "static", "interface", "virtual", "interface", "polymorphic", "polymorphic", None, None]


def test_entry_module_without_training_data(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("appcorpus.llm", "corpus_pipeline") else real(name, *a))
    assert set(__spark_entry__.queries()) == set(queries.QUERIES)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
