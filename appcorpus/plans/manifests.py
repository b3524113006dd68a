"""Registered queries over manifests in package files, and over what the sinks wrote."""

import uuid

from pyspark.sql import functions as F

from appcorpus.operators.references import render
from appcorpus.plans.queries import _findrefs_sql, j01_findrefs_string, query
from appcorpus.shared import cut, shared_folder
from appcorpus.sources.archives import list_entries
from appcorpus.sources.manifest import attributes, manifest_events, manifest_nodes, manifests
from appcorpus.sources.sinks import write_lines, write_references
from appcorpus.testing.manifests import packages_with_manifests
from appcorpus.testing.packages import written

_BINARY = "cast(substr(package_id, 4) as int) % 2 = 1"
_NAME = "replace(descriptor[2:-2], '/', '.')"


def _events(v):
    entries = list_entries(v("fx_classes").sparkSession, written(v, packages_with_manifests))
    return cut(manifest_events(entries)).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))


@query(f"""select package_id || '.apk' as path, case when {_BINARY} then '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="' || package_id || '" android:versionCode="' || count(*) || '">' || chr(10)
|| string_agg('    <activity android:name="' || {_NAME} || '" android:exported="' || case when access_flags % 2 = 1 then 'true' else 'false' end || '" android:icon="@7F' || printf('%06X', cast(p_size as int)) || '" android:label="R&amp;D ' || p_size || '" />', chr(10) order by entry_index, class_def_idx) || chr(10) || '</manifest>'
else '<manifest package="' || package_id || '"><application/></manifest>' end as xml from fx_classes group by package_id""")
def s22_manifest_xml(v):
    return manifests(_events(v)).where("error is null").select("path", "xml")


@query(f"""select distinct package_id || '.apk' as path, 0 as node_id, null::bigint as parent_id, 0 as depth, 'manifest' as tag, case when {_BINARY} then 3 else 1 end as n_attrs from fx_classes
union all select distinct package_id || '.apk', 1, 0, 1, 'application', 0 from fx_classes where not ({_BINARY})
union all select package_id || '.apk', row_number() over (partition by package_id order by entry_index, class_def_idx), 0, 1, 'activity', 4 from fx_classes where {_BINARY}""")
def s23_manifest_nodes(v):
    nodes = manifest_nodes(_events(v))
    return nodes.select("path", "node_id", "parent_id", "depth", "tag", F.size("attrs").cast("long").alias("n_attrs"))


@query(f"select package_id || '.apk' as path, {_NAME} as activity from fx_classes where {_BINARY}")
def s23_manifest_activities(v):
    found = attributes(manifest_nodes(_events(v)), "activity", "android:name")
    return found.withColumnRenamed("value", "activity")


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"


_HITS = _findrefs_sql("string", "select package_id, entry_index, string_index as target_index, value as text from fx_strings where contains(value, 'Authorization')")


@query(f"select dex_id || ' | ' || member || ' | matched=(' || matched || ')' as line from ({_HITS})")
def s25_text_sink(v):
    hits = render(j01_findrefs_string(v))
    path = _new_folder(hits.sparkSession)
    write_lines(hits, path, "package_id", "line")
    return hits.sparkSession.read.text(path).withColumnRenamed("value", "line")


@query("select package_id, entry_index, method_index, target_index, count(*) as n from fx_code_refs where ref_kind = 'field' group by all")
def s25_reference_sink(v):
    refs = v("fx_code_refs")
    path = _new_folder(refs.sparkSession)
    write_references(refs, path)
    field = refs.sparkSession.read.parquet(path).where("ref_kind = 'field'")
    return field.groupBy("package_id", "entry_index", "method_index", "target_index").agg(F.count("*").alias("n"))
