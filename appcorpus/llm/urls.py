"""URL filters: a tree of path templates for each host, rejected by the smoothed purity of labelled urls. JVM expressions only."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcorpus.shared import remove_folder, shared_folder

from .common import cut, free, ref, table

# The rules that label urls: verdict, host and path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Letters that a host's case doesn't count for.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A template is rejected if so much of its labelled urls is blocked, counting PRIOR urls more that are as all labelled ones are.
PURITY, PRIOR = 0.9, 4.0
#: Standard errors by which a branch's rate must differ from that of all its siblings to stay apart.
APART = 3.0
#: Segments that have a level of their own; what lies deeper is one wildcard.
DEPTH = 12
MAX_RULES = 1_000
#: Templates up to this size go to every task; beyond it, they and the pages are dealt out by host and shape.
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct<verdict, rule> of the longest rule (its text's length, then the smallest text) that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: {MAX_RULES} are the bound, each is an expression")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def shape_of(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: runs of digits, and names that are hexadecimal or long mixtures; its extension stays."""
    segment = F.replace(F.replace(segment, F.lit("*"), F.lit("%2A")), F.lit("{"), F.lit("%7B"))  # these are wildcards' own
    name, extension = F.regexp_replace(segment, r"(?s)^(.+)\.[A-Za-z]{1,5}$", "$1"), F.regexp_extract(segment, r"(?s)^.+(\.[A-Za-z]{1,5})$", 1)
    kind = (
        F.when(F.rlike(name, F.lit(r"^[0-9]+$")), "{n}")
        .when(F.rlike(name, F.lit(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$")), "{date}")
        .when(F.rlike(name, F.lit(r"^[0-9A-Fa-f]{8}(-?[0-9A-Fa-f]{4}){3}-?[0-9A-Fa-f]{12}$|^(?=.*[0-9])[0-9A-Fa-f]{16,}$")), "{hex}")
        .when(F.rlike(name, F.lit(r"^(?=.*[0-9])[0-9A-Za-z_-]{20,}$")), "{id}")
        .otherwise(F.regexp_replace(name, "[0-9]+", "{n}"))
    )
    return F.concat(kind, extension)


def _shapes(path: Column, depth: int) -> Column:
    """Shapes of a path's segments: what stands between slashes, the last one empty where the path ends with one; deeper ones are `**`."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.transform(F.slice(parts, 1, depth), shape_of)
    return F.when(path == "", F.array().cast("array<string>")).when(F.size(parts) > depth, F.concat(kept, F.array(F.lit("**")))).otherwise(kept)


def _tree(paths: DataFrame, prior: float, weight: float, apart: float, folder: str) -> DataFrame:
    """paths: host, key, shapes, labelled, blocked, one row a shaped path. Returns host, key, template, purity.

    Level by level from the host down. Siblings are compared with what all of them are together, never in pairs: a
    branch whose blocked share lies within `apart` standard errors of it is of the middle class, others are below or above, those
    without a labelled url are unknown. Siblings of one class whose next segments are of the same kinds merge.
    Each level is a table in the folder: a checkpoint would carry what Spark infers about all earlier templates along.
    """
    now = paths.select("host", "key", "shapes", "labelled", "blocked", F.lit("").alias("at"), F.lit(0).alias("level"))
    done, levels = None, []
    while True:
        at_end = F.size("shapes") <= F.col("level")
        ended = now.where(at_end)
        done = ended if done is None else done.unionByName(ended)
        going = now.where(~at_end)
        if going.isEmpty():
            break
        child = F.get("shapes", F.col("level"))
        after = F.get("shapes", F.col("level") + 1)
        kind = F.when(after.isNull(), "end").when(after == "", "slash").when(F.contains(after, F.lit("{")), "wild").otherwise("word")
        going = going.withColumns({"child": child, "kind": kind})
        sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
        children = going.groupBy("host", "at", "child").agg(*sums, F.array_sort(F.collect_set("kind")).alias("kinds"))
        pool = children.groupBy("host", "at").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        rate = (F.col("all_blocked") + weight * prior) / (F.col("all_labelled") + weight)
        error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
        off = (F.col("blocked") - F.col("labelled") * rate) / F.greatest(F.col("labelled"), F.lit(1)) / F.greatest(error, F.lit(1e-9))
        side = F.when(F.col("labelled") == 0, "?").when(off > apart, ">").when(off < -apart, "<").otherwise("=")
        # what is a wildcard by its shape is one branch already
        literal = ~F.contains("child", F.lit("{")) & (F.col("child") != "") & (F.col("child") != "**")
        kept = lambda c: F.concat(F.col(c), F.lit(""))  # noqa: E731  a new key, so that adaptive execution may split a host's
        judged = children.join(pool.select(kept("host").alias("host"), kept("at").alias("at"), "all_labelled", "all_blocked"), ["host", "at"])
        judged = judged.select("host", "at", "child", literal.alias("literal"), side.alias("side"), "kinds")
        merged = judged.where("literal").groupBy("host", "at", "side", "kinds").agg(F.count("*").alias("siblings"))
        judged = judged.join(merged.select(kept("host").alias("host"), kept("at").alias("at"), "side", "kinds", "siblings"), ["host", "at", "side", "kinds"], "left")
        wild = F.concat(F.lit("*"), F.when(F.col("side") == "=", "").otherwise(F.col("side")), F.lit("("), F.array_join("kinds", ","), F.lit(")"))
        node = F.when(F.col("literal") & (F.col("siblings") > 1), wild).otherwise(F.col("child"))
        judged = judged.select(kept("host").alias("host"), kept("at").alias("at"), kept("child").alias("child"), node.alias("node"))
        moved = going.join(judged, ["host", "at", "child"])
        path = f"{folder}/{len(levels)}"
        levels.append(path)
        moved.select("host", "key", "shapes", "labelled", "blocked", F.concat("at", F.lit("/"), "node").alias("at"), (F.col("level") + 1).alias("level")).write.parquet(path)
        now = paths.sparkSession.read.parquet(path)
    leaves = done.groupBy("host", "at").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + weight * prior) / (F.col("labelled") + weight)
    known = leaves.select(F.concat("host", F.lit("")).alias("host"), F.concat("at", F.lit("")).alias("at"), purity.alias("purity"))
    return done.join(known, ["host", "at"]).select("host", "key", F.col("at").alias("template"), "purity")


def filter_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, purity: float = PURITY,
    weight: float = PRIOR, apart: float = APART, depth: int = DEPTH, out: str = "filter",
) -> DataFrame:
    """pages, all columns, with a struct column `filter`: host, path, rule, template, purity, verdict (allow or block).

    A rule's verdict stands for the urls it fits, and labels them. Urls are counted by host and path shape first (variable
    segments are wildcards), so the tree is built over as many rows as there are shapes, whatever a host's share of the urls. Each level merges
    branches that the labels don't tell apart. A template's purity is its blocked share among labelled urls, smoothed by `weight`
    urls of the average; from `purity` on, its urls without a rule are blocked.

    Null urls and those without :// have an empty host and path and are one template; very long urls are read whole,
    segments beyond the `depth`th being one wildcard; repeated rows count as often as they stand; ties between rules of one length go
    to the smallest text; no pages give no rows; without labelled urls nothing is rejected unless a rule says so. A
    column called as the result (`out`) gives way to it, all others stay.
    """
    own, key = free(pages, "_own", "_key")
    host, path = host_of(ref(url)), path_of(ref(url))
    seen = pages.select(host.alias("host"), path.alias("path"))
    counted = seen.select("host", _shapes(F.col("path"), depth).alias("shapes"), longest_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("said"))
    counted = counted.select("host", "shapes", F.array_join("shapes", "/").alias("key"), F.size("shapes").alias("parts"), "said")
    counts = cut(counted.groupBy("host", "key", "parts").agg(F.first("shapes").alias("shapes"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked")))
    total = counts.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = total.blocked / total.labelled if total.labelled else 0.0
    counts = counts.withColumn("key", F.concat(F.col("parts").cast("string"), F.lit(":"), "key"))
    folder = f"{shared_folder(pages.sparkSession)}/urls-{uuid.uuid4().hex}"
    tree = cut(_tree(counts, prior, weight, apart, folder))
    remove_folder(pages.sparkSession, folder)
    shapes = _shapes(F.col(f"{own}.path"), depth)
    placed = pages.withColumn(own, F.struct(host.alias("host"), path.alias("path"))).withColumn(key, F.concat(F.size(shapes).cast("string"), F.lit(":"), F.array_join(shapes, "/")))
    names = free(placed, "_h", "_k", "_template", "_purity")
    tree = tree.select(F.concat("host", F.lit("")).alias(names[0]), F.concat("key", F.lit("")).alias(names[1]), F.col("template").alias(names[2]), F.col("purity").alias(names[3]))
    size = tree.agg(F.coalesce(F.sum(sum(F.octet_length(c) + 16 for c in names[:3])), F.lit(0))).first()[0]
    placed = placed.join(F.broadcast(tree) if size <= BROADCAST_BYTES else tree, (F.col(f"{own}.host") == F.col(names[0])) & (F.col(key) == F.col(names[1])))
    rule = longest_rule(F.col(f"{own}.host"), F.col(f"{own}.path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col(names[3]) >= purity, "block").otherwise("allow"))
    result = F.struct(F.col(f"{own}.host").alias("host"), F.col(f"{own}.path").alias("path"), rule["rule"].alias("rule"), F.col(names[2]).alias("template"), F.col(names[3]).alias("purity"), verdict.alias("verdict"))
    return placed.withColumn(out, result).drop(own, key, *names)


def op12(spark, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *(F.col(f"filter.{c}") for c in ("host", "path", "rule", "verdict", "template", "purity")))
