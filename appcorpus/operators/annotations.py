"""What the compiler's own annotations say of classes, fields and methods."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYSTEM = "Ldalvik/annotation/"


def element(name: str) -> Column:
    """The values of one element of an annotation, in order."""
    own = F.filter("elements", lambda e: e.startswith(f"{name}="))
    return F.transform(own, lambda e: F.substring(e, F.lit(len(name) + 2), F.length(e)))


def metadata(annotations: DataFrame, image: list[str]) -> DataFrame:
    """One row for each annotated target: signature, throws, inner_name, inner_flags, enclosing_class, enclosing_method, member_classes.

    Of several annotations of a type the first counts; member classes of all are appended. `image` names the columns
    that tell one image from another. Annotations of parameters have no such meaning and give no rows.
    """

    def first(kind: str, value: Column) -> Column:
        own = F.col("type") == f"{_SYSTEM}{kind};"
        return F.min_by(F.when(own, value), F.when(own, F.col("ordinal")))

    members = F.when(F.col("type") == f"{_SYSTEM}MemberClasses;", F.struct("ordinal", element("value").alias("names")))
    only = lambda name: F.get(element(name), F.lit(0))
    return (
        annotations.where("target_kind <> 'parameter'").groupBy(*image, "class_def_idx", "target_kind", "target_index")
        .agg(
            first("Signature", F.array_join(element("value"), "")).alias("signature"),
            first("Throws", element("value")).alias("throws"),
            first("InnerClass", only("name")).alias("inner_name"),
            first("InnerClass", only("accessFlags").cast("long")).alias("inner_flags"),
            first("EnclosingClass", only("value")).alias("enclosing_class"),
            first("EnclosingMethod", only("value")).alias("enclosing_method"),
            F.flatten(F.transform(F.array_sort(F.collect_list(members)), lambda m: m["names"])).alias("member_classes"),
        )
    )
