"""Names, descriptors and flags as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access flags by target, (bit, name) in the order they are listed.
ACCESS_FLAGS = {
    "class": [(0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x200, "interface"), (0x400, "abstract"), (0x1000, "synthetic"), (0x2000, "annotation"), (0x4000, "enum")],
    "field": [(0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x40, "volatile"), (0x80, "transient"), (0x1000, "synthetic"), (0x4000, "enum")],
    "method": [(0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x20, "synchronized"), (0x40, "bridge"), (0x80, "varargs"), (0x100, "native"), (0x400, "abstract"), (0x800, "strict"), (0x1000, "synthetic"), (0x10000, "constructor"), (0x20000, "declared synchronized")],
}
# Primitive descriptors and their names.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def class_descriptor(name: Column) -> Column:
    """A dotted or partial class name as descriptor; an empty name is an error, null stays null."""
    slashed = F.replace(name, F.lit("."), F.lit("/"))
    headed = F.when(slashed.startswith("L"), slashed).otherwise(F.concat(F.lit("L"), slashed))
    tailed = F.when(headed.endswith(";"), headed).otherwise(F.concat(headed, F.lit(";")))
    ready = name.startswith("L") & name.endswith(";") & name.contains("/")
    return F.when(name == "", F.raise_error(F.lit("class name cannot be empty"))).when(ready, name).otherwise(tailed)


def fuzzy_pattern(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("."), F.lit("/"))


def java_name(descriptor: Column) -> Column:
    """Without L and ; where both are there."""
    return F.when(descriptor.startswith("L") & descriptor.endswith(";"), F.substring(descriptor, F.lit(2), F.length(descriptor) - 2)).otherwise(descriptor)


def dotted_name(descriptor: Column) -> Column:
    return F.replace(java_name(descriptor), F.lit("/"), F.lit("."))


def package_name(descriptor: Column) -> Column:
    return F.regexp_extract(java_name(descriptor), "^(.*)/[^/]*$", 1)


def simple_name(descriptor: Column) -> Column:
    return F.substring_index(java_name(descriptor), "/", -1)


def inner_name(descriptor: Column) -> Column:
    return F.substring_index(simple_name(descriptor), "$", -1)


def outer_class(descriptor: Column) -> Column:
    return F.regexp_extract(java_name(descriptor), r"^(.*)\$[^$]*$", 1)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit).cast("long")) != 0


def access_names(flags: Column, target: str) -> Column:
    """Names of the valid bits joined by |; invalid bits are passed over."""
    return F.array_join(F.array_compact(F.array(*(F.when(has(flags, bit), name) for bit, name in ACCESS_FLAGS[target]))), "|")


def visibility_level(flags: Column) -> Column:
    return F.when(has(flags, 1), 3).when(has(flags, 4), 2).when(has(flags, 2), 0).otherwise(1)


def modifiers(flags: Column, target: str) -> Column:
    """Source modifiers in their usual order."""
    bits = {name: bit for bit, name in ACCESS_FLAGS[target]}
    seen = F.when(has(flags, 1), "public").when(has(flags, 2), "private").when(has(flags, 4), "protected")
    rest = [("static", "static"), ("final", "final"), ("abstract", "abstract"), ("native", "native"), ("synchronized", "synchronized"), ("strict", "strictfp"), ("transient", "transient"), ("volatile", "volatile")]
    return F.array_join(F.array_compact(F.array(seen, *(F.when(has(flags, bits[k]), v) for k, v in rest if k in bits))), " ")


# Invoke opcodes from 0x6e and, for ranges of registers, from 0x74 on, in this order.
INVOKE_KINDS = ["virtual", "super", "direct", "static", "interface"]


def invoke_kind(opcode: Column) -> Column:
    """What an invoke opcode calls; null for other opcodes."""
    out = F.when(opcode.isin(0xFA, 0xFB), "polymorphic")
    for k, name in enumerate(INVOKE_KINDS):
        out = out.when(opcode.isin(0x6E + k, 0x74 + k), name)
    return out


def class_line(dex_id: Column, descriptor: Column) -> Column:
    return F.concat(dex_id, F.lit(" | "), descriptor, F.lit(" | "), dotted_name(descriptor), F.lit(" | package="), package_name(descriptor), F.lit(" | class="), simple_name(descriptor))


def string_line(dex_id: Column, index: Column, value: Column) -> Column:
    return F.concat(dex_id, F.lit(" | "), index.cast("string"), F.lit(" | "), value)


def entry_line(name: Column, compression: Column, compressed_size: Column, size: Column) -> Column:
    return F.concat_ws(" | ", name, compression_label(compression), compressed_size.cast("string"), size.cast("string"))


def hex_flags(flags: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(flags)))


def proto_params(proto: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(proto, r"^\((.*)\)", 1), F.lit(r"(\[*(?:[ZBSCIJFD]|L[^;]+;))"), 1)


def signature_types(signature: Column) -> Column:
    """Descriptors of the classes in a generic signature: bounds, arguments and raw types. Type variables are none, and
    what follows a dot (a member of a class with arguments) names no type of its own."""
    parts = F.regexp_extract_all(signature, F.lit(r"([\w$]+::?|T[\w$]+;|\.[\w$]+|L[^;<>:.]+)"), 1)
    return F.transform(F.filter(parts, lambda p: p.startswith("L") & ~p.endswith(":")), lambda p: F.concat(p, F.lit(";")))


def proto_return(proto: Column) -> Column:
    return F.substring_index(proto, ")", -1)


def java_type(descriptor: Column) -> Column:
    """Short source type: [I is int[], packages are dropped."""
    element = F.regexp_replace(descriptor, r"^\[+", "")
    depth = F.length(descriptor) - F.length(element)
    named = F.substring_index(java_name(element), "/", -1)
    for code, word in PRIMITIVES.items():
        named = F.when(element == code, word).otherwise(named)
    return F.concat(named, F.repeat(F.lit("[]"), depth.cast("int")))


def compression_label(code: Column) -> Column:
    return F.when(code == 0, "stored").when(code == 8, "deflated").otherwise("other")


def xml_escape(text: Column, attribute: bool = False) -> Column:
    out = text
    for raw, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&apos;")] if attribute else [])]:
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def method_reference(text: Column) -> Column:
    """struct(owner, name, params, return) of Lowner;->name(params)return; null if a part is missing."""
    shape = r"^(L[^;]+;|\[+.+?)->([^(]+)(\(((?:\[*(?:[ZBSCIJFD]|L[^;]+;))*)\)(\[*(?:[VZBSCIJFD]|L[^;]+;)))$"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), F.struct(part(1).alias("owner"), part(2).alias("name"), part(4).alias("params"), part(5).alias("return_type")))


def field_reference(text: Column) -> Column:
    """struct(owner, name, type) of Lowner;->name:type; null if a part is missing or the type is void."""
    shape = r"^(L[^;]+;)->([^:]+):(\[*(?:[ZBSCIJFD]|L[^;]+;))$"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), F.struct(part(1).alias("owner"), part(2).alias("name"), part(3).alias("type")))
