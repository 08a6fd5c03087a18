"""Column functions. All are built-in expressions, so they stay inside codegen
and push through Catalyst; none calls Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomgraph.functions import fixed

MASK32 = 0xFFFFFFFF
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _units(c: Column) -> Column:
    """UTF-16 units of a string: a code point above the BMP counts as its surrogate pair."""
    points = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.flatten(F.transform(points, lambda p: F.when(
        p > 0xFFFF,
        F.array(F.shiftright(p - 0x10000, 10) + 0xD800, (p - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00),
    ).otherwise(F.array(p))))


def _fnv(c: Column) -> Column:
    h = F.aggregate(
        _units(c), F.lit(FNV_OFFSET).cast("long"),
        lambda acc, u: (acc.bitwiseXOR(u) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32)))
    return F.when(c == "", F.lit(FNV_OFFSET).cast("long")).otherwise(h)


def fnv1a32_hex(c) -> Column:
    """FNV-1a 32 bit as eight hex digits."""
    return F.lpad(F.lower(F.hex(_fnv(_col(c)))), 8, "0")


def fnv1a32_suffix(c) -> Column:
    """First four digits of the hash written without leading zeros."""
    return F.left(F.lower(F.hex(_fnv(_col(c)))), F.lit(4))


def external_id(url) -> Column:
    return F.concat(F.lit("__ext__"), fnv1a32_hex(url))


def truncate(c, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def sorted_unique(arr) -> Column:
    return F.array_sort(F.array_distinct(_col(arr)))


def segments(path) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(_col(path), "/"), lambda s: s != "")


def join_path(parent, child) -> Column:
    parent, child = _col(parent), F.trim(F.coalesce(_col(child), F.lit("")))
    base = F.regexp_replace(parent, "/+$", "")
    return (F.when(child == "", F.when(base == "", "/").otherwise(base))
            .otherwise(F.concat(base, F.lit("/"), child)))


def redirect_path(target, parent) -> Column:
    """Absolute path of a redirect target; relative ones hang below the parent."""
    target = _col(target)
    absolute = F.regexp_replace(target, "/+$", "")
    return (F.when(target.startswith("/"), F.when(absolute == "", "/").otherwise(absolute))
            .otherwise(join_path(parent, target)))


def path_params(path) -> Column:
    """Sorted unique names of `:param` segments."""
    named = F.filter(F.split(_col(path), "/"), lambda s: s.startswith(":"))
    return sorted_unique(F.transform(named, lambda s: F.substr(s, F.lit(2))))


def template_params(path) -> Column:
    """Names of `:param` placeholders anywhere in a path, in order."""
    return F.regexp_extract_all(_col(path), F.lit(":([a-zA-Z_][a-zA-Z0-9_]*)"), 1)


def substitute_params(path, params) -> Column:
    """Replace the first `:name` of every map entry, in key order."""
    def put(acc, e):
        at = F.instr(acc, F.concat(F.lit(":"), e["key"]))
        return F.when(at > 0, F.concat(
            F.substring(acc, F.lit(1), at - 1), e["value"],
            F.substring(acc, at + F.length(e["key"]) + 1, F.length(acc)))).otherwise(acc)
    return F.aggregate(F.array_sort(F.map_entries(_col(params))), _col(path), put)


def capitalise(c) -> Column:
    """First letter upper, the rest untouched."""
    c = _col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def literal_boolean(c) -> Column:
    """'true' or 'false' when the expression is that literal, else NULL."""
    c = F.trim(_col(c))
    return F.when(c.isin("true", "false"), c)


def is_binding_expression(c) -> Column:
    return F.trim(_col(c)).rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$.]*$")


def strip_quotes(c) -> Column:
    return F.regexp_replace(_col(c), r"""^['"]|['"]$""", "")


def tag_position(node_id, tag) -> Column:
    """`tag:n` from the ordinal at the end of a widget id."""
    index = F.element_at(F.split(_col(node_id), r"\|"), -1).try_cast("int")
    tag = F.coalesce(_col(tag), F.lit("element"))
    return F.when(index.isNotNull(), F.concat(tag, F.lit(":"), index + 1)).otherwise(tag)


def entity_family(template, param) -> Column:
    """Segment before `:param`; the first segment when there is none before it."""
    segs = segments(template)
    at = F.array_position(segs, F.concat(F.lit(":"), _col(param)))
    first = F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit("root"))
    return F.when(at <= 1, first).otherwise(F.try_element_at(segs, (at - 1).cast("int")))


def is_negative_guard(c, wide: bool = False) -> Column:
    """Guards that want nobody logged in. `wide` also accepts the `unauth` spelling."""
    low = F.lower(_col(c))
    return low.contains("noauth") | low.contains("unauth") if wide else low.contains("noauth")


def positive_guards(arr) -> Column:
    return F.filter(_col(arr), lambda g: ~is_negative_guard(g))


def percent1(num, den) -> Column:
    """Percentage with one decimal."""
    return F.round(F.lit(100.0) * _col(num) / _col(den), 1)


def is_variant(value, wanted: str) -> Column:
    """Whether a variant is a string, number, boolean, array or object; NULL is none of them."""
    kind = F.schema_of_variant(_col(value))
    test = {"string": kind == "STRING", "number": kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "boolean": kind == "BOOLEAN",
            "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}
    return F.coalesce(test[wanted], F.lit(False))


def ratio(num, den) -> Column:
    """num / den, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), F.lit(0.0))


def is_generic_class(c) -> Column:
    by_prefix = reduce(lambda a, b: a | b, [_col(c).startswith(p) for p in fixed.GENERIC_CLASS_PREFIXES])
    return _col(c).isin(fixed.GENERIC_CLASSES) | by_prefix


def all_classes_generic(class_attr) -> Column:
    tokens = F.filter(F.split(_col(class_attr), r"\s+"), lambda t: t != "")
    return F.forall(tokens, is_generic_class)


def short_test_name(workflow_id) -> Column:
    """Hash (31-multiplier, 32 bit) plus class name and abbreviated trigger kind."""
    c = _col(workflow_id)
    h = F.aggregate(_units(c), F.lit(0).cast("long"),
                    lambda acc, u: (acc * 31 + u).bitwiseAND(F.lit(MASK32)))
    kind = F.coalesce(F.try_element_at(F.split(c, "::"), F.lit(2)), F.lit(""))
    for short, long in fixed.TRIGGER_ABBREVIATIONS.items():
        kind = F.replace(kind, F.lit(long), F.lit(short))
    class_name = F.regexp_extract(c, r"^[^#|]*#([^|]*)\|", 1)
    suffix = (F.when((class_name != "") & (kind != ""), F.concat_ws("_", class_name, kind))
              .when(class_name != "", class_name).when(kind != "", kind).otherwise("test"))
    return F.concat_ws("_", F.lpad(F.lower(F.hex(h)), 8, "0"), suffix)


def id_parts(edge_id) -> Column:
    """Parts of a trigger edge id: component, class, template place, widget kind, edge kind, target."""
    c = _col(edge_id)
    origin = F.split_part(c, F.lit("::"), F.lit(1))
    return F.struct(
        F.split_part(origin, F.lit("|"), F.lit(1)).alias("component_id"),
        F.regexp_extract(F.split_part(origin, F.lit("|"), F.lit(1)), r"#([^#]*)$", 1).alias("class_name"),
        F.split_part(origin, F.lit("|"), F.lit(2)).alias("place"),
        F.split_part(origin, F.lit("|"), F.lit(3)).alias("widget_kind"),
        F.split_part(c, F.lit("::"), F.lit(2)).alias("edge_kind"),
        F.split_part(c, F.lit("::"), F.lit(3)).alias("target"),
    )


def path_matches(path_segments, template_segments) -> Column:
    """A concrete path fits a template: same length, each part equal or a `:param`."""
    p, t = _col(path_segments), _col(template_segments)
    return (F.size(p) == F.size(t)) & F.forall(
        F.arrays_zip(p.alias("p"), t.alias("t")),
        lambda z: z["t"].startswith(":") | (z["t"] == z["p"]))


def lookup(c, table: dict, default=None) -> Column:
    """Value of a small fixed dictionary as a literal map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(c))
    return found if default is None else F.coalesce(found, default)


def any_contains(c, words) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).contains(w) for w in words])


def non_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit("")) != ""
