"""Markup to widgets: tokens, kinds, labels, nesting, predicates.

A page is one text value, so every window below is keyed by page (or page and level) and
holds no more than the tokens of one page. Regions are found with windows instead of
comparing every pair of tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.functions import fixed
from loomgraph.functions.scalar import let, literal_boolean, lookup, sorted_unique, truncate
from loomgraph.functions.scale import cut_lineage, span_join

TOKEN = (r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|"""
         r"""<[a-z/!][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^<]+|<""")
ATTRIBUTE = r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""
CAP = 200
# tags whose closing tag is reliable enough to bound a region
REGION_TAGS = ["form", "select", "a", "button", "option", "textarea", "div", "span", "ul", "ol", "table", "ng-template", "ng-container"]
SPAN_BIN = 4096


def tokens(pages: DataFrame) -> DataFrame:
    """All tokens of a page in order with their place in the original text.

    Comments, scripts and styles are one token each; the tokens of a page joined
    together are the page, so offsets, lines and columns are exact. Text that cannot be
    read gives no tags and no error. A table that is tokenised already is taken as it is.

    Pages are dealt by their id before they are taken apart: whole texts travel, not token
    rows, and the windows below find their pages together. The generator is an outer one: before an inner one Spark
    filters by the size of the list, and would read every text once more for it.
    """
    if "tok" in pages.columns:
        return pages
    name_of = lambda tok: F.when(tok.startswith("<"), F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))).otherwise("")
    found = F.transform(F.regexp_extract_all("html", F.lit(TOKEN), 0), lambda tok: F.struct(tok.alias("tok"), name_of(tok).alias("name")))
    t = pages.select("page_id", "html").repartition("page_id").select("page_id", F.posexplode_outer(found).alias("pos", "t")).where("pos is not null").select("page_id", "pos", "t.tok", "t.name")
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("tok")
    t = t.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))
    tail = F.substring_index("tok", "\n", -1)
    after_break = F.when(F.contains("tok", F.lit("\n")), F.col("start") + size - F.length(tail))
    line = 1 + F.coalesce(F.sum(size - F.length(F.replace("tok", F.lit("\n"), F.lit("")))).over(before), F.lit(0))
    col = F.col("start") - F.coalesce(F.max(after_break).over(before), F.lit(0)) + 1
    name = F.col("name")
    raw = (name.startswith("script") | name.startswith("style")) & F.col("tok").rlike("^(?i)<(script|style)\\b")
    kind = (F.when(F.col("tok").startswith("<!") | raw, "raw").when(name == "", "text").when(F.col("tok").startswith("</"), "close")
            .when(F.col("tok").endswith("/>") | name.isin(fixed.VOID_ELEMENTS), "single").otherwise("open"))
    return t.select("page_id", "pos", "tok", "start", (F.col("start") + size).alias("stop"), line.cast("bigint").alias("line"),
                    col.cast("bigint").alias("col"), kind.alias("token"), F.when(kind.isin("open", "close", "single"), name).otherwise("").alias("name"))


def tokenised(pages: DataFrame) -> DataFrame:
    """The tokens of pages as a written table, for operators that read them several times."""
    return pages if "tok" in pages.columns else cut_lineage(tokens(pages))


def attributes(tok: Column) -> Column:
    """Attributes of a tag: binding kind, lower-case name, value without quotes.

    `(x)` is an event, `[x]` a bound attribute, `[(x)]` both, `*x` a structural directive.
    """
    body = F.regexp_replace(F.regexp_replace(tok, r"^<[a-zA-Z][^\s/>]*", ""), r"/?>$", "")
    def read(b):
        names = F.regexp_extract_all(b, F.lit(ATTRIBUTE), 1)
        values = F.transform(F.regexp_extract_all(b, F.lit(ATTRIBUTE), 2), lambda v: F.regexp_replace(v, """^["']|["']$""", ""))
        return F.flatten(F.zip_with(names, values, spread))
    def entry(binding, n, v):
        return F.struct(F.lit(binding).alias("binding"), F.lower(n).alias("name"), v.alias("value"))
    def spread(n, v):
        bare = F.regexp_replace(n, r"^[\[(*]+|[\])]+$", "")
        return (F.when(n.startswith("[("), F.array(entry("boundAttr", bare, v), entry("event", F.concat(bare, F.lit("Change")), v)))
                .when(n.startswith("("), F.array(entry("event", bare, v))).when(n.startswith("["), F.array(entry("boundAttr", bare, v)))
                .when(n.startswith("*"), F.array(entry("structural", bare, v))).otherwise(F.array(entry("attr", bare, v))))
    return let(body, read)


def tags(pages: DataFrame) -> DataFrame:
    """Opening tags with their attributes.

    They come from a generator, through which no filter on what is made of them is pushed: a tag is read once,
    however often later conditions name its attributes.
    """
    return tokens(pages).where("token in ('open', 'single')").select("*", F.explode(F.array(attributes(F.col("tok")))).alias("attrs"))


def plain(a: Column) -> Column:
    return a["binding"].isin("attr", "boundAttr")


def attr_value(name: str) -> Column:
    """Value of the first attribute with that name, bound or not."""
    return F.try_element_at(F.filter("attrs", lambda a: plain(a) & (a["name"] == name)), F.lit(1))["value"]


def has_attr(*names: str) -> Column:
    return F.exists("attrs", lambda a: plain(a) & a["name"].isin(*names))


def is_custom(name) -> Column:
    return ~(F.col(name) if isinstance(name, str) else name).isin(fixed.HTML_ELEMENTS)


def widget_kind() -> Column:
    """Kind of an opening tag, NULL for elements a user cannot act on.

    Events on custom elements are outputs of a component and make no widget.
    """
    by_type = F.when(F.col("name") == "input", lookup(F.lower(attr_value("type")), fixed.INPUT_WIDGET_KIND))
    by_tag = lookup("name", fixed.TAG_WIDGET_KIND)
    return (F.when(by_type.isNotNull(), by_type).when(by_tag.isNotNull(), by_tag)
            .when(has_attr(*fixed.BUTTON_DIRECTIVES), "Button").when(has_attr("mat-menu-item"), "MenuItem")
            .when(has_attr("routerlink", "href"), "Link")
            .when(F.exists("attrs", lambda a: a["binding"] == "event") & ~is_custom("name"), "Unknown"))


def kept_attributes() -> Column:
    """Map of the kept attributes, trimmed and cut, empty ones dropped."""
    rows = F.filter("attrs", lambda a: plain(a) & a["name"].isin(fixed.KEPT_ATTRIBUTES) & (F.trim(a["value"]) != ""))
    entries = F.transform(rows, lambda a: F.struct(a["name"].alias("k"), F.left(F.trim(a["value"]), F.lit(CAP)).alias("v")))
    # the last value of a repeated name wins
    return let(entries, lambda es: F.map_from_entries(
        F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["k"] == e["k"]))))


def widgets(pages: DataFrame) -> DataFrame:
    """Widgets in document order with ordinal per kind and stable id."""
    w = tags(pages).withColumn("kind", widget_kind()).where("kind is not null")
    nth = F.row_number().over(W.partitionBy("page_id", "kind").orderBy("pos")) - 1
    w = w.withColumn("idx", nth.cast("bigint"))
    ident = F.concat_ws("|", F.col("page_id").cast("string"), F.concat_ws(":", "line", "col"), "kind", "idx")
    return w.withColumn("widget_id", ident).withColumn("attributes", kept_attributes())


def regions(toks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Regions of the tags whose closing tag can be trusted, or of the given tag names."""
    wanted = F.col("name").isin(REGION_TAGS) | is_custom("name") if names is None else F.col("name").isin(names)
    return pair_tags(toks.where(wanted))


def pair_tags(toks: DataFrame) -> DataFrame:
    """Opening tags with the place of their closing tag: (page_id, pos, name, close_pos, start, region_stop).

    The n-th open tag at a nesting level of one name closes at the next row of that
    level, which is a window; a tag without a closing tag bounds no region.
    """
    t = toks.where("token in ('open', 'close')")
    running = F.sum(F.when(F.col("token") == "open", 1).otherwise(-1)).over(W.partitionBy("page_id", "name").orderBy("pos"))
    t = t.withColumn("level", running + F.when(F.col("token") == "close", 1).otherwise(0))
    nxt = F.lead(F.struct("token", "pos", "stop")).over(W.partitionBy("page_id", "name", "level").orderBy("pos"))
    return (t.withColumn("nxt", nxt).where("token = 'open' and nxt.token = 'close'")
            .select("page_id", "pos", "name", F.col("nxt.pos").alias("close_pos"), "start", F.col("nxt.stop").alias("region_stop")))


def innermost(items: DataFrame, areas: DataFrame, payload: str, out: str, inclusive: bool) -> DataFrame:
    """`payload` of the innermost area around every item (page_id, pos), NULL outside all areas.

    `areas` has (page_id, pos, close_pos, payload). A running depth gives every open area a
    level; the area around an item is the last one opened on the item's level. With
    `inclusive` an item on the opening tag counts as inside.
    """
    opens = areas.select("page_id", "pos", F.lit(0 if inclusive else 1).alias("phase"), F.lit(1).alias("step"), F.col(payload).alias("load"), F.lit(False).alias("is_item"))
    closes = areas.select("page_id", F.col("close_pos").alias("pos"), F.lit(2).alias("phase"), F.lit(-1).alias("step"), F.lit(None).alias("load"), F.lit(False).alias("is_item"))
    asks = items.select("page_id", "pos").select("page_id", "pos", F.lit(1 if inclusive else 0).alias("phase"), F.lit(0).alias("step"), F.lit(None).alias("load"), F.lit(True).alias("is_item"))
    events = opens.unionByName(closes).unionByName(asks)
    depth = F.sum("step").over(W.partitionBy("page_id").orderBy("pos", "phase").rowsBetween(W.unboundedPreceding, 0))
    events = events.withColumn("level", depth)
    last = F.last("load", ignorenulls=True).over(W.partitionBy("page_id", "level").orderBy("pos", "phase").rowsBetween(W.unboundedPreceding, 0))
    found = events.withColumn(out, F.when(F.col("level") > 0, last)).where("is_item").select("page_id", "pos", out)
    return items.join(found, ["page_id", "pos"], "left")


def parents(pages: DataFrame) -> DataFrame:
    """Widgets with the nearest widget around them."""
    pages = tokenised(pages)
    w = widgets(pages).select("page_id", "pos", "start", "kind", "idx", "name", "widget_id")
    areas = w.join(regions(tokens(pages)).select("page_id", "pos", "close_pos"), ["page_id", "pos"]).select("page_id", "pos", "close_pos", "widget_id")
    return innermost(w, areas, "widget_id", "parent_id", inclusive=False)


def labels(pages: DataFrame) -> DataFrame:
    """Text directly inside a widget, parts joined by a blank, cut."""
    pages = toks = tokenised(pages)
    inside = F.sum(F.when(F.col("token") == "open", 1).when(F.col("token") == "close", -1).otherwise(0)).over(W.partitionBy("page_id").orderBy("pos"))
    deep = toks.withColumn("depth", inside)
    w = widgets(pages).select("page_id", "pos", "widget_id")
    areas = (w.join(regions(toks).select("page_id", "pos", "close_pos"), ["page_id", "pos"])
             .join(deep.select("page_id", "pos", "depth"), ["page_id", "pos"]).withColumn("load", F.struct("widget_id", "depth")))
    texts = innermost(deep.where("token = 'text' and trim(tok) <> ''").select("page_id", "pos", "tok", "depth"), areas, "load", "owner", inclusive=False)
    direct = texts.where("owner.depth = depth").select("page_id", F.col("owner.widget_id").alias("widget_id"), "pos", F.regexp_replace("tok", r"^\s+|\s+$", "").alias("part"))
    return direct.groupBy("page_id", "widget_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " "), F.lit(CAP)).alias("label"))


def bindings(pages: DataFrame) -> DataFrame:
    """Every event, and the navigation and form attributes, of widgets."""
    rows = widgets(pages).select("page_id", "widget_id", "kind", F.posexplode("attrs").alias("nth", "a"))
    keep = (F.col("a.binding") == "event") | (F.col("a.binding").isin("attr", "boundAttr") & F.col("a.name").isin(fixed.BINDING_ATTRIBUTES))
    return rows.where(keep).select("page_id", "widget_id", "kind", "nth", F.col("a.binding").alias("binding"), F.col("a.name").alias("name"),
                                   F.left(F.trim("a.value"), F.lit(CAP)).alias("value"))


def validators() -> Column:
    """required, positive minlength and maxlength, pattern."""
    def positive(name):
        v = F.regexp_extract(F.coalesce(attr_value(name), F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
        return F.when(v > 0, v)
    required = F.exists("attrs", lambda a: (a["binding"] == "attr") & (a["name"] == "required"))
    return F.struct(required.alias("required"), positive("minlength").alias("min_length"), positive("maxlength").alias("max_length"),
                    attr_value("pattern").alias("pattern"))


def structural(name: str) -> Column:
    return F.try_element_at(F.filter("attrs", lambda a: (a["binding"] == "structural") & (a["name"] == name)), F.lit(1))["value"]


def directive_areas(pages: DataFrame, directive: str) -> DataFrame:
    """Elements that carry a structural directive, with their extent and expression."""
    t = tags(pages).withColumn("expr", structural(directive)).where("expr is not null")
    return regions_of(tokens(pages), t).join(t.select("page_id", "pos", "expr"), ["page_id", "pos"])


def regions_of(toks: DataFrame, carriers: DataFrame) -> DataFrame:
    """Regions of every tag name that some carrier has on the same page."""
    names = carriers.select("page_id", "name").distinct()
    return pair_tags(toks.join(names, ["page_id", "name"], "left_semi")).drop("name")


def repeaters(pages: DataFrame) -> DataFrame:
    """Widgets inside a repeater with the expression and their ordinal in it."""
    pages = tokenised(pages)
    w = widgets(pages).select("page_id", "pos", "kind", "name", "widget_id")
    inside = innermost(w, directive_areas(pages, "ngfor"), "expr", "repeater", inclusive=True).where("repeater is not null")
    group = F.when(F.col("kind") == "Unknown", F.col("name")).otherwise(F.col("kind"))
    nth = F.row_number().over(W.partitionBy("page_id", group, "repeater").orderBy("pos")) - 1
    return inside.withColumn("ordinal", nth.cast("bigint"))


def predicates(pages: DataFrame) -> DataFrame:
    """Visibility and enabledness conditions with the text range they rule.

    A structural directive rules its element, a bound property rules its own tag.
    """
    pages = tokenised(pages)
    t = tags(pages).select("page_id", "pos", "name", "start", "stop", F.explode("attrs").alias("a"))
    is_directive, is_bound, attr = F.col("a.binding") == "structural", F.col("a.binding") == "boundAttr", F.col("a.name")
    shows = [x.lower() for x in fixed.VISIBILITY_ATTRIBUTES]
    enables = [x.lower() for x in fixed.ENABLEMENT_ATTRIBUTES]
    kind = (F.when(is_directive & (attr == "ngif"), "ngIf").when(is_directive & (attr == "ngswitchcase"), "ngSwitchCase")
            .when(is_directive & ~attr.isin("ngfor", "ngforof"), "customDirective")
            .when(is_bound & attr.isin("hidden", "disabled"), attr).when(is_bound & attr.isin(shows + enables), "permissionDirective"))
    p = t.withColumn("predicate", kind).where("predicate is not null")
    areas = regions_of(tokens(pages), p.where("a.binding = 'structural'")).select("page_id", "pos", "region_stop")
    return p.join(areas, ["page_id", "pos"], "left").select(
        "page_id", F.col("pos").alias("pred_pos"), "predicate", F.when(is_bound & attr.isin(enables), "enabled").otherwise("visible").alias("rules"),
        truncate("a.value", CAP).alias("expr"), F.col("start").alias("from_at"),
        F.when(is_directive, F.coalesce("region_stop", "stop")).otherwise(F.col("stop")).alias("to_at"))


def attach_predicates(pages: DataFrame) -> DataFrame:
    """(widget, predicate) where the widget starts inside the predicate's range."""
    pages = tokenised(pages)
    w = widgets(pages).select("page_id", "widget_id", F.col("start").alias("at"))
    return span_join(w, predicates(pages), ["page_id"], "at", "from_at", "to_at", SPAN_BIN)


def references(expr) -> Column:
    """Identifiers of an expression without keywords, sorted (X11)."""
    found = F.regexp_extract_all(F.col(expr) if isinstance(expr, str) else expr, F.lit(r"\b([A-Za-z_$][A-Za-z0-9_$.]*)\b"), 1)
    return sorted_unique(F.filter(found, lambda x: ~x.isin(fixed.EXPRESSION_KEYWORDS)))


def custom_elements(pages: DataFrame) -> DataFrame:
    """Custom elements per page, distinct."""
    return tags(pages).where(is_custom("name")).select("page_id", "name").distinct()


def composition_context(pages: DataFrame) -> DataFrame:
    """Custom elements with the template, condition and repeater they stand in.

    The last place with any context wins when an element is used several times.
    """
    pages = tokenised(pages)
    c = tags(pages).where(is_custom("name")).select("page_id", "pos", "name")
    templates = regions(tokens(pages), ["ng-template"]).withColumn("yes", F.lit(True))
    c = innermost(c, templates, "yes", "inside_template", inclusive=False)
    c = innermost(c, directive_areas(pages, "ngif"), "expr", "inside_ng_if", inclusive=True)
    c = innermost(c, directive_areas(pages, "ngfor"), "expr", "inside_ng_for", inclusive=True)
    some = c.where("inside_template or inside_ng_if is not null or inside_ng_for is not null")
    return some.groupBy("page_id", "name").agg(F.max_by(F.struct("inside_template", "inside_ng_if", "inside_ng_for"), "pos").alias("x")).select("page_id", "name", "x.*")


def line_and_column(text, offset) -> Column:
    """1-based line and column of an offset."""
    head = F.left(F.col(text) if isinstance(text, str) else text, F.col(offset).cast("int") if isinstance(offset, str) else offset.cast("int"))
    return let(head, lambda h: F.struct((F.length(h) - F.length(F.replace(h, F.lit("\n"), F.lit(""))) + 1).alias("line"),
                                        (F.length(F.substring_index(h, "\n", -1)) + 1).alias("col")))


def ui_properties(pages: DataFrame) -> DataFrame:
    """Literal and expression conditions per widget.

    A literal that hides or disables wins; of the expressions the first non-empty one in
    document order is kept. `hidden` turns its meaning round.
    """
    pages = tokenised(pages)
    w = widgets(pages)
    lit = literal_boolean("expr")
    shows, enables = F.col("rules") == "visible", F.col("rules") == "enabled"
    open_expr = (F.trim("expr") != "") & (lit.isNull() | ~F.col("predicate").isin("ngIf", "hidden", "disabled"))
    conds = attach_predicates(pages).groupBy("page_id", "widget_id").agg(
        F.bool_or(((F.col("predicate") == "ngIf") & (lit == "false")) | ((F.col("predicate") == "hidden") & (lit == "true"))).alias("never"),
        F.min_by("expr", F.when(shows & open_expr, F.struct("pred_pos", "expr"))).alias("visible_expr"),
        F.bool_or((F.col("predicate") == "disabled") & (lit == "true")).alias("off"),
        F.min_by("expr", F.when(enables & open_expr, F.struct("pred_pos", "expr"))).alias("enabled_expr"))
    disabled = F.exists("attrs", lambda a: (a["binding"] == "attr") & (a["name"] == "disabled"))
    hidden = F.exists("attrs", lambda a: (a["binding"] == "attr") & (a["name"] == "hidden") & a["value"].isin("", "true", "hidden"))
    j = w.join(conds, ["page_id", "widget_id"], "left")
    no = F.lit(False)
    return j.select(
        "page_id", "widget_id", (F.coalesce("never", no) | hidden).alias("never_visible"), "visible_expr",
        (F.coalesce("off", no) | disabled).alias("never_enabled"), "enabled_expr",
        F.coalesce(F.try_element_at("attributes", F.lit("class")).rlike(r"(?i)\b(hide|hidden|d-none|visually-hidden|sr-only)\b"), no).alias("css_hidden"))

