from pyspark.sql import functions as F

from loomgraph.functions import scalar as sc


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()], F.lit(0).alias("zero"))
    return row.select(expr.alias("r")).first()["r"]


def test_published_hash_vectors(spark):
    for text, digest in {"": "811c9dc5", "a": "e40c292c", "foobar": "bf9cf968"}.items():
        assert one(spark, sc.fnv1a32_hex("x"), x=text) == digest


def test_hash_works_on_utf16_units(spark):
    h = 0x811C9DC5
    for unit in (0xD83D, 0xDE00):
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    assert one(spark, sc.fnv1a32_hex("x"), x="\U0001F600") == f"{h:08x}"


def test_suffix_is_cut_from_the_unpadded_hash(spark):
    assert one(spark, sc.fnv1a32_suffix("x"), x="foobar") == "bf9c"


def test_truncate(spark):
    assert one(spark, sc.truncate("x", 5), x="abcdef") == "abcd…"
    assert one(spark, sc.truncate("x", 5), x="abcde") == "abcde"


def test_paths(spark):
    for parent, child, want in [("/", "", "/"), ("/", "a", "/a"), ("/a/", "b", "/a/b"), ("/a", "", "/a"), ("/a", "**", "/a/**")]:
        assert one(spark, sc.join_path("p", F.col("c")), p=parent, c=child) == want
    assert one(spark, sc.redirect_path("x", F.lit("/a")), x="/b/") == "/b"
    assert one(spark, sc.redirect_path("x", F.lit("/a")), x="b") == "/a/b"
    assert one(spark, sc.path_params("x"), x="/u/:z/p/:a/:z") == ["a", "z"]


def test_substitution_replaces_the_first_place_only(spark):
    df = spark.sql("select '/a/:id/b/:id' as p, map('id', '7') as m")
    assert df.select(sc.substitute_params("p", "m").alias("r")).first()["r"] == "/a/7/b/:id"


def test_entity_family(spark):
    assert one(spark, sc.entity_family("x", F.lit("id")), x="/owners/:id/edit") == "owners"
    assert one(spark, sc.entity_family("x", F.lit("id")), x="/:id") == ":id"
    assert one(spark, sc.entity_family("x", F.lit("id")), x="/") == "root"


def test_generic_classes(spark):
    assert one(spark, sc.all_classes_generic("x"), x="btn col-md-4  p-2")
    assert not one(spark, sc.all_classes_generic("x"), x="btn hero")


def test_short_name(spark):
    got = one(spark, sc.short_test_name("x"), x="a.ts#HeroComponent|h.html:1:2|Button|0::WIDGET_TRIGGERS_HANDLER::c::0")
    assert got.endswith("_HeroComponent_WTH") and len(got.split("_")[0]) == 8
