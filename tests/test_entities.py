"""Entities undone in one pass, against the standard library."""

import html
import random

from pyspark.sql import functions as F

from quarrylake.functions import scalars


def test_entities(spark):
    r = random.Random(1)
    parts = ["&amp;", "&amp", "&lt;", "&hellip;", "&eacute;", "&notit;", "&notin;", "&#38;lt;", "&#x26;", "&#0;", "&#13;", "&#128;", "&#x9f;", "&#x110000;", "&#xD800;", "&#11;", "&#65", "&#x41g", "&#", "&#x;", "&;", "& ", "&unknown;", "&copycat", "&#99999999999;", "&#128512;", "x", " ", ";", "é", "&#xFFFE;", "&#000065;", "&NotEqualTilde;", "&a"]
    texts = parts + ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(300)] + ["", "plain"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", scalars.unescaped(F.col("x")).alias("u")).orderBy("i").collect()
    assert [(t, g.u) for t, g in zip(texts, got, strict=True)] == [(t, html.unescape(t)) for t in texts]
    assert spark.createDataFrame([(None,)], "x string").select(scalars.unescaped(F.col("x"))).first()[0] is None
    link = spark.createDataFrame([("　https://a.b/?x=1&amp;y=2)。",)], "x string").select(scalars.normal_url(F.col("x"))).first()[0]
    assert link == "https://a.b/?x=1&y=2"
