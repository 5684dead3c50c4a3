import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions import toon as TN
from parchmill.operators import render as R

STRINGS = {
    "barge": "barge",
    "rope,tar": '"rope,tar"',
    "tide:low": '"tide:low"',
    "pier[9]": '"pier[9]"',
    "fog\nrain": '"fog\\nrain"',
    "D:\\dock": '"D:\\\\dock"',
    'the "old" quay': '"the \\"old\\" quay"',
    "  inland": '"  inland"',
    "": '""',
    "bow\tstern": '"bow\\tstern"',
    "là": '"là"',
    "café": "café",
    "x-y": '"x-y"',
    "Fog over the quay": "Fog over the quay",
}


def test_strings(evaluate):
    assert evaluate(list(STRINGS), TN.toon_string) == list(STRINGS.values())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab ,:"\\\n\r\t-é[]{}|', max_size=12), min_size=40, max_size=80))
def test_quoting_round_trips(evaluate, values):
    for value, shown in zip(values, evaluate(values, TN.toon_string)):
        assert (json.loads(shown) if shown.startswith('"') else shown) == value


def test_numbers(evaluate):
    cases = [
        (42.0, "42"), (-123.0, "-123"), (0.0, "0"), (-0.0, "0"), (19.99, "19.99"), (1.0, "1"), (1e10, "10000000000"),
        (12345678.9012, "12345678.9012"), (1e-7, "0.0000001"), (1.5e-10, "0.00000000015"), (1e21, "1" + "0" * 21),
        (math.nan, "null"), (math.inf, "null"), (-math.inf, "null"), (-2.5e8, "-250000000"), (None, "null"),
    ]
    assert evaluate([c[0] for c in cases], TN.toon_double, "double") == [c[1] for c in cases]
    assert evaluate([42, -123, 0], lambda c: TN.toon_number(c, T.LongType()), "bigint") == ["42", "-123", "0"]
    assert evaluate([True, False, None], TN.toon_bool, "boolean") == ["true", "false", "null"]


def test_objects_keep_field_order_and_quote_keys(spark):
    df = spark.range(1).select(
        F.struct(
            F.lit("https://example.com").alias("url"),
            F.lit("Article Title").alias("title"),
            F.lit(12345).alias("length"),
            F.lit("value").alias("url:with:colon"),
            F.struct(F.lit(1).alias("n"), F.struct(F.lit("x").alias("deep")).alias("in")).alias("nested"),
        ).alias("o")
    )
    text = df.select(TN.toon_value(F.col("o"), df.schema["o"].dataType)).first()[0]
    assert text == (
        'url: "https://example.com"\ntitle: Article Title\nlength: 12345\n"url:with:colon": value\n'
        "nested:\n  n: 1\n  in:\n    deep: x"
    )


def test_arrays(spark):
    df = spark.range(1).select(
        F.array(F.lit("a"), F.lit("b,c")).alias("strings"),
        F.array().cast("array<int>").alias("none"),
        F.expr("array(named_struct('url', 'u:1', 'n', 1), named_struct('url', 'v', 'n', cast(null as int)))").alias("rows"),
    )
    shown = df.select(*[TN.toon_value(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert shown["strings"] == '2:\n  - a\n\n  - "b,c"\n'
    assert shown["none"] == "0"
    assert shown["rows"] == 'results[2]{url,n}:\n  "u:1",1\n  v,null'


def test_table_parts_make_one_table(spark):
    df = spark.range(25).select(F.col("id").alias("pos"), F.lit("g").alias("g"), F.concat(F.lit("t,"), "id").alias("title"))
    parts = R.toon_table(df, ["title"], ["g"], rows_per_part=10).orderBy("part").collect()
    assert len(parts) == 3
    lines = "".join(p.toon for p in parts).split("\n")
    assert lines[0] == "results[25]{title}:"
    assert lines[1:] == [f'  "t,{i}"' for i in range(25)]
