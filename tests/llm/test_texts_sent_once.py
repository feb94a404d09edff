"""A text that is both kept and read goes through an Arrow stage once."""

from spendlake.llm.common import map_arrow
from spendlake.llm.decontam import DecontamSettings, decontaminate


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_kept_inputs_are_not_sent_again(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "k bigint, t string, u string")
    out = map_arrow(df, ["k", "t"], ["u", "t"], [("both", "string")], lambda: lambda u, t: (
        [f"{x}|{y}" for x, y in zip(u.to_pylist(), t.to_pylist())],))
    assert "__in1" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "x|a b"), (2, None, "y|None")]


def test_decontamination_sends_a_text_once_and_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en"), (2, None, "de"), (3, "z z", None)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    out = decontaminate(docs, items, DecontamSettings(window=2))
    assert "__text#" in plan(out) and "text, text" not in plan(out) and "__in2" not in plan(out)
    assert out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect())) == [(2, None, "de"), (3, "z z", None)]
