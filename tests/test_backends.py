from __future__ import annotations

from parchmill import schemas as S
from parchmill.operators.answer import answer
from parchmill.operators.backends import first_loadable
from parchmill.operators.summarize import summarize
from parchmill.operators import translate as translate_module
from parchmill.operators.translate import IDENTITY, INLINE_LEXICON_ROWS, Translator, translate


def shouting():
    """A model that cannot stand the word bad."""

    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    return model


def missing():
    raise FileNotFoundError("no weights")


def test_one_bad_text_costs_one_row(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "c")], "i int, text string").coalesce(1)
    got = {r.i: (r.summary, r.ok) for r in summarize(df, model=shouting).collect()}
    assert got == {1: ("SUMMARIZE: A B", True), 2: (S.SUMMARY_FAILED, False), 3: ("SUMMARIZE: C", True)}


def test_a_model_that_does_not_load_fails_every_row(spark):
    df = spark.createDataFrame([("a", "q")], "text string, question string")
    assert summarize(df, model=missing).select("summary", "ok").first() == (S.SUMMARY_FAILED, False)
    assert translate(df, Translator(model=missing)).select("translation", "ok").first() == ("a", False)
    told = answer(df, model=missing).select("answer", "ok").first()
    assert told == (S.ANSWER_FAILED, False)


def test_second_place_to_load_from(spark):
    df = spark.createDataFrame([("a",)], "text string")
    assert summarize(df, model=first_loadable(missing, shouting)).first().summary == "SUMMARIZE: A"
    assert not summarize(df, model=first_loadable(missing, missing)).first().ok


def test_models_load_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def factory():
        loads.add(1)
        return lambda texts: list(texts)

    df = spark.range(0, 5000, 1, 2).selectExpr("cast(id as string) as text")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "100")
    try:
        assert summarize(df, model=factory).filter("ok").count() == 5000
    finally:
        spark.conf.unset(key)
    assert loads.value == 2


def test_translation_chunks(spark):
    texts = ["x" * 512, "y" * 513, "", "a" * 600 + "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.translation for r in translate(df, IDENTITY).orderBy("i").collect()] == [
        texts[0], "y" * 512 + " y", "", "a" * 512 + " " + "a" * 88 + "bad",
    ]
    rows = translate(df, Translator(model=shouting)).orderBy("i").collect()
    assert [(r.translation, r.ok) for r in rows] == [
        ("X" * 512, True), ("Y" * 512 + " Y", True), ("", True), (texts[3], False),
    ]


def test_small_and_large_lexicons_agree(spark):
    df = spark.createDataFrame(
        [(1, "The cat, the dog.\nTHE end"), (2, "nothing known"), (3, ""), (4, "cat " * 300), (5, "cat " * 300)], "i int, text string"
    )
    small = [("the", "этот"), ("cat", "кот"), ("dog", "пёс")]
    large = small + [(f"word{i}", f"w{i}") for i in range(INLINE_LEXICON_ROWS)]
    for chunk_chars in (None, 512):
        got = [
            {r.i: r.translation for r in translate(df, Translator(lexicon=spark.createDataFrame(x, "src string, tgt string")), chunk_chars=chunk_chars).collect()}
            for x in (small, large)
        ]
        assert got[0] == got[1]
        assert got[0][1] == "этот кот, этот пёс.\nэтот end"


def test_answer_is_translated_both_ways(spark):
    there = Translator(lexicon=spark.createDataFrame([("кот", "cat")], "src string, tgt string"))
    back = Translator(lexicon=spark.createDataFrame([("cat", "кот")], "src string, tgt string"))
    df = spark.createDataFrame([("Это кот дома.", "Где кот")], "text string, question string")
    assert answer(df, to_model=there, from_model=back).first().answer == "Это кот дома."


def test_lexicon_keys_do_not_depend_on_its_size(spark):
    df = spark.createDataFrame([(1, "one, two 42 İx"), (2, None)], "i int, text string")
    own = [(", ", "; "), ("one", "uno"), (" 42 ", " N "), ("i̇x", "Q"), (None, "void"), ("two", None)]
    filler = [(f"filler{i}", "x") for i in range(INLINE_LEXICON_ROWS + 10)]
    texts = []
    for entries in (own, own + filler):
        lexicon = spark.createDataFrame(entries, "src string, tgt string")
        texts.append({r.i: r.translation for r in translate(df, Translator(lexicon=lexicon)).collect()})
    assert texts[0] == texts[1] and texts[0][1] == "uno; two N Q"


def test_blocks_of_a_lexicon_are_independent(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "42"), (5, "one\n" * 700)], "i int, text string")
    # A target that is a source elsewhere is not looked up again.
    entries = [("one", "two"), ("two", "three"), ("three", "one")] + [(f"filler{i}", "x") for i in range(400)]
    lexicon = spark.createDataFrame(entries, "src string, tgt string")
    texts = []
    for size in (250_000, 50):
        monkeypatch.setattr(translate_module, "BLOCK_ENTRIES", size)
        done = translate(df, Translator(lexicon=lexicon))
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
        texts.append({r.i: r.translation for r in done.collect()})
    assert texts[0] == texts[1] and texts[0][1] == "two three one" and texts[0][2] is None


def test_a_large_lexicon_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "i int, text string")
    df.write.parquet(str(tmp_path / "in"))
    lexicon = spark.createDataFrame([("one", "uno")] + [(f"filler{i}", "x") for i in range(400)], "src string, tgt string")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = translate(stream, Translator(lexicon=lexicon)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.i: r.translation for r in out} == {1: "uno two", 2: None, 3: ""}


def test_the_text_of_a_failed_model_is_not_translated(spark):
    df = spark.createDataFrame([(1, "a context", "why")], "i int, text string, question string")
    row = answer(df, model=missing, from_model=Translator(model=shouting)).first()
    assert (row.answer, row.ok) == (S.ANSWER_FAILED, False)


def test_null_text_is_not_ok(spark):
    assert summarize(spark.createDataFrame([(None,)], "text string")).first().ok is False


def test_a_batch_meets_the_blocks_of_a_lexicon_one_by_one(spark, monkeypatch):
    """What a worker is given and gives back does not grow with the number of blocks."""
    df = spark.createDataFrame([(1, "one word299 word7"), (2, "")], "i int, text string")
    lexicon = spark.createDataFrame([("one", "uno")] + [(f"word{i}", f"w{i}") for i in range(300)], "src string, tgt string")
    lookups = []
    for size in (1000, 20):
        monkeypatch.setattr(translate_module, "BLOCK_ENTRIES", size)
        done = translate(df, Translator(lexicon=lexicon))
        lookups.append(done._jdf.queryExecution().optimizedPlan().toString().count("look_up("))
        # Digits are no letters: the gap between two words.
        assert {r.i: r.translation for r in done.collect()} == {1: "uno word299 word7", 2: ""}
    assert lookups[0] == lookups[1] > 0
