from __future__ import annotations

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import decoding
from parchmill.functions import text as tx
from parchmill.operators.answer import answer
from parchmill.operators.summarize import summarize

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strip_equals_unicode_strip(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [s + "a" + s + "b" + s for s in spaces] + ["", " ", "a", "​a​", "a\n\n"]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    assert column(spark, values, tx.is_blank) == [v.strip() == "" for v in values]


def test_extension(spark):
    names = ["a.PDF", "x.tar.gz", ".txt", "..a.b", "a.", "noext", "dir.x/file", "a b.Docx", "...", ".a.txt", "d/e.TXT", ""]
    assert column(spark, names, tx.extension) == [os.path.splitext(n)[1].lower() for n in names]


def test_question_normalization(spark):
    values = ["\twhy", "why ", "why?", "", "why? "]
    assert column(spark, values, tx.normalize_question) == ["why?", "why?", "why?", "?", "why?"]


def test_decode(spark):
    values = ["Привет".encode(), "Привет, мир".encode("cp1251"), b"\x98\xff", b"", b"ascii", bytes(range(0xC0, 0x100))]
    got = column(spark, values, decoding.decode_text, "binary")
    assert got == ["Привет", "Привет, мир", "", "", "ascii", bytes(range(0xC0, 0x100)).decode("cp1251")]


def test_decode_every_single_byte_pair(spark):
    values = [bytes([b, 0x41, b]) for b in range(256)]

    def reference(raw):
        for encoding in ("utf-8", "cp1251"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                pass
        return ""

    assert column(spark, values, decoding.decode_text, "binary") == [reference(v) for v in values]


def test_chunks(spark):
    values = ["x" * n for n in (0, 1, 511, 512, 513, 1024, 1025)] + ["a" * 511 + "😀" + "b" * 600, "\n" * 600]
    want = [[v[i : i + 512] for i in range(0, len(v), 512)] or [""] for v in values]
    assert column(spark, values, tx.chunks) == want


@FEW
@given(st.lists(st.text(alphabet="ab \n😀é", max_size=1200), min_size=1, max_size=5))
def test_chunks_give_back_the_text(spark, values):
    assert column(spark, values, lambda c: F.array_join(tx.chunks(c), "")) == values


def model_summary(text):
    """The summary rule, row by row in Python."""
    import re

    body = " ".join(text.split(" ")[:1023])
    found = []
    for s in re.split(r"[.!?]+[ \t\r\n]+|[\r\n]+", body):
        words = [w for w in re.split(r"[\W_]+", s.lower()) if w]
        if words:
            found.append((s, words))
    tf = {}
    for _, words in found:
        for w in words:
            tf[w] = tf.get(w, 0) + 1
    ranked = sorted(
        range(len(found)), key=lambda i: (-(sum(tf[w] for w in found[i][1]) * 1_000_000 // len(found[i][1])), i)
    )
    kept, cum = [], 0
    for rank, i in enumerate(ranked):
        n = len(found[i][1])
        if rank == 0 or (cum < 40 and cum + n <= 250):
            kept.append(i)
        cum += n
    return " ".join(
        " ".join(found[i][0].split(" ")[:250]) if len(found[i][1]) > 250 else found[i][0] for i in sorted(kept)
    )


@FEW
@given(
    st.lists(
        st.lists(st.sampled_from(["a", "b", "c", "dd", "e.", "f!", "g\n", "Ä", "x1", "--"]), max_size=300).map(" ".join),
        min_size=1,
        max_size=8,
    )
)
def test_summary_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.summary for r in summarize(df).orderBy("i").collect()]
    assert got == [model_summary(t) for t in texts]


def test_summary_cuts_an_overlong_sentence(spark):
    long = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(long,), ("",), ("... !",)], "text string")
    rows = summarize(df).collect()
    assert rows[0].summary == " ".join(f"w{i}" for i in range(250))
    assert [(r.summary, r.ok) for r in rows[1:]] == [("", False), ("", False)]


def test_answers(spark):
    context = "Nothing here. The cat sat on the mat. It was warm. " + "And so on. " * 30
    rows = [(context, "where is the cat"), (context, "zebra"), ("", "cat"), ("ab. cat", "cat")]
    df = spark.createDataFrame(rows, "text string, question string")
    got = answer(df).collect()
    assert got[0].answer.startswith("The cat sat on the mat It was warm And so on")
    assert got[0].score == 2 and got[0].ok
    assert [(r.answer, r.ok) for r in got[1:]] == [(S.ANSWER_NOT_FOUND, False)] * 3


def test_context_beyond_the_limit_is_not_searched(spark):
    df = spark.createDataFrame([("x" * 2997 + ". " + "needle in here", "needle")], "text string, question string")
    assert answer(df).first().answer == S.ANSWER_NOT_FOUND
