"""String scalars and predicates against an independent Python reading."""

import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepost.functions import predicates as P
from tidepost.functions import text as X

SAMPLES = [
    None, "", "   ", "Jalan macet #Banjir @kota http://t.example/1", "a &amp; b &lt;3 &copy;",
    "\U0001d400\U0001d401\U0001d41a bold", "\U0001d5d4\U0001d7ceＡ", "x y  z\n\nq",
    "emoji 😀 stays? no!", "@a#b#c @@d", "#한국 #tag_1 # x", "httpx://no space", "İstanbul ÉCOLE",
]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def python_clean(text):
    if not text:
        return ""
    bold = {0x1D400 + i: chr(65 + i) for i in range(26)} | {0x1D41A + i: chr(97 + i) for i in range(26)}
    text = html.unescape(text.translate(bold))
    for pattern in (r"http\S+", r"@\w+", r"[^\w\s,.:;!?#\"'-]"):
        text = re.sub(pattern, "", text)
    return " ".join(text.split()).lower()


def test_clean_text_samples(spark):
    assert column(spark, SAMPLES, X.clean_text) == [python_clean(s) for s in SAMPLES]


# characters every engine has known for long, so that letter tables agree
letters = st.text(
    alphabet=st.one_of(
        st.characters(min_codepoint=1, max_codepoint=0x24F),
        st.sampled_from("@#&; \n\t 　한漢カع😀\U0001d400\U0001d41a٣"),
    ),
    max_size=60,
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(letters, min_size=20, max_size=60))
def test_scalars_on_any_text(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    t = F.col("t")
    got = rows.select(
        "i",
        X.clean_text(t).alias("clean"),
        X.hashtags(t).alias("tags"),
        X.words(t).alias("words"),
        X.topic_tokens(t).alias("tokens"),
        P.mostly_latin(t).alias("latin"),
        P.long_enough(t).alias("long"),
        P.good_quality(t).alias("good"),
        P.few_foreign_letters(t).alias("few"),
    ).orderBy("i").collect()
    for text, row in zip(values, got):
        assert row.clean == python_clean(text)
        assert row.tags == re.findall(r"#\w+", text)
        assert row.words == re.findall(r"\w+", text.lower())
        plain = text.lower()
        for pattern in (r"http\S+", r"@\w+", r"#\w+"):
            plain = re.sub(pattern, "", plain)
        assert row.tokens == [
            w for w in re.sub(r"[^\w\s]", " ", plain).split() if len(w) > 2 and w not in X.TOPIC_STOPWORDS
        ]
        known = [ord(c) <= 0x24F or c.isspace() or c.isdigit() for c in text]
        assert row.latin == (bool(text) and sum(known) / len(text) > 0.8)
        assert row.long == (len(re.sub(r"http\S+", "", text).strip()) >= 15)
        body = re.sub(r"@\w+", "", re.sub(r"http\S+", "", text)).strip()
        assert row.good == (
            len(body) >= 15
            and sum(c.isalpha() for c in body) / len(body) >= 0.4
            and not re.search(r"(.)\1{4,}|(..)\2{3,}", body)
            and body.count("\n") <= 5
        )
        foreign = len(re.findall("[가-힯ᄀ-ᇿ一-鿿぀-ヿ؀-ۿ]", "".join(
            c for c, k in zip(text, known) if not k)))
        total = sum(known) + foreign
        assert row.few == (bool(text) and (total == 0 or foreign / total < 0.2))


@pytest.mark.parametrize(
    "label, count, with_point",
    [
        ("15 replies", 15, 15), ("1,234 likes", 1234, 1234), ("3K", 3000, 3000), ("1.2K", 12000, 1200),
        ("2M x", 2000000, 2000000), ("Reply", 0, 0), ("", 0, 0), (None, 0, 0), ("1KM", 0, 0),
        ("K", 0, 0), ("3k", 0, 0), ("1_000", 1000, 1000), ("-5", -5, -5), ("  7\tx", 7, 7),
    ],
)
def test_parse_count(spark, label, count, with_point):
    assert column(spark, [label], X.parse_count) == [count]
    assert column(spark, [label], lambda t: X.parse_count(t, decimal_point=True)) == [with_point]


def test_font_styles(spark):
    styled = "\U0001d400\U0001d433\U0001d5d4\U0001d607\U0001d7ce\U0001d7f5Ａｚ"
    assert column(spark, [styled], X.fold_fonts) == ["Az" + styled[2:]]
    assert column(spark, [styled], lambda t: X.fold_fonts(t, extended=True)) == ["AzAz09Az"]


def test_thresholds(spark):
    assert column(spark, ["한" + "a" * 4, "한" + "a" * 5], P.mostly_latin) == [False, True]
    assert column(spark, ["x" * 14 + " http://a", "x" * 15, None], P.long_enough) == [False, True, False]
    assert column(spark, ["Any", None], lambda t: P.contains_any(t, [])) == [True, True]
    assert column(spark, ["BANJIR", None], lambda t: P.contains_any(t, ["banjir"])) == [True, False]
    assert column(spark, [" Grok ", "x", None], P.account_allowed) == [False, True, True]
    assert column(spark, ["https://x.example/u7"], X.username_of) == ["u7"]


def test_text_column_is_chosen_by_schema(spark):
    both = spark.createDataFrame([("", "b")], "text string, original_text string")
    old = both.select("original_text")
    neither = spark.createDataFrame([(1,)], "i int")
    assert both.select(X.text_column(both.columns)).first()[0] == ""
    assert old.select(X.text_column(old.columns)).first()[0] == "b"
    assert neither.select(X.text_column(neither.columns)).first()[0] == ""


def test_filter_words_and_forms(spark):
    assert column(spark, ["pilpres 2024 di"], X.filter_words) == [["pilpres"]]
    assert column(spark, ["banjir sumatra", "#x"], X.hashtag_form) == ["#banjirsumatra", None]
    assert column(spark, ["a b", "a b c", "#a"], X.prefixed_forms) == [["berita a b", "update a b"], [], []]
    assert column(spark, ["a, ,b ,"], X.split_keywords) == [["a", "b"]]
    assert column(spark, ["#a b~*é"], X.form_encode) == ["%23a+b~%2A%C3%A9"]
