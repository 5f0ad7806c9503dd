from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfix.config import SpellConfig
from textfix.functions import completions, text


def test_tokens_rebuild_the_text(apply):
    rows = ["a  b\n c", " x ", "", "\t", "one", "a b c", "a\x1cb"]
    out = apply(text.tokens, rows)
    assert ["".join(t) for t in out] == rows
    assert out[5] == ["a", " ", "b", " ", "c"]
    assert out[6] == ["a", "\x1c", "b"]


def test_peel(apply):
    rows = ['"Hi!"', "(ORD-99)", "«été»", "...", "don't,", "__x__", "日本。"]
    assert apply(text.peel, rows) == [
        ('"', "Hi", '!"'), ("(", "ORD-99", ")"), ("«", "été", "»"), ("...", "", ""),
        ("", "don't", ","), ("", "__x__", ""), ("", "日本", "。"),
    ]


def test_peel_protect_knows_only_its_own_marks(apply):
    rows = ['"Hi!"', "(ORD-99)", "«été»", "...", "don't,", "(((", "[a.b]."]
    assert apply(text.peel_protect, rows) == [
        ('"', "Hi", '!"'), ("(", "ORD-99", ")"), ("", "«été»", ""), ("", "", "..."),
        ("", "don't", ","), ("(((", "", ""), ("[", "a.b", "]."),
    ]


def test_correctable(apply):
    rows = ["hi", "NASA", "RECIEVE", "ABCDE", "ABCDEF", "v2.3", "a@b.com", "it's", "well-known",
            "Kevin", "a--b", "-ab", "abc_", "été"]
    assert apply(text.is_correctable, rows) == [
        False, False, True, False, True, False, False, True, True, True, False, False, False, False
    ]
    strict = SpellConfig(correct_capitalized=False)
    # A long shouted word is allowed before the capitals rule is asked.
    assert apply(lambda c: text.is_correctable(c, strict), ["Kevin", "kevin", "RECIEVE"]) == [
        False, True, True
    ]


def test_plain_cores_equal_peel_and_test(apply, spark):
    line = "«it's» Well-known, a--b x_y 3pm (Hi!) ---  co-\tO'Neil's éa naïve B"
    toks = apply(text.words, [line])[0]
    peeled = [p[1] for p in apply(text.peel, toks)]
    plain = apply(text.is_plain_word, peeled)
    assert apply(text.plain_cores, [line])[0] == [c for c, ok in zip(peeled, plain) if ok]


def test_very_long_tokens(apply):
    long = "a-" * 50_000 + "a"
    assert apply(text.is_plain_word, [long, long + "-"]) == [True, False]
    assert [len(x) for x in apply(text.plain_cores, [long])] == [1]


def test_structured(apply):
    yes = ["a@b", "#tag", "HTTP://x", "www.x", "s3://b", "and/or", "v2", "x²", "a①", "team.io",
           "node.js", "٣"]
    no = ["", "e.g", "a.m", "hello", "a#b", "x.toolongtld"]
    assert all(apply(text.is_structured, yes))
    assert not any(apply(text.is_structured, no))


def test_match_case(apply):
    rows = [("TEH", "the"), ("Teh", "the"), ("teh", "the"), ("A", "ab"), ("tEH", "the"), ("1", "x")]
    assert apply(text.match_case, rows, "a string, b string") == [
        "THE", "The", "the", "AB", "the", "x"
    ]


def test_normalize(apply):
    rows = ["a. .", None, " A\t b  ", "Hi!!", "..", "x ?"]
    assert apply(text.normalize, rows) == ["a.", "", "a b", "hi", "", "x"]


def test_sentences(apply):
    rows = ["..Hi a@b.com now! ok", "", "a.\n\n b?! ", None]
    assert apply(text.sentences, rows) == [["Hi a@b.", "com now!", "ok"], [], ["a.", "b?!"], None]


def test_negation_count(apply):
    rows = ["I don’t know", "dont", "Not nothing", "wouldve", "knot", "can`t", "", "don t"]
    assert apply(text.negation_count, rows) == [1, 1, 2, 1, 0, 1, 0, 0]


def test_replace_first_is_literal(apply):
    rows = [("a.b a.b", "a.b", "$1"), ("xyz", "q", "r"), ("aaa", "a", ""), ("abc", "c", "d")]
    assert apply(text.replace_first, rows, "a string, b string, c string") == [
        "$1 a.b", "xyz", "aa", "abd"
    ]


def test_clean_completion(apply):
    rows = ["<think>a\nb</think>\n Corrected: 'Hi there.'\nmore", "\n\n", "“x”", '"', "Answer - ok",
            "correction:fine", "a b", None, "<think>open", '"a" and b']
    assert apply(completions.clean_completion, rows) == [
        "Hi there.", "", "x", '"', "ok", "fine", "a", None, "<think>open", '"a" and b'
    ]


def test_chat_messages(apply):
    out = apply(lambda c: completions.chat_messages(c, "sys"), ["hi"])
    assert out == [[("system", "sys"), ("user", "hi")]]


def test_word_count_ignores_edges(apply):
    assert apply(text.word_count, [" a  b ", "", "\n"]) == [2, 0, 0]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="aB -'.\n\t(é_1", max_size=25), min_size=200, max_size=200))
def _check_tokens(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    bad = df.where(F.array_join(text.tokens(F.col("a")), "") != F.col("a"))
    assert bad.count() == 0


def test_tokens_rebuild_random_texts(spark):
    _check_tokens(spark)


def test_patterns_of_words_match_as_their_plain_forms(apply):
    chars = ["a", "b-'", "Zé9", "_.", "(“", "😀ß", "\x00\x7f", "\x80\x84", *text.WS_CHARS, *"    "]
    texts = ["".join(chars[(i * k + k * k) % len(chars)] for k in range(1, 30)) for i in range(300)]
    ws, mark = text.WS, f"[^{text.WORD}{text.WS}]*+"
    plain = {
        text.WORD_RE: f"[^{ws}]+", text.TOKEN_RE: f"[{ws}]+|[^{ws}]+", text.PIECE_RE: f"[^{ws}]+[{ws}]*+|[{ws}]+",
        text.PLAIN_CORE_RE: rf"(?<![^{ws}]){mark}({text.PLAIN_BODY}){mark}(?![^{ws}])",
    }
    for new, old in plain.items():
        found = [apply(lambda x: F.regexp_extract_all(x, F.lit(p), F.lit(0)), texts) for p in (new, old)]
        assert found[0] == found[1] and any(found[0])
