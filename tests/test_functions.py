import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import json_repair, similarity
from foliant.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for i, v in enumerate(values)))
    return df.select(column).first()[0]


C = "c0"


@pytest.mark.parametrize(
    "make, given, wanted",
    [
        (T.normalize_text, "  What\n\tIS  x? ", "what is x?"),  # F1
        (T.key_slug, "Größe & Maß: x²", "groesse_und_mass_x"),  # F2
        (T.key_slug, "---", ""),
        (T.key_slug, "Σ ∩ Δ", ""),
        (T.token_set, "Was ist Größe?", ["was", "ist", "gr", "e"]),  # F7
        (T.sanitize_filename, "Größe: a/b", "Größe_a_b"),  # F10
        (T.page_number, "page_12.png", 12),  # F11
        (T.page_number, "cover.png", None),
        (T.strip_fence, "```json\n{}\n```", "{}"),  # F12
        (T.page_spec, "1-3,5", [0, 1, 2, 4]),  # F18
        (T.page_spec, "5-3", []),
        (T.page_spec, "abc", []),
        (T.rectangle, "1, 2,3,4", [1, 2, 3, 4]),  # F19
        (T.rectangle, "1,2,3", None),
        (T.preview, "x" * 201, "x" * 200 + "..."),  # F23
        (T.ocr_class, "  [ERROR: x", "error"),  # P5
        (T.ocr_class, "[INFO: other]", "info"),
        (T.ocr_class, " ", "empty"),
        (T.valid_candidate, "[INFO: other]", True),  # P7
        (T.valid_candidate, "[ERROR: x]", False),
        (T.wizard_key, "a b: c/d-e", "a_b_c_d_e"),  # F37
        (lambda c: T.has_mojibake(c), "grÃ¼n", True),  # P4
        (lambda c: T.category_code(c)[0], "answer: 12c.", 12),  # F22
        (lambda c: T.category_code(c)[1], "answer: 12c.", "C"),
        (lambda c: T.display_name(c, 2), "collection_3_foo_BAR", "Foo Bar"),  # F6
    ],
)
def test_text(spark, make, given, wanted):
    assert one(spark, make(F.col(C)), given) == wanted


def test_tags_and_keys(spark):
    assert one(spark, T.tag_path("T", "c0", "c1"), "collection_0_DFA_x", "a_kern_teil") == "T::Collection_0_Dfa_X::A_Kern_Teil"  # F4
    assert one(spark, T.sort_key("c0", F.lit("a"), F.lit(100)), 1) == "01_A_100"  # F5
    assert one(spark, T.progress("c0", F.lit(48.0))[1], 5.0) == 2  # 2.5 rounds to even
    assert one(spark, T.stable_id("c0"), "abc") == int("90015098", 16) % 2**31  # F20


REPLIES = [
    ('{"a": "\\Sigma",}', "direct", None),
    ('{"new_cards":[{"front":"f","back":"b"},{"front":"g"', "truncated_recovery", 1),
    ('x\n```json\n[{"front":"f","back":"b"}]\n```', "markdown_fence", 1),
    ('Sure: {"cards": [{"front": "f", "back": "b"}]} bye', "brace_match", 1),
    ('{"front": "f", "back": "b"}', "direct", 1),
    ("", "empty", 0),
    ("nothing", "all_failed", 0),
    ('{"a": "x\\undefined", "new_cards": []}', "direct", 0),
]


@pytest.mark.parametrize("reply, strategy, n", REPLIES)
def test_json(reply, strategy, n):
    name, found = json_repair.read_reply(reply)
    assert name == strategy
    if n is not None:
        assert len(found["new_cards"]) == n


def test_json_udf(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in REPLIES] + [(None,)], "reply string")
    got = df.select(json_repair.parse_reply("reply").alias("p")).select("p.*").collect()
    assert [r["strategy"] for r in got] == [s for _, s, _ in REPLIES] + ["empty"]
    assert json.loads(got[0]["payload"])["a"] == "\\Sigma"
    assert spark.range(1).select(json_repair.canonical_json(F.lit('{"b": 1, "a": [2]}'))).first()[0] == '{"a":[2],"b":1}'


def test_similarity(spark):
    assert similarity.norm_tokens("**Ab­c** <math>x</math>, (1.5) ﬁn") == ["abc", "x", "1.5", "fin"]
    assert similarity.order_score(["a", "b", "c"], ["a", "x", "c"]) == pytest.approx(2 / 3)
    hit = similarity.near_value()
    df = spark.createDataFrame([("Sum " + "x" * 87 + " 7", "Sum", "7"), ("Sum " + "x" * 88 + " 7", "Sum", "7"), ("SUM: 7,5 7", "sum", "7"), ("none 7", "Sum", "7")], "t string, l string, v string")
    assert [r[0] for r in df.select(hit("t", "l", "v")).collect()] == [True, False, True, False]
    assert spark.range(1).select(similarity.close_names(["apple", "ape", "zebra"])(F.lit("appel"))).first()[0][0] == "apple"
