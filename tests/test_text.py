from __future__ import annotations

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.script import PAIRS, SINGLES, normalize, normalize_text, tokens
from tessella.operators import text
from tessella.sources import lexicon, vocabulary


def scan(s: str) -> str:
    """From left to right: pairs, then single characters, else the character itself."""
    out, i = [], 0
    while i < len(s):
        if s[i : i + 2] in PAIRS:
            out.append(PAIRS[s[i : i + 2]])
            i += 2
        else:
            c = s[i].lower() if s[i].isascii() else s[i]
            out.append(SINGLES.get(c, s[i]))
            i += 1
    return "".join(out)


@given(st.text(alphabet="23456789'6abcpvxCPVXeE 01غ", max_size=20))
def test_normalize_is_a_scan(s):
    assert normalize_text(s) == scan(s)


def test_normalize_column(spark):
    texts = ["", "3'a7'", "6' 37'", "cpvx CPVX 01", "Salam 3alikom", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize(F.col("t"))).collect()
    assert [r[1] for r in rows] == [None if r[0] is None else scan(r[0]) for r in rows]


def test_tokens(spark):
    t = "a.b,c\td\x0be  ..f!é-g_h"
    assert spark.createDataFrame([(t,)], "t string").select(tokens(F.col("t"))).first()[0] == ["a", "b", "c", "d", "e", "f", "é", "g", "h"]


def brute_matches(n: str, patterns: list[str]) -> list[tuple[str, int, int]]:
    out = [(p, i, i + len(p)) for p in patterns for i in range(len(n) - len(p) + 1) if n.startswith(p, i)]
    return sorted((p, len(n[:a].encode()), len(n[:b].encode())) for p, a, b in out)


PATTERNS = ["اب", "اباب", "ب", "بب", "اب", "latin"]


def test_all_matches_overlap_and_repeat(spark):
    docs = spark.createDataFrame([(1, "ababab b latin"), (2, ""), (3, None), (4, "xyz")], "doc_id long, text string")
    rows = text.all_matches(docs, PATTERNS).collect()
    assert sorted((r[1], r[2], r[3]) for r in rows if r[0] == 1) == brute_matches(normalize_text("ababab b latin"), PATTERNS)
    assert {r[0] for r in rows} == {1}


def test_first_match_is_earliest_end_then_longest(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "b"), (3, "latin"), (4, None), (5, "")], "doc_id long, text string")
    want = {1: "اب", 2: "ب", 3: None, 4: None, 5: None}
    assert {r["doc_id"]: r["matched_pattern"] for r in text.with_first_match(docs, PATTERNS).collect()} == want
    many = [*PATTERNS, *(f"zz{k}" for k in range(5000))]
    assert {r["doc_id"]: r["matched_pattern"] for r in text.with_first_match(docs, many).collect()} == want


def test_token_retry_is_redundant():
    s = normalize_text("ab abab")
    assert any(p in s for p in PATTERNS) == (any(p in s for p in PATTERNS) or any(p in t for t in s.split() for p in PATTERNS))


def test_normalized_lexicon(spark):
    lex = lexicon.from_dict(spark, {"A": ["scum"]})
    assert text.pattern_list(lex) == ["scum"]
    assert text.pattern_list(lex, "normalized") == [normalize_text("scum")]


def test_semantic_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, " ... "), (3, "xx"), (4, "zero"), (5, "zero zero up"), (6, None)], "doc_id long, text string")
    words = spark.createDataFrame([(normalize_text("zero"), 0.0), (normalize_text("up"), 0.3)], "word string, weight double")
    gated = {r["doc_id"]: r for r in text.semantic_gate(text.semantic_scores(docs, words), 0.9).collect()}
    assert not gated[1]["is_valid"] and not gated[6]["is_valid"]
    assert (gated[2]["is_valid"], gated[2]["score"]) == (True, 0.0)
    assert gated[3]["score"] == 0.001
    assert (gated[4]["score"], gated[4]["flagged"], gated[4]["category"]) == (0.5, True, "NONE")
    report = {r["doc_id"]: r for r in text.moderate_text(docs, [], words, 0.9).collect()}
    assert (report[4]["is_safe"], report[4]["violation_type"]) == (False, "NONE")
    assert report[1]["is_safe"] and report[1]["risk_score"] == 0.0


def test_rows_are_judged_by_themselves(spark):
    """Keys that repeat or are null share nothing."""
    rows = [(1, "zero up"), (1, "xx"), (None, "up"), (None, "scum"), (None, None), (2, ""), (2, "up up zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([(normalize_text("zero"), -2.0), (normalize_text("up"), 1.0)], "word string, weight double")
    sigmoid = lambda x: 1 / (1 + 2.718281828459045**-x)
    want = [("1", sigmoid(-0.5)), ("1", 0.001), ("None", sigmoid(1.0)), ("None", 0.001), ("None", 0.0), ("2", 0.0), ("2", sigmoid(0.0))]
    got = [(str(r["doc_id"]), round(r["score"], 9)) for r in text.semantic_scores(docs, words).collect()]
    assert sorted(got) == sorted((k, round(s, 9)) for k, s in want)
    report = text.moderate_text(docs, [normalize_text("scum")], words, 0.5).collect()
    assert sorted((str(r["doc_id"]), r["is_safe"], r["violation_type"]) for r in report) == sorted(
        [("1", True, "NONE"), ("1", True, "NONE"), ("None", False, "PROFANITY_SEMANTIC"), ("None", False, "PROFANITY_EXACT"), ("None", True, "NONE"), ("2", True, "NONE"), ("2", False, "PROFANITY_SEMANTIC")]
    )


def test_one_pass(spark, tmp_path):
    """No shuffle, join, union or second scan, and one transliteration, also below a filter on the result."""
    spark.createDataFrame([(1, "abab")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    words = spark.createDataFrame([("up", 1.0)], "word string, weight double")
    for df in (text.moderate_text(docs, PATTERNS, words), text.semantic_scores(docs, words), text.with_first_match(docs, PATTERNS).where("matched_pattern is not null")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("translate(") <= 1
        assert not any(word in plan for word in ("Exchange", "Join", "Union"))


def test_exact_match_prevails(spark):
    docs = spark.createDataFrame([(1, "scum")], "doc_id long, text string")
    r = text.moderate_text(docs, [normalize_text("scum")], vocabulary.neutral_scores(spark), 0.5).first()
    assert (r["is_safe"], r["risk_score"], r["violation_type"], r["matched_pattern"]) == (False, 1.0, "PROFANITY_EXACT", normalize_text("scum"))


def test_tolerant_lexicon():
    parse = lexicon.parse_tolerant
    assert parse("") is None and parse("[1]") is None
    assert parse('{"a": ["x", "y"], "b": ["z"') == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    assert parse('{"a": ["x", 3]}') == [("a", 0, "x")]
    assert parse('{"a": ["", "\\u0041", "q\\"\\n"]}') == [("a", 0, "u0041"), ("a", 1, 'q"\n')]
    assert parse('{"": ["x"]}') == []
    assert parse("{}") == []


def test_read_lexicon(spark, tmp_path):
    path = tmp_path / "lex.json"
    path.write_text(json.dumps(lexicon.NEUTRAL, ensure_ascii=False))
    want = sorted((c, k, p) for c, ps in lexicon.NEUTRAL.items() for k, p in enumerate(ps))
    assert sorted(map(tuple, lexicon.read_lexicon(spark, str(path)).collect())) == want
    assert sorted(map(tuple, lexicon.read_lexicon(spark, str(path), tolerant=True).collect())) == want
    assert lexicon.load_status(spark, str(path)) and not lexicon.load_status(spark, "") and not lexicon.load_status(spark, str(tmp_path / "none"))
    assert lexicon.add_keywords(lexicon.read_lexicon(spark, str(path)), ["k", ""]).count() == len(want) + 1


def test_model_file(spark, tmp_path):
    data = vocabulary.write_model([("a", [1, -2]), ("b", [3, 4]), ("a", [9, 9])], 0.25)
    (tmp_path / "good.bin").write_bytes(data + b"more")
    (tmp_path / "short.bin").write_bytes(data[:-1])
    (tmp_path / "magic.bin").write_bytes(b"XXXX" + data[4:])
    rows = vocabulary.read_model(spark, str(tmp_path)).collect()
    assert {(r["word"], tuple(r["weights"]), r["threshold"]) for r in rows} == {("a", (1, -2), 0.25), ("b", (3, 4), 0.25)}
    assert {r["word"]: r["weight"] for r in vocabulary.word_scores(vocabulary.read_model(spark, str(tmp_path))).collect()} == {"a": -1 / 127, "b": 7 / 127}
