"""Behaviour of the search operators on small tables with literal expected values."""

import pytest
from pyspark.sql import functions as F
from sparkseek.conf import Analyzer, EngineConf
from sparkseek.functions import present
from sparkseek.functions.normalize import normalize, normalize_text, normalize_with_offsets
from sparkseek.functions.romaji import reads_as, to_romaji
from sparkseek.functions.stem import stem
from sparkseek.functions.tokenize import analyzer_of, query_terms, tokenize, tokenize_with, tokens_column
from sparkseek.operators import jsonsearch as J
from sparkseek.operators import predicates as P
from sparkseek.operators import vectors as V
from sparkseek.operators.index import build_index
from sparkseek.operators.predicates import Condition
from sparkseek.plans.query import QuerySyntaxError, extract_keywords, parse
from sparkseek.plans.script import ScriptSyntaxError
from sparkseek.plans.spread import spread
from sparkseek.sources.select import select
from sparkseek.sources.store import IndexStore, ReadOnly

MEMOS = [(1, "Postbase is a RDBMS."), (2, "Rustle is a (fast) full text search engine."), (3, "PRustle is a Postbase extension that uses Rustle."), (4, None)]


@pytest.fixture(scope="module")
def memos(spark):
    return spark.createDataFrame(MEMOS, "id long, content string")


@pytest.fixture(scope="module")
def index(memos):
    return build_index(memos, "id", ["content"])


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


C = lambda: F.col("content")


def test_substring_on_scan_and_tokens_on_index(memos, index):
    assert ids(memos.filter(P.match(C(), "rustle"))) == [2, 3]
    titles = build_index(memos.sparkSession.createDataFrame([(1, "Postbase"), (2, "Rustle"), (3, "PRustle")], "id long, t string"), "id", ["t"])
    assert scores(titles.search("rustle")) == {2: 1.0}


@pytest.mark.parametrize(
    "query, expected",
    [("PRustle OR Rustle", [2, 3]), ("rustle -prustle", [2]), ("rdbms OR extension", [1, 3]), ("rustle OR rdbms -prustle", [1, 2]), ('"full text"', [2]), ("(Rustle", [2]), ("", []), ("  ", []), ("-rustle", [1]), ("exten*", [3]), ("+rustle +uses", [3]), ("rustle OR", []), ("\\-rustle", [])],
)
def test_query_language_on_scan(memos, query, expected):
    assert ids(memos.filter(P.query(C(), query))) == expected


def test_index_scores(index):
    assert scores(index.search("PRustle OR Rustle")) == {3: 2.0, 2: 1.0}
    assert scores(index.search("Rustle PRustle")) == {3: 2.0}
    one = Condition("Rustle OR RDBMS -PRustle", weights=(5,), scorers=("scorer_tf_at_most($index, 0.25)",))
    assert scores(index.search(one)) == {2: 1.25, 1: 1.25}
    assert scores(index.search(Condition("Rustle OR RDBMS -PRustle", weights=(0,)))) == {}
    with pytest.raises(ValueError):
        index.search(Condition("x", weights=()))
    with pytest.raises(ValueError):
        index.search(Condition("rustle", scorers=("scorer_unknown()",)))


def test_fuzzy(index):
    assert scores(index.search(Condition("PRoostle", fuzzy_max_distance_ratio=0.25))) == {3: 1.0}
    assert scores(index.search(Condition("PRustlX", fuzzy_max_distance_ratio=0.8)))[3] == 5.0


def test_escalation(index):
    assert scores(index.search("rus eng")) == {}
    assert sorted(scores(index.search("rus eng", EngineConf(force_match_escalation=True)))) == [2]
    assert sorted(scores(index.search("rus", EngineConf(escalate=True)))) == [2, 3]
    assert sorted(scores(index.search("rustle", EngineConf(escalate=True)))) == [2, 3]


def test_phrases_and_signs(index):
    assert sorted(scores(index.search('"is a postbase"'))) == [3]
    assert sorted(scores(index.search("("))) == [2]
    assert scores(index.similar("uses rustle extension")) == {3: 3.0}


def test_predicates(spark):
    t = spark.createDataFrame([("Postbase",), ("Rustle",), ("PRustle",), ("plogical",), (None,)], "name string")
    names = lambda c: sorted(r.name for r in t.filter(c(F.col("name"))).collect())
    assert names(lambda c: P.prefix(c, "p")) == ["PRustle", "Postbase", "plogical"]
    assert names(lambda c: P.prefix_any(c, ["rus", None, "POS"])) == ["Postbase", "Rustle"]
    assert names(lambda c: P.not_prefix_any(c, ["rus", "pos"])) == ["PRustle", "plogical"]
    assert names(lambda c: P.not_prefix_any(c, [])) == ["PRustle", "Postbase", "Rustle", "plogical"]
    assert names(lambda c: P.prefix(c, "")) == [] and names(lambda c: P.equal(c, "")) == [] and names(lambda c: P.match(c, None)) == []
    assert names(lambda c: P.equal(c, "ＲＵＳＴＬＥ")) == ["Rustle"]
    assert names(lambda c: P.regexp(c, r"\Arustle")) == ["Rustle"] and names(lambda c: P.regexp(c, "")) == [] and names(lambda c: P.regexp(c, None)) == []
    assert names(lambda c: P.regexp(c, ".rustle")) == ["PRustle"] and names(lambda c: P.regexp_any(c, [None, "", "base"])) == ["Postbase"]
    assert names(lambda c: P.like(c, "%ust%")) == ["PRustle", "Rustle"] and names(lambda c: P.like(c, "post%", True)) == ["Postbase"]
    assert names(lambda c: P.is_in(c, [None, "Rustle"])) == ["Rustle"] and names(lambda c: P.is_in(c, [])) == []
    assert names(lambda c: P.compare(c, "<=", "PLOGICAL", Analyzer())) == ["plogical"]
    assert names(lambda c: P.match(c, Condition("rustle", weights=(0,)))) == []


def test_like_as_regexp():
    assert [P.like_as_regexp(p) for p in ("a%", "%a", "a_b%c", "100\\%", "%x%")] == ["\\Aa", "a\\z", "\\Aa.b.*c\\z", "\\A100%\\z", "x"]


def test_arrays(spark):
    t = spark.createDataFrame([("a", ["Postbase is an OSS RDBMS", "Postbase has partial full-text search"]), ("b", ["Rustle is OSS", "Rustle has full search"]), ("c", []), ("d", None), ("e", [None, "rustle"])], "k string, v array<string>")
    keys = lambda c: sorted(r.k for r in t.filter(c(F.col("v"))).collect())
    assert keys(lambda c: P.query_array(c, "oss search partial")) == ["a"]
    assert keys(lambda c: P.match_array(c, "RUSTLE")) == ["b", "e"] and keys(lambda c: P.match_array_any(c, ["rdbms", None, "full search"])) == ["a", "b"]
    assert keys(lambda c: P.query_array(c, "-rustle")) == ["a", "c"]
    assert keys(lambda c: P.equal_query_array(c, "rustle OR none")) == ["e"] and keys(lambda c: P.contains_element(c, "rustle")) == ["e"]
    assert keys(lambda c: P.prefix_array(c, "rustle h")) == ["b"] and keys(lambda c: P.regexp_array(c, r"\Arustle\z")) == ["e"]
    assert keys(lambda c: P.match_array(c, Condition("full", weights=(1, 0)))) == [] and keys(lambda c: P.match_array(c, Condition("oss", weights=(1,)))) == ["a", "b"]
    assert keys(lambda c: P.contains_all(c, ["rustle"])) == ["e"]
    index = build_index(t.withColumn("id", F.ascii("k").cast("long")), "id", ["v"])
    assert scores(index.search(Condition("rustle", weights=(2, 1)))) == {98: 3.0, 101: 1.0}


def test_weighted_sections(spark):
    t = spark.createDataFrame([(1, "Spark", "fast engine"), (2, "Engine", "Spark spark")], "id long, title string, content string")
    i = build_index(t, "id", ["title", "content"])
    assert scores(i.search(Condition("spark", weights=(5, 1)))) == {1: 5.0, 2: 2.0}
    assert scores(i.search(Condition("spark", weights=(5,)))) == {1: 5.0}
    assert scores(i.search(Condition("spark", weights=(None, 0)))) == {1: 1.0}


def test_romaji(spark):
    assert to_romaji("ピージーロジカル") == "pi-zi-rozikaru"
    names = ["ポストグレスキューエル", "グルンガ", "ピージールンガ", "ピージーロジカル"]
    assert [n for n in names if reads_as(n, "p")] == [names[0], names[2], names[3]]
    assert [n for n in names if reads_as(n, "posu")] == names[:1] and [n for n in names if reads_as(n, "ぐる")] == [names[1]] and not reads_as(names[0], "")
    assert reads_as("キャッチ", "kyacchi") and reads_as("シャシン", "shasi") and reads_as("ハッピ", "hap")
    t = spark.createDataFrame([(n, [n]) for n in names] + [(None, None)], "katakana string, all array<string>")
    assert sorted(r.katakana for r in t.filter(P.prefix_romaji_any(F.col("katakana"), ["po", "gu"])).collect()) == sorted(names[:2])
    assert t.filter(P.prefix_romaji_array(F.col("all"), "pi")).count() == 2


def test_json(spark):
    rows = [(1, "{}"), (2, '{"key": 100}'), (3, '{"key": "hello Apple"}'), (4, '{"key": true}'), (5, '{"key": []}'), (6, "[{}]"), (7, '{"host": {"ips": [{"v4": "10.0.0.1"}, {"v4": "apple"}]}, "message": {"a": null}}'), (8, "not json"), (9, None)]
    t = spark.createDataFrame(rows, "id long, r string").withColumn("l", J.json_leaves(F.col("r")))
    found = lambda c: ids(t.filter(c))
    leaf = F.col("l")
    assert found(J.json_contains(leaf, "{}")) == [1, 2, 3, 4, 5, 7]
    assert found(J.json_match(leaf, "APP")) == [3, 7] and found(J.json_query(leaf, "apple hello")) == [3] and found(J.json_query(leaf, "apple -hello")) == [7]
    assert found(J.json_script(leaf, 'string == "apple"')) == [7] and found(J.json_script(leaf, "number > 50 && number <= 100")) == [2]
    assert found(J.json_script(leaf, 'paths @ ".message" && type == "object"')) == [7]
    assert found(J.json_script(leaf, 'path == ".[\\"host\\"][\\"ips\\"][][\\"v4\\"]" && string @^ "10."')) == [7]
    assert found(J.json_script(leaf, "boolean == true")) == [4] and found(J.json_script(leaf, 'type == "array" && size == 0')) == [5]
    assert found(J.json_script(leaf, 'query("string", "hello OR 10")')) == [3, 7]
    assert found(J.json_contains(leaf, '{"key": 100}')) == [2] and found(J.json_contains(leaf, '{"key": []}')) == [5] and found(J.json_contains(leaf, '{"host": {"ips": [{"v4": "apple"}]}}')) == [7]
    with pytest.raises(QuerySyntaxError):
        J.json_query(leaf, "(hello")
    with pytest.raises(ScriptSyntaxError):
        J.json_script(leaf, "nonsense ==")


def test_json_empty_object_matches_every_object(spark):
    t = spark.createDataFrame([(1, "{}"), (2, '{"key": 1}'), (6, "[{}]")], "id long, r string").withColumn("l", J.json_leaves(F.col("r")))
    assert ids(t.filter(J.json_contains(F.col("l"), "{}"))) == [1, 2]


def test_normalize(spark):
    assert normalize_text("aBcDe 123") == "abcde 123" and normalize_text("ＡＢＣ㍉") == "abcミリ" and normalize_text("ｶﾞ") == "ガ"
    assert normalize_text("りんごリンゴ", 'NormalizerNFKC100("unify_kana", true)') == "りんごりんご"
    assert normalize_text("090-1234", 'NormalizerNFKC100("remove_symbol", true)') == "0901234"
    assert normalize_text("a・b", 'NormalizerNFKC100("unify_middle_dot", true)') == "a·b"
    got = spark.createDataFrame([("ＡＢＣ é",), (None,)], "t string").select(normalize(F.col("t")).alias("n"), normalize(F.col("t"), "NormalizerNFKC150").alias("u")).collect()
    assert got[0].n == got[0].u == "abc é" and got[1].n is None


def test_folding_by_runs_is_folding_by_characters():
    for t in ("", "Plain TEXT é É ß", "ｶﾞ A\u0301b\u0327 x", "㍉ é \u0130 ΑΣ", "a\u0301", "\u0301a", "ÿ Ÿ …", "ﾞa"):
        assert tuple(map(list, normalize_with_offsets(t))) == tuple(map(list, normalize_with_offsets(t, "NormalizerAuto")))


def test_small_inputs_are_spread(spark):
    df = spark.range(10)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tokenize(spark):
    values = lambda t, **a: [x["value"] for x in tokenize(t, Analyzer(**a))]
    assert values("This is a pen.") == ["this", "is", "a", "pen", "."]
    assert values("This is", normalizer=None)[:4] == ["Th", "hi", "is", "s "]
    assert values("日本語。") == ["日本", "本語", "語", "。"]
    assert values("a b  c", tokenizer="TokenDelimit") == ["a", "b", "c"] and values("Whole Value", tokenizer="none") == ["whole value"]
    assert values("test", tokenizer='TokenNgram("n", 3)', normalizer=None) == ["tes", "est", "st", "t"]
    assert values("works worked", token_filters=("TokenFilterStem",)) == ["work", "work"]
    assert values("(090)1234-5678", tokenizer='TokenNgram("loose_symbol", true)') == ["09012345678"]
    first, second = tokenize("one two", Analyzer(tokenizer='TokenNgram("report_source_location", true)'))
    assert (second["source_offset"], second["source_length"], second["source_first_character_length"], first["force_prefix_search"], second["force_prefix_search"]) == (3, 4, 2, False, True)
    assert [t["source_offset"] for t in tokenize("one two")] == [None, None]
    assert [t["value"] for t in tokenize_with("これはペン。", "tokenizer", "TokenNgram", "token_filters", 'TokenFilterNFKC100("unify_kana", true)')] == ["これ", "れは", "はぺ", "ぺん", "ん。", "。"]
    for wrong in (("tokenizer", "invalid"), ("tokenizer",), ("unknown", "x")):
        with pytest.raises(ValueError):
            tokenize_with("a pen", *wrong)
    assert values("a-b c", tokenizer='TokenNgram("loose_symbol", true)') == ["ab", "c"]
    assert query_terms("りんご") == ((0, "りん", False), (1, "んご", False)) and query_terms("検") == ((0, "検", True),) and query_terms("ab", Analyzer(normalizer=None)) == ((0, "ab", False),)
    assert spark.createDataFrame([("This",)], "t string").select(tokens_column(F.col("t"), Analyzer(normalizer=None)).alias("v")).first().v == ["Th", "hi", "is", "s"]
    t = spark.createDataFrame([("Spark 4.1は速い engine!",)], "t string")
    assert t.select(tokens_column(F.col("t")).alias("v")).first().v == values("Spark 4.1は速い engine!")


def test_options():
    a = analyzer_of({"tokenizer_mapping": '{"tags": "TokenNgram(\\"n\\", 3)"}', "normalizers": 'NormalizerNFKC130("unify_kana", true), NormalizerNFKC130("unify_middle_dot", true)', "token_filters": "none", "lexicon_type": "hash_table", "plugins": "token_filters/stem"}, "tags")
    assert a.tokenizer == 'TokenNgram("n", 3)' and not a.prefix_search and not a.token_filters and [x["value"] for x in tokenize("グル∙ンガ", a)] == ["ぐる", "る", "·", "んが", "が"]
    assert analyzer_of({"normalizer": "none", "full_text_search_normalizer": "NormalizerNFKC51"}).normalizer == "NormalizerNFKC51" and analyzer_of({"normalizer": ""}).normalizer is None
    assert analyzer_of({}, use="term_search").tokenizer == "none" and analyzer_of({"query_allow_column": "true"}).query_allow_column
    with pytest.raises(ValueError):
        analyzer_of({"tokeniser": "x"})


def test_unspaced_and_raw_pairs_on_index(spark):
    rows = [(1, "りんごはおいしい"), (2, "青リンゴ"), (3, "検索エンジン"), (4, "Postbase SQL")]
    t = spark.createDataFrame(rows, "id long, c string")
    i = build_index(t, "id", ["c"])
    assert sorted(scores(i.search("りんご"))) == [1] and sorted(scores(i.search("検"))) == [3] and sorted(scores(i.search("索エンジ"))) == [3] and scores(i.search("ごり")) == {}
    kana = build_index(t, "id", ["c"], analyzer_of({"normalizers": 'NormalizerNFKC100("unify_kana", true)'}))
    assert sorted(scores(kana.search("りんご"))) == [1, 2]
    raw = build_index(t, "id", ["c"], analyzer_of({"normalizer": ""}))
    assert scores(raw.search("postbase")) == {} and sorted(scores(raw.search("Postbase"))) == [4] and sorted(scores(raw.search("base SQL"))) == [4] and scores(raw.search('"SQL base"')) == {}
    loose = build_index(spark.createDataFrame([(1, "tel (090)1234-5678 now")], "id long, c string"), "id", ["c"], analyzer_of({"tokenizer": 'TokenNgram("loose_symbol", true)'}))
    assert sorted(scores(loose.search("090-12345678"))) == [1]


def test_keys_of_any_type(spark):
    t = spark.createDataFrame([("a", 1, "Rustle is fast"), ("b", 2, "Postbase uses Rustle Rustle")], "id string, n int, c string")
    assert scores(build_index(t, "id", ["c"]).search("rustle")) == {"a": 1.0, "b": 2.0}
    assert {tuple(k): v for k, v in scores(build_index(t, ["id", "n"], ["c"]).search("uses")).items()} == {("b", 2): 1.0}


def test_stem():
    assert [stem(w) for w in ("works", "worked", "working", "ponies", "caresses", "hopping", "relational", "sky")] == ["work", "work", "work", "poni", "caress", "hop", "relat", "sky"]


def test_highlight_and_positions(spark):
    tag = '<span class="keyword">{}</span>'
    assert present.highlight_html("Rustle & <b>", ["rustle"]) == tag.format("Rustle") + " &amp; &lt;b&gt;"
    assert present.highlight_html("100㍉メートル", ["ミリ"]) == "100" + tag.format("㍉") + "メートル"
    assert present.match_positions_character("100㍉メートル", ["ミリ"]) == [[3, 1]] and present.match_positions_byte("あa あ", ["あ"]) == [[0, 3], [5, 3]]
    assert present.snippet_html("Rustle is fast", ["Rustle"], 5) == [] and present.snippet_html("Rustle is", ["rustle"], 6) == [tag.format("Rustle")]
    assert present.snippet_html("x Rustle y", ["rustle"], 7) == [" " + tag.format("Rustle")] and len(present.snippet_html("ab " * 500, ["ab"])) == 3
    with pytest.raises(ValueError):
        present.snippet_html("a", ["a"], 0)
    located = analyzer_of({"tokenizer": 'TokenNgram("report_source_location", true)', "normalizer": "NormalizerNFKC100"})
    assert present.highlight_html("one two three four five two six three", ["two three", "five"], located) == "one" + tag.format(" two three") + " four" + tag.format(" five") + " two six three"
    loose = analyzer_of({"tokenizer": 'TokenNgram("loose_symbol", true, "report_source_location", true)', "normalizer": 'NormalizerNFKC100("unify_kana", true)'})
    assert present.highlight_html("この店のリンゴはよい。番号は０９０-12345678だ。", ["りんご", "（090）1234５６７８"], loose) == "この店の" + tag.format("リンゴ") + "はよい。番号は" + tag.format("０９０-12345678") + "だ。"
    term = analyzer_of({"normalizers": 'NormalizerNFKC130("unify_kana", true)'}, use="term_search")
    assert present.highlight_html("はろー ハロー", ["は"], term) == tag.format("は") + "ろー " + tag.format("ハ") + "ロー"
    got = spark.createDataFrame([("a Rustle",), (None,)], "t string").select(present.highlight_html_column(F.col("t"), ["rustle"]).alias("h"), present.match_positions_character_column(F.col("t"), ["rustle"]).alias("p")).collect()
    assert got[0].h == "a " + tag.format("Rustle") and got[0].p == [[2, 6]] and got[1].h is None


def test_highlight_column_is_the_kernel_row_by_row(spark):
    texts = ["Straße & ÉTÉ été", "a.b A.B axb \"q\" <amp> amp", "ＡＭＰ full", "10㎞ amp", "e\u0301te ÉTE", "x\x02amp\x03", "", None, "amp" * 5, "\u212aelvin kelvin", "“Amp” – it’s"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for keywords in (["amp"], ["a.b", "amp", None, ""], ["été", "e"], ["kelvin"], ["ß", "$1"], ['"', "&"], []):
        got = {r.i: r.h for r in rows.select("i", present.highlight_html_column(F.col("t"), keywords).alias("h")).collect()}
        assert got == {i: None if t is None else present.highlight_html(t, keywords) for i, t in enumerate(texts)}


def test_escapes(spark):
    t = spark.createDataFrame([("a+B-c< >あいう~*()\"\\':",)], "t string")
    one = lambda c: t.select(c.alias("x")).first().x
    assert one(present.query_escape(F.col("t"))) == "a\\+B\\-c\\< \\>あいう\\~\\*\\(\\)\\\"\\\\'\\:"
    assert one(present.escape(F.col("t"))) == "\"a+B-c< >あいう~*()\\\"\\\\':\""
    assert one(present.escape(F.col("t"), special='+-<>~*()"\\:')) == "\"a\\+B\\-c\\< \\>あいう\\~\\*\\(\\)\\\"\\\\'\\:\""
    assert one(present.command_escape_value(F.lit('a"\\\n'))) == '"a\\"\\\\\\n"'
    assert one(present.escape(F.lit(29.2929).cast("float"), "float")) == "29.29290008544922" and one(present.escape(F.lit(True), "boolean")) == "true"
    assert one(present.escape(F.expr("timestamp '2016-11-29 01:23:45'"), "timestamp")) == "1480382625"


def test_expansion_and_keywords(spark):
    table = {"Rustle": [["Rustle", "Senna"]], "PRustle": [["PRustle", "Rustle Postbase"]], "Old": ["ancient", "aged"]}
    assert present.expand_query("rustle", table) == "((Rustle) OR (Senna))"
    assert present.expand_query("Ruby (Rustle OR PRustle)", table) == "Ruby (((Rustle) OR (Senna)) OR ((PRustle) OR (Rustle Postbase)))"
    assert present.expand_query("old unknown", table) == "((ancient) OR (aged)) unknown"
    assert sorted(extract_keywords("Rustle -MyBase Postbase")) == ["Postbase", "Rustle"] and sorted(extract_keywords("(Rustle")) == ["(", "Rustle"]
    assert extract_keywords("Rustle content:@Postbase", columns=True) == ["Rustle", "Postbase"] and parse("  ") is None
    queries = spark.createDataFrame([("rustle OR x",), (None,)], "q string")
    got = present.expand_queries(queries, "q", spark.createDataFrame([("Rustle", "a"), ("rustle", "b")], "t string, s string"), "t", "s").collect()
    groups = spark.createDataFrame([(["Rustle", None, "Senna"],)], "s array<string>")
    assert {r.q: r.expanded for r in present.expand_queries(queries, "q", groups, "s", "s").collect()} == {"rustle OR x": "((Rustle) OR (Senna)) OR x", None: None}
    with pytest.raises(ValueError):
        present.expand_queries(queries, "q", spark.createDataFrame([("a", 1)], "t string, s int"), "t", "s")
    assert {r.q: r.expanded for r in got} == {"rustle OR x": "((a) OR (b)) OR x", None: None}


def test_results(spark):
    text = '[[0,0.0,0.0],[[[1],[["_id","UInt32"],["flag","Bool"],["at","Time"],["t","ShortText"]],[7,true,1480382625.5,"x"]]]]'
    row = present.result_rows(spark, text).first()
    assert (row._id, row.flag, row.t) == (7, True, "x") and row["at"].microsecond == 500000
    assert present.result_objects(text) == '[{"_id": 7, "flag": true, "at": 1480382625.5, "t": "x"}]'
    assert present.result_rows(spark, '[[0,0.0,0.0],[[[0],[["_id","UInt32"]]]]]').count() == 0


def test_vectors(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<float>")
    assert [r.id for r in V.knn(t, "v", [1.0, 0.1], 3, "id").collect()] == [1, 3, 2]
    assert [r.id for r in V.knn(t, "v", [1.0, 0.1], 3, "id", F.col("id") > 1).collect()] == [3, 2]
    docs = spark.createDataFrame([(1, "apples and pears"), (2, "engines run fast"), (3, None)], "id long, t string")
    assert V.semantic_search(docs, "t", "fast engines run", 1, "id").first().id == 2


def test_select(spark):
    t = spark.createDataFrame([(1, "Spark", 5), (2, "spark sql", 3), (3, "flink", 9)], "id long, title string, n int")
    assert [r.id for r in select(t, filter="n >= 3", match_columns="title", query="spark", sort_keys="-n", output_columns="id").collect()] == [1, 2]
    assert [r.id for r in select(t, sort_keys="id", offset=1, limit=1).collect()] == [2] and select(t, limit=-1).count() == 3
    with pytest.raises(ScriptSyntaxError):
        select(t, filter="missing == 1")


def test_command(spark):
    import json

    from sparkseek.sources.command import command

    t = spark.createDataFrame([("Postbase is a RDBMS.", 3), ("Rustle is fast.", 1)], "content string, n int").withColumn("at", F.expr("timestamp '2018-02-02 00:00:00'"))
    tables = {"Sources1": t}
    head, body = json.loads(command(spark, tables, "select Sources1 --output_columns content --sort_keys n"))
    assert head[0] == 0 and body == [[[2], [["content", "LongText"]], ["Rustle is fast."], ["Postbase is a RDBMS."]]]
    out = json.loads(command(spark, tables, "select", ["table", "Sources1", "filter", "n > 1", "output_columns", "n, at", "command_version", "3"]))
    assert out["body"] == {"n_hits": 1, "columns": [{"name": "n", "type": "Int32"}, {"name": "at", "type": "Time"}], "records": [[3, 1517529600.0]]}
    assert json.loads(command(spark, tables, "select Sources1 --match_columns content --query rustle --limit 0"))[1] == [[[1], [["content", "LongText"], ["n", "Int32"], ["at", "Time"]]]]
    assert isinstance(json.loads(command(spark, tables, "status")), list) and isinstance(json.loads(command(spark, tables, "status", ["command_version", "3"])), dict)
    assert json.loads(command(spark, tables, "object_exist Sources1"))[1] is True and "Sources1" in json.loads(command(spark, tables, "schema"))[1]["tables"] and json.loads(command(spark, tables, "table_list"))[1][1][1] == "Sources1"
    assert present.result_rows(spark, command(spark, tables, "select Sources1 --output_columns content --sort_keys -n")).first().content == "Postbase is a RDBMS."
    assert json.loads(command(spark, tables, "select Missing"))[0][0] != 0 and json.loads(command(spark, tables, "nonsense"))[0][0] != 0


def test_tokens_on_scan(memos, index):
    for q in ("rustle", "PRustle OR Rustle", "rustle -prustle", '"full text"', "exten*", "-rustle", "(", '"is a postbase"', "", "rus"):
        assert ids(memos.filter(P.query_tokens_of(C(), q))) == sorted(set(scores(index.search(q))) - {4})  # an index holds the row of a null value as an empty one
    stemmed = Analyzer(token_filters=("TokenFilterStem",))
    assert ids(memos.filter(P.query_tokens_of(C(), "extensions", stemmed))) == [3]


def test_store(spark, memos, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/s")
    store.create("m", None, "id", ["content"], table="memos")
    assert scores(store.open("m").search("rustle")) == {}
    store.append("m", memos.filter("id < 3"), key="b0")
    store.append("m", memos.filter("id < 3"), key="b0")  # a batch run again
    assert store.lagged(memos, "m").count() == 2
    store.append("m", memos.filter("id >= 3"))
    assert scores(store.open("m").search("rustle OR prustle")) == {2: 1.0, 3: 2.0}
    store.delete("m", spark.createDataFrame([(3,)], "id long"))
    assert scores(store.open("m").search("rustle")) == {2: 1.0} and ids(store.open("m").search("-rustle"), "doc_id") == [1, 4]
    store.append("m", memos.filter("id = 3"))  # and again after its deletion
    assert scores(store.open("m").search("rustle")) == {2: 1.0, 3: 1.0}
    store.vacuum("m")
    assert scores(store.open("m").search("rustle")) == {2: 1.0, 3: 1.0}
    assert (store.names(), store.table_name("m"), store.column_name("m", 0), store.column_name("m", "content"), store.column_name("m", "no"), store.broken(), store.flush("m")) == (["m"], "memos", "content", "content", None, [], True)
    assert store.status().first().segments == 1
    with pytest.raises(FileExistsError):
        store.create("m", None, "id", ["content"])
    before = store._read("m")
    store.append("m", memos.filter("id = 2"))
    assert store.truncate("m") > 0 and store.truncate("m") == 0
    assert not store._write("m", before)  # another writer has taken the number
    store.delete("m", spark.createDataFrame([(1,)], "id long"))
    store.vacuum("m")
    assert store.status().first().segments == 1 and scores(store.open("m").search("rustle")) == {2: 2.0, 3: 1.0} and store._versions("m") == [store._read("m")["version"]]
    store.set_writable(False)
    with pytest.raises(ReadOnly):
        store.append("m", memos)
    store.set_writable(True)
    store.drop("m")
    assert store.names() == [] and not store.broken()
    with pytest.raises(KeyError):
        store.open("m")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, memos, tmp_path):
    """Words reach the scan of the postings, a phrase takes one shuffle, and predicates of a scan run no Python."""
    store = IndexStore(spark, f"file://{tmp_path}/s")
    store.create("m", memos, "id", ["content"])
    plan = plan_of(store.open("m").search("rustle OR uses"))
    assert "EqualTo(token,rustle)" in plan and "EqualTo(token,uses)" in plan and "Join" not in plan
    assert plan_of(store.open("m").search('"full text search"')).count("Exchange") == 1 and plan.count("Exchange") == 1
    for c in (P.query(C(), "(a OR b) -c d*"), P.query_tokens_of(C(), '"a b" c'), P.regexp(C(), "a.b"), P.prefix(C(), "x"), P.not_prefix_any(C(), ["x"]), P.equal(C(), "y")):
        assert "Python" not in plan_of(memos.filter(c))
    memos.write.parquet(f"{tmp_path}/t")
    assert "GreaterThanOrEqual(id,2)" in plan_of(spark.read.parquet(f"{tmp_path}/t").filter(P.compare(F.col("id"), ">=", 2)))


def test_sql_functions(spark):
    from sparkseek.functions.sql import register

    names = register(spark)
    assert len(names) == len(set(names)) >= 25
    row = spark.sql(
        """SELECT seek_match('PySpark', 'SPARK') a, seek_query('fast engine', 'fast -slow') b, seek_prefix('Spark', 'sp') c, seek_not_prefix_in('Spark', array('x')) d,
        seek_equal('ＡＢ', 'ab') e, seek_regexp('Spark', '^s.*k$') f, seek_query_escape('a+b') g, seek_highlight_html('a Spark', array('spark')) h,
        seek_query_extract_keywords('a -b c') i, size(seek_tokenize('one two', 'TokenBigram')) j, seek_contain(array('a'), 'a') k, seek_prefix_rk('ポスト', 'po') l, seek_match(NULL, 'x') m"""
    ).first()
    other = spark.sql(
        r"""SELECT seek_query_array(array('a OSS b', 'full'), 'oss full') a, seek_match_in_array(array('xy'), array('', 'X')) b, seek_prefix_in_array(array('Ab'), array('aB')) c, seek_equal_query_array(array('SQL', 'x'), 'grn OR sql') d,
        seek_prefix_rk_in('ポスト', array('gu', 'po')) e, seek_json_match('{"k": ["Apple"]}', 'app') f, seek_json_query('{"k": "a b", "l": "c"}', 'a c') g, seek_json_contains('{"k": [1, "x"]}', '{"k": ["x"]}') h,
        seek_escape('a"') i, seek_escape_timestamp(timestamp '2016-11-29 01:23:45') j, seek_highlight_html_array(array('ab', NULL), array('a')) k, seek_snippet_html_width('ab', array('b'), 1) l, round(seek_cosine(array(1D, 0D), array(1D, 1D)), 3) m, seek_contain_all(array('a', 'b'), array('b')) n,
        seek_command_escape_value('a"b') o"""
    ).first()
    tag = '<span class="keyword">{}</span>'
    assert list(other) == [True, True, True, True, True, True, False, True, '"a\\""', "1480382625", [tag.format("a") + "b", None], [tag.format("b")], 0.707, True, '"a\\"b"']
    assert list(row) == [True, True, True, True, True, True, "a\\+b", 'a <span class="keyword">Spark</span>', ["a", "c"], 2, True, True, None]


def test_sql_functions_are_the_column_forms(spark):
    """Each SQL function and its Column twin over full-width, compatibility, empty and null values."""
    from sparkseek.functions.sql import register

    register(spark)
    texts = ["ＡＢ c", "ab", "ﾎﾟｽﾄ ①", "Ⅷ km㎞", "", None, "Straße ÄÖ", "x1F y"]
    rows = [(i, t, [t, "ＺＺ", None, texts[i - 1]]) for i, t in enumerate(texts)] + [(90, "ab", None), (91, None, [])]
    df = spark.createDataFrame(rows, "id int, t string, ts array<string>")
    words = ["ab", "ＡＢ", "ポスト", "1", "viii", "ä", "zz", ""]
    lists = [["", "ＡＢ"], ["q", None], ["ａ", "zz", "x"], []]
    t, ts = F.col("t"), F.col("ts")
    pairs = []
    for w in words:
        pairs += [(f"seek_match(t, '{w}')", P.match(t, w)), (f"seek_match_array(ts, '{w}')", P.match_array(ts, w)), (f"seek_prefix(t, '{w}')", P.prefix(t, w)), (f"seek_prefix_array(ts, '{w}')", P.prefix_array(ts, w)), (f"seek_equal(t, '{w}')", P.equal(t, w))]
        if w:
            pairs += [(f"seek_query(t, '{w} OR c')", P.query(t, f"{w} OR c")), (f"seek_query_array(ts, '{w} zz')", P.query_array(ts, f"{w} zz")), (f"seek_equal_query_array(ts, '{w} OR zz')", P.equal_query_array(ts, f"{w} OR zz")), (f"seek_prefix_rk(t, '{w}')", P.prefix_romaji(t, w)), (f"seek_prefix_rk_array(ts, '{w}')", P.prefix_romaji_array(ts, w))]
    for p in ("^ab", "b c", r"\\h", "[^a-z]$", "x1f"):
        q = p.replace("\\\\", "\\")
        pairs += [(f"seek_regexp(t, r'{q}')", P.regexp(t, q)), (f"seek_regexp_array(ts, r'{q}')", P.regexp_array(ts, q)), (f"seek_regexp_in(t, array('', r'{q}'))", P.regexp_any(t, ["", q]))]
    for ws in lists:
        a = "cast(array({}) as array<string>)".format(", ".join("NULL" if w is None else f"'{w}'" for w in ws))
        pairs += [(f"seek_match_in(t, {a})", P.match_any(t, ws)), (f"seek_match_in_array(ts, {a})", P.match_array_any(ts, ws)), (f"seek_prefix_in(t, {a})", P.prefix_any(t, ws)), (f"seek_prefix_in_array(ts, {a})", P.prefix_array_any(ts, ws)), (f"seek_not_prefix_in(t, {a})", P.not_prefix_any(t, ws))]
        pairs += [(f"seek_query_in(t, {a})", P.query_any(t, ws)), (f"seek_query_in_array(ts, {a})", P.query_array_any(ts, ws)), (f"seek_prefix_rk_in(t, {a})", P.prefix_romaji_any(t, ws)), (f"seek_prefix_rk_in_array(ts, {a})", P.prefix_romaji_array_any(ts, ws))]
    sql = df.select("id", *[F.expr(f"coalesce({s}, false)").alias(f"c{i}") for i, (s, _) in enumerate(pairs)]).orderBy("id").collect()
    own = df.select("id", *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, (_, c) in enumerate(pairs)]).orderBy("id").collect()
    wrong = [(pairs[i][0], a.id) for a, b in zip(sql, own) for i in range(len(pairs)) if a[i + 1] != b[i + 1]]
    assert not wrong and any(any(r[1:]) for r in own)


def test_segments_are_merged_by_level(spark, tmp_path, monkeypatch):
    from sparkseek.sources import store as S

    monkeypatch.setattr(S, "FAN", 3)
    store = IndexStore(spark, f"file://{tmp_path}/levels")
    row = lambda i: spark.createDataFrame([(i, f"word w{i} common")], "id long, t string")
    store.create("m", None, "id", ["t"])
    for i in range(10):
        store.append("m", row(i), key=f"batch{i}")
        if i == 4:
            store.delete("m", spark.createDataFrame([(1,)], "id long"))
    store.append("m", row(2), key="batch2")  # made before, and merged since
    segments = store._read("m")["segments"]
    assert len(segments) <= 4 and max(map(S._level, segments)) == 2
    assert set(scores(store.open("m").search("common"))) == {0, 2, 3, 4, 5, 6, 7, 8, 9}
    assert set(scores(store.open("m").search(P.Condition("wird", fuzzy_max_distance_ratio=0.3)))) == {0, 2, 3, 4, 5, 6, 7, 8, 9}
    store.append("m", row(1))  # it is back
    assert 1 in scores(store.open("m").search("common"))
    other = IndexStore(spark, f"file://{tmp_path}/levels")
    assert store.set_applied_position("m", 7) and other.applied_position("m") == 7 and other.set_applied_position() and store.applied_position("m") == store._read("m")["version"]
    store.set_writable(False)
    assert not other.is_writable()
    with pytest.raises(S.ReadOnly):
        other.append("m", row(20))
    other.set_writable(True)
    assert store.is_writable() and store.lagged(row(99), "m").count() == 1 and store.broken() == []


def test_similar_over_sections_and_elements(spark):
    df = spark.createDataFrame([(1, ["a b", "c d"]), (2, ["a b c", "x"]), (3, ["q", "r"])], "id long, ts array<string>")
    index = build_index(df, "id", ["ts"])
    assert scores(index.similar("a b c d")) == {1: 4.0, 2: 3.0}
    assert scores(index.similar(P.Condition("a b c d", weights=(1, 0)))) == {1: 2.0, 2: 3.0}
    assert scores(index.similar(P.Condition("a b", weights=(5, 1)))) == {1: 10.0, 2: 10.0}
    assert {r.doc_id: round(r.distance, 6) for r in index.similar_distance("a b c d").collect()} == {1: 0.0, 2: 0.25}


def test_escalation_in_one_pass(spark):
    df = spark.createDataFrame([(1, "spark sparks"), (2, "sparkling water"), (3, "water"), (4, "spark water -")], "id long, t string")
    index = build_index(df, "id", ["t"])
    wide = EngineConf(escalate=True)
    assert scores(index.search("spark", wide)) == scores(index.search("spark")) == {1: 1.0, 4: 1.0}
    assert scores(index.search("spark", EngineConf(escalate=True, match_escalation_threshold=2))) == {1: 1.0, 2: 1.0, 4: 1.0}
    assert scores(index.search("spar -wat", wide)) == {1: 2.0} and scores(index.search("spar wat", wide)) == {2: 2.0, 4: 2.0}
    assert scores(index.search("spar -water", wide)) == {1: 2.0} and scores(index.search("nothing", wide)) == {}
    assert scores(index.search(Condition("spar", weights=(0,)), wide)) == {} and scores(index.search(Condition("spar", weights=(3,)), wide)) == {1: 6.0, 2: 3.0, 4: 3.0}


def test_more_commands(spark, memos, monkeypatch):
    import json

    from sparkseek.sources import command as C

    t = {"m": memos.withColumn("k", F.col("id") % 2).withColumn("tags", F.array(F.lit("a")))}
    body = json.loads(C.command(spark, t, "select m --output_columns id --sort_keys id --limit 1 --drilldown k,content --drilldown_limit 2"))[1]
    assert body[0] == [[4], [["id", "Int64"]], [1]] and body[1] == [[2], [["_key", "Int64"], ["_nsubrecs", "Int32"]], [0, 2], [1, 2]] and body[2][0] == [4] and len(body[2]) == 4
    assert [r[1:] for r in json.loads(C.command(spark, t, "column_list m"))[1][1:]] == [["id", "fix", "m", "Int64"], ["content", "var", "m", "LongText"], ["k", "fix", "m", "Int64"], ["tags", "vector", "m", "LongText"]]
    assert json.loads(C.command(spark, t, "normalize auto 'ＡＢ'", ["string", "ＡＢ"]))[1]["normalized"] == "ab"
    assert [x["value"] for x in json.loads(C.command(spark, t, "tokenize TokenDelimit", ["string", "one two"]))[1]] == ["one", "two"]
    monkeypatch.setattr(C, "ANSWER_ROWS", 3)
    assert json.loads(C.command(spark, t, "select m --limit -1"))[0][0] == -22 and json.loads(C.command(spark, t, "select m --limit 3"))[0][0] == 0
    assert json.loads(C.command(spark, t, "select m --drilldown nothing"))[0][0] == -22


def test_operator_classes(spark):
    from sparkseek.operators.classes import CLASSES, default_class

    assert len(CLASSES) == 31
    assert {v: default_class(v).name for v in ("text", "varchar", "varchar[]", "json", "int4", "int4[]")} == {
        "text": "text_full_text_search_v2", "varchar": "varchar_term_search_v2", "varchar[]": "varchar_array_term_search_v2", "json": "json_json_v2", "int4": "int4_compare", "int4[]": "int4_array_compare",
    }
    term, plain = CLASSES["text_term_search_v2"], CLASSES["varchar_compare"]
    df = spark.createDataFrame([(1, "ＡＢ", [1, 2]), (2, "ab", [2]), (3, None, None)], "id int, t string, n array<int>")
    assert ids(df.filter(term.apply("=", F.col("t"), "ab"))) == [1, 2] and ids(df.filter(plain.apply("=", F.col("t"), "ab"))) == [2]
    assert ids(df.filter(CLASSES["int4_array_compare"].apply("=", F.col("n"), F.array(F.lit(1), F.lit(2))))) == [1]
    assert ids(df.filter(CLASSES["int4_compare"].apply(">=", F.col("id"), 2))) == [2, 3]
    with pytest.raises(ValueError):
        plain.apply("&@", F.col("t"), "ab")
    with pytest.raises(ValueError):
        CLASSES["varchar_regexp_search_v2"].apply("~~", F.col("t"), "%a%")
    assert CLASSES["text_full_text_search_v2"].analyzer(tokenizer="TokenDelimit").tokenizer == "TokenDelimit" and term.analyzer() == Analyzer(tokenizer="none")
    near = df.select("id", CLASSES["text_semantic_search_v2"].apply("<&@*>", F.col("t"), "ab").alias("d")).collect()
    assert [round(r.d, 6) if r.d is not None else None for r in near][1:] == [0.0, None]


def test_semantic_index(spark, tmp_path):
    V.register_model("length", lambda: lambda t: [1.0, float(len(t))])
    index = V.SemanticIndex(spark, f"file://{tmp_path}/v", "length", passage_prefix="--")
    df = spark.createDataFrame([(1, "a"), (2, "a" * 40), (3, None), (4, "abc")], "id long, t string")
    index.append(df.filter("id < 4"), "id", "t")
    index.append(df.filter("id = 4"), "id", "t")
    assert [r.doc_id for r in index.search("xxxxx", 2).collect()] == [4, 1]
    assert [r.doc_id for r in index.search("xxxxx", 2, where=spark.createDataFrame([(2,)], "doc_id long")).collect()] == [2]
    with pytest.raises(KeyError):
        V.vectorize(F.col("t"), "no such")


def test_stream(spark, memos, tmp_path):
    from sparkseek.streaming.incremental import index_stream, matching_stream

    memos.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(memos.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = IndexStore(spark, f"file://{tmp_path}/s")
    store.create("m", None, "id", ["content"])
    index_stream(stream, store, "m", f"{tmp_path}/c").awaitTermination()
    assert scores(store.open("m").search("rustle")) == {2: 1.0, 3: 1.0}
    assert matching_stream(stream, P.match(C(), "rustle")).isStreaming
