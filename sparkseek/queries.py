"""Queries over the reference operators' whole tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import TERM, Analyzer, EngineConf
from .functions import present
from .functions.normalize import normalize
from .functions.tokenize import tokens_column
from .operators import jsonsearch as J
from .operators import predicates as P
from .operators import vectors as V
from .operators.index import build_index
from .operators.predicates import Condition
from .plans.spread import spread
from .sources.shared import own_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The default tokens, as a pattern of the oracle; the tables hold no unspaced scripts.
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]+"
TOKENS = f"regexp_extract_all(lower(text), '{TOKEN}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scan(name: str, source: str, key: str, condition: Callable[[], Column], where: str) -> None:
    """A query that keeps the keys of rows that pass a predicate."""
    query(name, f"SELECT {key} FROM {source} WHERE {where}")(lambda spark, d: table(spark, d, source).filter(condition()).select(key))




def text() -> Column:
    return F.col("text")


def NAME() -> Column:
    return F.col("p_name")


def WORDS() -> Column:
    return F.split("p_name", " ")


def LEAF() -> Column:
    return F.col("leaves")


DOC = ("documents", "doc_id")

# matches and the query language on a scan
scan("match_term_scan", *DOC, lambda: P.match(text(), "Thtion"), "contains(lower(text), 'thtion')")
scan("match_term_condition", *DOC, lambda: P.match(text(), Condition("quevi", weights=(2,))), "contains(lower(text), 'quevi')")
scan("match_weight_zero", *DOC, lambda: P.match(text(), Condition("the", weights=(0,))), "false")
scan("match_any_of", *DOC, lambda: P.match_any(text(), ["thtion", None, "QUEVI", ""]), "contains(lower(text), 'thtion') OR contains(lower(text), 'quevi')")
scan("match_empty_term", *DOC, lambda: P.match(text(), ""), "false")
scan("query_and", *DOC, lambda: P.query(text(), "tion hea"), "contains(lower(text), 'tion') AND contains(lower(text), 'hea')")
scan("query_or", *DOC, lambda: P.query(text(), "thtion OR quevi OR schau"), "contains(lower(text), 'thtion') OR contains(lower(text), 'quevi') OR contains(lower(text), 'schau')")
scan("query_not", *DOC, lambda: P.query(text(), "tion -thtion"), "contains(lower(text), 'tion') AND NOT contains(lower(text), 'thtion')")
scan("query_leading_not", *DOC, lambda: P.query(text(), "-the"), "NOT contains(lower(text), 'the')")
scan("query_group", *DOC, lambda: P.query(text(), "(thtion OR quevi) -(edly OR eaux)"), "(contains(lower(text), 'thtion') OR contains(lower(text), 'quevi')) AND NOT (contains(lower(text), 'edly') OR contains(lower(text), 'eaux'))")
scan("query_phrase_scan", *DOC, lambda: P.query(text(), '"of the"'), "contains(lower(text), 'of the')")
scan("query_prefix_scan", *DOC, lambda: P.query(text(), "thtion*"), r"len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: starts_with(x, 'thtion'))) > 0")
scan("query_no_syntax_error", *DOC, lambda: P.query(text(), "the |"), "contains(lower(text), 'the') AND contains(text, '|')")
scan("query_blank", *DOC, lambda: P.query(text(), "   "), "false")
scan("query_any_of", *DOC, lambda: P.query_any(text(), ["thtion -the", "quevi eaux"]), "(contains(lower(text), 'thtion') AND NOT contains(lower(text), 'the')) OR (contains(lower(text), 'quevi') AND contains(lower(text), 'eaux'))")
query("query_allow_column", "SELECT doc_id FROM documents WHERE contains(lower(text), 'que') AND contains(lang, 'fr') AND source = 'src3'")(
    lambda spark, d: (t := table(spark, d, "documents")).filter(P.query(t.text, "que lang:@fr source:src3", Analyzer(query_allow_column=True), {"lang": t.lang, "source": t.source})).select("doc_id")
)

# terms: prefixes, equality, patterns, comparisons
PART = ("part", "p_partkey")
scan("prefix", *PART, lambda: P.prefix(NAME(), "B", TERM), "starts_with(lower(p_name), 'b')")
scan("prefix_any_of", *PART, lambda: P.prefix_any(NAME(), ["b", None, "Gr"], TERM), "starts_with(lower(p_name), 'b') OR starts_with(lower(p_name), 'gr')")
scan("not_prefix_any_of", *PART, lambda: P.not_prefix_any(NAME(), ["b", "gr"], TERM), "NOT (starts_with(lower(p_name), 'b') OR starts_with(lower(p_name), 'gr'))")
scan("equal_normalized", "customer", "c_custkey", lambda: P.equal(F.col("c_mktsegment"), "building", TERM), "lower(c_mktsegment) = 'building'")
scan("in_list", *PART, lambda: P.is_in(F.col("p_size"), [1, None, 7, 50]), "p_size IN (1, 7, 50)")
scan("in_empty", *PART, lambda: P.is_in(F.col("p_size"), []), "false")
scan("between", *PART, lambda: P.compare(F.col("p_retailprice"), ">=", 950.0) & P.compare(F.col("p_retailprice"), "<", 1200.0), "p_retailprice >= 950.0 AND p_retailprice < 1200.0")
scan("compare_multiple", "orders", "o_orderkey", lambda: P.compare(F.col("o_custkey"), "<=", 60) & P.compare(F.col("o_totalprice"), ">", 1000.0), "o_custkey <= 60 AND o_totalprice > 1000.0")
scan("compare_timestamp", "events", "event_id", lambda: P.compare(F.col("value"), ">", 0.5) & (F.col("ts") >= F.expr("timestamp '2024-01-01 00:00:00'")), "value > 0.5 AND ts >= timestamp '2024-01-01 00:00:00'")
scan("compare_normalized", "customer", "c_custkey", lambda: P.compare(F.col("c_mktsegment"), "<", "C", TERM), "lower(c_mktsegment) < 'c'")
scan("regexp", *DOC, lambda: P.regexp(text(), r"tion\w+ea\b"), r"regexp_matches(lower(text), 'tion\w+ea\b')")
scan("regexp_begin", *DOC, lambda: P.regexp(text(), r"\Athe"), r"regexp_matches(lower(text), '\Athe')")
scan("regexp_any_of", *DOC, lambda: P.regexp_any(text(), [r"\Athe", None, "", r"license\b"]), r"regexp_matches(lower(text), '\Athe') OR regexp_matches(lower(text), 'license\b')")
scan("like", *PART, lambda: P.like(NAME(), "%a_e%"), "p_name LIKE '%a_e%'")
scan("ilike", "customer", "c_custkey", lambda: P.like(F.col("c_mktsegment"), "%BUILD%", True), "c_mktsegment ILIKE '%BUILD%'")
scan("like_as_regexp", *PART, lambda: F.regexp_like(NAME(), F.lit(P.like_as_regexp("%a_e%"))), "p_name LIKE '%a_e%'")

# arrays
LIST = "string_split(p_name, ' ')"
scan("array_match", *PART, lambda: P.match_array(WORDS(), "RE"), f"len(list_filter({LIST}, lambda x: contains(lower(x), 're'))) > 0")
scan("array_match_any_of", *PART, lambda: P.match_array_any(WORDS(), ["re", "ee"]), f"len(list_filter({LIST}, lambda x: contains(lower(x), 're') OR contains(lower(x), 'ee'))) > 0")
scan("tokens_query", *DOC, lambda: P.query_tokens_of(text(), '"of the" attio* -thtion'), f"doc_id IN (SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE contains(chr(1) || array_to_string(t, chr(1)) || chr(1), chr(1) || 'of' || chr(1) || 'the' || chr(1)) AND len(list_filter(t, lambda x: starts_with(x, 'attio'))) > 0 AND NOT list_contains(t, 'thtion'))")
scan("array_query", *PART, lambda: P.query_array(WORDS(), "r -b"), f"len(list_filter({LIST}, lambda x: contains(lower(x), 'r'))) > 0 AND NOT len(list_filter({LIST}, lambda x: contains(lower(x), 'b'))) > 0")
scan("array_query_any_of", *PART, lambda: P.query_array_any(WORDS(), ["r b", "ee"]), f"(len(list_filter({LIST}, lambda x: contains(lower(x), 'r'))) > 0 AND len(list_filter({LIST}, lambda x: contains(lower(x), 'b'))) > 0) OR len(list_filter({LIST}, lambda x: contains(lower(x), 'ee'))) > 0")
scan("array_weights", *PART, lambda: P.match_array(WORDS(), Condition("r", weights=(0, 1))), f"contains(lower({LIST}[2]), 'r')")
scan("array_equal_query", *PART, lambda: P.equal_query_array(WORDS(), "RED OR small OR b*"), f"len(list_filter({LIST}, lambda x: lower(x) = 'red' OR lower(x) = 'small' OR starts_with(lower(x), 'b'))) > 0")
scan("array_prefix", *PART, lambda: P.prefix_array(WORDS(), "b"), f"len(list_filter({LIST}, lambda x: starts_with(lower(x), 'b'))) > 0")
scan("array_prefix_any_of", *PART, lambda: P.prefix_array_any(WORDS(), ["b", "r"]), f"len(list_filter({LIST}, lambda x: starts_with(lower(x), 'b') OR starts_with(lower(x), 'r'))) > 0")
scan("array_regexp", *PART, lambda: P.regexp_array(WORDS(), r"\A[a-f].*e\z"), rf"len(list_filter({LIST}, lambda x: regexp_matches(lower(x), '\A[a-f].*e\z'))) > 0")
scan("array_contains", *PART, lambda: P.contains_element(WORDS(), "red"), f"list_contains({LIST}, 'red')")
scan("array_contains_all", *PART, lambda: P.contains_all(WORDS(), ["small", "ring"]), f"list_contains({LIST}, 'small') AND list_contains({LIST}, 'ring')")

# scripts and commands
query("script", "SELECT p_partkey FROM part WHERE (p_size >= 10 AND starts_with(lower(p_name), 's')) OR (p_size < 5 AND NOT contains(lower(p_type), 'a'))")(
    lambda spark, d: (t := table(spark, d, "part")).filter(P.script({c: t[c] for c in t.columns}, 'p_size >= 10 && p_name @^ "s" || p_size < 5 &! p_type @ "a"')).select("p_partkey")
)


@query("select_command", "SELECT p_partkey, p_name FROM part WHERE p_size > 20 AND contains(lower(p_name), 'e') ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
def select_command(spark, d):
    from .sources.select import select

    return select(table(spark, d, "part"), filter="p_size > 20", match_columns="p_name", query="e", output_columns="p_partkey, p_name", sort_keys="-p_retailprice,p_partkey", offset=5, limit=20)


@query("command_answer", "SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND contains(lower(p_name), 'bolt') ORDER BY p_partkey LIMIT 30")
def command_answer(spark, d):
    from .sources.command import command

    answer = command(spark, {"Parts": table(spark, d, "part")}, "select Parts --match_columns p_name --query bolt --output_columns p_partkey,p_name --sort_keys p_partkey", ["filter", "p_size > 40", "limit", "30"])
    return present.result_rows(spark, answer)


READINGS = ("ポストグレス", "グルンガ", "ピージールンガ", "ピージーロジカル", "キャッチ", "シャシン", "ハッピ")
query("prefix_romaji", "SELECT * FROM (VALUES ('ピージールンガ'), ('ピージーロジカル'), ('ポストグレス'), ('シャシン')) AS t(reading)")(
    lambda spark, d: spark.createDataFrame([(r,) for r in READINGS], "reading string").filter(P.prefix_romaji_any(F.col("reading"), ["p", None, "しゃ"])).select("reading")
)

# token indexes
def documents_index(spark, d, analyzer=Analyzer()):
    return build_index(table(spark, d, "documents"), "doc_id", ["text"], analyzer)


def parts_index(spark, d):
    return build_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"])


def indexed(name: str, q, where: str, **options) -> None:
    """A query by index, as keys; where: over t, the tokens."""
    query(name, f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE {where}")(lambda spark, d: documents_index(spark, d).search(q, **options).select("doc_id"))


has = lambda w: f"list_contains(t, '{w}')"
phrase = lambda *w: "contains(chr(1) || array_to_string(t, chr(1)) || chr(1), " + "chr(1) || " + " || chr(1) || ".join(f"'{x}'" for x in w) + " || chr(1))"
indexed("token_match_index", "ther", has("ther"))
indexed("index_and", "ther thtion", f"{has('ther')} AND {has('thtion')}")
indexed("index_or", "ther OR quevi OR schau", f"{has('ther')} OR {has('quevi')} OR {has('schau')}")
indexed("index_not", "the -ther", f"{has('the')} AND NOT {has('ther')}")
indexed("index_leading_not", "-the", f"NOT {has('the')}")
indexed("index_phrase", '"of the"', phrase("of", "the"))
indexed("index_phrase_and_not", '"of the" -"to the" -ther', f"{phrase('of', 'the')} AND NOT {phrase('to', 'the')} AND NOT {has('ther')}")
indexed("index_prefix", "thtion*", "len(list_filter(t, lambda x: starts_with(x, 'thtion'))) > 0")
indexed("index_group", "(ther OR que) (the OR de) -eaux", f"({has('ther')} OR {has('que')}) AND ({has('the')} OR {has('de')}) AND NOT {has('eaux')}")
indexed("index_literal_sign", "|", has("|"))
indexed("index_escalated", "attio", "len(list_filter(t, lambda x: starts_with(x, 'attio'))) > 0", conf=EngineConf(escalate=True))
indexed("index_forced_escalation", "thti blean", "len(list_filter(t, lambda x: starts_with(x, 'thti'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'blean'))) > 0", conf=EngineConf(force_match_escalation=True))
TF = "len(list_filter(t, lambda x: x = '{}'))"
T = f"(SELECT doc_id, {TOKENS} AS t FROM documents)"
query("score_tf", f"SELECT doc_id, ({TF.format('the')} + {TF.format('of')})::DOUBLE AS score FROM {T} WHERE {has('the')} OR {has('of')}")(lambda spark, d: documents_index(spark, d).search("the OR of"))
query("score_tf_at_most", f"SELECT doc_id, (5.0 * (least({TF.format('the')}, 2.5) + least({TF.format('ther')}, 2.5)))::DOUBLE AS score FROM {T} WHERE {has('the')} AND {has('ther')}")(
    lambda spark, d: documents_index(spark, d).search(Condition("the ther", weights=(5,), scorers=("scorer_tf_at_most($index, 2.5)",)))
)
query("score_tf_idf", f"WITH t AS {T}, h AS (SELECT doc_id, {TF.format('ther')} AS tf FROM t WHERE {has('ther')}) SELECT doc_id, round(tf * (1.0 + ln((SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM h))), 6) AS score FROM h")(
    lambda spark, d: documents_index(spark, d).search(Condition("ther", scorers=("scorer_tf_idf($index)",))).select("doc_id", F.round("score", 6).alias("score"))
)
PARTS = "(SELECT p_partkey, string_split(lower(p_name), ' ') AS n, string_split(lower(p_type), ' ') AS y FROM part)"
COUNT = "len(list_filter({}, lambda x: x = '{}'))"
query("score_weighted_sections", f"SELECT p_partkey AS doc_id, (3 * {COUNT.format('n', 'small')} + {COUNT.format('y', 'small')})::DOUBLE AS score FROM {PARTS} WHERE list_contains(n, 'small') OR list_contains(y, 'small')")(
    lambda spark, d: parts_index(spark, d).search(Condition("small", weights=(3, None)))
)
query("score_weight_zero", f"SELECT p_partkey AS doc_id, (2 * {COUNT.format('y', 'small')})::DOUBLE AS score FROM {PARTS} WHERE list_contains(y, 'small')")(lambda spark, d: parts_index(spark, d).search(Condition("small", weights=(0, 2))))
query("weights_short_of_sections", f"SELECT p_partkey AS doc_id FROM {PARTS} WHERE list_contains(n, 'small')")(lambda spark, d: parts_index(spark, d).search(Condition("small", weights=(1,))).select("doc_id"))
query("fuzzy", f"SELECT doc_id, max(2 - levenshtein(regexp_replace(x, '[^a-z]', '?', 'g'), 'heaa') + 1)::DOUBLE AS score FROM (SELECT doc_id, unnest(t) AS x FROM {T}) WHERE levenshtein(regexp_replace(x, '[^a-z]', '?', 'g'), 'heaa') <= 2 GROUP BY doc_id")(
    lambda spark, d: documents_index(spark, d).search(Condition("heaa", fuzzy_max_distance_ratio=0.5))
)
query("topk_search", f"SELECT doc_id, ({TF.format('the')} + {TF.format('que')})::DOUBLE AS score FROM {T} WHERE {has('the')} OR {has('que')} ORDER BY score DESC, doc_id LIMIT 25")(
    lambda spark, d: documents_index(spark, d).search("the OR que").orderBy(F.desc("score"), "doc_id").limit(25)
)
query("search_with_rows", f"SELECT d.doc_id, lang, source, {TF.format('ther')}::DOUBLE AS score FROM documents d JOIN {T} t USING (doc_id) WHERE {has('ther')}")(
    lambda spark, d: table(spark, d, "documents").join(documents_index(spark, d).search("ther"), "doc_id").select("doc_id", "lang", "source", "score")
)
query("search_then_group", f"SELECT lang, count(*) AS n, sum({TF.format('la')})::DOUBLE AS score FROM documents d JOIN {T} t USING (doc_id) WHERE {has('la')} GROUP BY lang")(
    lambda spark, d: table(spark, d, "documents").join(documents_index(spark, d).search("la"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
)
query("lexicon", f"SELECT x AS token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM {T}) GROUP BY x")(lambda spark, d: documents_index(spark, d).lexicon())
query("similar", f"SELECT doc_id, n::DOUBLE AS score FROM (SELECT doc_id, {' + '.join(f'{has(w)}::INT' for w in ('the', 'ther', 'tion', 'of'))} AS n FROM {T}) WHERE n >= 2")(lambda spark, d: documents_index(spark, d).similar("the ther of tion"))
query("tokens_delimited", "SELECT p_partkey, unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS token FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(tokens_column(F.col("p_name"), Analyzer(tokenizer="TokenDelimit"))).alias("token")))
query("index_text_key", "SELECT c_name AS doc_id, 1.0::DOUBLE AS score FROM customer WHERE lower(c_mktsegment) = 'building'")(lambda spark, d: build_index(table(spark, d, "customer"), "c_name", ["c_mktsegment"]).search("building"))
query("index_array", f"SELECT p_partkey AS doc_id FROM part WHERE list_contains({LIST}, 'small') AND NOT list_contains({LIST}, 'ring')")(
    lambda spark, d: build_index(table(spark, d, "part").select("p_partkey", WORDS().alias("words")), "p_partkey", ["words"]).search("small -ring").select("doc_id")
)
query("row_policy", f"SELECT doc_id FROM {T} t JOIN documents d USING (doc_id) WHERE source = 'src1' AND {has('the')}")(
    lambda spark, d: build_index(table(spark, d, "documents").filter("source = 'src1'"), "doc_id", ["text"]).search("the").select("doc_id")
)
query("index_union", f"SELECT doc_id FROM {T} WHERE {has('ther')} UNION SELECT doc_id FROM documents WHERE starts_with(lower(text), 'th')")(
    lambda spark, d: documents_index(spark, d).search("ther").select("doc_id").union(table(spark, d, "documents").filter(P.prefix(text(), "th")).select("doc_id")).distinct()
)
query("count_matches", f"SELECT count(*) AS n FROM {T} WHERE {has('the')}")(lambda spark, d: documents_index(spark, d).search("the").agg(F.count("*").alias("n")))
query("index_only_range", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")(lambda spark, d: table(spark, d, "orders").select("o_orderkey").filter(P.compare(F.col("o_orderkey"), ">=", 1000) & P.compare(F.col("o_orderkey"), "<", 5000)))
query("ordered_scan", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")(lambda spark, d: table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10))
query("completion", "SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 's') ORDER BY p_name LIMIT 10")(lambda spark, d: table(spark, d, "part").filter(P.prefix(NAME(), "s", TERM)).select("p_name").distinct().orderBy("p_name").limit(10))


def stored(spark, d, change):
    """A fresh store with an index over part, changed, then searched."""
    from .sources.store import IndexStore

    return change(IndexStore(spark, own_folder(spark, "indexes")), table(spark, d, "part"))


@query("store_append_delete", f"SELECT p_partkey AS doc_id FROM {PARTS} WHERE list_contains(n, 'small') AND p_partkey % 10 <> 3")
def store_append_delete(spark, d):
    def change(store, part):
        store.create("parts", part.filter("p_size <= 25"), "p_partkey", ["p_name"])
        store.append("parts", part.filter("p_size > 25"))
        store.delete("parts", part.filter("p_partkey % 10 = 3").select("p_partkey"))
        return store.open("parts").search("small").select("doc_id")

    return stored(spark, d, change)


@query("store_vacuum", f"SELECT p_partkey AS doc_id FROM {PARTS} WHERE list_contains(n, 'small') AND list_contains(n, 'ring') AND p_partkey % 10 <> 3")
def store_vacuum(spark, d):
    def change(store, part):
        store.create("parts", part, "p_partkey", ["p_name"])
        store.delete("parts", part.filter("p_partkey % 10 = 3").select("p_partkey"))
        store.vacuum("parts")
        return store.open("parts").search("small ring").select("doc_id")

    return stored(spark, d, change)


@query("streaming_index", f"SELECT doc_id, {TF.format('ther')}::DOUBLE AS score FROM {T} WHERE {has('ther')}")
def streaming_index(spark, d):
    from .streaming.incremental import index_stream

    def change(store, _):
        rows = spark.readStream.schema(table(spark, d, "documents").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")  # a pattern, so that one file is as good as a folder
        store.create("documents", None, "doc_id", ["text"])
        index_stream(rows, store, "documents", f"{store.path}-progress").awaitTermination()
        return store.open("documents").search("ther")

    return stored(spark, d, change)


# JSON
def events_leaves(spark, d):
    return table(spark, d, "events").select("event_id", J.json_leaves(F.col("props")).alias("leaves"))


for name, condition, where in (
    ("json_script_number", lambda: J.json_script(LEAF(), 'number <= 50 && type == "number"'), "CAST(json_extract(props, '$.k') AS DOUBLE) <= 50"),
    ("json_script_paths", lambda: J.json_script(LEAF(), 'paths @ ".k" && number > 90'), "CAST(json_extract(props, '$.k') AS DOUBLE) > 90"),
    ("json_script_type", lambda: J.json_script(LEAF(), 'type == "object" && size == 1'), "len(json_keys(props)) = 1"),
    ("json_contain", lambda: J.json_contains(LEAF(), '{"k": 87}'), "CAST(json_extract(props, '$.k') AS DOUBLE) = 87"),
    ("json_contain_empty", lambda: J.json_contains(LEAF(), "{}"), "props IS NOT NULL"),
):
    query(name, f"SELECT event_id FROM events WHERE {where}")(lambda spark, d, c=condition: events_leaves(spark, d).filter(c()).select("event_id"))


def talks(spark, d):
    """Turns of conversations as JSON documents."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", J.json_leaves(F.to_json(F.struct("role", F.struct("text").alias("body")))).alias("leaves"))


query("json_query_same_leaf", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'hea') OR contains(lower(role), 'the') AND NOT contains(lower(role), 'hea')")(
    lambda spark, d: talks(spark, d).filter(J.json_query(LEAF(), "the -hea")).select("conv_id", "turn")
)
query("json_match", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'edly') OR contains(lower(role), 'edly')")(lambda spark, d: talks(spark, d).filter(J.json_match(LEAF(), "Edly")).select("conv_id", "turn"))
query("json_match_path", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'thtion')")(lambda spark, d: talks(spark, d).filter(J.json_script(LEAF(), 'path == ".[\\"body\\"][\\"text\\"]" && string @ "thtion"')).select("conv_id", "turn"))
query("json_full_text", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'edly') OR contains(lower(role), 'edly')")(lambda spark, d: talks(spark, d).filter(P.match_array(J.json_full_text(LEAF()), "edly")).select("conv_id", "turn"))

# presentation and scalar functions
query("highlight_html", "SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(thtion)', '<span class=\"keyword\">\\1</span>', 'gi') AS html FROM documents")(
    lambda spark, d: spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", present.highlight_html_column(text(), ["thtion"]).alias("html"))
)
query("match_positions", "SELECT doc_id, len(regexp_extract_all(lower(text), 'thtion')) AS n, strpos(lower(text), 'thtion') - 1 AS first_at FROM documents WHERE contains(lower(text), 'thtion')")(
    lambda spark, d: table(spark, d, "documents").filter(P.match(text(), "thtion")).select("doc_id", present.match_positions_character_column(text(), ["thtion"]).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.get(F.get("p", F.lit(0)), F.lit(0)).cast("long").alias("first_at"))
)
query("match_positions_byte", "SELECT doc_id, octet_length(encode(split_part(lower(text), 'quevi', 1)))::BIGINT AS first_at FROM documents WHERE contains(lower(text), 'quevi')")(
    lambda spark, d: table(spark, d, "documents").filter(P.match(text(), "quevi")).select("doc_id", F.get(F.get(present.match_positions_byte_column(text(), ["quevi"]), F.lit(0)), F.lit(0)).cast("long").alias("first_at"))
)
query("snippet_html")(lambda spark, d: spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", present.snippet_html_column(text(), ["thtion", "quevi"]).alias("snippets")))
query("normalize", "SELECT doc_id, lower(text) AS normalized FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", normalize(text()).alias("normalized")))
query("query_escape", r"""SELECT doc_id, regexp_replace(text, '([+\-<>~*()"\\:])', '\\\1', 'g') AS escaped FROM documents""")(lambda spark, d: table(spark, d, "documents").select("doc_id", present.query_escape(text()).alias("escaped")))
query("command_escape_value", r"""SELECT doc_id, '"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' AS escaped FROM documents""")(lambda spark, d: table(spark, d, "documents").select("doc_id", present.command_escape_value(text()).alias("escaped")))
query("escape_string", r"""SELECT doc_id, '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' AS escaped FROM documents""")(lambda spark, d: table(spark, d, "documents").select("doc_id", present.escape(text()).alias("escaped")))
query("escape_values", "SELECT event_id, CAST(user_id AS VARCHAR) AS i, CAST(value > 10 AS VARCHAR) AS b, CAST(epoch_us(date_trunc('second', ts)) // 1000000 AS VARCHAR) AS t FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", present.escape(F.col("user_id"), "int").alias("i"), present.escape(F.col("value") > 10, "boolean").alias("b"), present.escape(F.date_trunc("second", "ts"), "timestamp").alias("t"))
)
SYNONYMS = [("the", ["le", "der"]), ("of", ["de"])]
query("query_expand", "SELECT p_partkey, CASE WHEN string_split(p_name, ' ')[1] = 'small' THEN '((tiny) OR (little))' ELSE string_split(p_name, ' ')[1] END || ' ' || CASE WHEN string_split(p_name, ' ')[2] = 'small' THEN '((tiny) OR (little))' ELSE string_split(p_name, ' ')[2] END AS expanded FROM part")(
    lambda spark, d: present.expand_queries(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", spark.createDataFrame([("Small", ["tiny", "little"])], "term string, synonyms array<string>"), "term", "synonyms").select("p_partkey", "expanded")
)
query("expanded_search", f"SELECT doc_id FROM {T} WHERE ({has('ther')} OR {has('que')}) AND NOT {has('thtion')}")(lambda spark, d: documents_index(spark, d).search(present.expand_query("word -thtion", {"word": [["ther", "que"]]})).select("doc_id"))
query("extract_keywords", "SELECT unnest(['hea', 'que', 'of the']) AS keyword")(lambda spark, d: spark.createDataFrame([(k,) for k in P.keywords('(hea OR que) -thtion "of the"')], "keyword string"))
query("result_to_rows", "SELECT * FROM (VALUES (1::BIGINT, 'a', 2.5::DOUBLE), (2, 'b', NULL)) AS t(id, title, score)")(
    lambda spark, d: present.result_rows(spark, '[[0,0.0,0.0],[[[2],[["id","UInt32"],["title","ShortText"],["score","Float"]],[1,"a",2.5],[2,"b",null]]]]')
)

# vectors
TARGET = [((i * 37) % 11 - 5) / 10 for i in range(64)]
LITERAL = "[" + ", ".join(f"{x!r}" for x in TARGET) + "]::DOUBLE[]"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {LITERAL})"
query("knn_cosine", f"SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 20")(lambda spark, d: V.knn(table(spark, d, "embeddings"), "embedding", TARGET, 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity")))
query("knn_filtered", f"SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY {COS} DESC, vec_id LIMIT 10")(lambda spark, d: V.knn(table(spark, d, "embeddings"), "embedding", TARGET, 10, "vec_id", F.col("label") == 3).select("vec_id", F.round("similarity", 6).alias("similarity")))
query("cosine_distance", f"SELECT vec_id, round(1 - {COS}, 6) AS distance FROM embeddings")(lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(1 - V.cosine_to(F.col("embedding"), TARGET), 6).alias("distance")))
query("semantic_search")(lambda spark, d: V.semantic_search(table(spark, d, "documents"), "text", "the thtion of hea", 20, "doc_id").select("doc_id", "similarity"))


# functions of spark.sql, several a query
_registered: set[str] = set()


def with_functions(spark: SparkSession) -> None:
    from .functions.sql import register

    if spark.sparkContext.applicationId not in _registered:
        register(spark)
        _registered.add(spark.sparkContext.applicationId)


def by_sql(name: str, source: str, columns: dict[str, tuple[str, str]], prepare=lambda df: df) -> None:
    """A query of expressions over a table: column to (Spark's expression, the oracle's)."""

    @query(name, f"SELECT {', '.join(f'{o} AS {c}' for c, (_, o) in columns.items())} FROM {source}")
    def run(spark, d):
        with_functions(spark)
        return prepare(table(spark, d, source)).select(*[F.expr(s).alias(c) for c, (s, _) in columns.items()])


by_sql("sql_text_predicates", "documents", {
    "doc_id": ("doc_id", "doc_id"),
    "m": ("seek_match(text, 'ＴＨtion')", "contains(lower(text), 'thtion')"), "mi": ("seek_match_in(text, array('', 'Quevi', 'thtion'))", "contains(lower(text), 'quevi') OR contains(lower(text), 'thtion')"),
    "p": ("seek_prefix(text, 'The')", "starts_with(lower(text), 'the')"), "pi": ("seek_prefix_in(text, array('ｔｈ', 'x'))", "starts_with(lower(text), 'th') OR starts_with(lower(text), 'x')"),
    "np": ("seek_not_prefix_in(text, array('ｔｈ', 'x'))", "NOT (starts_with(lower(text), 'th') OR starts_with(lower(text), 'x'))"),
    "r": (r"seek_regexp(text, r'tion\w+ea\b')", r"regexp_matches(lower(text), 'tion\w+ea\b')"), "ri": (r"seek_regexp_in(text, array(r'\Athe', '', r'license\b'))", r"regexp_matches(lower(text), '\Athe') OR regexp_matches(lower(text), 'license\b')"),
    "q": ("seek_query(text, 'thtion -hea OR quevi')", "contains(lower(text), 'thtion') AND NOT contains(lower(text), 'hea') OR contains(lower(text), 'quevi')"),
    "qi": ("seek_query_in(text, array('thtion hea', 'quevi'))", "contains(lower(text), 'thtion') AND contains(lower(text), 'hea') OR contains(lower(text), 'quevi')"),
    "n": ("octet_length(seek_normalize(text))", "octet_length(encode(lower(text)))"),
})
by_sql("sql_array_predicates", "part", {
    "p_partkey": ("p_partkey", "p_partkey"), "e": ("seek_equal(p_name, 'SMALL ring')", "lower(p_name) = 'small ring'"),
    "m": ("seek_match_array(w, 'ＲE')", f"len(list_filter({LIST}, lambda x: contains(x, 're'))) > 0"), "mi": ("seek_match_in_array(w, array('Re', 'ee', ''))", f"len(list_filter({LIST}, lambda x: contains(x, 're') OR contains(x, 'ee'))) > 0"),
    "p": ("seek_prefix_array(w, 'B')", f"len(list_filter({LIST}, lambda x: starts_with(x, 'b'))) > 0"), "pi": ("seek_prefix_in_array(w, array('ｂ', 'R'))", f"len(list_filter({LIST}, lambda x: starts_with(x, 'b') OR starts_with(x, 'r'))) > 0"),
    "r": (r"seek_regexp_array(w, r'\A[a-f].*e\z')", rf"len(list_filter({LIST}, lambda x: regexp_matches(x, '\A[a-f].*e\z'))) > 0"), "c": ("seek_contain(w, 'red')", f"list_contains({LIST}, 'red')"),
    "ca": ("seek_contain_all(w, array('small', 'ring'))", f"list_contains({LIST}, 'small') AND list_contains({LIST}, 'ring')"),
    "q": ("seek_query_array(w, 'r -b')", f"len(list_filter({LIST}, lambda x: contains(x, 'r'))) > 0 AND NOT len(list_filter({LIST}, lambda x: contains(x, 'b'))) > 0"),
    "qe": ("seek_equal_query_array(w, 'RED OR small OR b*')", f"len(list_filter({LIST}, lambda x: x = 'red' OR x = 'small' OR starts_with(x, 'b'))) > 0"),
}, lambda df: df.withColumn("w", WORDS()))
by_sql("sql_escapes", "documents", {
    "doc_id": ("doc_id", "doc_id"), "q": ("seek_query_escape(text)", r"""regexp_replace(text, '([+\-<>~*()"\\:])', '\\\1', 'g')"""), "e": ("seek_escape(text)", r"""'"' || replace(replace(text, '\', '\\'), '"', '\"') || '"'"""),
    "l": ("seek_escape_long(n_chars)", "n_chars::VARCHAR"), "b": ("seek_escape_boolean(n_chars > 500)", "(n_chars > 500)::VARCHAR"),
})
by_sql("sql_presentation", "part", {
    "p_partkey": ("p_partkey", "p_partkey"), "h": ("seek_highlight_html(p_name, array('re'))", "replace(p_name, 're', '<span class=\"keyword\">re</span>')"),
    "ha": ("array_join(seek_highlight_html_array(split(p_name, ' '), array('re')), '|')", "replace(replace(p_name, ' ', '|'), 're', '<span class=\"keyword\">re</span>')"),
    "s": ("array_join(seek_snippet_html(p_name, array('re')), '|')", "CASE WHEN contains(p_name, 're') THEN replace(p_name, 're', '<span class=\"keyword\">re</span>') ELSE '' END"),
    "pc": ("coalesce(get(get(seek_match_positions_character(p_name, array('r')), 0), 0), -1)", "(strpos(p_name, 'r') - 1)::INT"), "t": ("size(seek_tokenize(p_name, 'TokenDelimit'))", "len(string_split(p_name, ' '))::INT"),
    "k": ("array_join(seek_query_extract_keywords(replace(p_name, ' ', ' OR ')), '|')", "replace(p_name, ' ', '|')"),
})
by_sql("sql_json", "events", {
    "event_id": ("event_id", "event_id"), "c": ("""seek_json_contains(props, '{"k": 87}')""", "CAST(json_extract(props, '$.k') AS DOUBLE) = 87"), "m": ("seek_json_match(to_json(named_struct('a', array(event_type))), 'CLI')", "contains(lower(event_type), 'cli')"),
    "q": ("seek_json_query(to_json(named_struct('a', event_type)), 'c -k')", "contains(lower(event_type), 'c') AND NOT contains(lower(event_type), 'k')"),
})
by_sql("sql_cosine", "embeddings", {"vec_id": ("vec_id", "vec_id"), "c": (f"round(seek_cosine(transform(embedding, x -> cast(x as double)), array({', '.join(f'{x!r}D' for x in TARGET)})), 6)", f"round({COS}, 6)")})

# over arrays, with names, and of stored indexes
query("highlight_array", "SELECT p_partkey, replace(replace(p_name, ' ', '|'), 're', '<span class=\"keyword\">re</span>') AS html FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(present.highlight_html_array_column(WORDS(), ["re"]), "|").alias("html"))
)
query("snippet_html_short", "SELECT p_partkey, CASE WHEN contains(p_name, 're') THEN replace(p_name, 're', '<span class=\"keyword\">re</span>') ELSE '' END AS snippets FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(present.snippet_html_column(NAME(), ["re"]), "|").alias("snippets"))
)
query("match_positions_array", f"SELECT p_partkey, list_aggregate(list_transform({LIST}, lambda x: CASE WHEN contains(x, 're') THEN (strpos(x, 're') - 1)::VARCHAR ELSE '-' END), 'string_agg', '|') AS at FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(F.transform(present.match_positions_byte_array_column(WORDS(), ["re"]), lambda p: F.coalesce(F.get(F.get(p, F.lit(0)), F.lit(0)).cast("string"), F.lit("-"))), "|").alias("at"))
)
query("normalize_named", "SELECT doc_id, lower(text) AS normalized FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", normalize(text(), "NormalizerAuto").alias("normalized")))
query("result_objects", """SELECT '[{"id": 1, "title": "a"}, {"id": 2, "title": "b"}]' AS objects""")(
    lambda spark, d: spark.createDataFrame([(present.result_objects('[[0,0.0,0.0],[[[2],[["id","UInt32"],["title","ShortText"]],[1,"a"],[2,"b"]]]]'),)], "objects string")
)
query("prefix_romaji_array", "SELECT * FROM (VALUES (0), (1), (2)) AS t(id)")(
    lambda spark, d: spark.createDataFrame([(i // 2, r) for i, r in enumerate(READINGS)], "id int, reading string").groupBy("id").agg(F.collect_list("reading").alias("readings")).filter(P.prefix_romaji_array_any(F.col("readings"), ["po", "pi-ji-", "kya"])).select("id")
)
BOTH = f"(SELECT p_partkey AS doc_id, {' + '.join(f'''(list_contains(n, '{w}') OR list_contains(y, '{w}'))::INT''' for w in ('small', 'ring', 'steel', 'red'))} AS k, {' + '.join(f'''CASE WHEN list_contains(n, '{w}') THEN 3 WHEN list_contains(y, '{w}') THEN 1 ELSE 0 END''' for w in ('small', 'ring', 'steel', 'red'))} AS s FROM {PARTS})"
query("similar_sections", f"SELECT doc_id, s::DOUBLE AS score FROM {BOTH} WHERE k >= 2")(lambda spark, d: parts_index(spark, d).similar(Condition("small ring steel red", weights=(3, 1))))
query("similar_distance", f"SELECT doc_id, 1 - k / 4.0::DOUBLE AS distance FROM {BOTH} WHERE k > 0")(lambda spark, d: parts_index(spark, d).similar_distance("small ring steel red"))


def half_indexed(store, part):
    store.create("parts", part.filter("p_size <= 25"), "p_partkey", ["p_name", "p_type"], table="part")
    store.append("parts", part.filter("p_size between 26 and 40"))
    store.delete("parts", part.filter("p_size = 40").select("p_partkey"))
    return store


query("store_lagged", "SELECT p_partkey FROM part WHERE p_size >= 40")(lambda spark, d: stored(spark, d, lambda store, part: half_indexed(store, part).lagged(part, "parts").select("p_partkey")))
query("store_status", "SELECT 'parts' AS name, 2 AS segments, 1 AS deletions, 'part' AS indexed, 'p_type' AS second, 0 AS broken, 9::BIGINT AS applied")(
    lambda spark, d: stored(spark, d, lambda store, part: (half_indexed(store, part), store.set_applied_position("parts", 9))[0].status().select("name", "segments", "deletions", F.lit(store.table_name("parts")).alias("indexed"), F.lit(store.column_name("parts", 1)).alias("second"), F.lit(len(store.broken())).alias("broken"), F.lit(store.applied_position("parts")).cast("long").alias("applied")))
)
query("store_fuzzy", f"SELECT p_partkey AS doc_id FROM {PARTS} WHERE len(list_filter(list_concat(n, y), lambda x: levenshtein(x, 'smell') <= 1)) > 0")(
    lambda spark, d: stored(spark, d, lambda store, part: store.create("parts", part, "p_partkey", ["p_name", "p_type"]).search(Condition("smell", fuzzy_max_distance_ratio=0.2)).select("doc_id"))
)


@query("store_compacted", f"SELECT p_partkey AS doc_id FROM {PARTS} WHERE list_contains(n, 'small') AND p_partkey % 10 <> 3")
def store_compacted(spark, d):
    """Eighteen appends, which leave a merged segment and two others."""

    def change(store, part):
        store.create("parts", None, "p_partkey", ["p_name"])
        for i in range(18):
            store.append("parts", part.filter(F.col("p_partkey") % 18 == i))
            if i == 4:
                store.delete("parts", part.filter("p_partkey % 10 = 3 and p_partkey % 18 <= 4").select("p_partkey"))
        store.delete("parts", part.filter("p_partkey % 10 = 3").select("p_partkey"))
        return store.open("parts").search("small").select("doc_id")

    return stored(spark, d, change)


# operators of classes, as a column's declaration chooses them
def by_class(name: str, source: str, key: str, columns: dict[str, tuple[str, str, object, str]], prepare=lambda df: df, value: Callable[[], Column] = text) -> None:
    """A query of operators: column to (class, sign, operand, the oracle's expression)."""

    @query(name, f"SELECT {key}, {', '.join(f'{o} AS {c}' for c, (*_, o) in columns.items())} FROM {source}")
    def run(spark, d):
        from .operators.classes import CLASSES

        return prepare(table(spark, d, source)).select(key, *[CLASSES[k].apply(sign, value(), operand).alias(c) for c, (k, sign, operand, _) in columns.items()])


FT, TS, RX = "text_full_text_search_v2", "text_term_search_v2", "text_regexp_search_v2"
by_class("class_full_text", "documents", "doc_id", {
    "like": (FT, "~~", "%tion%", "text LIKE '%tion%'"), "m": (FT, "&@", "Thtion", "contains(lower(text), 'thtion')"), "q": (FT, "&@~", "thtion -hea", "contains(lower(text), 'thtion') AND NOT contains(lower(text), 'hea')"),
    "mi": (FT, "&@|", ["quevi", None, "thtion"], "contains(lower(text), 'quevi') OR contains(lower(text), 'thtion')"), "qi": (FT, "&@~|", ["thtion hea", "quevi"], "contains(lower(text), 'thtion') AND contains(lower(text), 'hea') OR contains(lower(text), 'quevi')"),
    "old": ("varchar_full_text_search", "%%", "quevi", "contains(lower(text), 'quevi')"), "r": (RX, "&~", r"tion\w+ea\b", r"regexp_matches(lower(text), 'tion\w+ea\b')"), "ri": (RX, "&~|", [r"\Athe", r"license\b"], r"regexp_matches(lower(text), '\Athe') OR regexp_matches(lower(text), 'license\b')"),
    "script": (FT, "&`", 'value @ "thtion" && value @ "hea"', "contains(lower(text), 'thtion') AND contains(lower(text), 'hea')"),
})
by_class("class_terms", "part", "p_partkey", {
    "folded": (TS, "=", "SMALL ring", "lower(p_name) = 'small ring'"), "plain": ("varchar_compare", "=", "SMALL ring", "p_name = 'SMALL ring'"), "less": (TS, "<", "RED", "lower(p_name) < 'red'"), "p": (TS, "&^", "Small", "starts_with(lower(p_name), 'small')"),
    "pi": (TS, "&^|", ["b", "R"], "starts_with(lower(p_name), 'b') OR starts_with(lower(p_name), 'r')"), "np": (TS, "!&^|", ["b", "R"], "NOT (starts_with(lower(p_name), 'b') OR starts_with(lower(p_name), 'r'))"), "e": ("varchar_term_search_v2", "&=", "red BOLT", "lower(p_name) = 'red bolt'"),
}, value=NAME)
by_class("class_arrays", "part", "p_partkey", {
    "m": ("text_array_full_text_search_v2", "&@", "RE", f"len(list_filter({LIST}, lambda x: contains(x, 're'))) > 0"), "q": ("text_array_full_text_search", "&?", "r -b", f"len(list_filter({LIST}, lambda x: contains(x, 'r'))) > 0 AND NOT len(list_filter({LIST}, lambda x: contains(x, 'b'))) > 0"),
    "all_of": ("text_array_term_search_v2", "@>", ["small", "ring"], f"list_contains({LIST}, 'small') AND list_contains({LIST}, 'ring')"), "p": ("text_array_term_search_v2", "&^>", "B", f"len(list_filter({LIST}, lambda x: starts_with(x, 'b'))) > 0"),
    "one": ("varchar_array_term_search_v2", "&>", "red", f"list_contains({LIST}, 'red')"), "eq": ("varchar_array_term_search_v2", "&=~", "RED OR b*", f"len(list_filter({LIST}, lambda x: x = 'red' OR starts_with(x, 'b'))) > 0"),
    "r": ("text_array_regexp_search_v2", "&~", r"\A[a-f].*e\z", rf"len(list_filter({LIST}, lambda x: regexp_matches(x, '\A[a-f].*e\z'))) > 0"),
}, value=WORDS)
by_class("class_json", "events", "event_id", {
    "c": ("json_json_v2", "@>", '{"k": 87}', "CAST(json_extract(props, '$.k') AS DOUBLE) = 87"), "s": ("json_json_v2", "&`", 'paths @ ".k" && number > 90', "CAST(json_extract(props, '$.k') AS DOUBLE) > 90"), "m": ("json_full_text_search_v2", "&@", "zz", "false"),
}, lambda df: df.withColumn("leaves", J.json_leaves(F.col("props"))), LEAF)


@query("command_drilldown", "SELECT p_size, count(*) AS n FROM part WHERE contains(lower(p_name), 'bolt') GROUP BY p_size ORDER BY n DESC, p_size LIMIT 12")
def command_drilldown(spark, d):
    import json

    from .sources.command import command

    answer = json.loads(command(spark, {"Parts": table(spark, d, "part")}, "select Parts --match_columns p_name --query bolt --limit 0 --drilldown p_size --drilldown_limit 12"))
    return spark.createDataFrame([tuple(r) for r in answer[1][1][2:]], "p_size int, n long")
