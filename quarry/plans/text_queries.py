"""Queries over text functions and reply parsers, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import classes, replies, text
from quarry.operators import metrics
from quarry.sources import star_kg

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("text_token_estimate", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r\x0B]+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("n"))


NORM = r"lower(array_to_string(list_filter(regexp_split_to_array(replace(replace({c}, '_', ' '), '/', ' / '), '[ \t\n\f\r\x0B]+'), lambda w: w <> ''), ' '))"


@query("text_normalize_class", "SELECT p_partkey, " + NORM.format(c="p_type || '/Sub_' || p_brand || ' '") + " AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_class(F.concat("p_type", F.lit("/Sub_"), "p_brand", F.lit(" "))).alias("name"))


@query("text_normalize_answer", r"SELECT o_orderkey, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(trim(' The ' || o_orderstatus || '-Tower, a ' || o_orderpriority || '! ')), '\b(a|an|the)\b', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g'), ' '), lambda w: w <> ''), ' ') AS answer FROM orders")
def _(spark, d):
    raw = F.concat(F.lit(" The "), "o_orderstatus", F.lit("-Tower, a "), "o_orderpriority", F.lit("! "))
    return table(spark, d, "orders").select("o_orderkey", text.normalize_answer(raw).alias("answer"))


REPLY = "'<think>Answer: no' || chr(10) || 'x</think> <|im|>Answer: {\"id\": ' || conv_id || '} ' || role || '<tool_call>y</tool_call> Answer: [' || turn || '] ' || role || ' '"


def _reply():
    return F.concat(F.lit("<think>Answer: no\nx</think> <|im|>Answer: {\"id\": "), F.col("conv_id").cast("string"), F.lit("} "), "role", F.lit("<tool_call>y</tool_call> Answer: ["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(" "))


BLOCKS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<think>.*?</think>', '', 'g'), '(?s)<tool_call>.*?</tool_call>', '', 'g'), '(?s)<tool_response>.*?</tool_response>', '', 'g'), '(?s)<\|.*?\|>', '', 'g'), " + WS + ")"
AFTER = "trim(list_extract(string_split(list_extract(string_split({c}, 'Answer:'), -1), 'answer:'), -1), " + WS + ")"


@query("text_clean_output", f"SELECT conv_id, turn, {BLOCKS.format(c=REPLY)} AS blocks, {AFTER.format(c=REPLY)} AS after, {BLOCKS.format(c='(' + AFTER.format(c=REPLY) + ')')} AS clean FROM conversations")
def _(spark, d):
    r = _reply()
    return table(spark, d, "conversations").select("conv_id", "turn", text.remove_blocks(r).alias("blocks"), text.after_answer(r).alias("after"), text.clean_raw_output(r).alias("clean"))


@query("text_documents_cleaned", f"SELECT doc_id, md5({BLOCKS.format(c='text')}) AS blocks, md5({AFTER.format(c='text')}) AS after FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.remove_blocks("text")).alias("blocks"), F.md5(text.after_answer("text")).alias("after"))


VERB = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[/_.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' +', ' ', 'g')))"


@query("text_relation_names", "SELECT p_partkey, " + VERB.format(c="'/film/writtenBy_XMLFile.' || p_brand") + " AS verbal, 'Given the head entity \"' || p_name || '\", which candidate entity best completes the relation \"' || " + VERB.format(c="'has' || p_brand") + " || '\"?' AS question FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.verbalize_relation(F.concat(F.lit("/film/writtenBy_XMLFile."), "p_brand")).alias("verbal"), text.fallback_question("p_name", F.concat(F.lit("has"), "p_brand")).alias("question"))


@query("text_formats", "WITH " + star_kg.SQL + " SELECT id, CASE WHEN len(classes) = 0 THEN 'Unknown' ELSE array_to_string(classes, ', ') END AS classes, ' (score=' || printf('%d.%04d', id % 7, id % 10000) || ', eta=' || printf('0.%02d', id % 100) || ')' AS suffix, (id % 30) || '. text ' || label AS line, 'text ' || label AS plain FROM ent")
def _(spark, d):
    e = star_kg.load(spark, d).entities
    score = F.col("id") % 7 + (F.col("id") % 10000) / 10000.0
    line = F.concat((F.col("id") % 30).cast("string"), F.lit(". text "), "label")
    return e.select("id", text.class_list("classes").alias("classes"), text.score_suffix(score, (F.col("id") % 100) / 100.0).alias("suffix"), line.alias("line"), text.strip_number(line).alias("plain"))


@query("text_keys", "WITH " + star_kg.SQL + ", x AS (SELECT *, list_sort(list_transform(classes, lambda c: lower(c))) AS cs FROM ent) SELECT id, 'pair::' || lower(classes[1]) || '|||' || 'a / b c' AS pair, 'r=' || (id % 8) || '::range=a||b::classes=' || array_to_string(cs, '||') AS signature FROM x")
def _(spark, d):
    e = star_kg.load(spark, d).entities
    return e.select("id", text.pair_key(F.get("classes", F.lit(0)), F.lit(" A/b_c ")).alias("pair"), text.query_signature((F.col("id") % 8), F.array(F.lit("B"), F.lit("a")), "classes").alias("signature"))


@query("text_patterns", "WITH p AS (SELECT c_custkey, list_sort(list_transform(range(c_custkey % 9), lambda k: 'out:p' || ((c_custkey * 7 + k * 3) % 11))) AS v FROM customer) SELECT c_custkey, CASE WHEN len(v) = 0 THEN 'none' ELSE array_to_string(v[1:6], ', ') || CASE WHEN len(v) > 6 THEN ', ... (+' || (len(v) - 6) || ' more)' ELSE '' END END AS patterns FROM p")
def _(spark, d):
    c = F.col("c_custkey")
    n = (c % 9).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("out:p"), ((c * 7 + k * 3) % 11).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", text.pattern_text(made).alias("patterns"))


@query("text_judgements", "SELECT o_orderkey, l AS label, CASE l WHEN 'subclass_or_same' THEN 1.0 WHEN 'parent_of_range' THEN 0.9 WHEN 'overlap_related' THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'subclass_or_same' WHEN 1 THEN 'parent_of_range' WHEN 2 THEN 'overlap_related' ELSE 'disjoint' END AS l FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "Subclass-or equal ").when(k == 1, " superclass of-range ").when(k == 2, "RELATED").when(k == 3, "disjoint").otherwise("who knows")
    return table(spark, d, "orders").select("o_orderkey", text.judgement(raw).alias("label")).withColumn("score", text.judgement_score("label"))


@query("text_messages", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, role AS last FROM conversations")
def _(spark, d):
    m = text.messages("role", F.when(F.col("turn") % 2 == 0, F.lit("Be brief.")))
    return table(spark, d, "conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.element_at("m", -1)["content"].alias("last"))


def _index_reply():
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey")
    s = lambda c: c.cast("string")
    a, b, c = s(n % 20), s(n % 23), s(n % 7)
    return (
        F.when(k == 0, F.concat(F.lit('{"selected_indices": ['), a, F.lit(", "), a, F.lit(", "), b, F.lit(', "'), c, F.lit('"]}')))
        .when(k == 1, F.concat(F.lit('<think>9 9</think>```json\n{"ranked_indices": ['), b, F.lit(", "), c, F.lit("]}\n```")))
        .when(k == 2, F.concat(F.lit("I choose "), a, F.lit(" then 99 and "), c))
        .when(k == 3, F.concat(F.lit('Sure: {"top10": ['), c, F.lit(", 1]} ok")))
        .when(k == 4, F.lit("none"))
    )


INDEX = (
    "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN [o_orderkey % 20, o_orderkey % 20, o_orderkey % 23, o_orderkey % 7] WHEN 1 THEN [o_orderkey % 23, o_orderkey % 7] WHEN 2 THEN [o_orderkey % 20, 99, o_orderkey % 7] WHEN 3 THEN [o_orderkey % 7, 1] ELSE [] END AS l FROM orders),"
    " y AS (SELECT o_orderkey, list_filter(l, lambda v: v < 20) AS l FROM x),"
    " z AS (SELECT o_orderkey, list_filter(l, lambda v, i: list_position(l, v) = i) AS p FROM y),"
    " f AS (SELECT o_orderkey, p, list_concat(p, list_filter(range(20), lambda v: NOT list_contains(p, v)))[1:10] AS full10 FROM z) "
)


@query("replies_ranked_indices", INDEX + "SELECT o_orderkey, CASE WHEN len(p) = 0 THEN NULL ELSE array_to_string(p, ',') END AS picked, array_to_string(full10, ',') AS completed FROM f")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", _index_reply().alias("reply")).select("o_orderkey", replies.ranked_indices("reply").alias("p"))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return x.select("o_orderkey", join(F.col("p")).alias("picked"), join(replies.complete_indices("p")).alias("completed"))


@query("replies_rank_metrics", INDEX + ", r AS (SELECT o_orderkey, list_position(full10, o_orderkey % 13) AS rank FROM f) SELECT o_orderkey, rank::BIGINT AS rank, round(coalesce(1.0 / rank, 0), 9) AS rr, (coalesce(rank, 99) <= 1)::INT AS hit1, (coalesce(rank, 99) <= 3)::INT AS hit3, (coalesce(rank, 99) <= 10)::INT AS hit10 FROM r")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", _index_reply().alias("reply")).select("o_orderkey", replies.ranked_indices("reply").alias("p")).select("o_orderkey", replies.complete_indices("p").alias("full"))
    x = x.withColumn("rank", metrics.rank_in("full", F.col("o_orderkey") % 13))
    return x.select("o_orderkey", "rank", *metrics.rank_columns("rank")).withColumn("rr", F.round("rr", 9))


@query("replies_mean_metrics", INDEX + ", r AS (SELECT p, list_position(full10, o_orderkey % 13) AS rank FROM f) SELECT count(*) AS total, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr_at_k, round(avg((coalesce(rank, 99) <= 3)::INT), 9) AS hits3, count(*) FILTER (len(p) > 0) AS ok_count, count(*) FILTER (len(p) = 0) AS failed_count, 0::BIGINT AS candidate_error_count, count(*) FILTER (len(p) = 0) AS real_failures FROM r")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", _index_reply().alias("reply")).select("o_orderkey", replies.ranked_indices("reply").alias("p"))
    x = x.select(metrics.rank_in(replies.complete_indices("p"), F.col("o_orderkey") % 13).alias("rank"), F.when(F.col("p").isNull(), "failed_parse_filled_by_default_order").otherwise("ok").alias("status"))
    return metrics.means(x).select("total", F.round("mrr_at_k", 9).alias("mrr_at_k"), F.round("hits3", 9).alias("hits3"), "ok_count", "failed_count", "candidate_error_count", "real_failures")


@query("replies_json", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[' || turn || ']' WHEN 1 THEN '{\"a\":' || conv_id || '}' WHEN 2 THEN '[1]' ELSE NULL END AS parsed, CASE turn % 4 WHEN 1 THEN '{\"a\": ' || conv_id || '}' WHEN 2 THEN '{\"a\":[1]}' END AS object FROM conversations")
def _(spark, d):
    k, s = F.col("turn") % 4, lambda c: F.col(c).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("```JSON\n["), s("turn"), F.lit("]```"))).when(k == 1, F.concat(F.lit('Answer: {"a": '), s("conv_id"), F.lit("} "))).when(k == 2, F.lit('text {"a":[1]}')).otherwise(F.lit("no json"))
    return table(spark, d, "conversations").select("conv_id", "turn", replies.tolerant_json(raw).alias("parsed"), replies.json_object(raw).alias("object"))


@query("replies_questions", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Who is ' || role || '?' WHEN 1 THEN 'which one is it then' ELSE 'fallback ' || role END AS question FROM conversations")
def _(spark, d):
    k = F.col("turn") % 3
    raw = F.when(k == 0, F.concat(F.lit('```json\n{"query": " Who is '), "role", F.lit('? "}\n```'))).when(k == 1, F.lit("ok\n\n - which one is it then\nmore"))
    return table(spark, d, "conversations").select("conv_id", "turn", replies.parse_question(raw, F.concat(F.lit("fallback "), "role")).alias("question"))


@query("replies_integers", r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '-?\d+'), '') AS BIGINT) AS first, len(regexp_extract_all(text, '-?\d+'))::BIGINT AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", replies.first_integer("text").alias("first"), F.size(replies.all_integers("text")).cast("long").alias("n"))


@query("classes_predicates", r"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n, bool_and(regexp_full_match(' ' || l_quantity::INT || CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE ' ' END, '\s*\d+\s*')) AS numeric FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise(" "))
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("n"), F.bool_and(classes.is_numeric(raw)).alias("numeric"))
