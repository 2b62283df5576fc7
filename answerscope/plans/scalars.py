"""Scalar functions on the stand-in tables."""

from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.plans.registry import query, table


def docs(s, d):
    return table(s, d, "documents")


@query("f1_normalise_chain", "SELECT p_partkey, substring(replace(trim(lower(p_name || ' ')), ' ', '_'), 1, 8) AS v FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.substring(F.replace(F.trim(F.lower(F.concat("p_name", F.lit(" ")))), F.lit(" "), F.lit("_")), 1, 8).alias("v"))


@query(
    "f2_normalise_value",
    """SELECT c_custkey, trim(translate(regexp_replace(regexp_replace(translate(lower(trim(c_mktsegment || '，  ＡＢ：' || c_name)), 'ａｂｃ１２３', 'abc123'), '\\s+', ' ', 'g'), '^(household|building)\\s+(.+)', '\\2'), '，。、（）：', ',.,():')) AS v FROM customer""",
)
def _(s, d):
    raw = F.concat("c_mktsegment", F.lit("，  ＡＢ："), "c_name")
    return table(s, d, "customer").select("c_custkey", T.normalise_value(raw, ("household", "building")).alias("v"))


@query(
    "f3_alias_equivalence",
    """WITH a AS (SELECT p_partkey, p_type AS x, CASE WHEN p_size % 2 = 0 THEN 'budget' ELSE p_type END AS y, p_size FROM part)
    SELECT p_partkey, x = y OR (x = 'ECONOMY' AND y = 'budget') AS same FROM a""",
)
def _(s, d):
    # equal, or one is a known alias of the other; the alias map is fixed
    aliases = F.create_map(F.lit("ECONOMY"), F.array(F.lit("budget")))
    a = table(s, d, "part").select("p_partkey", F.col("p_type").alias("x"), F.when(F.col("p_size") % 2 == 0, "budget").otherwise(F.col("p_type")).alias("y"))
    known = F.coalesce(F.try_element_at(aliases, F.col("x")), F.array().cast("array<string>"))
    return a.select("p_partkey", ((F.col("x") == F.col("y")) | F.array_contains(known, F.col("y"))).alias("same"))


NGRAMS = """WITH p AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(lower(p_name || ',' || p_type), '[，。、；：！？\\s()（）\\[\\]【】"/,!?;:\\\\-]+'), lambda x: trim(x)), lambda x: length(x) >= 2) AS ps FROM part),
    t AS (SELECT p_partkey, list_distinct(flatten(list_transform(ps, lambda p: list_concat([p], list_transform(range(1, length(p)), lambda i: substring(p, i, 2)), list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substring(p, i, 3)))))) AS t FROM p)"""


@query("f4_ngram_tokens", NGRAMS + " SELECT p_partkey, array_to_string(list_sort(t), '|') AS tokens FROM t")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(T.ngram_tokens(F.concat_ws(",", "p_name", "p_type"))), "|").alias("tokens"))


@query("f5_space_tokens", "SELECT doc_id, len(list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda x: x <> '')) AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(T.space_tokens(F.col("text"))).cast("long").alias("n"))


@query("f6_word_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || '-' || p_brand || ' 星巴克'), '[\\w一-鿿]+'))), '|') AS tokens FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(T.word_tokens(F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.lit(" 星巴克")))), "|").alias("tokens"))


@query("f7_sentences", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[。\\n]+')) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1")
def _(s, d):
    return docs(s, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f8_urls", "SELECT page_id, len(u) AS n, coalesce(u[1], '') AS first FROM (SELECT page_id, regexp_extract_all(url || ' (' || url || ')', 'https?://[^\\s)\\]】]+') AS u FROM pages)")
def _(s, d):
    u = T.urls(F.concat("url", F.lit(" ("), "url", F.lit(")")))
    return table(s, d, "pages").select("page_id", F.size(u).cast("long").alias("n"), F.coalesce(F.get(u, 0), F.lit("")).alias("first"))


@query("f9_first_item", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?:^|\\n)\\s*(?:[0-9]+[.)、]|[-*])\\s*([^\\n]{0,80})') THEN regexp_extract(text, '(?:^|\\n)\\s*(?:[0-9]+[.)、]|[-*])\\s*([^\\n]{0,80})', 1) END AS item FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", T.first_list_item(F.col("text")).alias("item"))


@query("f10_escaped_name", "SELECT c_custkey, regexp_matches('buy ' || c_name || ' first', 'buy ' || regexp_escape(c_name)) AS hit FROM customer")
def _(s, d):
    said = F.concat(F.lit("buy "), "c_name", F.lit(" first"))
    return table(s, d, "customer").select("c_custkey", F.rlike(said, F.concat(F.lit("buy \\Q"), "c_name", F.lit("\\E"))).alias("hit"))


@query("f11_unresolved", "SELECT event_id, len(regexp_extract_all(props, '\\{[^{}]+\\}')) AS n FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.size(T.unresolved(F.col("props"))).cast("long").alias("n"))


@query("f12_render", "SELECT n_nationkey, replace(CASE WHEN r_name = 'ASIA' THEN '{brand} in {industry}' ELSE replace('{brand} in {industry}', '{industry}', r_name) END, '{brand}', n_name) AS question FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    industry = F.when(F.col("r_name") != "ASIA", F.col("r_name"))
    return n.select("n_nationkey", T.render(F.lit("{brand} in {industry}"), {"brand": F.col("n_name"), "industry": industry}).alias("question"))


@query("f13_fact_patterns", "SELECT doc_id, regexp_matches(text, '[0-9]+[%％]|\\$[0-9]+[BKMT]?|[0-9]+\\s*(stores|employees|users|million)') AS numeric_fact FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.col("text").rlike(r"[0-9]+[%％]|\$[0-9]+[BKMT]?|[0-9]+\s*(stores|employees|users|million)").alias("numeric_fact"))


@query("f14_four_digits", "SELECT doc_id, try_cast(nullif(regexp_extract(text, '\\b([0-9]{4})\\b', 1), '') AS INTEGER) AS year FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')")
def _(s, d):
    return docs(s, d).where(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", T.four_digits(F.col("text")).alias("year"))


@query("f15_first_number", "SELECT doc_id, try_cast(replace(regexp_extract(text, '[0-9][0-9,]*', 0), ',', '') AS BIGINT) AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", T.first_number(F.col("text")).alias("n"))


@query("f16_domain", "SELECT page_id, split_part(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), 'https?://', ''), '^[w.]+', ''), '/+$', ''), '/', 1) AS domain FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query("f17_url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))


@query(
    "f18_source_tier",
    """WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://www.sec.gov/ir/x' WHEN 1 THEN 'https://m.zhihu.com/about' WHEN 2 THEN 'https://bloomberg.com/q' WHEN 3 THEN 'https://en.wikipedia.org/wiki' WHEN 4 THEN 'https://forum.x.com/1' WHEN 5 THEN 'https://x.com/investor/2' WHEN 6 THEN '' ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN url = '' THEN 'C' WHEN url LIKE '%.gov%' THEN 'S' WHEN regexp_matches(url, '/investor|/ir|/announcement|/about') AND url NOT LIKE '%zhihu.com%' THEN 'S' WHEN url LIKE '%bloomberg.com%' THEN 'A'
      WHEN url LIKE '%wikipedia.org%' THEN 'B' WHEN regexp_matches(url, 'zhihu.com') OR regexp_matches(regexp_extract(url, '//([^/]*)', 1), 'blog\\.|forum\\.|bbs\\.') THEN 'D' ELSE 'C' END AS tier FROM u""",
)
def _(s, d):
    k, u = F.col("page_id") % 8, F.col("url")
    cases = ["https://www.sec.gov/ir/x", "https://m.zhihu.com/about", "https://bloomberg.com/q", "https://en.wikipedia.org/wiki", "https://forum.x.com/1", "https://x.com/investor/2", ""]
    for i, case in reversed(list(enumerate(cases))):
        u = F.when(k == i, case).otherwise(u)
    return table(s, d, "pages").select("page_id", T.source_tier(u).alias("tier"))


@query("f19_keys", "SELECT o_orderkey, substring(sha256(o_custkey || '|' || o_orderstatus), 1, 16) AS key FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", T.digest(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), length=16).alias("key"))


@query(
    "f21_sanitised_html",
    """SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|iframe|object|embed)[^>]*>.*?</(script|style|iframe|object|embed)>', '', 'gis'), '\\son[a-z]+=("[^"]*"|''[^'']*'')', '', 'gi'), 'javascript:', '', 'gi') AS x FROM pages)""",
)
def _(s, d):
    x = T.sanitise_html(F.col("html"))
    return table(s, d, "pages").select("page_id", x.alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query("f22_slug_markdown", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, '<h2>' || p_name || '</h2>' || chr(10) || '<li><strong>' || p_type || '</strong></li>' AS html FROM part")
def _(s, d):
    md = F.concat(F.lit("## "), "p_name", F.lit("\n- **"), "p_type", F.lit("**"))
    return table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.markdown_html(md).alias("html"))


@query(
    "f23_masked_text",
    """SELECT doc_id, md5(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), 'sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{16,}', '[key]', 'g'), '[A-Za-z0-9+/]{40,}={0,2}', '[token]', 'g'), '/(home|root|usr|etc|var|tmp)(/[A-Za-z0-9._-]+)+', '[path]', 'g'), 1, 500)) AS digest FROM documents""",
)
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(T.mask(F.col("text"))).alias("digest"))


@query("f24_masked_keys", "SELECT event_id, '{\"k\":\"***\",\"type\":\"' || event_type || '\"}' AS masked FROM events")
def _(s, d):
    # values under sensitive keys are masked whatever they are
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return table(s, d, "events").select("event_id", F.to_json(F.transform_values(fields, lambda k, v: F.when(k.isin("k", "password", "token", "secret"), "***").otherwise(v))).alias("masked"))


@query("f25_masked_credential", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", T.mask_credential(F.col("c_name")).alias("masked"))


@query("f27_forbidden_terms", "SELECT doc_id, array_to_string(list_filter(['idiot', 'license', 'token', 'zzz'], lambda w: contains(lower(text), w)), ',') AS hits FROM documents")
def _(s, d):
    terms = F.array(*[F.lit(w) for w in ("idiot", "license", "token", "zzz")])
    return docs(s, d).select("doc_id", F.array_join(F.filter(terms, lambda w: F.contains(F.lower("text"), w)), ",").alias("hits"))


@query("f29_date_buckets", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week FROM orders")
def _(s, d):
    o = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.date_format(o, "yyyy-MM-dd").alias("day"), F.date_format(o, "yyyy-MM").alias("month"), T.week_bucket(o).alias("week"))


@query("f30_elapsed_days", "SELECT event_id, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000)::BIGINT AS days, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) > 7 * 86400000000 AS stale FROM events")
def _(s, d):
    as_of = F.expr("timestamp_ntz '2024-01-31'")
    stale = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 7 * 86400000000
    return table(s, d, "events").select("event_id", T.whole_days(as_of, F.col("ts")).alias("days"), stale.alias("stale"))


@query("f31_month_hour", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS month, strftime(ts, '%Y%m%d%H') AS hour FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), F.date_format("ts", "yyyyMMddHH").alias("hour"))


@query("f32_clamp_backoff", "SELECT s_suppkey, round(greatest(0, least(1, s_acctbal / 10000)), 6) AS clamped, least(60.0, 1.0 * pow(2.0, s_suppkey % 8)) AS wait FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.round(T.clamp(F.col("s_acctbal") / 10000, 0.0, 1.0), 6).alias("clamped"), T.backoff(F.col("s_suppkey") % 8).alias("wait"))


@query("f33_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("f34_ladders", "SELECT source, CASE WHEN count(*) >= 60 THEN 'high' WHEN count(*) >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM documents GROUP BY 1")
def _(s, d):
    return docs(s, d).groupBy("source").agg(T.ladder(F.count("*"), [(60, "high"), (30, "medium")], "low").alias("confidence"))


@query(
    "f35_array_functions",
    "SELECT o_custkey, len(list_filter(l, lambda x: x > 200000)) AS n_large, list_sum(l) > 1000000 AS rich, len(list_filter(l, lambda x: x > 0)) = len(l) AS all_positive FROM (SELECT o_custkey, list(o_totalprice) AS l FROM orders GROUP BY 1)",
)
def _(s, d):
    listed = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    return listed.select("o_custkey", F.size(F.filter("l", lambda x: x > 200000)).cast("long").alias("n_large"), (total > 1000000).alias("rich"), F.forall("l", lambda x: x > 0).alias("all_positive"))


@query("f36_map_merge", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ',v=' || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS merged FROM events")
def _(s, d):
    # later maps win; a null in them clears the entry
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("v"), F.col("event_type")))
    over = F.create_map(F.lit("v"), F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")))
    merged = F.map_zip_with(base, over, lambda k, a, b: F.when(F.map_contains_key(over, k), b).otherwise(a))
    return table(s, d, "events").select("event_id", F.concat(F.lit("k="), merged["k"], F.lit(",v="), F.coalesce(merged["v"], F.lit("none"))).alias("merged"))


@query("f37_json_round_trip", "SELECT event_id, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events")
def _(s, d):
    k = F.from_json("props", "k int")["k"]
    return table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("j"))


@query("f42_error_codes", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'auth_failed' WHEN 3 THEN 'quota_exhausted' ELSE 'unknown_error' END AS code FROM events WHERE event_type = 'error'")
def _(s, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Read Timed out", "HTTP 429", "401 Unauthorized", "Quota used up", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events").where("event_type = 'error'").select("event_id", T.error_code(said).alias("code"))


@query("f43_json_ld", "SELECT s_suppkey, '{\"@context\":\"https://schema.org\",\"@type\":\"Organization\",\"name\":\"' || s_name || '\"}' AS ld FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), F.col("s_name").alias("name"))).alias("ld"))


@query("f44_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f45_file_name", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type || '?', '[\\\\/:*?\"<>|\\s]+', '_', 'g') AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.file_name(F.concat("p_name", F.lit("/"), "p_type", F.lit("?"))).alias("name"))


@query("f46_percent_bar", "SELECT p_partkey, repeat('#', (p_size // 5)::INT) || repeat('.', (10 - p_size // 5)::INT) || ' ' || (p_size * 2) || '%' AS bar FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.percent_bar(F.col("p_size") / 50).alias("bar"))


@query("f48_safe_url", "SELECT page_id, url LIKE 'https://%' AS safe FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe"))


@query("f49_redacted_payload", "SELECT event_id, left(regexp_replace('{\"token\":\"' || event_type || '\",\"v\":1}', '\"token\":\"[^\"]*\"', '\"token\":\"***\"'), 200) AS payload FROM events")
def _(s, d):
    raw = F.concat(F.lit('{"token":"'), "event_type", F.lit('","v":1}'))
    return table(s, d, "events").select("event_id", F.left(F.regexp_replace(raw, '"token":"[^"]*"', '"token":"***"'), F.lit(200)).alias("payload"))


@query(
    "f51_retry_after",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 90.0 ELSE least(60.0, pow(2.0, event_id % 7)) END AS wait FROM events",
)
def _(s, d):
    # seconds, or a date after the event, or exponential backoff
    header = F.when(F.col("event_id") % 3 == 0, "30").when(F.col("event_id") % 3 == 1, "2024-02-01 00:01:30")
    at = F.try_to_timestamp(header, F.lit("yyyy-MM-dd HH:mm:ss"))
    dated = (F.unix_timestamp(at) - F.unix_timestamp(F.lit("2024-02-01 00:00:00"))).cast("double")
    wait = F.coalesce(header.try_cast("double"), dated, T.backoff(F.col("event_id") % 7))
    return table(s, d, "events").select("event_id", wait.alias("wait"))
