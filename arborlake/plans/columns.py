"""Registered queries of column functions, groups and cleaning: each over whole tables, with the same answer in SQL.

Texts that the tables do not hold (paths, scripts, JSON, comments) are put together from columns and fixed lists, in the same way in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.functions import paths, records, text
from arborlake.graph import Graph, event_graph, table, trade_graph
from arborlake.operators import aggregates, analytics, filters, joins, sets
from arborlake.plans.catalogue import query


def pick(items: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.col(key) % len(items) + 1).cast("int"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return ", ".join(map(_quoted, items))


def pick_sql(items: list[str], key: str) -> str:
    return f"([{listed(items)}])[{key} % {len(items)} + 1]"


def ends_sql(column: str, endings: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {_quoted(e)})" for e in endings) + ")"


def holds_sql(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(p)})" for p in parts) + ")"


def all_sql(column: str, pattern: str, to: str) -> str:
    return f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(to)}, 'g')"


def id_sql(column: str) -> str:
    return f"lower({all_sql(column, '[^A-Za-z0-9]', '_')})"


# ---- ids and labels


@query(f"""WITH $T, p AS (SELECT *, string_split(source_file, '/') AS parts FROM g_nodes), f AS (SELECT *, parts[-1] AS name, parts[-2] AS parent FROM p)
SELECT id, {id_sql("file_type || '_' || label")} AS made, lower(regexp_replace({all_sql('label', '[^A-Za-z0-9]+', '_')}, '^_+|_+$', '', 'g')) AS squeezed,
{id_sql("concat_ws('_', nullif(parent, ''), nullif(regexp_extract(name, '^(.*?)(?:[.]([^.]*))?$', 1), ''), nullif(regexp_extract(name, '[.]([^.]*)$', 1), ''))")} AS file,
lower(label) AS callable, lower(label) AS bare, 'scip_s_' || sha256(source_file || ':' || label)[1:12] AS symbol FROM f""")
def node_id_forms(spark, d):
    """Ids made, squeezed, of files and of symbols; labels as callables."""
    c = F.col
    return trade_graph(spark, d).nodes.select(
        "id", text.make_id(c("file_type"), c("label")).alias("made"), text.squeezed_id(c("label")).alias("squeezed"), text.file_id(c("source_file")).alias("file"),
        text.callable_label(F.concat(F.lit("."), "label", F.lit("()"))).alias("callable"), text.bare_label(F.concat("label", F.lit("()"))).alias("bare"),
        text.symbol_node_id(F.lit("s"), c("source_file"), c("label")).alias("symbol"),
    )


CAMEL_SQL = "regexp_replace(regexp_replace(l, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"


@query(f"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', 'HTTPServer') || p_brand AS l FROM part), w AS (SELECT *, list_filter(regexp_split_to_array(lower({CAMEL_SQL}), '[_:./ \\-]+'), lambda x: x <> '') AS words FROM n)
SELECT p_partkey, lower({CAMEL_SQL}) AS camel, lower(l) || '_x' AS snake, array_to_string(words, '|') AS words,
array_to_string(list_transform(words, lambda x: upper(x[1]) || x[2:]), ' ') AS human FROM w""")
def label_parts(spark, d):
    """Camel-case parts, label tokens and readable labels."""
    n = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("HTTPServer")), "p_brand").alias("l"))
    return n.select(
        "p_partkey", F.array_join(text.camel_parts(F.col("l")), " ").alias("camel"), F.array_join(text.camel_parts(F.concat("l", F.lit("_x"))), " ").alias("snake"),
        F.array_join(text.label_tokens(F.col("l")), "|").alias("words"), text.humanised(F.concat("l", F.lit("()"))).alias("human"),
    )


CJK = "零一二三四五六七八九"


@query(f"""WITH n AS (SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '{CJK}') AS w, lower(c_mktsegment) AS s FROM customer)
SELECT c_custkey, true AS cjk, false AS plain, array_to_string(list_distinct_in_order, ' ') AS terms FROM (
  SELECT c_custkey, list_concat([s], list_filter(g, lambda x, i: list_position(g, x) = i)) AS list_distinct_in_order FROM (
    SELECT c_custkey, s, list_concat(CASE WHEN length(w) < 2 THEN [] ELSE list_transform(range(1, length(w)), lambda i: substring(w, i::BIGINT, 2)) END, [w]) AS g FROM n))""")
def chinese_terms(spark, d):
    """Query terms: words that are searchable, bigrams of Chinese characters and the runs themselves."""
    w = F.translate(F.col("c_custkey").cast("string"), "0123456789", CJK)
    n = table(spark, d, "customer").select("c_custkey", w.alias("w"), F.concat(F.lit("to "), "c_mktsegment", F.lit(" of "), w).alias("q"), "c_mktsegment")
    return n.select("c_custkey", text.has_cjk(F.col("q")).alias("cjk"), text.has_cjk(F.col("c_mktsegment")).alias("plain"), F.array_join(text.query_terms(F.col("q")), " ").alias("terms"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '.' || p_size || '.run' WHEN 1 THEN 'find ' || p_name || ' get_it' WHEN 2 THEN p_type ELSE p_name END AS q FROM part)
SELECT p_partkey, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS candidates, regexp_matches(q, '^[A-Za-z0-9_]+$') AND regexp_matches(q, '[A-Z_]') AS symbol FROM (
  SELECT *, CASE WHEN regexp_matches(q, '^\\S+\\.\\S+$') THEN string_split(q, '.') ELSE list_filter(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: regexp_matches(w, '[A-Z_]') OR length(w) >= 4) END AS c FROM n)""")
def symbol_words(spark, d):
    """Candidates for symbols in a question, and whether the whole is a symbol."""
    k = F.col("p_partkey") % 4
    q = F.when(k == 0, F.concat_ws(".", "p_type", F.col("p_size").cast("string"), F.lit("run"))).when(k == 1, F.concat(F.lit("find "), "p_name", F.lit(" get_it"))).when(k == 2, F.col("p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.symbol_candidates(q), "|").alias("candidates"), text.is_symbol(q).alias("symbol"))


# ---- texts


@query("""WITH n AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t, p_partkey % 9 AS a, p_partkey % 31 AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN a ELSE -1 END AS start, CASE WHEN p_partkey % 11 <> 0 AND a < b THEN substring(t, a + 1, b - a) ELSE '' END AS body FROM n""")
def byte_bodies(spark, d):
    """Byte ranges and the bodies that they cut; what is no range gives none."""
    location = F.when(F.col("p_partkey") % 11 == 0, "L4").otherwise(F.concat_ws(":", (F.col("p_partkey") % 9).cast("string"), (F.col("p_partkey") % 31).cast("string")))
    n = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"), location.alias("at"))
    return n.select("p_partkey", F.coalesce(text.byte_range(F.col("at"))["start"], F.lit(-1)).alias("start"), text.body(F.col("t"), F.col("at")).alias("body"))


@query(f"""WITH n AS (SELECT page_id, html, url FROM pages)
SELECT page_id, substring({all_sql('html', '[\\x00-\\x1F\\x7F]', '')}, 1, 256) AS label, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
md5(replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')) AS yaml,
md5(trim({all_sql(all_sql('html', '["`<>{}\\[\\]()|;#]', ' '), '[ \\t\\n\\f\\r\\x0B]+', ' ')})) AS mermaid,
CASE WHEN length(one) <= 60 THEN one ELSE substring(one, 1, 57) || '...' END AS short FROM (SELECT *, trim({all_sql('html', '[ \\t\\n\\f\\r\\x0B]+', ' ')}) AS one FROM n)""")
def clean_texts(spark, d):
    """Labels, HTML, YAML and Mermaid escapes, and shortened texts of whole pages."""
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", text.clean_label(h).alias("label"), F.md5(text.html_escaped(h)).alias("escaped"), F.md5(text.yaml_escaped(h)).alias("yaml"), F.md5(text.mermaid(h)).alias("mermaid"), text.shortened(h, 60).alias("short")
    )


@query(f"""WITH n AS (SELECT page_id, url, {all_sql("url", "[^A-Za-z0-9]+", "_")} AS s FROM pages), t AS (SELECT *, lower(regexp_replace(s, '^_+|_+$', '', 'g')) AS slug, {all_sql("url", '[\\\\/:*?"<>|#^\\[\\]]', '-')} AS w FROM n)
SELECT page_id, substring(slug, 1, 40) || '_' || sha256(url)[1:8] AS stable, substring('p_' || page_id || '_' || slug, 1, 40) || '_' || sha256(page_id || ' ' || url)[1:8] AS numbered,
substring(regexp_replace(w, '^[ .]+|[ .]+$', '', 'g'), 1, 200) AS wiki FROM t""")
def safe_names(spark, d):
    """Stable ids and file names made from addresses."""
    u = F.col("url")
    numbered = F.concat_ws(" ", F.col("page_id").cast("string"), u)
    return table(spark, d, "pages").select("page_id", text.stable_id(u).alias("stable"), text.stable_id(numbered, "p").alias("numbered"), text.wiki_file_name(u).alias("wiki"))


@query("""SELECT doc_id, (strlen(text) >= 80 OR len(regexp_split_to_array(trim(text), '[ \\t\\n\\f\\r\\x0B]+')) >= 8) AND regexp_matches(text, '[.!?:]') AS rationale,
greatest(1, strlen(text) // 4)::BIGINT AS tokens, ((least(strlen(text), 20000) + 80) // 4)::BIGINT AS file_tokens FROM documents""")
def text_measures(spark, d):
    """Sentences that give reasons, and token estimates, of whole documents."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.is_rationale(t).alias("rationale"), text.token_estimate(t).alias("tokens"), text.file_token_estimate(F.octet_length(t)).alias("file_tokens"))


@query("""WITH n AS (SELECT p_partkey, '{"a": "x // y, }", "n": ' || p_size || ', "l": [1, 2], "b": "' || p_name || '"}' AS j FROM part)
SELECT p_partkey, replace(j, ', "l"', ',  "l"') AS plain, j AS fenced, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'About ' || p_name END AS doc FROM n JOIN part USING (p_partkey)""")
def stripped_texts(spark, d):
    """JSON without comments and trailing commas, texts without fences, docstrings without their signs."""
    c = F.col
    size = c("p_size").cast("string")
    raw = F.concat(F.lit('{"a": "x // y, }", "n": '), size, F.lit(', /* n */ "l": [1, 2,], "b": "'), "p_name", F.lit('",} // end'))
    clean = F.concat(F.lit('{"a": "x // y, }", "n": '), size, F.lit(', "l": [1, 2], "b": "'), "p_name", F.lit('"}'))
    doc = F.when(c("p_partkey") % 5 == 0, "/** */").when(c("p_partkey") % 5 == 1, F.concat(F.lit('"""About '), "p_name", F.lit('"""'))).otherwise(F.concat(F.lit("// About "), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.trim(text.without_comments(raw)).alias("plain"), text.without_fences(F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).alias("fenced"), text.docstring(doc).alias("doc"))


# ---- numbers and states


@query("""WITH n AS (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS n, epoch(o_orderdate)::BIGINT + o_orderkey * 977 AS t, o_orderkey % 1200 AS k FROM orders)
SELECT o_orderkey, format('{:,}', n) AS thousands, CASE WHEN k * 100 < 1000 THEN '<1k' WHEN k * 100 < 10000 THEN '1k-10k' WHEN k * 100 < 100000 THEN '10k-100k' ELSE '100k+' END AS chars,
CASE WHEN k < 10 THEN '<10s' WHEN k < 60 THEN '10-60s' WHEN k < 300 THEN '1-5m' ELSE '5m+' END AS duration, CASE WHEN k = 0 THEN '0' WHEN k < 10 THEN '1-9' WHEN k < 100 THEN '10-99' WHEN k < 1000 THEN '100-999' ELSE '1000+' END AS counted,
strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM n""")
def number_buckets(spark, d):
    """Thousands, buckets of characters, durations and counts, days and times in UTC."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate AS timestamp_ntz))") + F.col("o_orderkey") * 977
    n = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("n"), seconds.alias("t"), (F.col("o_orderkey") % 1200).alias("k"))
    c = F.col
    return n.select(
        "o_orderkey", text.grouped_thousands(c("n")).alias("thousands"), text.char_bucket(c("k") * 100).alias("chars"), text.duration_bucket(c("k")).alias("duration"), text.count_bucket(c("k")).alias("counted"),
        text.utc_day(c("t")).alias("day"), text.utc_iso(c("t")).alias("iso"),
    )


CHECKS = ["SUCCESS", "FAILURE", "IN_PROGRESS", "SKIPPED", "QUEUED"]
REVIEWS = ["APPROVED", "CHANGES_REQUESTED", "COMMENTED"]


@query(f"""WITH n AS (SELECT o_orderkey AS k, {pick_sql(CHECKS, 'o_orderkey')} AS a, {pick_sql(CHECKS, '(o_orderkey // 5)')} AS b, {pick_sql(REVIEWS, '(o_orderkey // 7)')} AS r, o_orderkey % 23 AS age FROM orders),
c AS (SELECT *, CASE WHEN 'FAILURE' IN (a, b) THEN 'FAILURE' WHEN 'IN_PROGRESS' IN (a, b) OR 'QUEUED' IN (a, b) THEN 'PENDING' WHEN 'SUCCESS' IN (a, b) THEN 'SUCCESS' ELSE 'NONE' END AS checks FROM n)
SELECT k, checks, CASE WHEN k % 13 = 0 THEN 'WRONG-BASE' WHEN checks = 'FAILURE' THEN 'CI-FAIL' WHEN r = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN k % 11 = 0 THEN 'DRAFT' WHEN age >= 14 THEN 'STALE'
WHEN r = 'APPROVED' THEN 'APPROVED' WHEN checks = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM c""")
def review_states(spark, d):
    """Roll-up of checks and the state of change requests."""
    k = F.col("o_orderkey")
    n = table(spark, d, "orders").select(k.alias("k"), F.floor(k / 5).alias("k5"), F.floor(k / 7).alias("k7"))
    n = n.select("k", text.checks_rollup(F.array(pick(CHECKS, "k"), pick(CHECKS, "k5"))).alias("checks"), pick(REVIEWS, "k7").alias("r"))
    return n.select("k", "checks", text.review_status(F.col("k") % 13 != 0, F.col("checks"), F.col("r"), F.col("k") % 11 == 0, F.col("k") % 23).alias("status"))


@query("""WITH $T SELECT source, target, s AS score, round(s + CASE confidence WHEN 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE relation WHEN 'calls' THEN 1.0 WHEN 'imports' THEN 0.6 ELSE 0.0 END, 6) AS rank
FROM (SELECT *, (CASE confidence WHEN 'INFERRED' THEN 0.7 ELSE 1.0 END)::DOUBLE AS s FROM g_edges)""")
def edge_scores(spark, d):
    """Scores of confidences and edges."""
    e = trade_graph(spark, d).edges
    return e.select("source", "target", text.confidence_score(F.col("confidence")).alias("score"), F.round(text.edge_score(F.col("confidence"), F.col("relation")), 6).alias("rank"))


# ---- paths and addresses

FOLDERS = ["src", "tests", "node_modules", ".ssh", "target", "src/main/java/target", "my_env", "docs/spec", "a/b.egg-info", "examples", ""]
NAMES = ["main.py", "app.tsx", "Main.java", "id_rsa", ".env.local", "my_token.txt", "README.md", "photo.PNG", "clip.mp4", "go.sum", "sheet.gsheet", "paper.pdf", "lib_test.go", "x.kt", "plan.docx", "Makefile", "server.pem"]
PATH_SQL = f"p AS (SELECT p_partkey, {pick_sql(FOLDERS, 'p_partkey')} AS folder, {pick_sql(NAMES, 'p_partkey')} AS name FROM part), f AS (SELECT p_partkey, folder, name, 'r/' || CASE WHEN folder = '' THEN '' ELSE folder || '/' END || name AS path, lower(regexp_extract(name, '^.+([.][^.]*)$', 1)) AS e, string_split(folder, '/') AS parts FROM p)"


def _paths(spark, d):
    p = table(spark, d, "part").select("p_partkey", pick(FOLDERS, "p_partkey").alias("folder"), pick(NAMES, "p_partkey").alias("name"))
    return p.withColumn("path", F.concat_ws("/", F.lit("r"), F.nullif("folder", F.lit("")), "name"))


LANGUAGE_SQL = " ".join(f"WHEN {ends_sql('path', endings)} THEN {_quoted(name)}" for name, endings in paths.LANGUAGES)


@query(f"""WITH {PATH_SQL} SELECT p_partkey, CASE WHEN e IN ({listed(paths.CODE_ENDINGS)}) THEN 'code' WHEN e = '.pdf' THEN 'paper' WHEN e IN ({listed(paths.IMAGE_ENDINGS)}) THEN 'image'
WHEN e IN ({listed(paths.DOCUMENT_ENDINGS + paths.OFFICE_ENDINGS + paths.WORKSPACE_ENDINGS)}) THEN 'document' WHEN e IN ({listed(paths.VIDEO_ENDINGS)}) THEN 'video' END AS kind,
e IN ({listed(paths.WORKSPACE_ENDINGS)}) AS shortcut, CASE {LANGUAGE_SQL} ELSE 'Other' END AS language FROM f""")
def file_kinds(spark, d):
    """Kind, language and workspace shortcuts by file ending."""
    p = F.col("path")
    return _paths(spark, d).select("p_partkey", paths.file_kind(p).alias("kind"), paths.is_workspace_shortcut(p).alias("shortcut"), paths.language_by_ending(p).alias("language"))


SENSITIVE_SQL = " OR ".join(f"regexp_matches(name, {_quoted(x)})" for x in paths.SENSITIVE_NAMES)


@query(f"""WITH {PATH_SQL} SELECT p_partkey, list_has_any(parts, [{listed(paths.SENSITIVE_FOLDERS)}]) OR {SENSITIVE_SQL} AS sensitive,
len(list_filter(parts, lambda x: (x IN ({listed(paths.SKIPPED_FOLDERS)}) AND NOT (x IN ('target', 'out') AND regexp_matches(path, 'src/(main|test)/java/'))) OR ends_with(x, '_venv') OR ends_with(x, '_env') OR ends_with(x, '.egg-info'))) > 0
OR name IN ({listed(paths.SKIPPED_FILES)}) AS skipped,
{holds_sql('lower(path)', paths.TEST_PARTS)} OR {ends_sql('lower(path)', paths.TEST_ENDINGS)} OR (ends_with(lower(path), '.java') AND contains(lower(path), 'test')) AS test,
path = name OR ends_with(path, '/' || name) AS own, path = 'in.py' OR ends_with(path, '/in.py') OR ends_with('in.py', '/' || path) AS other FROM f""")
def path_predicates(spark, d):
    """Sensitive and skipped files, tests and examples, and paths that match by their ends."""
    p = F.col("path")
    return _paths(spark, d).select(
        "p_partkey", paths.is_sensitive(p).alias("sensitive"), paths.is_skipped(p).alias("skipped"), paths.is_test_or_example(p).alias("test"), paths.suffix_match(p, F.col("name")).alias("own"), paths.suffix_match(p, F.lit("in.py")).alias("other")
    )


FIRST_LINES = ["#!/usr/bin/env python3", "#!/bin/bash -e", "#! /usr/bin/env -S A=1 node --flag", "#!/usr/bin/awk -f", "print(1)", "#!/usr/bin/perl"]
FOUND = ["python3", "bash", "node", "awk", "", "perl"]


@query(f"SELECT p_partkey, nullif({pick_sql(FOUND, 'p_partkey')}, '') AS interpreter, p_partkey % 6 NOT IN (3, 4) AS script FROM part")
def script_lines(spark, d):
    """The interpreter of a first line, and whether its scripts are code."""
    content = F.concat_ws("\n", pick(FIRST_LINES, "p_partkey"), "p_name")
    s = paths.shebang(content)
    return table(spark, d, "part").select("p_partkey", F.nullif(s, F.lit("")).alias("interpreter"), paths.is_script(content).alias("script"))


HOSTS = ["http://10.1.2.3/a", "https://user@metadata.google.internal/x", "ftp://example.com/f", "https://arxiv.org/abs/2301.01234v2", "http://172.20.0.1:80/", "http://172.40.0.1/", "HTTPS://LOCALHOST/", "http://[::1]/", "https://example.org/2301.12"]
PUBLIC = ["n", "n", "n", "y", "n", "y", "n", "n", "y"]


@query(f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {pick_sql(HOSTS, '(page_id // 3)')} ELSE url END AS url, page_id % 3 <> 0 OR {pick_sql(PUBLIC, '(page_id // 3)')} = 'y' AS public FROM pages)
SELECT page_id, public, nullif(regexp_extract(url, '(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?', 1), '') AS arxiv,
substring({all_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*?://', ''), '[?#].*$', ''), '[^0-9A-Za-z_-]', '_', 'g'), '^_+|_+$', '', 'g')", '_+', '_')}, 1, 80) || '.md' AS file,
regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '(/.*)$', 1), '[?#].*$', '') AS path FROM u""")
def url_parts(spark, d):
    """Addresses that may be fetched, arXiv ids, file names and paths of addresses."""
    p = table(spark, d, "pages").select("page_id", "url", F.floor(F.col("page_id") / 3).alias("k"))
    u = F.when(F.col("page_id") % 3 == 0, pick(HOSTS, "k")).otherwise(F.col("url"))
    return p.select("page_id", paths.is_public_url(u).alias("public"), paths.arxiv_id(u).alias("arxiv"), paths.safe_file_name(u, ".md").alias("file"), paths.url_path(u).alias("path"))


# ---- records

TYPES = ["", "Class", "package", "route", "spec", "hook", "other"]
KIND_LABELS = ["run()", "useThing", "users_api", "cli_main", "await_it", "Widget", "Widget()", "mod.rs", "test_x", "data_store"]
KIND_SQL = " ".join(f"WHEN t IN ({listed(types)}) THEN {_quoted(kind)}" for kind, types in records.KIND_BY_TYPE.items())
LABEL_KIND_SQL = " ".join(f"WHEN {holds_sql('l', signs)} THEN {_quoted(kind)}" for kind, signs in records.KIND_BY_LABEL.items())


@query(f"""WITH {PATH_SQL}, n AS (SELECT p_partkey, lower({pick_sql(TYPES, 'p_partkey')}) AS t, {pick_sql(['code', 'rationale', 'code', 'code'], '(p_partkey // 7)')} AS ft, {pick_sql(KIND_LABELS, '(p_partkey // 3)')} AS raw, lower(path) AS path FROM f),
m AS (SELECT *, lower(raw) AS l FROM n)
SELECT p_partkey, CASE {KIND_SQL} WHEN ft IN ({listed(records.CONCEPT_FILES)}) THEN 'concept' WHEN regexp_matches(path, 'test|spec') OR starts_with(l, 'test_') THEN 'test' {LABEL_KIND_SQL}
WHEN regexp_matches(raw, '^use[A-Z_-]') OR {holds_sql('l', records.UI_LABELS)} OR {ends_sql('path', records.UI_ENDINGS)} THEN 'ui' WHEN regexp_matches(raw, '^[A-Z]') AND NOT ends_with(raw, '()') THEN 'klass'
WHEN {ends_sql('raw', records.MODULE_ENDINGS)} THEN 'module' ELSE 'function' END AS kind FROM m""")
def node_kinds(spark, d):
    """The kind of a node by its type, file and label."""
    n = _paths(spark, d).withColumn("k7", F.floor(F.col("p_partkey") / 7)).withColumn("k3", F.floor(F.col("p_partkey") / 3))
    return n.select("p_partkey", records.node_kind(pick(TYPES, "p_partkey"), pick(["code", "rationale", "code", "code"], "k7"), pick(KIND_LABELS, "k3"), F.col("path")).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN k = 3 THEN '' WHEN k = 2 THEN 's' ELSE p_partkey::VARCHAR END AS source, CASE WHEN k = 3 THEN '' ELSE p_name END AS target, CASE WHEN k = 1 THEN 'true' WHEN k = 2 THEN '[1,2]' ELSE '' END AS context,
CASE WHEN k = 3 THEN 'non_object_edge' ELSE '' END AS invalid, CASE k WHEN 0 THEN '{"source":' || p_partkey || ',"target":"' || p_name || '"}'
WHEN 1 THEN '{"context":true,"source":"' || p_partkey || '","target":"' || p_name || '"}' WHEN 2 THEN '{"context":[1,2],"source":"s","target":"' || p_name || '"}' ELSE '<non-object>' END AS signature FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def edge_records(spark, d):
    """JSON edges in canonical form, with their signatures; scalars as texts."""
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    record = (
        F.when(k == 0, F.concat(F.lit('{"to": "'), "p_name", F.lit('", "from": '), key, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"target": "'), "p_name", F.lit('", "context": true, "from": "'), key, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"source": "s", "from": "f", "context": [1, 2], "target": "'), "p_name", F.lit('"}')))
        .otherwise(F.concat(F.lit('["'), "p_name", F.lit('"]')))
    )
    r = table(spark, d, "part").select("p_partkey", record.alias("r")).withColumn("c", records.canonical_edge(F.col("r")))
    return r.select("p_partkey", "c.source", "c.target", "c.context", "c.invalid", records.edge_signature(F.col("r")).alias("signature"))


# ---- groups


@query("""WITH $T SELECT (SELECT count(*) FROM (SELECT source FROM g_edges GROUP BY 1 HAVING count(DISTINCT confidence) > 1)) AS groups,
(SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM g_edges GROUP BY target, relation)) AS surplus""")
def variants_and_surplus(spark, d):
    """Groups of edges with several confidences, and edges beyond the first of each target and relation."""
    e = trade_graph(spark, d).edges
    return aggregates.variant_groups(e, ["source"], "confidence").crossJoin(aggregates.surplus(e, ["target", "relation"]))


@query("WITH $T SELECT community, len(m)::INTEGER AS members, m[1] AS first, m[-1] AS last FROM (SELECT community, list(id ORDER BY ord, id) AS m FROM g_nodes WHERE community IS NOT NULL GROUP BY 1)")
def community_lists(spark, d):
    c = aggregates.communities(trade_graph(spark, d).nodes)
    return c.select("community", F.size("members").alias("members"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"))


@query("""WITH $T, w AS (SELECT coalesce(community, -1) AS community, unnest(list_filter(regexp_split_to_array(lower(label), '[_:./ \\-]+'), lambda x: x <> '')) AS word FROM g_nodes), c AS (SELECT community, word, count(*) AS n FROM w WHERE word <> 'ring' AND length(word) > 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, word DESC)::INTEGER AS place FROM c) SELECT * FROM r WHERE place <= 10""")
def section_words(spark, d):
    """The most frequent words of each community's labels."""
    nodes = trade_graph(spark, d).nodes.withColumn("community", F.coalesce("community", F.lit(-1)))
    return aggregates.section_keywords(nodes, ["ring"])


@query("""WITH $T SELECT source, target, relation FROM g_edges WHERE confidence <> 'INFERRED' OR NOT starts_with(source, 'supplier:')""")
def same_language_edges(spark, d):
    """Inferred edges between languages or file types go."""
    return filters.without_cross_language(trade_graph(spark, d)).select("source", "target", "relation")


@query("WITH $T SELECT lower(trim(label)) AS name, count(*)::INTEGER AS n, min(id) AS first FROM g_nodes GROUP BY 1")
def labels_index(spark, d):
    i = joins.label_index(trade_graph(spark, d).nodes)
    return i.select("name", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


@query("""WITH e AS (SELECT 'customer:' || o_custkey AS source, o_orderpriority AS target, o_orderstatus AS relation FROM orders) SELECT DISTINCT source, target, relation FROM e""")
def edges_once(spark, d):
    """Each edge once by source, target and relation."""
    e = table(spark, d, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("relation"))
    return sets.distinct_edges(e)


@query("""WITH x AS (SELECT o_custkey::VARCHAR AS a, o_orderpriority AS b, o_orderstatus AS relation, o_orderkey AS o FROM orders), y AS (SELECT a AS u, b AS v, relation, o FROM x UNION ALL SELECT b, a, relation, o FROM x)
SELECT u, v, arg_max(relation, o) AS relation FROM y GROUP BY u, v""")
def last_relations(spark, d):
    """The last edge of each pair of ends, both ways."""
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("relation"), F.col("o_orderkey").alias("ord"))
    return joins.last_edge(Graph(e.select(F.col("source").alias("id")), e))


@query("""WITH $T, e AS (SELECT count(*) AS n, count(DISTINCT source || ' ' || target) AS pairs, count(DISTINCT least(source, target) || ' ' || greatest(source, target)) AS flat FROM g_edges)
SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])::INTEGER AS line, unnest(['edge diagnostics', 'edges: ' || n, 'missing_ends: 0', 'dangling: 0', 'loops: 0', 'valid: ' || n, 'pairs: ' || pairs, 'surplus: ' || (n - pairs), 'variants: 0',
'undirected_pairs: ' || flat, 'undirected_surplus: ' || (n - flat)]) AS text FROM e""")
def diagnostics_lines(spark, d):
    """The edge diagnostics as a report."""
    return aggregates.diagnostics_report(trade_graph(spark, d))


# ---- sections, risk and cleaning

ARCHETYPES = [("storage", 1, ["customer", "ring"]), ("sources", 2, ["supplier", "widget", "red"]), ("places", 3, ["asia", "europe"])]


@query("""WITH $T, w AS (SELECT coalesce(community, ord % 7 + 10) AS community, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_:./ #\\-]+'), lambda x: x <> '')) AS word FROM g_nodes),
k AS (SELECT * FROM (VALUES ('storage', 1, 'customer'), ('storage', 1, 'ring'), ('sources', 2, 'supplier'), ('sources', 2, 'widget'), ('sources', 2, 'red'), ('places', 3, 'asia'), ('places', 3, 'europe')) t(section, priority, word)),
s AS (SELECT community, section, priority, count(*) AS score FROM w JOIN k USING (word) GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY score DESC, priority) AS p FROM s)
SELECT DISTINCT w.community, coalesce(r.section, 'other') AS section FROM w LEFT JOIN r ON r.community = w.community AND p = 1""")
def named_sections(spark, d):
    """The section that the words of each community's labels name."""
    nodes = trade_graph(spark, d).nodes.withColumn("community", F.coalesce("community", F.col("ord") % 7 + 10)).withColumn("label", F.replace("label", F.lit("#"), F.lit(" ")))
    return aggregates.sections(nodes, spark.createDataFrame(ARCHETYPES, "section string, priority int, keywords array<string>"))


@query("""WITH $T, b AS (SELECT source AS id FROM g_edges WHERE relation = 'inherits' UNION ALL SELECT target FROM g_edges WHERE relation = 'inherits'), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
dg AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY 1), c AS (SELECT source_file, count(*) AS commits FROM g_nodes GROUP BY 1)
SELECT g.id, commits * coalesce(dg.n, 0) * (1 + coalesce(nb.n, 0)) AS risk FROM g_nodes g JOIN c USING (source_file) LEFT JOIN dg ON dg.id = g.id LEFT JOIN nb ON nb.id = g.id""")
def file_churn_risk(spark, d):
    """Risk by commits, degree and bridges; each file counts one commit for each of its nodes, and belonging edges stand for bridges."""
    g = trade_graph(spark, d)
    churn = g.nodes.groupBy("source_file").agg(F.count("*").alias("commits"))
    files = Graph(g.nodes.withColumn("file_type", F.lit("file")), g.edges, g.directed)
    return aggregates.churn_risk(files, churn, g.edges.where("relation = 'inherits'").select("source", "target"))


WHY = " is told here for the record. It explains why that part of the tables was laid out in this way."


@query(f"""WITH $T SELECT id, CASE WHEN file_type = 'module' THEN (SELECT string_agg(n.label || '{WHY}', chr(10) || chr(10) ORDER BY n.id) FROM g_nodes n JOIN g_edges ON source = n.id WHERE target = g_nodes.id AND n.file_type = 'class') END AS rationale
FROM g_nodes WHERE id NOT LIKE 'nation:%'""")
def told_rationales(spark, d):
    """Nodes without rationale nodes, whose sentences join what they explain; nations stand for rationales."""
    g = trade_graph(spark, d)
    nation = F.col("id").startswith("nation:")
    nodes = g.nodes.withColumn("label", F.when(nation, F.concat("label", F.lit(WHY))).otherwise(F.col("label"))).withColumn("file_type", F.when(nation, "rationale").otherwise(F.col("file_type")))
    edges = g.edges.withColumn("relation", F.when(F.col("relation") == "inherits", "rationale_for").otherwise(F.col("relation")))
    return sets.sanitised(Graph(nodes, edges))[0].nodes.select("id", "rationale")


@query("""WITH RECURSIVE o AS (SELECT p_partkey AS k, p_partkey AS origin FROM part WHERE p_partkey % 7 = 1 UNION ALL SELECT p_partkey, origin FROM part JOIN o ON p_partkey // 2 = k AND p_partkey % 7 <> 1)
SELECT 'm' || k AS module, 'n' || k AS name, 'm' || origin AS origin, 'n' || origin AS origin_name FROM o""")
def export_origins(spark, d):
    """Where exported names are declared: each seventh part declares, the others pass on the name of the part at half their number; part 0 passes on its own and finds nothing."""
    k = F.col("p_partkey")
    key = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    half = F.when(k % 7 != 1, F.floor(k / 2))
    exports = table(spark, d, "part").select(key("m", k).alias("module"), key("n", k).alias("name"), key("m", half).alias("from_module"), key("n", half).alias("from_name"))
    return joins.export_closure(exports, spark.createDataFrame([], "module string, from_module string"))


@query("""WITH $T SELECT 'nodes' AS kind, count(*) AS n FROM g_nodes WHERE id <> 'region:0' UNION ALL SELECT 'edges', count(*) FROM g_edges WHERE NOT (source = 'nation:3' AND relation = 'inherits')
UNION ALL SELECT 'replaced', count(*) + 1 FROM g_nodes WHERE source_file NOT LIKE 'geo/%' UNION ALL SELECT 'inferred', count(*) FROM g_edges WHERE confidence = 'INFERRED'""")
def deletions(spark, d):
    """Rows left after a node, an edge or the rows of some files went, and inferred edges."""
    g = trade_graph(spark, d)
    marked = g.with_edges(g.edges.withColumn("source_file", F.lit("x")))
    end = g.edges.where("source = 'nation:3' AND relation = 'inherits'").select("target").first()[0]
    files = g.nodes.where("source_file LIKE 'geo/%'").select("source_file")
    new = g.nodes.where("id = 'region:0'")
    counts = {
        "nodes": filters.without_node(g, "region:0").nodes,
        "edges": filters.without_edge(g, "nation:3", end, "inherits").edges,
        "replaced": filters.replace_sources(marked, files, new, marked.edges.limit(0)).nodes,
        "inferred": filters.inferred_edges(g.edges),
    }
    out = None
    for kind, rows in counts.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH RECURSIVE $E, r(a, b) AS (SELECT source, target FROM e_edges UNION SELECT a, target FROM r JOIN e_edges ON b = source),
s AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT component, string_agg(id, ' ' ORDER BY id) AS members FROM s GROUP BY 1 HAVING count(*) > 1""")
def event_cycles(spark, d):
    """Strong components of two event types or more."""
    return analytics.cycles(event_graph(spark, d)).select("component", F.array_join("members", " ").alias("members"))


@query("""SELECT 'o' || o_custkey AS id, o_orderpriority AS kind FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p = 1
UNION ALL SELECT 'o' || c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def attached_hyperedges(spark, d):
    """Groups of orders by customer, and those of customers without one."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("kind"))
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("id")
    return sets.attached(o.select(key("o_custkey"), "kind"), table(spark, d, "customer").select(key("c_custkey"), F.col("c_mktsegment").alias("kind")))
