"""Columns over labels, tokens and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_id(*parts: Column) -> Column:
    """Parts joined by _, everything but letters and digits made _, small letters; runs stay."""
    return F.lower(F.regexp_replace(F.concat_ws("_", *parts), r"[^A-Za-z0-9]", "_"))


def squeezed_id(text: Column) -> Column:
    """The same with runs of _ made one and none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def file_id(path: Column) -> Column:
    """Parent folder, stem and ending as an id."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem, end = F.regexp_extract(name, r"^(.*?)(?:\.([^.]*))?$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    return make_id(F.when(parent != "", parent), F.when(stem != "", stem), F.when(end != "", end))


def callable_label(label: Column) -> Column:
    """Trimmed, without parentheses at the ends and leading dots, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def bare_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"\(\)$", "")


def store_tokens(text: Column) -> Column:
    """Small-letter runs of letters and digits of two characters or more."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def search_tokens(text: Column) -> Column:
    """Small-letter words of letters, digits and _; ASCII, so that every engine agrees."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def is_searchable(word: Column) -> Column:
    """Words of two or fewer small ASCII letters are not searched."""
    return ~word.rlike(r"^[a-z]{0,2}$")


def query_terms(text: Column) -> Column:
    """Search tokens that are searchable; runs of Chinese characters give bigrams and themselves."""
    words = F.filter(search_tokens(text), is_searchable)
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4E00}-\x{9FFF}]+)"), F.lit(1))
    return F.concat(words, F.flatten(F.transform(runs, bigrams)))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def bigrams(word: Column) -> Column:
    """Each two neighbouring characters, and the word itself if it is longer or shorter than two."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.array_distinct(F.concat(F.filter(F.transform(at, lambda i: F.substr(word, i, F.lit(2))), lambda g: F.length(g) == 2), F.array(word)))


def camel_parts(token: Column) -> Column:
    """camelCase and PascalCase in parts of small letters; snake_case as it is."""
    marked = F.regexp_replace(F.regexp_replace(token, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.when(token.contains("_"), F.array(F.lower(token))).otherwise(F.split(F.lower(marked), " "))


def label_tokens(label: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(label, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(marked), r"[_:./ \-]+"), lambda w: w != "")


def symbol_candidates(query: Column) -> Column:
    """A single dotted token in its parts; else the words that look like identifiers, each once."""
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    likely = F.filter(words, lambda w: w.rlike("[A-Z_]") | (F.length(w) >= 4))
    dotted = query.rlike(r"^\S+\.\S+$")
    return F.array_distinct(F.when(dotted, F.split(query, r"\.")).otherwise(likely))


def is_symbol(query: Column) -> Column:
    return query.rlike(r"^[A-Za-z0-9_]+$") & query.rlike("[A-Z_]")


def byte_range(location: Column) -> Column:
    """start:end as struct(start, end); null for anything else."""
    ok = location.rlike(r"^\d+:\d+$")
    return F.when(ok, F.struct(F.split(location, ":")[0].try_cast("long").alias("start"), F.split(location, ":")[1].try_cast("long").alias("end")))


def body(content: Column, location: Column) -> Column:
    """The bytes of a range as text; empty if the range is no range or begins after its end or the content."""
    r = byte_range(location)
    raw = F.encode(content, "UTF-8")
    ok = (r["start"] < r["end"]) & (r["start"] < F.octet_length(content))
    piece = F.substring(raw, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))
    return F.when(F.coalesce(ok, F.lit(False)), F.make_valid_utf8(piece.cast("string"))).otherwise("")


def docstring(text: Column) -> Column:
    """Quote and comment signs and margins removed; null if nothing is left."""
    inner = F.regexp_replace(F.trim(text), r'^("""|\'\'\'|/\*\*?|//[/!]?|#+)\s*|\s*("""|\'\'\'|\*/)$', "")
    clean = F.trim(F.regexp_replace(inner, r"(?m)^[ \t]*(\*|///?|#)?[ \t]?", ""))
    return F.when(clean != "", clean)


def clean_label(label: Column) -> Column:
    """Without control characters, at most 256 characters; null is empty."""
    return F.coalesce(F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, 256), F.lit(""))


def html_escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def clean_metadata(metadata: Column) -> Column:
    """Keys and values without control characters, escaped, at most 512 characters; empty keys go."""
    fix = lambda c: F.substring(html_escaped(F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")), 1, 512)
    pairs = F.filter(F.transform(F.map_entries(metadata), lambda e: F.struct(fix(e["key"]).alias("key"), fix(e["value"]).alias("value"))), lambda e: e["key"] != "")
    return F.map_from_entries(F.filter(pairs, lambda e: e.isNotNull()))


def wiki_file_name(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|#^\[\]]', "-"), r"^[ .]+|[ .]+$", "")
    return F.when(clean == "", "unnamed").otherwise(F.substring(clean, 1, 200))


def yaml_escaped(text: Column) -> Column:
    out = text
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def stable_id(text: Column, prefix: str = "n", limit: int = 40) -> Column:
    slug = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")
    named = F.when((slug == "") | slug.rlike(r"^\d"), F.concat_ws("_", F.lit(prefix), F.when(slug != "", slug))).otherwise(slug)
    return F.concat(F.substring(named, 1, limit), F.lit("_"), F.substring(F.sha2(text, 256), 1, 8))


def mermaid(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'["`<>{}\[\]()|;#]', " "), r"\s+", " "))


def shortened(text: Column, limit: int) -> Column:
    """White space made single, then at most ``limit`` characters with three dots at the end."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, max(0, limit - 3)), F.lit("...")))


def humanised(label: Column) -> Column:
    return F.initcap(F.array_join(label_tokens(F.regexp_replace(label, r"\(\)$", "")), " "))


def is_rationale(text: Column) -> Column:
    """A sentence: at least 80 bytes or 8 words, and one of . ! ? :"""
    return ((F.octet_length(text) >= 80) | (F.size(F.split(F.trim(text), r"\s+")) >= 8)) & text.rlike(r"[.!?:]")


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def without_comments(json: Column) -> Column:
    """JSON without comments and trailing commas; strings stay."""
    no_comment = F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    return F.regexp_replace(no_comment, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def html_text(html: Column, limit: int | None = 8000) -> Column:
    """Without scripts, styles and tags, white space made single, at most ``limit`` characters."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
    return F.substring(flat, 1, limit) if limit else flat


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def file_token_estimate(size: Column) -> Column:
    return F.floor((F.least(size, F.lit(20000)) + 80) / 4).cast("long")


def grouped_thousands(n: Column) -> Column:
    return F.regexp_replace(n.cast("long").cast("string"), r"\B(?=(\d{3})+$)", ",")


def char_bucket(n: Column) -> Column:
    return F.when(n < 1000, "<1k").when(n < 10000, "1k-10k").when(n < 100000, "10k-100k").otherwise("100k+")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 10, "<10s").when(seconds < 60, "10-60s").when(seconds < 300, "1-5m").otherwise("5m+")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").when(n < 1000, "100-999").otherwise("1000+")


def utc_day(epoch: Column) -> Column:
    """The day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string")


def utc_iso(epoch: Column) -> Column:
    second = F.pmod(F.floor(epoch).cast("long"), F.lit(86400))
    return F.concat(utc_day(epoch), F.format_string("T%02d:%02d:%02dZ", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60))


def confidence_score(confidence: Column) -> Column:
    return F.when(confidence == "INFERRED", 0.7).when(confidence == "AMBIGUOUS", 0.4).otherwise(1.0)


def edge_score(confidence: Column, relation: Column) -> Column:
    bonus = F.when(relation.isin("calls", "uses", "method"), 1.0).when(relation.isin("imports", "imports_from"), 0.6).when(relation == "contains", -0.2).when(relation == "rationale_for", -0.6).otherwise(0.0)
    return confidence_score(confidence) + F.when(confidence == "EXTRACTED", 2.0).otherwise(0.0) + bonus


def review_status(base_ok: Column, checks: Column, review: Column, draft: Column, age_days: Column) -> Column:
    """The state of a change request, the first that holds."""
    return (
        F.when(~base_ok, "WRONG-BASE").when(checks == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(age_days >= 14, "STALE").when(review == "APPROVED", "APPROVED").when(checks == "PENDING", "PENDING").otherwise("READY")
    )


def checks_rollup(states: Column) -> Column:
    """Any failure, else any in progress, else any success, else none."""
    has = lambda *names: F.exists(states, lambda s: s.isin(*names))
    return F.when(has("FAILURE", "ERROR", "TIMED_OUT", "CANCELLED"), "FAILURE").when(has("IN_PROGRESS", "QUEUED", "PENDING"), "PENDING").when(has("SUCCESS"), "SUCCESS").otherwise("NONE")


def symbol_node_id(suffix: Column, file: Column, symbol: Column) -> Column:
    return F.concat(F.lit("scip_"), suffix, F.lit("_"), F.substring(F.sha2(F.concat_ws(":", file, symbol), 256), 1, 12))
