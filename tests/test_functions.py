import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import paths, text, vectors


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'array<double>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column,value,want",
    [
        (text.make_id, "Foo--Bar", "foo__bar"), (text.squeezed_id, "--Foo--Bar-", "foo_bar"), (text.file_id, "src/util/Main.rs", "util_main_rs"), (text.callable_label, " .run() ", "run"),
        (text.store_tokens, "Ab c_de1", ["ab", "de1"]), (text.search_tokens, "Foo_bar baz!", ["foo_bar", "baz"]), (text.query_terms, "is the Big42 of", ["the", "big42"]), (text.bigrams, "中文字", ["中文", "文字", "中文字"]),
        (text.camel_parts, "parseHTMLBody", ["parse", "html", "body"]), (text.camel_parts, "Snake_Case", ["snake_case"]), (text.label_tokens, "getUser_name.x", ["get", "user", "name", "x"]), (text.is_symbol, "fooBar", True), (text.is_symbol, "foobar", False),
        (text.docstring, '"""  Hello.\n  there """', "Hello.\nthere"), (text.clean_label, "a\x07b", "ab"), (text.html_escaped, "<a href='x'>", "&lt;a href=&#x27;x&#x27;&gt;"), (text.without_fences, '```json\n{"a":1}\n```', '{"a":1}'),
        (text.without_comments, '{"u": "http://x", /* c */ "b": [1,], // d\n}', '{"u": "http://x",  "b": [1] \n}'), (text.html_text, "<p>a<script>x</script> <b>b</b></p>", "a b"), (text.is_rationale, "It is so.", False), (text.token_estimate, "", 1),
        (paths.file_kind, "a/b.RS", "code"), (paths.file_kind, "x.pdf", "paper"), (paths.file_kind, "noext", None), (paths.is_sensitive, "a/.ssh/config", True), (paths.is_sensitive, "my_password.txt", True), (paths.is_sensitive, "src/main.py", False),
        (paths.is_skipped, "a/node_modules/x.js", True), (paths.is_skipped, "src/main/java/out/X.java", False), (paths.is_skipped, "yarn.lock", True), (paths.shebang, "#!/usr/bin/env -S python3 -u\nx", "python3"), (paths.is_test_or_example, "src/Test/FooTest.java", True),
        (paths.url_kind, "https://arxiv.org/abs/2101.00001", "arxiv"), (paths.url_kind, "https://e.org/a.PDF?x", "pdf"), (paths.safe_file_name, "https://a.b/c d?q#f", "a_b_c_d"), (paths.arxiv_id, "https://arxiv.org/abs/2101.00001v2", "2101.00001"),
        (paths.is_public_url, "http://169.254.169.254/x", False), (paths.is_public_url, "https://example.org/", True), (paths.is_public_url, "ftp://example.org/", False), (paths.language_by_ending, "x.tsx", "TypeScript"),
    ],
)
def test_columns(spark, column, value, want):
    assert one(spark, column, value) == want


def test_columns_of_two_values(spark):
    assert one(spark, text.body, "hello wörld", "6:12") == "wörld"
    assert one(spark, text.body, "hello", "9:12") == ""
    assert one(spark, paths.suffix_match, "a/b/c.py", "c.py") is True
    assert one(spark, paths.suffix_match, "a/b/xc.py", "c.py") is False
    assert one(spark, text.grouped_thousands, 1234567) == "1,234,567"
    assert one(spark, vectors.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine, [0.0, 0.0], [1.0, 1.0]) == 0.0


def test_jaro_winkler():
    assert vectors.jaro_winkler_of("MARTHA", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert vectors.jaro_winkler_of("", "a") == 0.0 and vectors.jaro_winkler_of("", "") == 1.0


def test_token_vectors_are_fixed_unit_vectors():
    a, b = vectors.token_vector("user"), vectors.token_vector("users")
    assert np.allclose(a, vectors.token_vector("user")) and abs(np.linalg.norm(a) - 1) < 1e-9 and abs(a @ b) < 0.4


def test_review_status_takes_the_first_that_holds(spark):
    row = spark.createDataFrame([(True, "SUCCESS", "APPROVED", False, 20), (True, "SUCCESS", "APPROVED", False, 2), (False, "FAILURE", "", True, 0)], "b boolean, c string, r string, d boolean, a int")
    got = [r[0] for r in row.select(text.review_status(*[F.col(x) for x in "bcrda"])).collect()]
    assert got == ["STALE", "APPROVED", "WRONG-BASE"]
