from pyspark.sql import functions as F

from arborlake.extract import imports


def test_python_names_are_traced(spark):
    files = spark.createDataFrame(
        [
            ("pkg/__init__.py", "from .core import run as go\n"),
            ("pkg/core.py", "class Job: pass\n\ndef run(job: 'Job', n: list[Job] | None = None) -> Job:\n    return helper()\n\ndef helper():\n    return Job()\n"),
            ("pkg/sub/user.py", "from ..core import run, Job\nimport pkg.core\n\ndef main(x: Job):\n    run(x)\n    x.run()\n"),
            ("bad.py", "def ("),
        ],
        "path string, content string",
    )
    facts = imports.python_facts(files)
    assert facts.where("kind = 'error'").count() == 1
    edges = {tuple(r) for r in imports.python_edges(facts, files).collect()}
    assert ("pkg/sub/user.py", "pkg/core.py", "calls", "run", "call") in edges
    assert ("pkg/sub/user.py", "pkg/core.py", "references", "Job", "parameter_type") in edges
    assert ("pkg/core.py", "pkg/core.py", "references", "Job", "generic_arg") in edges
    assert ("pkg/__init__.py", "pkg/core.py", "imports", "run", "import") in edges
    assert ("pkg/sub/user.py", "pkg/core.py", "imports", "pkg.core", "import") in edges


def test_scripts_are_probed_in_order(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.tsx",), ("src/b.js",), ("src/b.ts",), ("app/x.ts",)], "path string")
    asked = spark.createDataFrame([("src/m.ts", "./a"), ("src/m.ts", "./lib"), ("src/m.ts", "./b.js"), ("src/m.ts", "./none"), ("src/m.ts", "@/x")], "path string, specifier string")
    aliases = spark.createDataFrame([("@/*", "app/*"), ("@/y", "z")], "prefix string, target string")
    wanted = imports.aliased(asked, aliases).withColumn("candidates", imports.script_candidates(F.col("path"), F.col("wanted")))
    got = {r["specifier"]: r["target"] for r in imports.resolved(wanted, files).collect()}
    assert got == {"./a": "src/a.ts", "./lib": "src/lib/index.tsx", "./b.js": "src/b.js", "./none": None, "@/x": "app/x.ts"}


def test_more_than_a_thousand_aliases(spark):
    aliases = [(f"@p{i}/*", f"src/p{i}/*") for i in range(1500)] + [("@p7/deep/*", "deep/*"), ("exact", "src/exact")]
    specifiers = [f"@p{i}/x" for i in range(1500)] + ["@p7/deep/y", "exact", "exact/more", "react", "", None]
    asked = spark.createDataFrame([("a.ts", s) for s in specifiers], "path string, specifier string")
    got = {r["specifier"]: r["wanted"] for r in imports.aliased(asked, spark.createDataFrame(aliases, "prefix string, target string")).collect()}
    assert got == {**{f"@p{i}/x": f"src/p{i}/x" for i in range(1500)}, "@p7/deep/y": "deep/y", "exact": "src/exact", "exact/more": "exact/more", "react": "react", "": "", None: None}
