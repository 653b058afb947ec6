"""The retrieval operators against plain versions and the behaviours they promise."""

import re
import sqlite3
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom import config
from rankloom.functions import text as T
from rankloom.operators import chunking, fusion, lexical, records, vector


def test_queries_and_sql_agree_on_names():
    from rankloom.plans import registry

    assert registry.oracle_sql().keys() <= registry.queries().keys() and "hybrid_search" in registry.queries()


def test_nothing_else_imports_the_training_operators():
    root = Path(__file__).parent.parent / "rankloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "rankloom.llm" not in p.read_text()


def test_config_falls_back():
    c = config.from_env({"RANKLOOM_RRF_K": "x", "RANKLOOM_CONTENT_MODE": "docs", "RANKLOOM_VECTOR_WEIGHT": "nan"}.get)
    assert c.rrf_k == 20 and c.weights() == (0.7, 0.3) and config.SearchConfig().weights(True) == (0.35, 0.65)
    assert config.parse_bool("off", True) is False and config.parse_int("7", 1, 0, 5) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.text(alphabet="ab*?[]!./", max_size=8))
def test_globs_compile(path, glob):
    re.compile(T.glob_regex(glob).replace(r"\z", r"\Z"))


def test_globs_paths_and_boosts(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    assert list(row(T.matches_glob(F.lit("a/b/test_x.py"), "test_*.py"), T.matches_glob(F.lit("a/b.py"), "a/*"), T.matches_glob(F.lit(""), "*"), T.matches_glob(F.lit("x\\y.py"), ["z", "y.py"]))) == [True, True, False, True]
    assert list(row(T.same_file(F.lit("test.py"), F.lit("conftest.py"), F.lit("/r/conftest.py")), T.same_file(F.lit("a.py"), F.lit("a.py"), F.lit("")), T.same_file(F.lit("a.py"), F.lit("sub/a.py"), F.lit("")))) == [False, True, False]
    assert row(T.name_boost(F.lit("loadUser"), F.lit("load user"), F.array(F.lit("load"), F.lit("user"))))[0] == 1.3
    assert row(T.body_of(F.lit("a.md"), F.lit("---\nx: 1\n---\nbody")), T.body_of(F.lit("a.py"), F.lit("---\n---\nb")))[0] == "\nbody"
    assert row(T.judge_score(F.lit('```json\n{"score": 17.9}\n```')), T.judge_score(F.lit("{}")), T.judge_score(F.lit("no"))) == (10, 0, None)
    assert row(T.remote_url(F.lit("git@Host.org:a/B.git")), T.remote_url(F.lit("https://u:p@Host.org/a/B/?q#f"))) == ("https://host.org/a/B", "https://host.org/a/B")


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust")])
def test_porter(word, stem):
    assert lexical.porter(word) == stem


def test_bm25_equals_sqlite(spark):
    rows = [(1, "the cat sat on the mat", "cat mat"), (2, "dogs and cats run", "dog"), (3, "a running cat; the cat runs", ""), (4, "nothing here", "cat"), (5, None, "x")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, name, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, body, name) values (?, coalesce(?, ''), ?)", rows)
    want = {r: -s for r, s in db.execute("select rowid, bm25(f, 1.0, 5.0) from f where f match '\"the cat\" OR \"runs\"'")}
    df = spark.createDataFrame(rows, "id long, body string, name string")
    ask = spark.createDataFrame([(1, 0, ["the", "cat"]), (1, 1, [lexical.porter("runs")])], "query_id long, n int, words array<string>")
    got = {r.id: r.score for r in lexical.bm25(df, ask, [1.0, 5.0], ["body", "name"], lexical.porter_tokens).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_signals_and_expansion():
    s = lexical.signals("see `parse_row` and Flow.validate")
    assert s["explicit"] and s["owner_members"] == [("flow", "validate")] and s["path_hints"] == [] and s["identifiers"] == ["parse_row", "Flow.validate"]
    assert not lexical.signals("how are errors handled")["explicit"] and lexical.lexical_query("plain words") == "plain words"
    syn = lexical.overlay([("auth", ["login"]), ("db", ["sql"])], {"db": None, "net": ["http"]})
    assert lexical.expand("Login page", syn) == "login page auth" and lexical.expand("Nothing", syn) == "Nothing"


def test_fusion_orders(spark):
    arm = lambda *ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id long, id long, rank int")
    got = fusion.rrf([(arm(1, 2), 0.5), (arm(3, 1), 0.5)]).orderBy(F.desc("score"), "first_arm").collect()
    assert [r.id for r in got] == [1, 3, 2] or [r.id for r in got][0] == 1
    assert abs(got[0].score - (0.5 / 21 + 0.5 / 22)) < 1e-12
    res = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 3, 0.1)], "project string, id long, score double")
    assert [r.id for r in fusion.interleave(res).orderBy("global_rank").collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        fusion.interleave(res, 0)


def test_vector_top_k_checks_k(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.1])], "id long, v array<double>")
    assert [r.id for r in vector.top_k(q, rows, 2, skip_self=True).orderBy("rank").collect()] == [3, 2]
    with pytest.raises(ValueError):
        vector.top_k(q, rows, 0)


def test_binary_survivors_are_rescored(spark):
    import duckdb

    from rankloom.plans import registry

    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 1.0]), (2, [9.0, 0.1]), (3, [1.0, 0.9]), (4, [1.0, -0.01]), (5, None)], "id long, v array<double>")
    got = vector.binary_top_k(q, rows, 3, skip_self=True).orderBy("rank").collect()
    assert [(r.id, r.bits) for r in got] == [(3, 0), (2, 0), (4, 1)]
    assert [r.id for r in vector.binary_top_k(q, rows, 1, factor=2, skip_self=True).collect()] == [3]
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(registry.oracle_sql()["binary_rescore_float"].replace("from embeddings", f"from '{sf}/embeddings.parquet'")).fetchall()
    have = registry.queries()["binary_rescore_float"](spark, sf).collect()
    assert want and sorted(r[:3] + (round(r[3], 5), r[4]) for r in want) == sorted((*r[:3], round(r[3], 5), r[4]) for r in map(tuple, have))


def test_changes_and_integrity(spark):
    snap = lambda **k: spark.createDataFrame(list(k.items()), "path string, hash string")
    ch = records.changes(snap(a="1", b="2", c="3"), snap(a="1", b="9", d="4"))
    assert dict(ch.collect()) == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    assert {r.path for r in records.to_remove(ch).collect()} == {"b", "c"}


def test_markdown_keeps_fences(spark):
    text = "intro\n# One\n```\n# not a heading\n```\n## Two\nx"
    got = chunking.markdown_sections(spark.createDataFrame([("a.md", text)], "path string, text string")).orderBy("start_line").collect()
    assert [(r.kind, r.name, r.start_line, r.end_line) for r in got] == [("preamble", None, 1, 1), ("section", "One", 2, 5), ("section", "Two", 6, 7)]


def test_python_and_brace_units():
    u = chunking.python_units("a.py", "class A:\n    def f(self):\n        pass\n\n@d\ndef g():\n    pass\n")
    assert [(x["kind"], x["name"], x["parent"]) for x in u] == [("class", "A", None), ("method", "f", "A"), ("decorated_definition", "g", None)]
    b = chunking.braced_units("a.rs", "struct P {\n  x: i32,\n}\nfn f() {\n  if x {\n  }\n}\n")
    assert [(x["kind"], x["name"], x["start_line"], x["end_line"]) for x in b] == [("class", "P", 1, 3), ("function", "f", 4, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["x = 1", "", "def f():\n    return 2", "class C:\n    def m(self):\n        pass\n    y = 3"]), max_size=12), st.integers(5, 60))
def test_merging_loses_no_line(blocks, budget):
    text = "\n".join(blocks)
    got = chunking.merge_file(text, [u for u in chunking.python_units("a.py", text) if u["kind"] != "module"], budget)
    covered = {n for c in got for n in range(c["start_line"], c["end_line"] + 1)}
    assert all(i in covered for i, line in enumerate(text.split("\n"), 1) if line.strip())


def test_rerank_keeps_order_on_failures(spark):
    r = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(5)], "query_id long, id long, score double")
    off = [x.id for x in records.rerank("unknown", r, 3).orderBy("rank").collect()]
    bad = records.rerank("pointwise", r, 3, judge=F.lit(None).cast("double")).orderBy("rank").collect()
    good = records.rerank("pointwise", r, 3, judge=F.col("id") + 5.0).orderBy("rank").collect()
    assert off == [0, 1, 2] and [x.id for x in bad] == off and bad[0].reason == "failures" and [x.id for x in good] == [4, 3, 2]


def test_graph_scores(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, path string")
    edges = spark.createDataFrame([(1, 3, "calls"), (2, 3, "calls"), (1, 2, "calls")], "source long, target long, type string")
    seeds = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "path string, sim double")
    w = {(1, 3): 1, (3, 1): 1, (2, 3): 1, (3, 2): 1, (1, 2): 2, (2, 1): 2}
    deg = {u: sum(n for (a, _), n in w.items() if a == u) for u in (1, 2, 3)}
    s, r = {1: 2 / 3, 2: 1 / 3, 3: 0.0}, {1: 2 / 3, 2: 1 / 3, 3: 0.0}
    for _ in range(5):
        r = {v: 0.85 * sum(r[u] * n / deg[u] for (u, x), n in w.items() if x == v) + 0.15 * s[v] for v in r}
    got = {x.path: x.score for x in records.graph_scores(seeds, nodes, edges).collect()}
    assert abs(got["b"] / got["a"] - r[2] / r[1]) < 1e-9 and max(got.values()) == 1.0
    assert records.graph_scores(seeds.where("path = 'a'"), nodes, edges).count() == 0


def test_summary_of_nothing(spark):
    assert list(records.summary(spark.createDataFrame([], "expected array<string>, ranked array<string>")).first()) == [0, 0.0, 0.0, 0.0]


def test_query_expand_equals_its_sql(spark, tmp_path):
    import duckdb

    from rankloom.plans import registry

    texts = ["of the cat", "edsh.\nthe cat and", "onrein.\nand  the", "and\tthe\n", "the", "x\nand", "", None, "a  und b"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    got = {tuple(r) for r in registry.queries()["query_expand"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(registry.oracle_sql()["query_expand"]).fetchall())


def test_shown_scores_are_rounded_as_sql_does(spark):
    import duckdb

    xs = [77.195, 128.605, 1.005, 0.5, -77.195, 0.125, -0.125, 2.675, 1e6 + 0.005, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.y for r in df.select("i", T.rounded(F.col("x"), 2).alias("y")).orderBy("i").collect()]
    assert got == [duckdb.execute("select round(?::double, 2)", [x]).fetchone()[0] for x in xs] and got[0] == 77.19
