"""Registered queries over scalar functions, filters and row constructors, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import SearchConfig
from rankloom.functions import text as T
from rankloom.operators import chunking, lexical, search, vector
from rankloom.plans.catalog import _PATH, _docs, _t
from rankloom.plans.registry import query

# A query text for each customer, so that scalar functions meet many shapes: names, segments, actions, paths.
_ASK = """(select c_custkey, case c_custkey % 8 when 0 then 'find the ' || lower(c_mktsegment) || ' class' when 1 then 'UserStore' when 2 then 'alpha beta gamma' when 3 then 'manage users'
 when 4 then 'database connection error' when 5 then 'how does login work' when 6 then 'unit test ' || c_nationkey else lower(c_mktsegment) || ' docs' end as q from customer)"""


def _asks(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    q = F.expr("case c_custkey % 8 when 0 then 'find the ' || lower(c_mktsegment) || ' class' when 1 then 'UserStore' when 2 then 'alpha beta gamma' when 3 then 'manage users' when 4 then 'database connection error' when 5 then 'how does login work' when 6 then 'unit test ' || c_nationkey else lower(c_mktsegment) || ' docs' end")
    return c.select("c_custkey", q.alias("q"))


_ACTIONS = "['find', 'search', 'get', 'show', 'list', 'how', 'what', 'where', 'when', 'create', 'build', 'make', 'handle', 'process', 'manage', 'implement']"


@query(f"""select c_custkey, len(w) <= 3 and len(list_intersect(w, {_ACTIONS})) = 0 and (regexp_matches(q, '[A-Z][a-z]+[A-Z]') or len(w) <= 2) as entity from (select *, regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+') as w from {_ASK})""")
def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).select("c_custkey", T.entity_like(F.col("q"), T.name_tokens(F.lower("q"))).alias("entity"))


@query(f"""select c_custkey, array_to_string(list_filter([
 case when regexp_matches(l, '\\bfunction\\b|\\bdef\\b|\\bmethod\\b|\\bclass\\b|how.*work|implement.*|algorithm.*') then 'function_search' end,
 case when regexp_matches(l, '\\berror\\b|\\bexception\\b|\\btry\\b|\\bcatch\\b|handle.*error|exception.*handling') then 'error_handling' end,
 case when regexp_matches(l, '\\bdatabase\\b|\\bdb\\b|\\bquery\\b|\\bsql\\b|\\bmodel\\b|\\btable\\b|connection') then 'database' end,
 case when regexp_matches(l, '\\bapi\\b|\\bendpoint\\b|\\broute\\b|\\brequest\\b|\\bresponse\\b|\\bhttp\\b|rest.*api') then 'api' end,
 case when regexp_matches(l, '\\bauth\\b|\\blogin\\b|\\btoken\\b|\\bpassword\\b|\\bsession\\b|authenticate|permission') then 'authentication' end,
 case when regexp_matches(l, '\\btest\\b|\\bmock\\b|\\bassert\\b|\\bfixture\\b|unit.*test|integration.*test') then 'testing' end], lambda x: x is not null), ',') as intents from (select *, lower(q) as l from {_ASK})""")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).select("c_custkey", F.array_join(T.intents(F.col("q")), ",").alias("intents"))


@query("""select p_partkey, 1.0 + 0.05 * len(list_intersect(list_distinct(regexp_extract_all(lower(replace(p_type, ' ', '/')) || '/' || lower(p_brand), '[\\p{L}\\p{N}]+')), ['steel', 'brand', 'small', 'xyz']))::double as boost from part""")
def path_boosts(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.regexp_replace("p_type", " ", "/"), F.lit("/"), "p_brand")
    return _t(spark, d, "part").select("p_partkey", T.path_boost(path, F.array(*[F.lit(x) for x in ("steel", "brand", "small", "xyz")])).alias("boost"))


@query("""select p_partkey, case when p_size % 5 in (0, 2) then 0.82 when p_size % 5 = 1 then 0.82 else 1.0 end::double as role from part""")
def role_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Paths of tests (in a folder, by suffix) and of documentation, among others, for a query that asks for neither."""
    path = F.expr("case p_size % 5 when 0 then 'src/Tests/a.py' when 1 then 'docs/guide.txt' when 2 then 'src/a_test.py' when 3 then 'src/contest/a.py' else 'spec/a.py' end")
    no = F.lit("where is it")
    return _t(spark, d, "part").select("p_partkey", T.role_boost(path, T.asks_tests(no), T.asks_docs(no)).alias("role"))


@query("""select p_partkey, case p_size % 4 when 0 then 1.3 when 1 then 0.7 when 2 then 0.9 else 1.0 end::double as code, case p_size % 4 when 0 then 0.8 when 1 then 1.3 when 2 then 0.9 else 1.0 end::double as docs from part""")
def type_boosts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("case p_size % 4 when 0 then 'function' when 1 then 'section' when 2 then 'module' else 'other' end")
    of = lambda mode: search._by_type(kind, SearchConfig(mode).boosts())
    return _t(spark, d, "part").select("p_partkey", of("code").alias("code"), of("docs").alias("docs"))


@query("""select p_partkey, case when p_size % 3 = 2 then null when p_size % 3 = 1 then null else p_size end::int as start_line, case when p_size % 3 = 0 then p_size + 3 end::int as end_line from part""")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    v = F.expr("case p_size % 3 when 0 then p_size || '-' || (p_size + 3) when 1 then (p_size + 1) || '-' || p_size else 'a-' || p_size end")
    r = _t(spark, d, "part").select("p_partkey", T.line_range(v).alias("r"))
    return r.select("p_partkey", "r.start", "r.end").toDF("p_partkey", "start_line", "end_line")


@query("""select p_partkey, case p_size % 5 when 0 then least(10, p_size) when 1 then 0 when 2 then null when 3 then 10 else 0 end::int as score from part""")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a score, without one, unreadable, too high, and below 0 in a fence."""
    reply = F.expr("""case p_size % 5 when 0 then '{"score": ' || p_size || '}' when 1 then '{"why": "x"}' when 2 then 'no' when 3 then '{"score": 99}' else concat('```json\n', '{"score": -2}', '\n```') end""")
    return _t(spark, d, "part").select("p_partkey", T.judge_score(reply).alias("score"))


@query("""select p_partkey, case p_size % 4 when 0 then 'hand' || 'l' when 1 then 'function' when 2 then 'pars' else 'is' end as stem from part""")
def stems(spark: SparkSession, d: str) -> DataFrame:
    word = F.expr("case p_size % 4 when 0 then 'handled' when 1 then 'functions' when 2 then 'parsing' else 'is' end")
    cut = F.when(word == "handled", F.lit("handled")).otherwise(word)
    return _t(spark, d, "part").select("p_partkey", T.stem(cut).alias("stem"))


@query("""select item_id, sha256(case when item_id % 3 = 0 then chr(10) || text when item_id % 3 = 1 then '---' || chr(10) || text else text end) as hash from benchmark""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of Markdown files is left out of their hash; an open one, and other files, are hashed whole."""
    text = F.expr("case item_id % 3 when 0 then concat('---\ntitle: x\n---\n', text) when 1 then concat('---\n', text) else text end")
    return _t(spark, d, "benchmark").select("item_id", F.sha2(T.body_of(F.lit("a/b.md"), text), 256).alias("hash"))


@query("""select s_suppkey, 'https://host.org/Team/s' || s_suppkey as url, sha256('remote:https://host.org/Team/s' || s_suppkey) as repository_id, md5(s_name || case when s_suppkey % 2 = 0 then ':p' else '' end) as project_id from supplier""")
def repository_ids(spark: SparkSession, d: str) -> DataFrame:
    """Remotes in scp and URL form, with credentials, query and .git, all of one normal form; ids of repositories and projects."""
    name = F.concat(F.lit("s"), "s_suppkey")
    remote = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("git@HOST.org:Team/"), name, F.lit(".git"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://u:p@host.org/Team/"), name, F.lit("/?a=b"))).otherwise(F.concat(F.lit("ssh://git@host.org/Team/"), name, F.lit(".git")))
    return _t(spark, d, "supplier").select("s_suppkey", T.remote_url(remote).alias("url"), T.repository_id(remote, F.lit("/x")).alias("repository_id"), T.project_id(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "p")).alias("project_id"))


@query("""select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as claim from benchmark""")
def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", T.claim_text(F.concat(F.lit(" \t"), F.regexp_replace("text", " ", " \n "), F.lit(" "))).alias("claim"))


@query("""select p_partkey, p_size % 4 = 0 as component, p_size % 4 = 1 as hook from part""")
def component_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("case p_size % 4 when 0 then 'UserCard' when 1 then 'useStore' when 2 then 'HTTP' else 'user' end")
    return _t(spark, d, "part").select("p_partkey", T.component_name(name).alias("component"), T.hook_name(name).alias("hook"))


@query(f"""select doc_id, '# From ' || {_PATH} || ' - document ' || source || '.d' || doc_id || chr(10) as header from documents""")
def lexical_headers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.lexical_header(F.col("path"), F.lit("document"), F.col("source"), F.concat(F.lit("d"), "doc_id")).alias("header"))


@query(f"""select doc_id, source || '/' || lang as folder from documents where lang = 'en' and starts_with(source, 'src1') and doc_id % 7 < 5""")
def metadata_filters(spark: SparkSession, d: str) -> DataFrame:
    """A glob, an overlap of folders, tags, equality on a column that rows have, and a key that they have not, which filters nothing."""
    x = _docs(spark, d).withColumns({"kind": F.lit("document"), "tags": F.when(F.col("doc_id") % 7 < 5, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))})
    want = {"file_pattern": ["src1*/*"], "folder_structure": ["en", "nowhere"], "chunk_type": "document", "tags": ["b", "z"], "lang": "en", "no_such_key": 1, "source": None}
    return x.where(search.matches(x.columns, want)).select("doc_id", F.concat_ws("/", "source", "lang").alias("folder"))


@query(f"""select doc_id, p = 'doc_7.md' or ends_with(p, 'doc_7.md') or ends_with('doc_7.md', p) as fits from (select doc_id, {_PATH} as p from documents)""")
def suffix_paths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.path_suffix_match(F.col("path"), F.lit("doc_7.md")).alias("fits"))


@query(f"""select doc_id, p = 'en/doc_7.md' or ends_with(p, '/en/doc_7.md') or ends_with(p, '/doc_8.md') as gold from (select doc_id, {_PATH} as p from documents)""")
def gold_matches(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.gold_match(F.col("path"), F.array(F.lit("en/doc_7.md"), F.lit("doc_8.md"))).alias("gold"))


@query("""select path, list_contains(['build', '.git'], f) or e = 'pyc' as skip from (select f || '/x.' || e as path, f, e from (select unnest(['build', '.git', 'src', 'builder']) as f), (select unnest(['py', 'pyc']) as e))""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.sources.files import ignored

    f = _t(spark, d, "region").limit(1).select(F.explode(F.array(*[F.lit(x) for x in ("build", ".git", "src", "builder")])).alias("f"), F.lit(1).alias("x"))
    rows = f.select("f", F.explode(F.array(F.lit("py"), F.lit("pyc"))).alias("e")).select(F.concat("f", F.lit("/x."), "e").alias("path"))
    return rows.select("path", ignored(F.col("path")).alias("skip"))


@query("""select doc_id, length(regexp_replace(text, '\\s', '', 'g'))::int as nws, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) < 5 and not regexp_matches(text, '[_(){}\\[\\].:/\\\\`]|[a-z][A-Z]|\\b[A-Z]{2,}\\b') as short from documents""")
def short_queries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.char_length(F.regexp_replace("text", r"\s", "")).alias("nws"), T.short_natural(F.col("text")).alias("short"))


@query("""select suffix, language from (values ('.py', 'python'), ('.C++', 'cpp'), ('.h', null), ('.hcl', null), ('.tf', 'hcl'), ('.YML', 'yaml'), ('.svelte', 'svelte'), ('.nix', 'nix')) t(suffix, language)""")
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in (".py", ".C++", ".h", ".hcl", ".tf", ".YML", ".svelte", ".nix")], "suffix string")
    return s.select("suffix", chunking.language(F.concat(F.lit("a/b"), "suffix")).alias("language"))


@query("""select item_id, w.n, w.explicit from (select item_id, case item_id % 4 when 0 then 3 when 1 then 7 when 2 then 0 else 1 end as n, item_id % 4 <> 2 as explicit from benchmark) w""")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    """Back-ticked and shaped identifiers, a pinned path with its first line's words, plain prose, and a name in CamelCase: lexical terms and whether they are explicit."""
    q = F.expr("""case item_id % 4 when 0 then 'fix `load_all` in HTTP' when 1 then concat('see https://github.com/a/b/blob/', repeat('0123456789', 4), '/x/y.py#L3') when 2 then 'plain words here' else 'UserStore' end""")
    s = _t(spark, d, "benchmark").select("item_id", lexical.signals_of(q).alias("s"))
    named = F.when(F.col("s.explicit"), F.size(F.split("s.lexical_query", " "))).otherwise(0)
    return s.select("item_id", named.alias("n"), F.col("s.explicit").alias("explicit"))


@query("""select 'rec' || (p_size % 3) as unit, count(*) as n from part group by 1""")
def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunkers over generated files: Python functions, Svelte scripts and Nix options, one unit a part."""
    body = F.expr("case p_size % 3 when 0 then concat('def f', p_partkey, '():\n    return 1\n') when 1 then concat('<script>\nlet a = ', p_partkey, ';\n</script>\n') else concat('{\n  a', p_partkey, ' = mkOption {\n    type = int;\n    default = 1;\n    x = 2;\n    y = 3;\n  };\n}\n') end")
    path = F.expr("case p_size % 3 when 0 then p_partkey || '.py' when 1 then p_partkey || '.svelte' else p_partkey || '.nix' end")
    u = chunking.code_units(_t(spark, d, "part").select(path.alias("path"), body.alias("text")))
    return u.groupBy(F.expr("case kind when 'function' then 'rec0' when 'script' then 'rec1' when 'option' then 'rec2' else kind end").alias("unit")).agg(F.count("*").alias("n"))


@query("""select query_id, id, round(s, 3) as score from (select a.vec_id as query_id, b.vec_id as id, round(list_dot_product(a.e, b.e), 6) as s, row_number() over (partition by a.vec_id order by round(list_dot_product(a.e, b.e), 6) desc, b.vec_id) as r
 from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as e from embeddings) a join (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as e from embeddings) b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) where r <= 3""")
def similar_rows(spark: SparkSession, d: str) -> DataFrame:
    """Similar chunks as a caller sees them: three decimals."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vector.top_k(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), e, 3, skip_self=True).select("query_id", "id", F.round("score", 3).alias("score"))


