"""The search pipeline: filters, vector and lexical arms, fusion, boosts, dedupe, graph blend and reranking of a batch of queries.

One call is one lazy plan for all its queries. Filters come before the arms' top k, so k rows come back where so many match.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.config import SearchConfig
from rankloom.functions import text as X
from rankloom.operators import fusion, lexical, records, vector

MODES = ("auto", "hybrid", "semantic", "keyword")
#: Columns of the lexical arm, and what an occurrence in each weighs (the name's weight is a setting).
LEXICAL_COLUMNS = ["chunk_id", "content", "path", "name"]
# Score factors of chunk types in semantic mode, by what the query looks like.
SEMANTIC_TYPES = {
    "class_word": {"class": 1.3, "function": 1.05, "method": 1.05, "module": 0.9},
    "entity": {"class": 1.15, "function": 1.1, "method": 1.1, "module": 0.92},
    "other": {"function": 1.1, "method": 1.1, "class": 1.05, "module": 0.95},
}
# The kind of evidence that a mode's results are.
EVIDENCE_TYPES = {"keyword": "lexical_match", "semantic": "semantic_match", "hybrid": "hybrid_match", "auto": "hybrid_match"}


@dataclass
class Index:
    """What a search reads. chunks: id long, chunk_id, path, kind, name, parent, docstring, start_line, end_line, text, tags and any
    others; postings and stats as lexical.build_postings() and corpus_stats() give them; vectors: id long, v array. rows: where
    postings are not stored, what makes the lexical arm's rows of chunks, whose texts are then scanned."""

    chunks: DataFrame
    postings: DataFrame | None
    stats: DataFrame | None
    vectors: DataFrame | None
    analyser: str = "porter"
    problems: list[str] = field(default_factory=list)
    rows: Callable[[DataFrame], DataFrame] | None = None


def analyse(name: str):
    return lexical.porter_tokens if name == "porter" else lexical.plain_tokens


def query_tokens(name: str):
    """The same analysis of query words on the driver."""
    import re

    return (lambda t: [lexical.porter(w) for w in lexical.folded(t)]) if name == "porter" else (lambda t: re.findall(r"[^\W_]+", t.lower()))


class InvalidSearch(ValueError):
    """A search that cannot be made: code, field and message as a caller shows them."""

    def __init__(self, field_: str, message: str) -> None:
        super().__init__(message)
        self.error = {"code": "invalid_argument", "field": field_, "message": message}


def validated(k: int, mode: str, filters: Mapping | None = None, query: str | None = "x") -> None:
    """Raises InvalidSearch: a blank query, k outside 1 to 100, an unknown mode, an empty glob or one with a NUL."""
    if query is None or not str(query).strip():
        raise InvalidSearch("query", "query must not be blank")
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 100:
        raise InvalidSearch("k", "k must be an integer from 1 to 100")
    if mode not in MODES:
        raise InvalidSearch("search_mode", f"mode must be one of {', '.join(MODES)}")
    globs = (filters or {}).get("file_pattern")
    for g in [globs] if isinstance(globs, str) else globs or []:
        if not g or "\0" in g:
            raise InvalidSearch("file_pattern", "a file pattern must not be empty or hold NUL")


def matches(columns: list[str], filters: Mapping | None) -> Column:
    """All filters hold: file_pattern by glob, chunk_type (column kind) by equality, tags and folder_structure by any overlap, any
    other key by equality where rows have such a column. A None value filters nothing."""
    out = F.lit(True)
    for key, want in (filters or {}).items():
        if want is None:
            continue
        if key == "file_pattern":
            out = out & X.matches_glob(F.col("path"), want)
        elif key == "chunk_type":
            out = out & F.col("kind").eqNullSafe(F.lit(want))
        elif key == "tags":
            out = out & F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in ([want] if isinstance(want, str) else want)])), F.lit(False))
        elif key == "folder_structure":
            parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
            out = out & F.arrays_overlap(parts, F.array(*[F.lit(t) for t in ([want] if isinstance(want, str) else want)]))
        elif key in columns:
            out = out & F.col(f"`{key}`").eqNullSafe(F.lit(want))
    return out


def prepared(queries: DataFrame) -> DataFrame:
    """queries (query_id, text, v) with what their text says: sig, tokens, whether they ask for tests or documentation."""
    q = queries.withColumn("sig", lexical.signals_of(F.coalesce("text", F.lit(""))))
    return q.select("query_id", "text", "v", "sig", X.name_tokens(F.lower("text")).alias("tokens"), X.asks_tests(F.col("text")).alias("asks_tests"), X.asks_docs(F.col("text")).alias("asks_docs"))


def lexical_phrases(queries: DataFrame, analyser: str, synonyms: list[tuple[str, list[str]]] | None = None, compact: bool = True) -> DataFrame:
    """(query_id, n, words): each query's phrases, after compacting to its signals and expansion by synonyms."""
    tokens = query_tokens(analyser)
    rows = []
    for r in queries.select("query_id", "text").toLocalIterator():
        q = lexical.lexical_query(r.text or "") if compact else r.text or ""
        q = lexical.expand(q, synonyms) if synonyms else q
        rows += [(r.query_id, n, words) for n, words in enumerate(lexical.phrases_of(q, tokens))]
    return queries.sparkSession.createDataFrame(rows, "query_id long, n int, words array<string>")


def _none(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")


def vector_arm(index: Index, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, score, rank); no rows where the index has no vectors."""
    if index.vectors is None:
        return _none(queries)
    v = index.vectors if allowed is None else index.vectors.join(allowed.select("id"), "id", "left_semi")
    return vector.top_k(queries.where("v is not null").select("query_id", "v"), v, k)


def lexical_arm(index: Index, phrases: DataFrame, k: int, allowed: DataFrame | None, name_weight: float = 5.0) -> DataFrame:
    """(query_id, id, score, rank) by BM25; no rows where the index has no postings. Statistics are those of all rows; allowed: the
    chunks that may be found."""
    if index.postings is None or index.stats is None:
        return _none(phrases)
    weights = [0.0, 1.0, 0.5, name_weight]
    if index.rows is not None:
        among = None if allowed is None else index.rows(allowed)
        s = lexical.bm25_best(index.rows(index.chunks), phrases, weights, LEXICAL_COLUMNS, k, analyse(index.analyser), among=among)
    else:
        s = lexical.bm25_stored(index.postings, index.stats, phrases, weights)
        s = s if allowed is None else s.join(allowed.select("id"), "id", "left_semi")
    return fusion.top(s.withColumn("score", F.round("score", 6)), k, ["query_id"], F.desc("score"), "id")


def _by_type(kind: Column, boosts: Mapping[str, float]) -> Column:
    return F.lit(1.0) if not boosts else F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(boosts.items()) for x in kv])[kind], F.lit(1.0))


def _beyond_one(boost: Column, times: float) -> Column:
    return F.when(boost > 1, 1 + (boost - 1) * times).otherwise(boost)


_FIELDS = ("id", "chunk_id", "path", "kind", "name", "parent", "docstring", "start_line", "end_line", "text", "tags")


def hybrid_candidates(index: Index, q: DataFrame, k: int, cfg: SearchConfig, phrases: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Fused, boosted and deduped candidates of prepared queries: at most 3 k a query before the dedupe, one a file after it."""
    most = fusion.candidate_k(k, True)
    own = q.select("query_id", "text", "sig", "tokens", "asks_tests", "asks_docs", F.when(F.col("sig.explicit"), most).otherwise(fusion.candidate_k(k, False)).alias("pool"))
    own = own.withColumnRenamed("text", "asked")
    chunks = index.chunks.select(*_FIELDS)
    arms = None
    for n, arm in enumerate((vector_arm(index, q, most, allowed), lexical_arm(index, phrases, most, allowed, cfg.name_weight))):
        one = arm.join(F.broadcast(own.select("query_id", "sig", "pool")), "query_id").where("rank <= pool")  # the batch's queries
        plain, flipped = cfg.weights(), cfg.weights(explicit=True)
        weight = F.when(F.col("sig.explicit"), flipped[n]).otherwise(plain[n])
        one = one.select("query_id", "id", "score", "rank", "sig", weight.alias("weight"), F.lit(n).alias("arm"))
        arms = one if arms is None else arms.unionByName(one)
    seen = F.broadcast(arms).join(chunks.select("id", "path", "name", "parent", "text"), "id")  # at most 400 rows a query of the batch
    seen = seen.withColumn("signal", lexical.signal_boost(F.col("sig"), F.col("path"), F.col("name"), F.col("parent"), F.col("text")))
    seen = seen.select("query_id", "id", "arm", "weight", "rank", "signal", F.when(F.col("sig.explicit"), -F.abs("score") * F.col("signal")).otherwise(F.col("rank").cast("double")).alias("by"), F.when(F.col("sig.explicit"), F.col("id")).otherwise(F.lit(0)).alias("tie"))
    seen = fusion.ranked(seen.drop("rank"), ["query_id", "arm"], "by", "tie")
    fused = seen.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (cfg.rrf_k + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("arm", "rank")).alias("first_arm"), F.first("signal").alias("signal"))
    order = [F.desc("rrf"), F.col("first_arm.arm"), F.col("first_arm.rank")]
    best = fusion.top(fused, cfg.over_fetch * k, ["query_id"], *order).withColumnRenamed("rank", "fused_rank")
    c = F.broadcast(best).join(chunks, "id").join(F.broadcast(own), "query_id")
    score = F.col("rrf") * _by_type(F.col("kind"), cfg.boosts())
    score = score * _beyond_one(X.name_boost(F.col("name"), F.col("asked"), F.col("tokens")), 2.0) * _beyond_one(X.path_boost(F.col("path"), F.col("tokens")), 3.0) * F.col("signal")
    if cfg.content_mode == "code":
        score = score * X.role_boost(F.col("path"), F.col("asks_tests"), F.col("asks_docs"))
    c = c.select("query_id", *_FIELDS, "fused_rank", F.round(score, 12).alias("score"))
    return fusion.best_per(c, ["query_id", "path"], F.desc("score"), "fused_rank")


def semantic_score(tokens: Column, asked: Column, chunk: Mapping[str, Column], similarity: Column) -> Column:
    """A similarity times the factors of semantic mode: chunk type by kind of query, name, path, tags that are the query's intents,
    docstring, and a long preview."""
    entity = X.entity_like(asked, tokens)
    kinds = F.when(F.lower(asked).contains("class"), _by_type(chunk["kind"], SEMANTIC_TYPES["class_word"])).when(entity, _by_type(chunk["kind"], SEMANTIC_TYPES["entity"])).otherwise(_by_type(chunk["kind"], SEMANTIC_TYPES["other"]))
    tagged = F.size(F.array_intersect(X.intents(asked), F.coalesce(chunk["tags"], F.array().cast("array<string>"))))
    doc = F.when(F.coalesce(chunk["docstring"], F.lit("")) == "", 1.0).when(entity & (chunk["kind"] == "module"), 1.02).otherwise(1.05)
    long_ = F.when(F.char_length(X.preview(chunk["text"])) > 1000, 0.98).otherwise(1.0)
    return similarity * kinds * X.name_boost(chunk["name"], asked, tokens) * X.path_boost(chunk["path"], tokens) * (1 + 0.1 * tagged) * doc * long_


def semantic_candidates(index: Index, q: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """The min(10 k, 200) nearest chunks of each query with their semantic score."""
    arm = vector_arm(index, q, min(10 * k, 200), allowed).withColumnRenamed("score", "similarity").withColumnRenamed("rank", "fused_rank")
    c = F.broadcast(arm).join(index.chunks.select(*_FIELDS), "id").join(F.broadcast(q.select("query_id", F.col("text").alias("asked"), "tokens")), "query_id")
    chunk = {n: F.col(n) for n in ("kind", "tags", "docstring", "text", "name", "path")}
    score = semantic_score(F.col("tokens"), F.col("asked"), chunk, F.col("similarity"))
    return c.select("query_id", *_FIELDS, "fused_rank", F.round(score, 9).alias("score"))


def keyword_candidates(index: Index, phrases: DataFrame, k: int, cfg: SearchConfig, allowed: DataFrame | None) -> DataFrame:
    arm = lexical_arm(index, phrases, k, allowed, cfg.name_weight).withColumnRenamed("rank", "fused_rank")
    return F.broadcast(arm.select("query_id", "id", F.abs("score").alias("score"), "fused_rank")).join(index.chunks.select(*_FIELDS), "id").select("query_id", *_FIELDS, "fused_rank", "score")


def search(queries: DataFrame, index: Index, mode: str = "hybrid", k: int = 5, filters: Mapping | None = None, config: SearchConfig | None = None, synonyms: list[tuple[str, list[str]]] | None = None, graph: DataFrame | None = None, **rerank_options) -> DataFrame:
    """The best k chunks of each query (query_id, text, v): query_id, rank, id, chunk_id, path, kind, name, start_line, end_line,
    score, snippet, reason.

    auto is hybrid. queries are the small side; v may be null, such a query has its lexical arm alone. A null or blank text has no
    lexical arm. graph (query_id, path, score): graph scores to blend in by config.ppr_alpha. config.rerank_mode names the reranker
    (rerank_options go to it); it never fails a search, reason says what it did. Results hold one chunk a file, except in keyword
    and semantic mode. Equal scores keep the order before; a query_id must be one query's.
    """
    cfg = config or SearchConfig()
    validated(k, mode, filters)
    q = prepared(queries)
    q = q if cfg.signals else q.withColumn("sig", F.col("sig").withField("explicit", F.lit(False)))
    allowed = index.chunks.where(matches(index.chunks.columns, filters)) if any(v is not None for v in (filters or {}).values()) else None
    if mode == "semantic":
        c = semantic_candidates(index, q, k, allowed)
    elif mode == "keyword":
        c = keyword_candidates(index, lexical_phrases(queries, index.analyser, compact=False), k, cfg, allowed)
    else:
        c = hybrid_candidates(index, q, k, cfg, lexical_phrases(queries, index.analyser, synonyms, cfg.signals), allowed)
        if graph is not None and cfg.ppr_alpha:
            p = graph.select("query_id", "path", F.col("score").alias("ppr"))
            c = c.join(p, ["query_id", "path"], "left").withColumn("score", F.col("score") * (1 + cfg.ppr_alpha * F.coalesce("ppr", F.lit(0.0)))).drop("ppr")
    if mode in ("auto", "hybrid") and cfg.rerank_mode != "off":
        out = records.rerank(cfg.rerank_mode, c, k, pool=cfg.rerank_pool, confident=cfg.confident, **rerank_options)
    else:
        out = fusion.top(c, k, ["query_id"], F.desc("score"), "fused_rank").withColumn("reason", F.lit("off"))
    return out.select("query_id", "rank", "id", "chunk_id", "path", "kind", "name", "start_line", "end_line", "score", X.snippet(X.preview(F.col("text"))).alias("snippet"), "reason")


def shown(results: DataFrame, digits: int = 2) -> DataFrame:
    """Rows as a caller sees them: file, lines, kind, score rounded to digits (similar rows: 3), name and snippet where there are."""
    return results.select("query_id", "rank", F.col("path").alias("file"), F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("lines"), "kind", X.rounded(F.col("score"), digits).alias("score"), "chunk_id", F.nullif("name", F.lit("")).alias("name"), F.nullif("snippet", F.lit("")).alias("snippet"))


def with_context(results: DataFrame, index: Index, similar: int = 3, kept: int = 2) -> DataFrame:
    """Results with context_info: of the similar chunks nearest to each the best kept, and how many chunks its file has."""
    ids = results.select("id").distinct()
    context = T.ArrayType(T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())]))
    if index.vectors is None:
        near = ids.select(F.col("id").alias("near_id"), F.array().cast(context).alias("similar_chunks"))
    else:
        asked = index.vectors.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), "v")
        found = vector.top_k(asked, index.vectors, similar, skip_self=True).where(F.col("rank") <= kept)
        named = found.join(index.chunks.select("id", "chunk_id"), "id")
        near = named.groupBy(F.col("query_id").alias("near_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("t")).select("near_id", F.transform("t", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.round(x["score"], 3).alias("score"))).alias("similar_chunks"))
    per = chunks_per_file(index.chunks).withColumnRenamed("path", "file_path")
    j = results.join(near, F.col("id") == F.col("near_id"), "left").join(per, F.col("path") == F.col("file_path"), "left")
    return j.withColumn("context_info", F.struct(F.coalesce("similar_chunks", F.array().cast(context)).alias("similar_chunks"), F.struct(F.coalesce("n_chunks", F.lit(0)).alias("total_chunks_in_file")).alias("file_context"))).drop("near_id", "similar_chunks", "file_path", "n_chunks")


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("n_chunks"))


def evidence_fence(before: Mapping | None, after: Mapping | None) -> str | None:
    """Why results may not be referenced: the identity before or after the search is missing or incomplete, or it changed; else None.

    An identity has status ready and the same fields both times."""
    for when, x in (("before_search", before), ("after_search", after)):
        if not x or x.get("status") != "ready":
            return f"{when}:{(x or {}).get('status', 'missing')}"
    fields = ("repository_id", "checkout_id", "source_revision", "dirty_fingerprint", "index_generation")
    return None if all(before[f] == after[f] for f in fields) else "identity_changed_during_search"


def with_evidence(results: DataFrame, index: Index, before: Mapping | None, after: Mapping | None, mode: str = "hybrid") -> tuple[DataFrame, str | None]:
    """Results joined to their chunks' source lines as evidence (one row a line), and why there is none.

    Rows: query_id, rank, chunk_id, path, line_no, evidence_id, observation_id, evidence_type, snippet. An observation's id covers
    its evidence, the query and the kind of evidence.
    """
    lines = records.source_lines(index.chunks.join(results.select("id").distinct(), "id", "left_semi").select("path", "start_line", "end_line", "text"))
    why = evidence_fence(before, after)
    ok = before if why is None else {"repository_id": "", "source_revision": "", "index_generation": ""}
    ev = records.evidence(lines, ok["repository_id"], ok["source_revision"], ok["index_generation"]).withColumnRenamed("path", "line_path").withColumnRenamed("snippet", "line_snippet")
    j = results.join(ev, (F.col("path") == F.col("line_path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    kind = EVIDENCE_TYPES.get(mode, "search_match")
    oid = X.stable_id("ob", evidence_id=X.json_text(F.col("evidence_id")), evidence_type=X.json_text(F.lit(kind)), query_id=F.col("query_id").cast("string"))
    out = j.select("query_id", "rank", "chunk_id", "path", "line_no", "evidence_id", oid.alias("observation_id"), F.lit(kind).alias("evidence_type"), F.col("line_snippet").alias("snippet"))
    return (out if why is None else out.limit(0)), why


def suggestions(chunks: DataFrame, partial: str, n: int = 5) -> DataFrame:
    """At most n tags and chunk types that hold the partial word, by how often they occur."""
    words = chunks.select(F.explode(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("kind")))).alias("suggestion"))
    return words.where(F.lower("suggestion").contains(partial.lower())).groupBy("suggestion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suggestion").limit(n)
