"""Model judges and query rewriting: prompts, calls through a client that the caller gives, and what their replies say.

No client is built here. A client is a function of a prompt to a reply; it may raise, and no call of it ever fails a search.
"""

from __future__ import annotations

import json
import random
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import fusion, records

Client = Callable[[str], str]
#: Characters of a candidate that a judge sees, and lines of one in a list.
CONTENT_CHARS, LIST_LINES = 4000, 10


def judge_prompt(query: str, path: str | None, content: str | None, clauses: list[str] | None = None) -> str:
    """Asks for a score of 0 to 10 of how well one chunk answers a query."""
    body = (content or "")[:CONTENT_CHARS] or "(no content)"
    more = "".join(f"\n- {c}" for c in clauses or [])
    return f"Score from 0 to 10 how well this piece of a repository answers the search.\n\nSearch: {query}\nFile: {path or '(unknown)'}\n\n---\n{body}\n---\n\n10: what is searched for; 7 to 9: close to it; 4 to 6: related; 1 to 3: remotely; 0: not at all.{more}\n\nReply with JSON alone: {{\"score\": <integer>}}"


def reply_score(reply: str | None) -> int | None:
    """The score in a reply, 0 to 10; a missing one is 0, an unreadable reply None. Code fences are dropped."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = "\n".join(line for line in text.split("\n") if not line.startswith("```"))
    try:
        return max(0, min(10, int(json.loads(text).get("score", 0))))
    except (ValueError, TypeError, AttributeError):
        return None


def error_kind(e: BaseException) -> str:
    """rate_limit, timeout or error, by an exception's status, type and text."""
    status, text = getattr(e, "status", getattr(e, "status_code", None)), f"{type(e).__name__} {e}".lower()
    if status in (429, 529) or "rate limit" in text or "overloaded" in text:
        return records.RATE_LIMIT
    return records.TIMEOUT if isinstance(e, TimeoutError) or "timeout" in text or "timed out" in text else "error"


def judged(candidates: DataFrame, client: Client, threads: int = 8) -> DataFrame:
    """(query_id, id, judged, error) of candidates (query_id, id, asked, path, text, clauses): scores, and why there is none.

    A task calls the client for a batch in threads; clauses is optional.
    """

    def ask(row: tuple) -> tuple[int | None, str | None]:
        try:
            got = reply_score(client(judge_prompt(*row)))
            return got, None if got is not None else "unreadable"
        except Exception as e:  # noqa: BLE001  a judge never fails a search
            return None, error_kind(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(ask, zip(pdf["asked"], pdf["path"], pdf["text"], [list(c) if c is not None else [] for c in pdf["clauses"]], strict=True)))
                yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "judged": pd.array([g[0] for g in got], "Int32"), "error": [g[1] for g in got]})

    c = candidates if "clauses" in candidates.columns else candidates.withColumn("clauses", F.array().cast("array<string>"))
    return c.select("query_id", "id", "asked", "path", "text", "clauses").mapInPandas(run, "query_id long, id long, judged int, error string")


@records.reranker("judged")
def rerank_judged(results: DataFrame, k: int, client: Client | None = None, queries: DataFrame | None = None, pool: int = 15, clauses: DataFrame | None = None, **options) -> DataFrame:
    """The pointwise reranker with a client's scores of the best pool rows; results: (query_id, id, score, path, text), queries:
    (query_id, text). Where over 30 % of a query's calls failed the reason is what failed most."""
    if client is None or queries is None:
        return records.rerank_off(results, k).withColumn("reason", F.lit("no_client"))
    best = fusion.top(results, pool, ["query_id"], F.desc("score"), "id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    if clauses is not None:
        best = best.join(records.prompt_clauses(best, clauses), ["query_id", "id"], "left")
    scores = judged(best, client)
    rows = results.join(scores.select("query_id", "id", "judged"), ["query_id", "id"], "left")
    out = records.rerank_pointwise(rows, k, judge=F.col("judged"), pool=pool, **options).drop("judged")
    why = records.failure_reason(scores.where("error is not null").select("query_id", "error")).withColumnRenamed("reason", "why")
    return out.join(why, "query_id", "left").withColumn("reason", F.when(F.col("reason") == "failures", F.col("why")).otherwise(F.col("reason"))).drop("why")


def first_object(text: str | None) -> dict | None:
    """The first balanced JSON object in a text, or None."""
    for m in re.finditer(r"\{", text or ""):
        try:
            got, _ = json.JSONDecoder().raw_decode(text, m.start())
            return got if isinstance(got, dict) else None
        except ValueError:
            continue
    return None


def list_prompt(query: str, rows: list[tuple[str, str, str]]) -> str:
    """Asks for an order of candidates (id, path, text), of each of which the first lines are shown."""
    shown = "\n\n".join(f"[{i}] {p}\n" + "\n".join((t or "").split("\n")[:LIST_LINES]) for i, p, t in rows)
    return f"Put these pieces of a repository in order, the best answer to the search first.\n\nSearch: {query}\n\n{shown}\n\nReply with JSON alone: {{\"ranking\": [<all ids, each once>]}}"


def list_replies(results: DataFrame, queries: DataFrame, client: Client, pool: int = 15, seed: int = 7) -> DataFrame:
    """(query_id, ids, error): a client's order of each query's best pool rows, which it sees in a seeded random order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(f"C{n:02d}", i, p, t) for n, (i, p, t) in enumerate(zip(pdf["id"], pdf["path"], pdf["text"], strict=True))]
        shown = rows[:]
        random.Random(f"{seed}:{pdf['query_id'].iat[0]}").shuffle(shown)
        ids, error = None, None
        try:
            got = first_object(client(list_prompt(pdf["asked"].iat[0], [(c, p, t) for c, _, p, t in shown])))
            order = got.get("ranking") if got else None
            known = {c: str(i) for c, i, _, _ in rows}
            ids, error = ([known.get(str(x), f"?{x}") for x in order], None) if isinstance(order, list) else (None, "unreadable")
        except Exception as e:  # noqa: BLE001  a judge never fails a search
            error = error_kind(e)
        return pd.DataFrame([{"query_id": pdf["query_id"].iat[0], "ids": ids, "error": error}], columns=["query_id", "ids", "error"])

    best = fusion.top(results, pool, ["query_id"], F.desc("score"), "id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    return best.select("query_id", "id", "path", "text", "asked", "rank").groupBy("query_id").applyInPandas(lambda p: run(p.sort_values("rank")), "query_id long, ids array<string>, error string")


def hosted_rerank(query: str, documents: list[str], call: Callable[[str, list[str]], list[tuple[int, float]]], k: int | None = None) -> list[tuple[int, float]]:
    """(number, score) of documents in a hosted model's order, at most k; the given order with score 0 where the call fails."""
    try:
        got = sorted(call(query, documents), key=lambda x: (-x[1], x[0]))
    except Exception:  # noqa: BLE001
        got = [(i, 0.0) for i in range(len(documents))]
    return got if k is None else got[:k]


# ---- rewriting ----


class Rewriter:
    """Lexical queries rewritten by a client; off without one. The latest most rewrites are kept; any failure gives the query."""

    def __init__(self, client: Client | None = None, most: int = 500) -> None:
        self.client, self.most, self.held = client, most, OrderedDict()

    def __call__(self, query: str) -> str:
        if self.client is None or not query.strip():
            return query
        if query in self.held:
            self.held.move_to_end(query)
            return self.held[query]
        try:
            out = self.client(f"Rewrite this search as a few words to look up in source text, on one line.\n\n{query}").strip().split("\n")[0].strip()
        except Exception:  # noqa: BLE001  the query itself is a good lexical query
            return query
        self.held[query] = out or query
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[query]


def alternatives(query: str, reply: str | None, most: int = 3) -> list[str]:
    """The items of a numbered list in a reply: at most so many of 2 to 200 characters that are not the query itself."""
    items = (re.sub(r"^\s*(?:\d+[.)]|[-*])\s*", "", line).strip().strip("\"'") for line in (reply or "").split("\n"))
    out = [x for x in items if 2 <= len(x) <= 200 and x.casefold() != query.strip().casefold()]
    return list(dict.fromkeys(out))[:most]


def short_query_alternatives(query: str, client: Client | None) -> list[str]:
    """Alternatives for a short query without code shapes; none for others, without a client, or where it fails."""
    if client is None or len(query.split()) >= 5 or re.search(r"[_(){}\[\].:/\\`]|[a-z][A-Z]|\b[A-Z]{2,}\b", query):
        return []
    try:
        return alternatives(query, client(f"Give three other ways to put this search, as a numbered list.\n\n{query}"))
    except Exception:  # noqa: BLE001
        return []
