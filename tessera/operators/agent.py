"""A bounded tool loop over the retrieval operators.

The loop is driver-side and each tool call is one query. What chooses the calls is
a policy: a function of the question and the results so far. A real model plugs in
there; tests use a script. A policy returns a list of (tool, input), or a :class:`Turn`
that also tells the tokens it took and the text it said.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as J
from ..functions import predicates as P
from . import retrieval as R
from . import toc as O

log = logging.getLogger(__name__)

MAX_ITERATIONS, MAX_CALLS, MAX_INPUT, STALE = 8, 30, 500_000, 5
#: Statuses of a file's section index that a search warns of.
WARNED = ("MISSING_TOC", "INVALID_TOC", "SOURCE_NOT_INDEXED", "BACKFILL_FAILED")
#: How a run ended.
SUBMITTED, FORCED = "submit_answer_called", "forced_final_synthesis"
BUDGET_BEFORE, BUDGET_AFTER = "budget_exceeded_before_model_turn", "budget_exceeded_after_loop"
STALE_STOP, ITERATIONS = "stale_early_stop", "max_iterations_reached"
NO_ANSWER, SAID, SILENT = "no_final_answer", "no_tool_requests_with_text", "no_tool_requests_empty"
#: What is said when there is no answer: out of budget, or nothing found.
FALLBACKS = ("The limit of tool calls or tokens was reached before an answer.", "The documents do not hold enough information.")
TOOLS = ("get_toc", "get_section", "get_chunk_window", "hybrid_search", "search_toc", "submit_answer")


@dataclass
class Context:
    """What tools see: chunks (with embedding), sections and an embedder of queries."""

    chunks: DataFrame
    sections: DataFrame
    query_vector: Callable[[str], DataFrame]
    sources: tuple[str, ...] = ()
    enabled: tuple[str, ...] = TOOLS
    validate: Callable[[dict], list[str]] | None = None
    #: A closed schema of answers; it is the validator where none is given.
    schema: dict | None = None
    #: (source_path, status, eligible) of the files' section indexes; None: all may be searched.
    index_states: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.schema and not self.validate:
            self.validate = lambda answer: J.problems(self.schema, answer)
        if unknown := set(self.enabled) - set(TOOLS):
            raise ValueError(f"unknown tools: {sorted(unknown)}")
        if "submit_answer" not in self.enabled:
            raise ValueError("submit_answer is needed")

    @property
    def base(self) -> dict | None:
        return {"field": "source_path", "operator": "in", "value": list(self.sources)} if self.sources else None


@dataclass
class Turn:
    """One turn of a policy."""

    requests: list[tuple[str, dict]] = field(default_factory=list)
    text: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    cache_read_tokens: int = 0
    cache_write_tokens: int = 0


@dataclass
class State:
    calls: int = 0
    iterations: int = 0
    stale: int = 0
    seen: dict = field(default_factory=dict)
    log: list = field(default_factory=list)
    answer: str | None = None
    tokens: dict = field(default_factory=lambda: dict.fromkeys(("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"), 0))

    @property
    def exceeded(self) -> bool:
        return self.calls >= MAX_CALLS or self.tokens["input_tokens"] >= MAX_INPUT

    def spend(self, turn: Turn) -> None:
        for name in self.tokens:
            self.tokens[name] += getattr(turn, name)

    def record(self, rows: list) -> tuple[list[str], int]:
        """Texts of rows: whole when new, a mark when already returned."""
        texts, new = [], 0
        for r in rows:
            key = (r["source_path"], r["chunk_index"])
            if key in self.seen:
                texts.append(f"[ALREADY RETURNED: {key[0]}::{key[1]}]")
            else:
                self.seen[key] = r
                texts.append(r["rendered"])
                new += 1
        return texts, new


class Tools:
    def __init__(self, context: Context, state: State):
        self.c, self.s = context, state

    def call(self, name: str, given: dict) -> str:
        """Counts the call; an unknown tool, an error or a spent budget is text for the
        policy. An answer is taken whatever the budget."""
        if self.s.exceeded and name != "submit_answer":
            return "Error: the budget is exceeded"
        self.s.calls += 1
        if name not in self.c.enabled:
            return f"Error: unknown tool {name}"
        try:
            return getattr(self, name)(given)
        except Exception as e:  # the policy reads it and may go on
            return f"Error: {e}"

    def _file(self, file_id: str | None) -> str | None:
        if not file_id:
            return None
        spark = self.c.chunks.sparkSession
        files = self.c.chunks.where(P.compiled(self.c.base)).select("source_path").distinct()
        return R.resolve_file(spark.createDataFrame([(file_id,)], "file_id string"), files).first()["source_path"]

    def _show(self, rows: DataFrame, order: list[str]) -> str:
        found = self._rows(rows.withColumn("rendered", R.rendered_chunk()).select("source_path", "chunk_index", "rendered", *order).orderBy(*order))
        texts, new = self.s.record(found)
        return "\n\n".join([f"{len(found)} chunks, {new} new", *texts])

    def _rows(self, rows: DataFrame) -> list:
        """All rows, one partition at a time: an answer may be of any length."""
        return list(rows.toLocalIterator(prefetchPartitions=True))

    def _scope(self, given: dict) -> dict:
        path = self._file(given.get("file_id"))
        title = given.get("section_title")
        if path and title and not given.get("section_id"):
            spark = self.c.chunks.sparkSession
            titles = self.c.sections.where(F.col("source_path") == path)
            title = R.resolve_title(spark.createDataFrame([(title,)], "needle string"), titles).first()["title"]
        return P.scope(self.c.base, path, given.get("section_id"), title)[0]

    def hybrid_search(self, given: dict) -> str:
        """The best chunks by both legs; one that fails is left out."""
        predicate = P.compiled(self._scope(given))
        keyword = given.get("phrase") or given["query"]
        failed = lambda name, e: log.warning("%s leg failed: %s", name, e)
        top = R.hybrid(self.c.chunks, keyword, self.c.query_vector(given["query"]), predicate=predicate, warn=failed).withColumn("_order", -F.col("rrf"))
        # The fused keys are a handful; content joins back to them.
        return self._show(self.c.chunks.join(F.broadcast(top), ["source_path", "chunk_index"]), ["_order", "source_path", "chunk_index"])

    def _eligible(self, path: str | None) -> tuple[set[str] | None, list[str]]:
        """Files in scope that may be searched (None: no limit), and warnings of the rest."""
        scope = {path} if path else set(self.c.sources) or None
        if self.c.index_states is None:
            return scope, []
        states = self.c.index_states.where(F.col("source_path").isin(*scope)) if scope else self.c.index_states
        found = self._rows(states.select("source_path", "status", "eligible").orderBy("source_path"))
        return {r["source_path"] for r in found if r["eligible"]}, [f"[SEARCH_TOC_WARNING: {r['status']} file_id={r['source_path']}]" for r in found if r["status"] in WARNED]

    def search_toc(self, given: dict) -> str:
        """Sections by both legs, fused; no evidence is recorded."""
        query = str(given.get("query", "")).strip()
        if not query:
            return "No query provided."
        path = self._file(given.get("file_id"))
        if given.get("file_id") and path is None:
            return f"Error: no such file: {given['file_id']}"
        eligible, warnings = self._eligible(path)
        if eligible is not None and not eligible:
            return "\n".join([*warnings, "No searchable TOC sections in the effective scope."])
        rows = self.c.sections if eligible is None else self.c.sections.where(F.col("source_path").isin(*sorted(eligible)))
        keys, order = ["source_path", "section_id"], ("source_path", "ordinal")
        legs = {
            "SEMANTIC": lambda: R.ranked(R.vector_topk(rows.select(*keys, "ordinal", "embedding"), self.c.query_vector(query), R.LEG, order=order), 0, keys, [F.desc("score"), *order]),
            "KEYWORD": lambda: R.ranked(R.bm25_topk(rows.select(*keys, "ordinal", "content"), str(given.get("phrase") or query), R.LEG, order=order), 1, keys, ["bm25", *order]),
        }
        held = []
        for name, leg in legs.items():
            try:
                found = leg()
                held.append(rows.sparkSession.createDataFrame(found.collect(), found.schema))  # LEG rows at most
            except Exception as e:
                log.warning("%s leg failed: %s", name, e)
                warnings.append(f"[SEARCH_TOC_WARNING: {name}_RETRIEVAL_FAILED]")
        if not held:
            return "\n".join([*warnings, "TOC search failed: both retrieval legs failed."])
        top = R.fused(held, keys, R.TOC)
        found = rows.select(*keys, "ordinal", "breadcrumb").join(F.broadcast(top), keys).orderBy(F.desc("rrf"), *order).collect()
        if not found:
            return "\n".join([*warnings, "No matching TOC sections."])
        return "\n".join([*warnings, f"{len(found)} TOC section(s) returned:", *(f"[{r['section_id']}] {r['breadcrumb']}" for r in found)])

    def get_toc(self, given: dict) -> str:
        """The file's sections as an indented list with chunk counts and pages."""
        path = self._file(given["file_id"])
        if path is None:
            return "Error: no such file"
        known = {"depth": F.lit(None).cast("int"), "chunk_count": F.lit(0), "page_start": F.lit(None).cast("int")}
        rows = self.c.sections.where(F.col("source_path") == path).withColumn("id", F.col("section_id"))
        rows = rows.withColumns({n: v for n, v in known.items() if n not in rows.columns})
        found = self._rows(rows.select("ordinal", "chunk_count", O.section_line().alias("line")).orderBy("ordinal"))
        total = sum(r["chunk_count"] or 0 for r in found)
        return "\n".join([f"TOC for: {path}", f"Sections: {len(found)}  |  Total chunks: {total}", "", *(r["line"] for r in found)])

    def get_section(self, given: dict) -> str:
        return self._show(self.c.chunks.where(P.compiled(self._scope(given))), ["source_path", "chunk_index"])

    def get_chunk_window(self, given: dict) -> str:
        spark = self.c.chunks.sparkSession
        ids = R.parse_chunk_ids(spark.createDataFrame([(x,) for x in given["chunk_ids"]], "chunk_id string"))
        rows = R.chunk_window(self.c.chunks.where(P.compiled(self.c.base)), ids.where("error is null"), given.get("before", 1), given.get("after", 1))
        return self._show(rows, ["source_path", "chunk_index"])

    def submit_answer(self, given: dict) -> str:
        """Text that is not empty, or an object that passes the validator."""
        answer = given.get("answer", given)
        if self.c.validate:
            if isinstance(answer, str):
                answer = J.repaired_json(answer)
                if not isinstance(answer, dict):
                    return "Error: the answer is no JSON object"
            problems = self.c.validate(answer) if isinstance(answer, dict) else ["not an object"]
            if problems:
                return "Error: " + "; ".join(problems[:3])
            answer = json.dumps(answer, ensure_ascii=False)
        elif not str(answer).strip():
            return "Error: the answer is empty"
        self.s.answer = str(answer)
        return "accepted"


def _synthesised(context: Context, question: str, state: State, synthesise: Callable[[str, str], str]) -> str:
    """An answer made of the evidence, cut to the context budget; '' if it is refused."""
    texts, used = [], 0
    for r in list(state.seen.values())[: R.CONTEXT_DOCS]:
        if used + len(r["rendered"]) > R.CONTEXT_CHARS:
            break
        texts.append(r["rendered"])
        used += len(r["rendered"])
    said = synthesise(question, "\n".join(texts)).strip() if texts else ""
    if not said or not context.validate:
        return said
    value = J.repaired_json(said)
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) and not context.validate(value) else ""


def fallback(context: Context, state: State) -> str:
    """What is answered when there is no answer; a payload of the schema if there is one."""
    text = FALLBACKS[0 if state.exceeded else 1]
    return json.dumps(J.fallback_payload(context.schema, text), ensure_ascii=False) if context.schema else text


def run(context: Context, question: str, policy: Callable[[str, State], Turn | list], synthesise: Callable[[str, str], str] | None = None) -> dict:
    """The answer, why the loop stopped, and counters.

    A turn's remaining calls are dropped once an answer is accepted. A turn without
    calls ends the loop: its text is the answer, unless answers have a schema. Without
    an answer the evidence goes to synthesise, and without that there is a fallback.
    """
    state = State()
    tools = Tools(context, state)
    reason = None
    while reason is None:
        if state.exceeded:
            reason = BUDGET_BEFORE
        elif state.iterations >= 2 and state.stale >= STALE:
            reason = STALE_STOP
        elif state.iterations >= MAX_ITERATIONS:
            reason = ITERATIONS
        else:
            before = len(state.seen)
            state.iterations += 1
            turn = policy(question, state)
            turn = turn if isinstance(turn, Turn) else Turn(list(turn))
            state.spend(turn)
            for name, given in turn.requests:
                state.log.append({"step": state.iterations, "tool": name, "input": given, "result": tools.call(name, given)})
                if state.answer is not None:
                    break
            state.stale = 0 if len(state.seen) > before else state.stale + 1
            if state.answer is not None:
                reason = SUBMITTED
            elif not turn.requests:
                text = turn.text.strip()
                reason = SILENT if not text else NO_ANSWER if context.validate else SAID
                state.answer = text if reason == SAID else None
                state.log.append({"step": state.iterations, "event": "final_text", "text": text})
            elif state.exceeded:
                reason = BUDGET_AFTER
    if state.answer is None and synthesise and (made := _synthesised(context, question, state, synthesise)):
        state.answer, reason = made, FORCED
        state.log.append({"step": state.iterations, "event": FORCED})
    used = reason not in (SUBMITTED, FORCED)
    return {
        "question": question, "answer": fallback(context, state) if state.answer is None else state.answer, "stop_reason": reason,
        "strict_json_required": context.validate is not None, "fallback_used": used, "calls": state.calls, "iterations": state.iterations,
        "budget_exceeded": state.exceeded, "max_calls": MAX_CALLS, "max_input_tokens": MAX_INPUT, "stale_iterations": state.stale,
        **state.tokens, "evidence": [f"{p}::{i}" for p, i in state.seen], "log": state.log,
    }


def run_all(context: Context, questions: list[str], policy: Callable, synthesise: Callable | None = None, workers: int = 1) -> list[dict]:
    """One result a question, in order; a run that raises is a failed result.

    Loops wait for queries and for the policy, so threads are enough.
    """
    if workers < 1:
        raise ValueError("at least one worker is needed")

    def one(question: str) -> dict:
        try:
            return {"status": "completed", **run(context, question, policy, synthesise)}
        except Exception as e:
            return {"status": "failed", "question": question[:100], "error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(min(workers, max(1, len(questions)))) as pool:
        return list(pool.map(one, questions))
