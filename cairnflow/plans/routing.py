"""Corrective routing around a retrieval: judge what was found, then pass, refine or search elsewhere.

Models and outside services are functions that the caller gives; none is called by default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORRECT, AMBIGUOUS, INCORRECT = "correct", "ambiguous", "incorrect"
#: Characters of a chunk that the refiner reads, and of all chunks.
REFINE_HEAD, REFINE_ALL = 800, 6000

Judge = Callable[[str, list[str]], str]
Refiner = Callable[[str, str], str]
WebSearch = Callable[[str, int], list[tuple[str, str]]]


@dataclass(frozen=True)
class Routed:
    hits: DataFrame
    verdict: str
    action: str


def score_judge(high: float = 0.6, low: float = 0.3) -> Callable[[DataFrame], str]:
    """A judge by the best score, without a model."""

    def judge(hits: DataFrame) -> str:
        best = hits.agg(F.max("sim")).first()[0]
        return INCORRECT if best is None or best < low else CORRECT if best >= high else AMBIGUOUS

    return judge


def judged(hits: DataFrame, question: str, judge: Judge | None, head: int = 500, k: int = 10) -> str:
    """The judge's verdict on the heads of the best hits; nothing found is incorrect, an error or another word ambiguous."""
    texts = [r[0] for r in hits.orderBy(F.desc("sim"), "id").limit(k).select(F.substring("content_with_weight", 1, head)).collect()]
    if not texts:
        return INCORRECT
    if judge is None:
        return score_judge()(hits)
    try:
        said = judge(question, texts).strip().lower()
    except Exception:  # noqa: BLE001  a model's failure is no verdict
        return AMBIGUOUS
    return said if said in (CORRECT, AMBIGUOUS, INCORRECT) else AMBIGUOUS


def _virtual(spark, like: DataFrame, rows: list[tuple[str, str, str, float]]) -> DataFrame:
    made = spark.createDataFrame(rows, "docnm_kwd string, content_with_weight string, doc_type_kwd string, sim double")
    made = made.withColumn("id", F.md5(F.concat_ws("_", "doc_type_kwd", "docnm_kwd", "content_with_weight")))
    return like.limit(0).unionByName(made.select(*[c for c in made.columns if c in like.columns]), allowMissingColumns=True)


def refined(hits: DataFrame, question: str, refiner: Refiner) -> DataFrame:
    """One hit with the facts that the refiner keeps; none where it finds none, the raw head where it fails."""
    heads = [r[0] or "" for r in hits.orderBy(F.desc("sim"), "id").limit(20).select(F.substring("content_with_weight", 1, REFINE_HEAD)).collect()]
    body = "\n\n".join(heads)[:REFINE_ALL]
    try:
        said, sim = refiner(question, body).strip(), 0.7
    except Exception:  # noqa: BLE001
        said, sim = body[:1000], 0.6
    rows = [] if not said or said.lower() == "no relevant facts" else [("refined", said, "refined", sim)]
    return _virtual(hits.sparkSession, hits, rows)


def from_web(hits: DataFrame, question: str, web: WebSearch | None, k: int) -> DataFrame:
    rows = [(name, body, "web_search", 0.8) for name, body in web(question, k)[:k]] if web else []
    return _virtual(hits.sparkSession, hits, rows)


def route(hits: DataFrame, question: str, judge: Judge | None = None, refiner: Refiner | None = None, web: WebSearch | None = None) -> Routed:
    """Correct: the hits. Incorrect: three web results, or the hits where there are none. Ambiguous: what the refiner
    keeps, or the hits without a refiner, and two web results."""
    verdict = judged(hits, question, judge)
    if verdict == CORRECT:
        return Routed(hits, verdict, "local")
    if verdict == INCORRECT:
        found = from_web(hits, question, web, 3)
        return Routed(hits, verdict, "local fallback") if found.isEmpty() else Routed(found, verdict, "web")
    own = refined(hits, question, refiner) if refiner else hits
    return Routed(own.unionByName(from_web(hits, question, web, 2)), verdict, "refined" + " and web" * bool(web))
