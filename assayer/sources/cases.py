"""Cases from benchmark files and semantic projects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.model import Comparison, EvalCase, GoldQuery
from assayer.sources.databases import sqlite_ddl

SPIDER = "db_id string, question string, query string"
BIRD = "db_id string, question string, evidence string, SQL string, question_id string, difficulty string"


def spider_cases(spark: SparkSession, path: str) -> DataFrame:
    """`case_id, db_id, question, gold_sql, difficulty` of a file of question and query."""
    return spider_rows(spark.read.schema(SPIDER).json(path, multiLine=True))


def spider_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat_ws("-", "db_id", F.substring(F.md5(F.concat_ws("\n", "question", "query")), 1, 8)).alias("case_id"), "db_id", "question", F.col("query").alias("gold_sql"), F.lit(None).cast("string").alias("difficulty"))


def bird_cases(spark: SparkSession, path: str, include_evidence: bool = True) -> DataFrame:
    return bird_rows(spark.read.schema(BIRD).json(path, multiLine=True), include_evidence)


def bird_rows(raw: DataFrame, include_evidence: bool = True) -> DataFrame:
    """Evidence, where there is any, follows the question."""
    hint = F.when(F.lit(include_evidence) & (F.trim(F.coalesce("evidence", F.lit(""))) != ""), F.concat(F.lit("\nEvidence: "), "evidence")).otherwise("")
    number = F.coalesce("question_id", F.substring(F.md5(F.concat_ws("\n", "question", "SQL")), 1, 8))
    return raw.select(F.concat_ws("-", "db_id", number).alias("case_id"), "db_id", F.concat("question", hint).alias("question"), F.col("SQL").alias("gold_sql"), "difficulty")


def as_cases(rows: DataFrame, comparison: Comparison | None = None) -> list[EvalCase]:
    """Case rows, which people write and driver memory holds, as cases."""
    return [EvalCase(r["case_id"], r["question"], GoldQuery(r["gold_sql"]), comparison or Comparison(), metadata={"db_id": r["db_id"], "difficulty": r["difficulty"]}) for r in rows.collect()]


def dataset_cases(root: str, split: str = "dev", databases: str = "database", kind: str = "spider", include_evidence: bool = True) -> Iterator[EvalCase]:
    """Cases of an unpacked data set, in the order of its file, each with its database's path and the statements that made its tables."""
    for k, r in enumerate(json.loads((Path(root) / f"{split}.json").read_text(encoding="utf-8"))):
        path = Path(root) / databases / r["db_id"] / f"{r['db_id']}.sqlite"
        evidence = (r.get("evidence") or "").strip()
        question = r["question"] + (f"\nEvidence: {evidence}" if include_evidence and evidence else "")
        more = {"source": kind, "db_id": r["db_id"], "db_path": str(path), "context": _ddl_of(str(path)), "difficulty": r.get("difficulty"), "split": split}
        yield EvalCase(f"{kind}/{r['db_id']}/{r.get('question_id', k)}", question, GoldQuery(r["SQL"] if "SQL" in r else r["query"]), metadata=more)


@lru_cache(maxsize=None)
def _ddl_of(path: str) -> str:
    return sqlite_ddl(path) if Path(path).is_file() else ""


def extract_sql(reply: str) -> str | None:
    """The first fenced block of a reply, else all of it; None if that is empty."""
    m = re.search(r"```[a-zA-Z]*\s*\n(.*?)```", reply, re.DOTALL)
    return (m[1] if m else reply).strip() or None


_REGISTRY: dict = {}


def eval_case(**fields):
    """Attach a case to a function; `case_of` finds it."""

    def attach(f):
        _REGISTRY[f] = EvalCase(**{"id": f.__name__} | fields)
        return f

    return attach


def case_of(f) -> EvalCase | None:
    return _REGISTRY.get(f)
