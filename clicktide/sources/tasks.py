"""Task records and their JSON parameters.

Every parameter is a JSON array of which element 0 counts; that element may be
a comma list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed parameter names of the JSON text, with the column each becomes.
PARAMS = {
    "start_date": "startDate",
    "end_date": "endDate",
    "start_age": "startAge",
    "end_age": "endAge",
    "professionals": "professionals",
    "cities": "cities",
    "sex": "sex",
    "keywords": "keywords",
    "category_ids": "categoryIds",
    "target_page_flow": "targetPageFlow",
}


def task_params(tasks: DataFrame) -> DataFrame:
    """One row per task with every parameter as a typed column, NULL when missing."""
    text = {col: F.get_json_object("task_param", f"$.{key}[0]") for col, key in PARAMS.items()}
    casts = {"start_date": "date", "end_date": "date", "start_age": "int", "end_age": "int"}
    return tasks.select(
        "task_id",
        *[
            (text[col].try_cast(casts[col]) if col in casts else text[col]).alias(col)
            for col in PARAMS
        ],
    )


@dataclass(frozen=True)
class TaskParams:
    """The parameters of one task as plain values."""

    task_id: int
    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: tuple[str, ...] | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None
    target_page_flow: tuple[int, ...] | None = None


def _tokens(text: str | None, kind=str) -> tuple | None:
    if not text:
        return None
    return tuple(kind(t) for t in text.split(","))


def find_task(tasks: DataFrame, task_id: int) -> TaskParams:
    """Parameters of one task; an unknown id is an error."""
    row = task_params(tasks.where(F.col("task_id") == task_id)).first()
    if row is None:
        raise LookupError(f"no task with id {task_id}")
    return TaskParams(
        task_id=row.task_id,
        start_date=None if row.start_date is None else row.start_date.isoformat(),
        end_date=None if row.end_date is None else row.end_date.isoformat(),
        start_age=row.start_age,
        end_age=row.end_age,
        professionals=_tokens(row.professionals),
        cities=_tokens(row.cities),
        sex=_tokens(row.sex),
        keywords=_tokens(row.keywords),
        category_ids=_tokens(row.category_ids, int),
        target_page_flow=_tokens(row.target_page_flow, int),
    )
