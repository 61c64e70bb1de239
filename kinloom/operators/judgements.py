"""Journal rows for what people say about piles and faces."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FACE_ID
from ..sources.tables import FEEDBACK
from .journal import live

#: Kinds of judgement, and what each needs.
KINDS = {
    "PERSON_OK": "faces", "SAME_PERSON": "faces", "DIFFERENT_PEOPLE": "pair", "FACE_WRONG": "face", "NOT_A_FACE": "face", "NAME": "label", "NOTE": "text",
}


class BadJudgement(ValueError):
    pass


def judgement(kind: str, reviewer: str, faces: list[str] = (), subject: str | None = None, label: str | None = None, text: str | None = None, version: str | None = None, now: datetime | None = None) -> dict:
    """One journal row; BadJudgement if something needed is missing or malformed."""
    needs = KINDS.get(kind)
    if needs is None:
        raise BadJudgement(f"unknown kind {kind!r}")
    if not reviewer.strip():
        raise BadJudgement("a judgement needs a reviewer")
    faces = list(dict.fromkeys(faces))
    if bad := [f for f in [*faces, *([subject] if needs == "face" and subject else [])] if not re.match(FACE_ID, f)]:
        raise BadJudgement(f"not a face id: {bad[0]!r}")
    if needs == "faces" and len(faces) < (2 if kind == "SAME_PERSON" else 1) or needs == "pair" and len(faces) != 2:
        raise BadJudgement(f"{kind} needs {'two faces' if needs == 'pair' or kind == 'SAME_PERSON' else 'faces'}")
    if needs == "face" and not subject or needs == "label" and not (label or "").strip() or needs == "text" and not (text or "").strip():
        raise BadJudgement(f"{kind} needs a {needs}")
    return {
        "kind": kind, "reviewer": reviewer.strip(), "record_id": uuid.uuid4().hex, "ts": (now or datetime.now(timezone.utc)).isoformat(), "same_group": faces if needs == "faces" else [],
        "different_pairs": [sorted(faces)] if needs == "pair" else [], "excluded": [subject] if needs == "face" else [], "subject": subject, "person_label": label, "text": text, "retracted": False, "model_version": version,
    }


def retraction(record_id: str, reviewer: str) -> dict:
    """A row that takes a record back."""
    return dict.fromkeys((c.split()[0] for c in FEEDBACK.split(", ")), None) | {"kind": "RETRACT", "reviewer": reviewer, "record_id": uuid.uuid4().hex, "subject": record_id, "retracted": True, "same_group": [], "different_pairs": [], "excluded": []}


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in FEEDBACK.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FEEDBACK)


def face_wrong(journal: DataFrame, face: str, group_key: str, reviewer: str) -> list[dict]:
    """Rows to add when a face doesn't belong to a pile: the judgement, and if the pile was approved, that approval taken back and given again without the face."""
    rows = [judgement("FACE_WRONG", reviewer, subject=face)]
    for r in live(journal).where((F.col("kind") == "PERSON_OK") & (F.col("subject") == group_key)).collect():  # approvals of one pile
        rows.append(retraction(r["record_id"], reviewer))
        if rest := [f for f in r["same_group"] if f != face]:
            rows.append(judgement("SAME_PERSON" if len(rest) > 1 else "PERSON_OK", reviewer, faces=rest))
    return rows


def claims(journal: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of live rows: (a, b) neighbours in groups called the same, (a, b) pairs called different, (node) excluded faces."""
    rows = live(journal)
    same = rows.where(F.size("same_group") > 1).select(F.explode(F.arrays_zip(F.slice("same_group", F.lit(1), F.size("same_group") - 1).alias("a"), F.slice("same_group", F.lit(2), F.size("same_group") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    pairs = rows.select(F.explode("different_pairs").alias("p")).select(F.least(F.col("p")[0], F.col("p")[1]).alias("a"), F.greatest(F.col("p")[0], F.col("p")[1]).alias("b")).distinct()
    return same, pairs, rows.select(F.explode("excluded").alias("node")).distinct()
